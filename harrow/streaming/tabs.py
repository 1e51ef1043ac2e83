"""Streams over page events: counts for each tab and rule, detections by kind, segments and settling.

Each function takes a streaming (or batch) DataFrame of trace events and returns a DataFrame; ``replay`` runs one over
the files that are there and returns what a batch over all of them would. State is dropped when the watermark, a
parameter, passes: windows and sessions by themselves, that of a tab TTL_MS after its last event.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from harrow.session import shared_path

WATERMARK = "365 days"
STATE_MS, TTL_MS = 3_600_000, 7 * 24 * 3_600_000
#: Pauses between looks and their caps in milliseconds, and the additions that are flushed at once: fixed values.
THROTTLE = {"modal-open": 1000, "mutation-burst": 500}
QUIET_MS, SETTLE_MS, FLUSH_MS, FLUSH_AT = 500, 3000, 250, 512


def trace(events: DataFrame) -> DataFrame:
    """Trace entries projected from events: tab, frame, rule, type, at."""
    kind = F.when(F.col("event_type") == "error", "segment").when(F.col("event_type") == "view", "navigation").otherwise("rule-application")
    return events.select((F.col("user_id") % 20).alias("tab_id"), (F.col("event_id") % 3).alias("frame_id"), F.concat(F.lit("rule-"), (F.col("event_id") % 6).cast("string")).alias("rule_id"), kind.alias("type"), "event_id", F.col("ts").cast("timestamp").alias("at"))


def valid(messages: DataFrame, schema: str) -> DataFrame:
    """Messages (JSON in ``body``) that fit the schema; others are left out."""
    return messages.select(F.from_json("body", schema).alias("m")).filter(F.col("m").isNotNull()).select("m.*")


def rule_counts(t: DataFrame) -> DataFrame:
    """Rule applications of each tab and rule over all frames."""
    return t.filter("type = 'rule-application'").groupBy("tab_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


def latest_by_kind(t: DataFrame) -> DataFrame:
    """The last entry of each tab and kind: later ones replace it."""
    return t.groupBy("tab_id", "type").agg(F.max_by("rule_id", F.struct("at", "event_id")).alias("rule_id"), F.max("at").alias("at"))


def bursts(t: DataFrame, gap: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Sessions of a tab that end when it is quiet for ``gap``."""
    return t.withWatermark("at", watermark).groupBy("tab_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("tab_id", F.col("w.start").alias("started"), F.col("w.end").alias("settled"), "n")


def windows(t: DataFrame, width: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    """Entries of each type by tumbling window."""
    return t.withWatermark("at", watermark).groupBy(F.window("at", width).alias("w"), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("started"), "type", "n")


def falling(snapshots: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """(key, seconds) of timers that went down since the last look, by a state for each timer.

    Of (key, seconds, at, place): rows of one key in a batch are taken in the order of at and place; a timer is told
    once. Its state goes when the watermark passes STATE_MS after the last look.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, told = state.get if state.exists else (None, False)
        rows = pd.concat(frames).sort_values(["at", "place"])
        for seconds in rows["seconds"].tolist():
            if last is not None and seconds < last and not told:
                told = True
                yield pd.DataFrame({"key": [key[0]], "seconds": [int(seconds)]})
            last = int(seconds)
        state.update((last, told))
        state.setTimeoutTimestamp(max(int(rows["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + STATE_MS)

    return snapshots.withWatermark("at", watermark).groupBy("key").applyInPandasWithState(step, "key long, seconds int", "last int, told boolean", "append", GroupStateTimeout.EventTimeTimeout)


def stepped(rows: DataFrame, key: str, out: str, step: Callable[[dict, dict], list[tuple]], end: Callable[[dict], list[tuple]] | None = None, watermark: str = WATERMARK, ttl_ms: int = TTL_MS) -> DataFrame:
    """A stateful operator: ``step(state, row)`` for every row of a key by (at, place) gives output rows and changes the state, a JSON object.

    Rows have key, at (timestamp), place (a number that orders equal times) and others; ``row["ms"]`` is at in milliseconds.
    ``ttl_ms`` after a key's last row its state ends, with the rows that ``end(state)`` gives.
    """
    names = [f.split()[0] for f in out.split(", ")]

    def run(id_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        if state.hasTimedOut:
            state.remove()
            made = end(held) if end else []
        else:
            frame = pd.concat(frames).sort_values(["at", "place"])
            frame["ms"] = frame["at"].map(lambda t: int(t.timestamp() * 1000 + 0.5))
            made = [x for row in frame.to_dict("records") for x in step(held, row)]
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(int(frame["ms"].max()), state.getCurrentWatermarkMs()) + ttl_ms)
        yield pd.DataFrame([(id_[0], *x) for x in made], columns=names)

    return rows.withWatermark("at", watermark).groupBy(key).applyInPandasWithState(run, out, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def frame_totals(messages: DataFrame, **more) -> DataFrame:
    """tab_id, place, ms and total whenever a tab's total changes. Messages: tab_id, at, place, frame_id, counts (JSON by rule), load.

    A frame's counts replace its earlier ones, none above zero forget the frame, and a load forgets all frames.
    """

    def step(state: dict, row: dict) -> list[tuple]:
        frames = state.setdefault("frames", {})
        if row["load"]:
            frames.clear()
        else:
            counts = {k: int(v) for k, v in json.loads(row["counts"] or "{}").items() if isinstance(v, (int, float)) and not isinstance(v, bool) and 0 < v < math.inf}
            if counts:
                frames[str(row["frame_id"])] = counts
            else:
                frames.pop(str(row["frame_id"]), None)
        total = sum(sum(c.values()) for c in frames.values())
        changed = total != state.get("total", 0)
        state["total"] = total
        return [(row["place"], row["ms"], total)] if changed else []

    return stepped(messages, "tab_id", "tab_id long, place long, ms long, total long", step, **more)


def detections(messages: DataFrame, **more) -> DataFrame:
    """tab_id, kind, payload, place and ms: a kind's new payload, or null when it ends. Messages: tab_id, at, place, event, kind, payload.

    ``found`` sets a kind (the last wins), ``off`` ends one kind and ``load`` all kinds of the tab.
    """

    def step(state: dict, row: dict) -> list[tuple]:
        if row["event"] == "found":
            changed = state.get(row["kind"]) != row["payload"]
            state[row["kind"]] = row["payload"]
            return [(row["kind"], row["payload"], row["place"], row["ms"])] if changed else []
        ended = sorted(state) if row["event"] == "load" else [row["kind"]] if row["kind"] in state else []
        for kind in ended:
            del state[kind]
        return [(kind, None, row["place"], row["ms"]) for kind in ended]

    return stepped(messages, "tab_id", "tab_id long, kind string, payload string, place long, ms long", step, **more)


def segments(markers: DataFrame, widths: dict[str, int] | None = None, **more) -> DataFrame:
    """tab_id, segment, kind and place of the markers that start a segment: of a throttled kind, the first and then none for its width.

    Markers: tab_id, at, place, kind.
    """
    widths = THROTTLE if widths is None else widths

    def step(state: dict, row: dict) -> list[tuple]:
        last = state.get(row["kind"])
        if row["kind"] in widths and last is not None and row["ms"] - last < widths[row["kind"]]:
            return []
        state[row["kind"]] = row["ms"]
        state["n"] = state.get("n", 0) + 1
        return [(state["n"], row["kind"], row["place"])]

    return stepped(markers, "tab_id", "tab_id long, segment long, kind string, place long", step, **more)


def settled(changes: DataFrame, quiet_ms: int = QUIET_MS, cap_ms: int = SETTLE_MS, **more) -> DataFrame:
    """tab_id, started_ms and settled_ms of each wait: it ends when nothing changed for ``quiet_ms``, or after ``cap_ms``.

    Changes: tab_id, at, place, start (true where a wait begins; one that is under way goes on). A wait that no later row
    ends is told when the state ends.
    """

    def done(state: dict, now: int | None) -> list[tuple]:
        if "start" not in state:
            return []
        finish = min(state["last"] + quiet_ms, state["start"] + cap_ms)
        if now is not None and now < finish:
            return []
        out = [(state.pop("start"), finish)]
        state.pop("last")
        return out

    def step(state: dict, row: dict) -> list[tuple]:
        out = done(state, row["ms"])
        if row["start"] and "start" not in state:
            state["start"] = state["last"] = row["ms"]
        elif "start" in state:
            state["last"] = row["ms"]
        return out

    return stepped(changes, "tab_id", "tab_id long, started_ms long, settled_ms long", step, lambda state: done(state, None), **more)


def flushes(additions: DataFrame, wait_ms: int = FLUSH_MS, most: int = FLUSH_AT, **more) -> DataFrame:
    """tab_id, flushed_ms, n and burst: additions gathered for ``wait_ms`` from the first, or until there are ``most``.

    Additions: tab_id, at, place, n, event: ``add``, ``route`` (what waits is dropped, a full sweep follows), ``hidden`` (what
    is added until ``shown`` is never seen).
    """

    def step(state: dict, row: dict) -> list[tuple]:
        out = []
        if "first" in state and row["ms"] >= state["first"] + wait_ms:
            out.append((state.pop("first") + wait_ms, state.pop("n"), False))
        if row["event"] in ("route", "hidden"):
            state.pop("first", None)
            state.pop("n", None)
        if row["event"] in ("hidden", "shown"):
            state["hidden"] = row["event"] == "hidden"
        elif row["event"] == "add" and not state.get("hidden"):
            state.setdefault("first", row["ms"])
            state["n"] = state.get("n", 0) + int(row["n"])
            if state["n"] >= most:
                state.pop("first")
                out.append((row["ms"], state.pop("n"), True))
        return out

    def end(state: dict) -> list[tuple]:
        return [(state["first"] + wait_ms, state["n"], False)] if "first" in state else []

    return stepped(additions, "tab_id", "tab_id long, flushed_ms long, n long, burst boolean", step, end, **more)


def pauses(events: DataFrame, **more) -> DataFrame:
    """tab_id, place and paused of every look: whether a pause is active. Events: tab_id, at, place, event, scope, ttl_ms.

    ``pause`` sets one (scope page or tab, ttl_ms null for no end), ``resume`` ends it, ``load`` ends one of scope page, ``look`` asks.
    """

    def step(state: dict, row: dict) -> list[tuple]:
        if row["event"] == "pause":
            ttl = row["ttl_ms"]
            state["pause"] = [row["scope"], None if ttl is None or ttl != ttl else row["ms"] + int(ttl)]
        elif row["event"] == "resume" or (row["event"] == "load" and state.get("pause", [""])[0] == "page"):
            state.pop("pause", None)
        elif row["event"] == "look":
            held = state.get("pause")
            return [(row["place"], held is not None and (held[1] is None or held[1] > row["ms"]))]
        return []

    return stepped(events, "tab_id", "tab_id long, place long, paused boolean", step, **more)


def replay(spark: SparkSession, source: DataFrame, plan: Callable[[DataFrame], DataFrame], mode: str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream over what its source holds and return its rows.

    Each batch is written to the shared folder under its number, so one that is repeated replaces itself. In update mode
    the last row of ``keys`` counts, in complete mode the last batch.
    """
    root = shared_path(spark, name)
    rows, done = plan(source), []

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/rows/{number}")
        done.append(number)

    query = rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], rows.schema)
    parts = [f"{root}/rows/{n}" for n in (done[-1:] if mode == "complete" else done)]
    made = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(*parts)
    if mode == "update":
        made = made.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_batch")))).filter("_n = 1").drop("_n")
    return made.drop("_batch")


def prune(store: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` entries of each tab."""
    w = Window.partitionBy("tab_id").orderBy(F.col("event_id").desc())
    return store.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")
