"""Stateful streams as registers: for each key of a tab the value of the latest stamp counts.

A stamp is (time, place). State is kept by key in maps (``MapState``) of which a batch reads and writes only the keys that its
rows name, so a tab with many rows costs a chunk of rows at a time and never all of them. A row whose stamp lies before
what is known changes nothing, so rows may come late or in any order, in any number of micro-batches, and a batch may be
repeated: what stands after all rows is the same. A load clears what lies before it, by its stamp alone.

Needs the state store of RocksDB (``use_store``). ``ttl_ms`` drops the state of a key that long after its last change by
the cluster's clock; null keeps it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STAMP = "at long, place long"
NEVER = (-(2**62), -(2**62))


def use_store(spark: SparkSession) -> None:
    """The state store that maps and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _ms(times: pd.Series) -> list[int]:
    micros = pd.to_datetime(times, utc=True).dt.tz_localize(None).to_numpy("datetime64[us]").astype("int64")
    return ((micros + 500) // 1000).tolist()


def _latest(frame: pd.DataFrame, key: str, loads: pd.Series) -> tuple[tuple | None, pd.DataFrame]:
    """The stamp of the latest load of a chunk and, of its other rows, the latest of each key, the first of equal ones: no other row
    can change what stands, so the state is asked once for each key of a chunk."""
    f = frame.assign(_at=_ms(frame["at"])).sort_values(["_at", "place"], ascending=False, kind="stable")
    loads = loads.reindex(f.index)
    ended = f[loads]
    stamp = (int(ended["_at"].iloc[0]), int(ended["place"].iloc[0])) if len(ended) else None
    return stamp, f[~loads].drop_duplicates(key)


class _Registers(StatefulProcessor):
    """State of a tab: when it was loaded last, and what each key (a frame, a kind) was set to when."""

    key, value = "frame string", "value string"

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.loaded = handle.getValueState("loaded", STAMP, self.ttl_ms)
        self.held = handle.getMapState("held", self.key, f"{STAMP}, {self.value}", self.ttl_ms)

    def set_(self, key, stamp: tuple, value) -> bool:
        """Whether ``value`` became what stands for ``key``."""
        known = self.held.getValue((key,)) if self.held.containsKey((key,)) else None
        if stamp <= self.load() or (known and stamp <= known[:2]):
            return False
        self.held.updateValue((key,), (*stamp, value))
        return True

    def load(self) -> tuple:
        return tuple(self.loaded.get()) if self.loaded.exists() else NEVER

    def load_at(self, stamp: tuple) -> list:
        """The keys that a load ends, which are forgotten."""
        if stamp <= self.load():
            return []
        self.loaded.update(stamp)
        ended = [(k[0], v[2]) for k, v in list(self.held.iterator()) if tuple(v[:2]) <= stamp]
        for k, _ in ended:
            self.held.removeKey((k,))
        return ended

    def close(self) -> None:
        pass


class _Totals(_Registers):
    value = "total long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.told = handle.getValueState("told", "total long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            loaded, last = _latest(frame, "frame_id", frame["load"].map(bool))
            if loaded:
                self.load_at(loaded)
            for at, place, id_, counts in zip(last["_at"], last["place"], last["frame_id"], last["counts"], strict=True):
                said = json.loads(counts or "{}").values()
                self.set_(str(id_), (int(at), int(place)), sum(int(v) for v in said if isinstance(v, (int, float)) and not isinstance(v, bool) and 0 < v < math.inf))
        total = sum(v[2] for v in list(self.held.values()))
        before = self.told.get()[0] if self.told.exists() else 0
        if total != before:
            self.told.update((total,))
            yield pd.DataFrame({"tab_id": [key[0]], "total": [total]})


class _Standing(_Registers):
    key, value = "kind string", "payload string"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        changed: dict[str, str | None] = {}
        for frame in rows:
            loaded, last = _latest(frame, "kind", frame["event"] == "load")
            if loaded:
                changed |= dict.fromkeys((k for k, _ in self.load_at(loaded)), None)
            for at, place, event, kind, payload in zip(last["_at"], last["place"], last["event"], last["kind"], last["payload"], strict=True):
                if self.set_(kind, (int(at), int(place)), payload if event == "found" else None):
                    changed[kind] = payload if event == "found" else None
        if changed:
            yield pd.DataFrame({"tab_id": key[0], "kind": list(changed), "payload": list(changed.values())})


class _Pauses(StatefulProcessor):
    """A pause of a tab: what was said last, and a timer for its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"{STAMP}, event string, scope string, until long")
        self.told = handle.getValueState("told", "paused boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.last.get() if self.last.exists() else None
        for frame in rows:
            some = sorted(zip(_ms(frame["at"]), frame["place"], frame["event"], frame["scope"], frame["ttl_ms"], strict=True), key=lambda r: r[:2])
            for at, place, event, scope, ttl in some:
                stamp = (at, int(place))
                if known and stamp <= tuple(known[:2]):
                    continue
                if event == "load" and known and known[2] == "pause" and known[3] != "page":
                    continue  # a pause of the tab outlives a load
                until = None if event != "pause" or ttl is None or ttl != ttl else at + int(ttl)
                known = (*stamp, event, scope, until)
        if known is None:
            return
        self.last.update(known)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        now, until = timerValues.getCurrentWatermarkInMs(), known[4]
        on = known[2] == "pause" and (until is None or until > now)
        if on and until is not None:
            self.handle.registerTimer(until)
        yield from self._tell(key, on, known[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._tell(key, False, expiredTimerInfo.getExpiryTimeInMs())

    def _tell(self, key, on: bool, at: int) -> Iterator[pd.DataFrame]:
        if on != (self.told.get()[0] if self.told.exists() else False):
            self.told.update((on,))
            yield pd.DataFrame({"tab_id": [key[0]], "paused": [on], "at_ms": [at]})

    def close(self) -> None:
        pass


class _Runs(StatefulProcessor):
    """What the cumulative events of a run leave: the longest lists, the last answer, whether it was completed."""

    fields = "actions string, n_actions int, actions_seq long, messages string, n_messages int, messages_seq long, answer string, answer_seq long, completed boolean, success boolean, success_seq long, seq long"

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", self.fields, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = list(self.state.get()) if self.state.exists() else [None, -1, -1, None, -1, -1, None, -1, False, None, -1, -1]
        before = list(s)
        for frame in rows:
            for row in frame.itertuples(index=False):
                seq = int(row.seq)
                for at, said in ((0, row.actions), (3, row.messages)):
                    n = len(json.loads(said)) if said else -1
                    if n >= 0 and (n, seq) > (s[at + 1], s[at + 2]):
                        s[at : at + 3] = [said, n, seq]
                if row.message and row.message.strip() and seq > s[7]:
                    s[6:8] = [row.message, seq]
                if row.success is not None and row.success == row.success and seq > s[10]:
                    s[9:11] = [bool(row.success), seq]
                s[8] = s[8] or bool(row.completed is not None and row.completed == row.completed and row.completed)
                s[11] = max(s[11], seq)
        if s != before:
            self.state.update(tuple(s))
            yield pd.DataFrame({"run": [key[0]], "actions": [s[0]], "messages": [s[3]], "answer": [s[6]], "completed": [s[8]], "success": [s[9]], "seq": [s[11]]})

    def close(self) -> None:
        pass


def _run(rows: DataFrame, key: str, processor: StatefulProcessor, out: str, time_mode: str | None = None) -> DataFrame:
    """Without a time to live no batch is run for the clock alone, so a stream over what is there ends."""
    use_store(rows.sparkSession)
    mode = time_mode or ("ProcessingTime" if getattr(processor, "ttl_ms", None) else "None")
    return rows.groupBy(key).transformWithStateInPandas(processor, out, "Update", mode)


def totals(messages: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """tab_id and total of each tab whose total a batch has changed. Messages: tab_id, at, place, frame_id, counts (JSON by
    rule), load. A frame's counts replace its earlier ones, and a load forgets all frames."""
    return _run(messages, "tab_id", _Totals(ttl_ms), "tab_id long, total long")


def standing(messages: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """tab_id, kind and payload of each kind that a batch has changed; null where it ended. Messages: tab_id, at, place, event
    (``found`` sets a kind, ``off`` ends it, ``load`` ends all of the tab), kind, payload."""
    return _run(messages, "tab_id", _Standing(ttl_ms), "tab_id long, kind string, payload string")


def pauses(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """tab_id, paused and at_ms whenever a tab's pause begins or ends. Events: tab_id, at, place, event (``pause``, ``resume``,
    ``load``), scope (page or tab), ttl_ms. One that runs out is told when the watermark passes its end, by a timer."""
    return _run(events.withWatermark("at", watermark), "tab_id", _Pauses(), "tab_id long, paused boolean, at_ms long", "EventTime")


def latest_runs(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """run, actions, messages, answer, completed, success and seq of each run that a batch has changed. Events: run, seq, type,
    actions and messages (JSON lists so far, or null), message, completed, success; those of type "data" count."""
    some = events.filter("type = 'data'").select("run", "seq", "actions", "messages", "message", "completed", "success")
    return _run(some, "run", _Runs(ttl_ms), "run long, actions string, messages string, answer string, completed boolean, success boolean, seq long")
