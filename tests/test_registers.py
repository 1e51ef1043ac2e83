"""Streams as registers: what stands is the same in any order, in any number of micro-batches."""

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from harrow.operators import traces
from harrow.streaming import registers, tabs

START = datetime(2026, 1, 1, tzinfo=UTC)


@pytest.fixture
def told(spark, tmp_path):
    """All rows that a plan returns over ``rows`` (tab, milliseconds, place, ...), dealt to ``batches`` files in the given order, each with its batch."""

    def make(rows, schema, plan, batches, key="tab_id"):
        folder, store, root = (str(tmp_path / f"{len(list(tmp_path.iterdir()))}-{n}") for n in ("in", "out", "state"))
        whole = f"{key} long, at timestamp, place long, {schema}"
        made = [(r[0], START + timedelta(milliseconds=r[1]), *r[2:]) for r in rows]
        for k in range(batches):
            spark.createDataFrame(made[k::batches] if batches > 1 else made, whole).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(whole).option("maxFilesPerTrigger", 1).parquet(folder)
        got = []

        def keep(batch, number):
            got.extend((number, *r) for r in batch.collect())

        registers.use_store(spark)
        query = plan(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", root).trigger(availableNow=True).start()
        query.awaitTermination()
        return got

    return make


def last(rows, n_key):
    """What the last batch says of each key."""
    out = {}
    for _, *r in sorted(rows, key=lambda r: r[0]):
        out[tuple(r[:n_key])] = r[n_key]
    return out


def test_totals_in_any_order(told):
    rng, rows, want = random.Random(31), [], {}
    for place in range(120):
        rows.append((rng.randrange(3), rng.randrange(1000), place, str(rng.randrange(4)), json.dumps({"a": rng.randrange(4), "b": rng.choice([1.9, -1, "x", True])}), rng.random() < 0.05))
    for tab in range(3):
        frames = {}
        for _, _, _, frame, counts, load in sorted((r for r in rows if r[0] == tab), key=lambda r: r[1:3]):
            if load:
                frames.clear()
            else:
                frames[frame] = sum(int(v) for v in json.loads(counts).values() if type(v) in (int, float) and v > 0)
        want[tab,] = sum(frames.values())
    for batches in (1, 3):
        rng.shuffle(rows)
        got = last(told(rows, "frame_id string, counts string, load boolean", registers.totals, batches), 1)
        assert {k: got.get(k, 0) for k in want} == want


def test_standing_in_any_order(told):
    rng, rows, want = random.Random(32), [], {}
    for place in range(150):
        event = rng.choice(["found"] * 6 + ["off", "load"])
        rows.append((rng.randrange(3), rng.randrange(300), place, event, rng.choice("xyz"), str(place)))
    for tab in range(3):
        held = {}
        for _, _, _, event, kind, payload in sorted((r for r in rows if r[0] == tab), key=lambda r: r[1:3]):
            if event == "load":
                held.clear()
            elif event == "off":
                held.pop(kind, None)
            else:
                held[kind] = payload
        want |= {(tab, k): v for k, v in held.items()}
    for batches in (1, 4):
        rng.shuffle(rows)
        got = last(told(rows, "event string, kind string, payload string", registers.standing, batches), 2)
        assert {k: v for k, v in got.items() if v is not None} == want


def test_pauses_end_by_a_timer(told):
    rows = [(1, 0, 0, "pause", "tab", 5_000), (1, 10, 1, "load", None, None), (2, 0, 2, "pause", "page", None), (2, 20, 3, "load", None, None), (3, 0, 4, "pause", "tab", None), (3, 5, 5, "resume", None, None), (4, 0, 6, "pause", "tab", None)]
    later = [(9, 3_600_000, 7, "resume", None, None), (9, 7_200_000, 8, "resume", None, None)]
    # In two batches the watermark passes the end of the first tab's pause.
    got = told([x for a, b in zip(rows, [*later, *later, *later, *later], strict=False) for x in (a, b)], "event string, scope string, ttl_ms long", lambda s: registers.pauses(s, "1 second"), 2)
    ends = [(r[3], r[2]) for r in got if r[1] == 1]
    assert (int(START.timestamp() * 1000) + 5_000, False) in ends and last(got, 1)[4,]


def test_runs_in_any_order_equal_the_batch(spark, told):
    rng, rows, seq = random.Random(33), [], 0
    for run in range(4):
        for _ in range(rng.randint(1, 12)):
            seq += 1
            lists = lambda kind: rng.choice([None, json.dumps([{"type": f"{kind}{rng.randrange(3)}", "role": "user"}] * rng.randrange(4))])
            rows.append((run, seq, seq, seq, rng.choice(["data", "data", "data", "log"]), lists("a"), lists("m"), rng.choice([None, " ", f"said {seq}"]), rng.choice([None, False, True]), rng.choice([None, True, False])))
    schema = "seq long, type string, actions string, messages string, message string, completed boolean, success boolean"
    frame = spark.createDataFrame([(r[0], *r[3:]) for r in rows], f"run long, {schema}")
    typed = frame.withColumns({"actions": F.from_json("actions", traces.ACTIONS), "messages": F.from_json("messages", traces.MESSAGES)})
    want = {r.run: (r.actions and len(r.actions), r.messages and len(r.messages), r.answer, r.completed, r.success, r.seq) for r in traces.latest_state(typed).collect()}
    for batches in (1, 3):
        rng.shuffle(rows)
        got = {}
        for _, run, actions, messages, answer, completed, success, at in sorted(told(rows, schema, registers.latest_runs, batches, "run"), key=lambda r: r[0]):
            got[run] = (None if actions is None else len(json.loads(actions)) or [], None if messages is None else len(json.loads(messages)) or [], answer, completed, success, at)
        assert {k: tuple(x or None for x in v[:2]) + v[2:] for k, v in got.items()} == {k: tuple(x or None for x in v[:2]) + v[2:] for k, v in want.items()}


def test_store_is_that_of_maps(spark):
    registers.use_store(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == registers.STORE and tabs.WATERMARK
