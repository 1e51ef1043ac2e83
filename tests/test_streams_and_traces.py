"""Stateful stream operators, event logs and cleaned pages on small cases."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from harrow.operators import cleaning, dom, runs, steps, traces
from harrow.sources import html, logs
from harrow.streaming import tabs

START = datetime(2026, 1, 1, tzinfo=UTC)


@pytest.fixture
def stream(spark, tmp_path):
    """Rows (tab, milliseconds, ...) as a stream of two files; the second one ends all waits of tab 1 by its time."""

    def make(rows, schema, plan, batches=2):
        made = [(r[0], START + timedelta(milliseconds=r[1]), i, *r[2:]) for i, r in enumerate(rows)]
        whole = f"tab_id long, at timestamp, place long, {schema}"
        folder = str(tmp_path / "in")
        cut = len(made) // batches
        for k in range(batches):
            part = made[k * cut : (k + 1) * cut] if k < batches - 1 else made[k * cut :]
            spark.createDataFrame(part, whole).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
        return [tuple(r) for r in tabs.replay(spark, source, plan, "append", "t").collect()]

    return make


def test_frame_totals(stream):
    rows = [(1, 0, 0, '{"a": 2, "b": 1.9}', False), (1, 10, 1, '{"a": 4}', False), (1, 20, 1, '{"a": 4}', False), (1, 30, 0, '{"a": 0, "b": "x", "c": -1}', False), (2, 40, 0, None, False), (1, 50, 0, None, True), (2, 60, 5, '{"a": true}', False)]
    got = stream(rows, "frame_id int, counts string, load boolean", tabs.frame_totals)
    assert sorted((t, p, n) for t, p, _, n in got) == [(1, 0, 3), (1, 1, 7), (1, 3, 4), (1, 5, 0)]


def test_detections(stream):
    rows = [(1, 0, "found", "x", "p"), (1, 1, "found", "x", "p"), (1, 2, "found", "y", "q"), (1, 3, "off", "x", None), (1, 4, "off", "x", None), (1, 5, "found", "x", "r"), (1, 6, "load", None, None), (2, 7, "load", None, None)]
    got = stream(rows, "event string, kind string, payload string", tabs.detections)
    assert sorted((p, k, x or "") for _, k, x, p, _ in got) == [(0, "x", "p"), (2, "y", "q"), (3, "x", ""), (5, "x", "r"), (6, "x", ""), (6, "y", "")]


def test_segments(stream):
    rows = [(1, 0, "initial-load"), (1, 100, "modal-open"), (1, 1099, "modal-open"), (1, 1100, "modal-open"), (1, 1100, "mutation-burst"), (1, 1599, "mutation-burst"), (1, 1600, "route-change"), (1, 1601, "route-change")]
    got = stream(rows, "kind string", tabs.segments)
    assert sorted((n, k, p) for _, n, k, p in got) == [(1, "initial-load", 0), (2, "modal-open", 1), (3, "modal-open", 3), (4, "mutation-burst", 4), (5, "route-change", 6), (6, "route-change", 7)]


def test_settled(stream):
    quiet = [(1, 0, True), (1, 300, False), (1, 700, False), (1, 1300, False)]
    busy = [(2, 0, True), *[(2, 200 * k, False) for k in range(1, 20)]]
    got = stream([*quiet, *busy, (1, 9000, False), (2, 9000, False)], "start boolean", tabs.settled)
    base = int(START.timestamp() * 1000)
    assert sorted((t, a - base, b - base) for t, a, b in got) == [(1, 0, 1200), (2, 0, 3000)]


def test_flushes(stream):
    rows = [(1, 0, 5, "add"), (1, 100, 6, "add"), (1, 250, 1, "add"), (1, 300, 511, "add"), (1, 400, 3, "add"), (1, 450, 0, "route"), (1, 500, 9, "add"), (1, 600, 0, "hidden"), (1, 650, 7, "add"), (1, 700, 0, "shown"), (1, 800, 2, "add"), (1, 5000, 0, "shown")]
    got = stream(rows, "n int, event string", tabs.flushes)
    base = int(START.timestamp() * 1000)
    assert sorted((a - base, n, b) for _, a, n, b in got) == [(250, 11, False), (300, 512, True), (1050, 2, False)]


def test_pauses(stream):
    rows = [(1, 0, "look", None, None), (1, 1, "pause", "page", None), (1, 2, "look", None, None), (1, 3, "load", None, None), (1, 4, "look", None, None), (1, 5, "pause", "tab", 100), (1, 6, "load", None, None), (1, 104, "look", None, None), (1, 105, "look", None, None), (1, 110, "pause", "tab", None), (1, 120, "resume", None, None), (1, 130, "look", None, None)]
    got = stream(rows, "event string, scope string, ttl_ms long", tabs.pauses)
    assert [on for _, _, on in sorted(got)] == [False, True, False, True, False, False]


def test_tool_pairs(spark):
    call = lambda i, *why: {"role": "assistant", "content": [*[{"type": "reasoning", "text": w} for w in why], {"type": "tool-call", "tool_call_id": i, "tool_name": "act", "input": "{}"}]}
    said = lambda *ids: {"role": "tool", "content": [{"type": "tool-result", "tool_call_id": i, "output_type": "json", "output": f"r{i}"} for i in ids]}
    messages = [said("x"), call("a", " ", "why"), said("z"), said("a"), said("a"), call("b"), call("c"), said("b", "c"), {"role": "user", "content": None}, call("d")]
    actions = [{"type": "goto", "page_url": "https://a.example/x/", "timestamp_ms": None}, {"type": "act", "timestamp_ms": 50}, {"type": "act", "timestamp_ms": 80}]
    frame = spark.createDataFrame([(1, json.dumps(messages), json.dumps(actions)), (2, "[]", "[]"), (3, None, None)], "run long, m string, a string").select("run", F.from_json("m", traces.MESSAGES).alias("messages"), F.from_json("a", traces.ACTIONS).alias("actions"))
    got = traces.tool_pairs(frame).orderBy("place").collect()
    assert [(r.run, r.place, r.call_id, r.reasoning, r.result_text) for r in got] == [(1, 0, "a", "why", "ra"), (1, 1, "c", "", "rc")]
    made = traces.steps(frame).orderBy("place").collect()
    assert [(r.ms_since_start, r.result_kind, r.tool_name) for r in made] == [(0, "json", "act"), (0, "json", "act"), (30, "empty", "act")]
    starts = spark.createDataFrame([(1, "https://a.example/x"), (2, "https://a.example/")], "run long, start_url string")
    assert {r.run: r.direct for r in traces.direct_goto(traces.steps(frame), starts).collect()} == {1: False, 2: False}
    assert {r.run: r.direct for r in traces.direct_goto(traces.steps(frame), starts.withColumn("start_url", F.lit("https://a.example/y"))).collect()}[1]


def test_logs_in_order(spark, tmp_path):
    row = lambda n: json.dumps({"scenario_id": "s", "task_id": "t", "repetition": 1, "steps_taken": n})
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.jsonl").write_text("\n".join([row(1), "", "{bad", row(2)]) + "\n")
    (tmp_path / "r/b.jsonl").write_text(row(3) + "\n" * 2)
    good, bad = logs.results(spark, str(tmp_path / "r"))
    assert [r.steps_taken for r in good.orderBy("seq").collect()] == [1, 2, 3] and bad.count() == 1
    (tmp_path / "e").mkdir()
    (tmp_path / "e/s_1_t-2_r3.jsonl").write_text('{"type": "data", "payload": {}}\nnot json\n')
    events, bad = logs.event_log(spark, str(tmp_path / "e"))
    assert [(r.scenario_id, r.task_id, r.repetition, r.type) for r in events.collect()] == [("s_1", "t-2", 3, "data")] and bad.count() == 1
    (tmp_path / "p.jsonl").write_text('{"endpoint": "/v1/chat", "status": 200, "stream": true, "request": {"model": "m"}, "response_raw": "x"}\n{"unhandled": true, "path": "/y", "body": null}\n')
    assert sorted(tuple(r)[:4] for r in logs.proxy_log(spark, str(tmp_path / "p.jsonl")).collect()) == [("stream", "/v1/chat", "m", 200), ("unhandled", "/y", None, None)]
    for name, text in (("a.json", '[{"task_id": "1", "confirmed_task": "go"}, {"task_id": "2"}]'), ("a.jsonl", '{"task_id": "1", "confirmed_task": "go"}\n{"task_id": "2"}\n')):
        (tmp_path / name).write_text(text)
        good, bad = logs.external_tasks(spark, str(tmp_path / name))
        assert [(r.id, r.task) for r in good.collect()] == [("1", "go")] and [tuple(r) for r in bad.collect()] == [("2", "missing confirmed_task")]
    log = str(tmp_path / "log")
    logs.append_rows(spark.range(3), log)
    logs.append_rows(spark.range(3, 5), log)
    assert spark.read.json(log).count() == 5
    logs.replace_rows(spark.read.json(log).filter("id > 1"), log)
    assert sorted(r.id for r in spark.read.json(log).collect()) == [2, 3, 4]


PAGE = "<p>Call <b>415</b>-555-<i>2671</i> or 4111 1111 1111 1111 now</p><p>415-</p><p>555-2671</p><script>415-555-2671</script>"


def test_cleaned_pages(spark):
    nodes = html.nodes(spark.createDataFrame([(1, PAGE)], "page_id long, html string"))
    groups = dom.inline_groups(nodes)
    found = cleaning.detections(groups).cache()
    assert sorted((r.label, r.end - r.start) for r in found.collect()) == [("[card hidden]", 19), ("[phone hidden]", 12)]
    cleaned = {r.text for r in cleaning.clean(groups, found).collect()}
    assert cleaned == {"Call [phone hidden] or [card hidden] now", "415-", "555-2671"}
    texts = [r.text for r in cleaning.clean_nodes(nodes).orderBy("node_id").collect()]
    assert texts == ["Call ", "[phone hidden]", "", "", " or [card hidden] now", "415-", "555-2671"]
    back = cleaning.reveal(found, found.filter("label = '[phone hidden]'"))
    assert "Call 415-555-2671 or [card hidden] now" in {r.text for r in cleaning.clean(groups, back).collect()}
    none = cleaning.without_rule(found, "pii-redact")
    assert {r.text for r in cleaning.clean(groups, none).collect()} == {r.text for r in groups.collect()}
    # Cleaning what is clean changes nothing.
    again = groups.drop("text").withColumn("text", F.lit("Call [phone hidden] or [card hidden] now"))
    assert cleaning.detections(again).count() == 0


def test_parameters(spark):
    events = spark.createDataFrame([(i, 1, "click", 2.0) for i in range(9)], "event_id long, user_id long, event_type string, value double")
    assert steps.apply("trace_prune", events, keep=4).count() == 4 and steps.apply("trace_prune", events).count() == 9
    row = "scenario_id string, task_id string, repetition int, model string, steps int, input_tokens long, output_tokens long, cached_tokens long, duration_s double, passed boolean, completed boolean, blocked boolean, defense string, answer string, extractable boolean, error string, seq long"
    made = [("x", "t", 1, "m", 3, 10, 1, 0, 1.0, True, True, False, None, "a", True, None, 1), ("y", "t", 1, "m", 5, 30, 1, 0, 1.0, False, True, False, None, "b", True, None, 2)]
    prices = spark.createDataFrame([("m", 1e5, 0.0)], "model string, input_per_mtok double, output_per_mtok double")
    given = {"runs": spark.createDataFrame(made, row), "pricing": prices}
    got = runs.apply("ab_compare", {"a": "x", "b": "y"}, **given).first()
    assert (got.tokens_a, got.tokens_b, got.cost_a, got.cost_b, got.steps_b) == (11, 31, 1.0, 3.0, 5)
    assert runs.apply("passing_cost", **given).first().avg_cost == 1.0
    assert runs.apply("guarded_severity", {"guarded": ("y",)}, **given).first().cost_ratio == 3.0
    assert runs.apply("retention_keep", {"keep": 0, "always": ("t",)}, **given).filter("keep").count() == 2
