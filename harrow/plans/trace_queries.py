"""Queries over agent event logs and traces, which are projected from the events table.

The check SQL states the same facts another way: no nesting, and interval joins or correlated subqueries for windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import records
from harrow.operators import traces

#: Messages of a run: every RUN events make one run, each event a message.
RUN = 12


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.floor(F.col("event_id") / RUN).alias("run"), (F.col("event_id") % RUN).cast("int").alias("at"), "event_id", "event_type", "value", "user_id")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each run: its events as messages (calls, results, errors) and actions."""
    none = F.lit(None).cast("string")
    call = F.concat(F.lit("c"), F.floor(F.col("at") / 2).cast("string"))
    part = lambda kind, text=none, id_=none, name=none, out=none: F.struct(F.lit(kind).alias("type"), text.alias("text"), id_.alias("tool_call_id"), name.alias("tool_name"), none.alias("input"), F.when(out.isNotNull(), "content").alias("output_type"), out.alias("output"))
    asks = F.array(part("reasoning", F.concat(F.lit("why "), F.col("at").cast("string"))), part("tool-call", id_=call, name=F.when(F.col("event_id") % 5 == 0, "ariaTree").otherwise(F.col("event_type"))))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Accessibility Tree: "), F.col("event_type"))).when(F.col("event_id") % 3 == 1, "").otherwise("short")
    says = F.array(part("tool-result", id_=F.when(F.col("event_type") == "error", "lost").otherwise(call), out=text))
    message = F.struct(F.when(F.col("at") % 2 == 0, "assistant").otherwise("tool").alias("role"), F.when(F.col("at") % 2 == 0, asks).otherwise(says).alias("content"))
    action = F.struct(F.when(F.col("at") < 2, "screenshot").when(F.col("event_id") % 2 == 0, "goto").otherwise("act").alias("type"), none.alias("instruction"), none.alias("reasoning"), F.concat(F.lit("https://a.example/p"), (F.col("event_id") % 4).cast("string"), F.lit("/")).alias("page_url"), F.when(F.col("at") > 0, F.col("event_id") * 10).alias("timestamp_ms"))
    e = _events(spark, sf_dir)
    # A run is a document of RUN rows at most.
    got = e.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("at", message.alias("m"), action.alias("a")))).alias("x"))
    return got.select("run", F.transform("x", lambda r: r["m"]).cast(traces.MESSAGES).alias("messages"), F.transform("x", lambda r: r["a"]).cast(traces.ACTIONS).alias("actions"))


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    grown = lambda kind: F.when(F.col("event_id") % 7 != 0, F.sequence(F.lit(0), F.col("event_id") % 4).cast("array<string>")).cast(kind)
    log = e.select(
        "run", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "log").otherwise("data").alias("type"), grown("array<string>").alias("actions"), grown("array<string>").alias("messages"),
        F.when(F.col("event_id") % 3 == 0, " ").when(F.col("event_id") % 3 == 1, F.concat(F.lit("answer "), F.col("event_id").cast("string"))).alias("message"), (F.col("event_id") % 50 == 0).alias("completed"), F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 8 == 0).alias("success"),
    )
    return traces.latest_state(log).select("run", F.coalesce(F.size("actions"), F.lit(-1)).cast("long").alias("n_actions"), "answer", "completed", "success", "seq")


def tool_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.tool_pairs(states(spark, sf_dir)).select("run", F.col("place").cast("long").alias("place"), "call_id", "tool_name", "reasoning", "result_text")


def agent_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.steps(states(spark, sf_dir)).select("run", F.col("place").cast("long").alias("place"), "type", "tool_name", "result_kind", "ms_since_start", F.col("result_len").cast("long").alias("result_len"))


def direct_goto(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = traces.steps(states(spark, sf_dir))
    starts = _events(spark, sf_dir).select("run").distinct().withColumn("start_url", F.lit("https://a.example/p2"))
    return traces.direct_goto(s, starts)


def step_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = traces.steps(states(spark, sf_dir)).withColumns({"pair": F.floor(F.col("run") / 2), "side": F.col("run") % 2})
    made = traces.nth_step_join(s, ["pair"], "side", 0, 1)
    return made.select("pair", "type", "result_kind", *[F.col(c).cast("long").alias(c) for c in ("nth", "place_a", "place_b")], "same")


def token_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    i, o = (F.floor(F.col("value") * k).cast("long") for k in (10, 3))
    openai = F.to_json(F.struct(F.struct(i.alias("prompt_tokens"), o.alias("completion_tokens"), F.struct((F.col("event_id") % 9).alias("cached_tokens")).alias("prompt_tokens_details")).alias("usage")))
    other = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(i.alias("inputTokens"), o.alias("outputTokens")).alias("tokenUsage"))).alias("steps")).alias("payload")))
    body = F.when(F.col("event_id") % 3 == 0, openai).when(F.col("event_id") % 3 == 1, other).otherwise('{"note": 1}')
    return traces.token_backfill(e.select((F.col("user_id") % 500).alias("run"), records.usage(body).alias("u")).select("run", "u.*")).select("run", "input", "output", "total", "cached")


def trace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    entry = F.struct(F.when(F.col("event_type") == "error", "segment").otherwise("rule-application").alias("type"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("rule"))
    return traces.trace_stats(e.select((F.col("user_id") % 50).alias("tab_id"), entry.alias("entry")))


def seq_since_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent_steps(spark, sf_dir).select("run", "place", "ms_since_start")


QUERIES = {f.__name__: f for f in (agent_steps, seq_since_start, direct_goto, step_pairing, token_backfill, trace_stats)} | {"latest_state": run_states, "tool_call_join": tool_pairs}

_M = f"""e AS (SELECT event_id // {RUN} AS run, event_id % {RUN} AS pos, * FROM events),
calls AS (SELECT run, pos, event_id, CASE WHEN event_id % 5 = 0 THEN 'ariaTree' ELSE event_type END AS tool_name, (SELECT min(n.pos) FROM e n WHERE n.run = e.run AND n.pos > e.pos AND n.pos % 2 = 0) AS until FROM e WHERE pos % 2 = 0),
results AS (SELECT run, pos, CASE event_id % 3 WHEN 0 THEN 'Accessibility Tree: ' || event_type WHEN 1 THEN '' ELSE 'short' END AS result_text FROM e WHERE pos % 2 = 1 AND event_type <> 'error'),
pairs AS (SELECT c.run, c.pos, 'c' || (c.pos // 2) AS call_id, tool_name, 'why ' || c.pos AS reasoning, result_text FROM calls c JOIN results r ON r.run = c.run AND r.pos > c.pos AND r.pos < coalesce(until, 1000) AND r.pos // 2 = c.pos // 2),
placed AS (SELECT *, (SELECT count(*) FROM pairs q WHERE q.run = p.run AND q.pos < p.pos) AS place FROM pairs p),
steps AS (SELECT e.run, e.pos AS place, CASE WHEN e.pos < 2 THEN 'screenshot' WHEN e.event_id % 2 = 0 THEN 'goto' ELSE 'act' END AS type, e.event_id % 4 AS page, coalesce(p.tool_name, CASE WHEN e.pos < 2 THEN 'screenshot' WHEN e.event_id % 2 = 0 THEN 'goto' ELSE 'act' END) AS tool_name,
    coalesce(p.result_text, '') AS t, p.run IS NOT NULL AS answered, CASE WHEN e.pos = 0 THEN 0 ELSE 10 * (e.event_id - (SELECT min(f.event_id) FROM e f WHERE f.run = e.run AND f.pos > 0)) END AS ms_since_start
    FROM (SELECT run, row_number() OVER (PARTITION BY run ORDER BY pos) - 1 AS pos, pos AS old_pos, event_id FROM e) e LEFT JOIN placed p ON p.run = e.run AND p.place = e.pos),
kinds AS (SELECT *, CASE WHEN tool_name = 'ariaTree' THEN CASE WHEN t LIKE 'Accessibility Tree:%' THEN 'aria_tree' WHEN trim(t) <> '' THEN 'aria_tree_placeholder' ELSE 'empty' END WHEN answered THEN 'text' ELSE 'empty' END AS result_kind FROM steps)"""
ORACLES = {
    "latest_state": f"""WITH d AS (SELECT event_id // {RUN} AS run, event_id AS seq, CASE WHEN event_id % 7 <> 0 THEN event_id % 4 + 1 END AS n FROM events WHERE event_type <> 'error')
SELECT run, coalesce(max(n), -1) AS n_actions, (SELECT 'answer ' || max(x.seq) FROM d x WHERE x.run = d.run AND x.seq % 3 = 1) AS answer, count(*) FILTER (WHERE seq % 50 = 0) > 0 AS completed,
    (SELECT max(x.seq) FROM d x WHERE x.run = d.run AND x.seq % 4 = 0) % 8 = 0 AS success, max(seq) AS seq FROM d GROUP BY run""",
    "tool_call_join": f"WITH {_M} SELECT run, place, call_id, tool_name, reasoning, result_text FROM placed",
    "agent_steps": f"WITH {_M} SELECT run, place, type, tool_name, result_kind, ms_since_start, length(t) AS result_len FROM kinds",
    "seq_since_start": f"WITH {_M} SELECT run, place, ms_since_start FROM steps",
    "direct_goto": f"""WITH {_M} SELECT r.run, coalesce((SELECT s.type = 'goto' AND s.page <> 2 FROM steps s WHERE s.run = r.run AND s.type <> 'screenshot' ORDER BY s.place LIMIT 1), FALSE) AS direct FROM (SELECT DISTINCT run FROM e) r""",
    "step_pairing": f"""WITH {_M}, n AS (SELECT k.run // 2 AS pair, k.run % 2 AS side, k.type, k.result_kind, k.place, k.t, (SELECT count(*) FROM kinds o WHERE o.run = k.run AND o.type = k.type AND o.result_kind = k.result_kind AND o.place <= k.place) AS nth FROM kinds k),
a AS (SELECT * FROM n WHERE side = 0), b AS (SELECT * FROM n WHERE side = 1)
SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.type, b.type) AS type, coalesce(a.result_kind, b.result_kind) AS result_kind, coalesce(a.nth, b.nth) AS nth, a.place AS place_a, b.place AS place_b, coalesce(a.t <> '' AND a.t = b.t, FALSE) AS same
FROM a FULL JOIN b ON a.pair = b.pair AND a.type = b.type AND a.result_kind = b.result_kind AND a.nth = b.nth""",
    "token_backfill": """SELECT user_id % 500 AS run, CAST(sum(i) AS BIGINT) AS input, CAST(sum(o) AS BIGINT) AS output, CAST(sum(i + o) AS BIGINT) AS total, CAST(sum(CASE WHEN event_id % 3 = 0 THEN event_id % 9 END) AS BIGINT) AS cached
FROM (SELECT *, CAST(floor(value * 10) AS BIGINT) AS i, CAST(floor(value * 3) AS BIGINT) AS o FROM events WHERE event_id % 3 < 2) WHERE i > 0 OR o > 0 GROUP BY 1""",
    "trace_stats": """SELECT user_id % 50 AS tab_id, count(*) FILTER (WHERE event_type <> 'error') AS events,
    CAST(sum(length('{"type":"","id":,"rule":}') + CASE WHEN event_type = 'error' THEN 7 ELSE 16 END + length(CAST(event_id AS VARCHAR)) + CASE WHEN event_id % 2 = 0 THEN length(event_type) + 2 ELSE 4 END) AS BIGINT) AS chars FROM events GROUP BY 1""",
}
