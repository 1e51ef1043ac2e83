"""Streams replayed over the events table; the check SQL is the same aggregate over all of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.streaming import registers, tabs


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


def _replayed(plan: Callable[[DataFrame], DataFrame], mode: str, name: str, *keys: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = tabs.replay(spark, tabs.trace(source(spark, sf_dir)), plan, mode, name, keys)
        return rows.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else c for c, t in rows.dtypes])

    return query


def stream_falling_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    looks = source(spark, sf_dir).select((F.col("user_id") % 50).alias("key"), (F.floor("value") % 60).cast("int").alias("seconds"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("place"))
    return tabs.replay(spark, looks, tabs.falling, "append", "stream_falling_timers").select("key")


def _of(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    """The events of tab user_id % 200 with at, place and columns."""
    return source(spark, sf_dir).select((F.col("user_id") % 200).alias("tab_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("place"), *columns)


def stream_frame_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total of each tab that has had one, after all messages."""
    counts = F.to_json(F.create_map(F.lit("rule-1"), F.floor("value") % 3, F.lit("rule-2"), F.floor("value") % 5 - 2))
    m = _of(spark, sf_dir, (F.col("event_id") % 4).alias("frame_id"), counts.alias("counts"), (F.col("event_type") == "error").alias("load"))
    told = tabs.replay(spark, m, tabs.frame_totals, "append", "frame_totals")
    return told.groupBy("tab_id").agg(F.max_by("total", F.struct("ms", "place")).alias("total"))


def stream_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for each tab and kind after all messages."""
    event = F.when(F.col("event_type") == "error", "load").when(F.col("event_id") % 7 == 0, "off").otherwise("found")
    m = _of(spark, sf_dir, event.alias("event"), F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")).alias("kind"), F.floor("value").cast("string").alias("payload"))
    told = tabs.replay(spark, m, tabs.detections, "append", "detections")
    last = told.groupBy("tab_id", "kind").agg(F.max_by("payload", F.struct("ms", "place")).alias("payload"))
    return last.filter("payload IS NOT NULL")


def stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers that start a segment; those of one kind are throttled to one in twelve hours."""
    kind = F.when(F.col("event_type") == "view", "mutation-burst").when(F.col("event_type") == "error", "route-change")
    m = _of(spark, sf_dir, kind.alias("kind")).filter("kind IS NOT NULL")
    return tabs.replay(spark, m, lambda x: tabs.segments(x, {"mutation-burst": 43_200_000}), "append", "segments").groupBy("tab_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def _registered(spark: SparkSession, messages: DataFrame, plan: Callable[[DataFrame], DataFrame], name: str, *keys: str) -> DataFrame:
    """The last row of each key that a stream of registers tells; the session's state store is as before."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    try:
        return tabs.replay(spark, messages, plan, "update", name, keys)
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)


def stream_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for each tab and kind, by registers: rows count by their stamps, in whatever order they come."""
    event = F.when(F.col("event_type") == "error", "load").when(F.col("event_id") % 7 == 0, "off").otherwise("found")
    m = _of(spark, sf_dir, event.alias("event"), F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")).alias("kind"), F.floor("value").cast("string").alias("payload"))
    return _registered(spark, m, registers.standing, "standing", "tab_id", "kind").filter("payload IS NOT NULL")


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total of each tab that has one above zero, by registers."""
    counts = F.to_json(F.create_map(F.lit("rule-1"), F.floor("value") % 3, F.lit("rule-2"), F.floor("value") % 5 - 2))
    m = _of(spark, sf_dir, (F.col("event_id") % 4).cast("string").alias("frame_id"), counts.alias("counts"), (F.col("event_type") == "error").alias("load"))
    return _registered(spark, m, registers.totals, "totals", "tab_id").filter("total > 0")


QUERIES = {
    "stream_standing": stream_standing,
    "stream_totals": stream_totals,
    "stream_frame_totals": stream_frame_totals,
    "stream_detections": stream_detections,
    "stream_segments": stream_segments,
    "stream_rule_counts": _replayed(tabs.rule_counts, "update", "stream_rule_counts", "tab_id", "rule_id"),
    "stream_latest_by_kind": _replayed(tabs.latest_by_kind, "update", "stream_latest_by_kind", "tab_id", "type"),
    "stream_windows": _replayed(tabs.windows, "update", "stream_windows", "started", "type"),
    "stream_bursts": _replayed(tabs.bursts, "complete", "stream_bursts"),
    "stream_falling_timers": stream_falling_timers,
}

_TRACE = """SELECT user_id % 20 AS tab_id, concat('rule-', CAST(event_id % 6 AS VARCHAR)) AS rule_id, CASE event_type WHEN 'error' THEN 'segment' WHEN 'view' THEN 'navigation' ELSE 'rule-application' END AS type, event_id, ts AS "at" FROM events"""
ORACLES = {
    "stream_frame_totals": """WITH m AS (SELECT user_id % 200 AS tab_id, event_id % 4 AS frame_id, ts, event_id, event_type = 'error' AS load, CAST(floor(value) AS BIGINT) % 3 + greatest(CAST(floor(value) AS BIGINT) % 5 - 2, 0) AS n FROM events),
s AS (SELECT m.*, sum(CASE WHEN load THEN 1 ELSE 0 END) OVER (PARTITION BY tab_id ORDER BY ts, event_id) AS loads FROM m),
e AS (SELECT tab_id, max(loads) AS loads FROM s GROUP BY tab_id),
f AS (SELECT s.tab_id, frame_id, arg_max(n, (ts, event_id)) AS n FROM s JOIN e USING (tab_id, loads) WHERE NOT load GROUP BY s.tab_id, frame_id)
SELECT tab_id, CAST(coalesce((SELECT sum(n) FROM f WHERE f.tab_id = m.tab_id), 0) AS BIGINT) AS total FROM m WHERE n > 0 AND NOT load GROUP BY tab_id""",
    "stream_detections": """WITH m AS (SELECT user_id % 200 AS tab_id, 'k' || (event_id % 3) AS kind, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS payload, ts, event_id, CASE WHEN event_type = 'error' THEN 'load' WHEN event_id % 7 = 0 THEN 'off' ELSE 'found' END AS event FROM events),
f AS (SELECT tab_id, kind, arg_max(payload, (ts, event_id)) AS payload, max((ts, event_id)) AS last FROM m WHERE event = 'found' GROUP BY tab_id, kind)
SELECT tab_id, kind, payload FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.tab_id = f.tab_id AND (m.ts, m.event_id) > f.last AND (event = 'load' OR (event = 'off' AND m.kind = f.kind)))""",
    "stream_segments": """WITH RECURSIVE m AS (SELECT user_id % 200 AS tab_id, ts, row_number() OVER (PARTITION BY user_id % 200 ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'view'),
r AS (SELECT tab_id, i, ts FROM m WHERE i = 1 UNION ALL SELECT r.tab_id, n.i, n.ts FROM r, LATERAL (SELECT m.i, m.ts FROM m WHERE m.tab_id = r.tab_id AND m.i > r.i AND m.ts >= r.ts + INTERVAL 12 HOUR ORDER BY m.i LIMIT 1) n)
SELECT tab_id, 'mutation-burst' AS kind, count(*) AS n FROM r GROUP BY tab_id UNION ALL SELECT user_id % 200, 'route-change', count(*) FROM events WHERE event_type = 'error' GROUP BY 1""",
    "stream_rule_counts": f"SELECT tab_id, rule_id, count(*) AS n FROM ({_TRACE}) WHERE type = 'rule-application' GROUP BY tab_id, rule_id",
    "stream_latest_by_kind": f'''SELECT tab_id, type, arg_max(rule_id, ("at", event_id)) AS rule_id, max("at") AS "at" FROM ({_TRACE}) GROUP BY tab_id, type''',
    "stream_windows": f'''SELECT CAST(date_trunc('day', "at") AS TIMESTAMP) AS started, type, count(*) AS n FROM ({_TRACE}) GROUP BY 1, 2''',
    "stream_bursts": f"""SELECT tab_id, min("at") AS started, max("at") + INTERVAL 1 HOUR AS settled, count(*) AS n FROM (SELECT *, sum(CASE WHEN before IS NULL OR "at" > before + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY tab_id ORDER BY "at", event_id) AS burst
    FROM (SELECT *, lag("at") OVER (PARTITION BY tab_id ORDER BY "at", event_id) AS before FROM ({_TRACE}))) GROUP BY tab_id, burst""",
    "stream_falling_timers": """SELECT DISTINCT key FROM (SELECT user_id % 50 AS key, CAST(floor(value) AS BIGINT) % 60 AS s, lag(CAST(floor(value) AS BIGINT) % 60) OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS b FROM events) WHERE s < b""",
}
ORACLES["stream_standing"] = ORACLES["stream_detections"]
ORACLES["stream_totals"] = f"SELECT tab_id, total FROM ({ORACLES['stream_frame_totals']}) WHERE total > 0"
