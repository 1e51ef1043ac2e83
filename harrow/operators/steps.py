"""Operators over trace entries (tab_id, frame_id, seq, type, rule_id, n), projected from an events table: retention, segments and counts.

Each is SQL over the trace, with parameters in braces: ``KEEP`` is the number of entries kept for each tab.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Entries of a tab that the store keeps, and the rules whose counts are taken in a report.
KEEP, KNOWN = 2000, ("rule-1", "rule-2", "rule-3")
TRACE = """SELECT user_id % 20 AS tab_id, event_id % 3 AS frame_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'segment' WHEN event_type = 'view' THEN 'navigation' ELSE 'rule-application' END AS type,
    concat('rule-', CAST(event_id % 6 AS VARCHAR(9))) AS rule_id, CAST(floor(value) AS BIGINT) AS n,
    CASE WHEN event_id % 9 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 9 = 1 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 9 = 2 THEN -value WHEN event_id % 9 > 3 THEN value + 0.5e0 END AS raw FROM {events}"""

OPERATORS: dict[str, str] = {
    "tab_rule_counts": "SELECT tab_id, rule_id, count(*) AS n FROM {trace} WHERE type = 'rule-application' GROUP BY tab_id, rule_id",
    "trace_prune": "SELECT tab_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY tab_id ORDER BY seq DESC) AS place FROM {trace}) x WHERE place <= {keep}",
    "segment_attribution": "SELECT tab_id, seq, CAST(sum(CASE WHEN type = 'segment' THEN 1 ELSE 0 END) OVER (PARTITION BY tab_id ORDER BY seq) AS BIGINT) AS segment FROM {trace}",
    "badge_text": "SELECT tab_id, CASE WHEN c <= 0 THEN '' WHEN c > 999 THEN '999+' ELSE CAST(c AS VARCHAR(9)) END AS badge FROM (SELECT tab_id, CAST(sum(CASE WHEN type = 'rule-application' THEN 1 ELSE 0 END) AS BIGINT) AS c FROM {trace} GROUP BY tab_id) x",
    # Counts as reported: what is no number, not finite or not positive is dropped, others lose their fraction.
    "count_sanitize": "SELECT tab_id, seq, rule_id, CAST(floor(raw) AS BIGINT) AS n FROM {trace} WHERE rule_id IN {known} AND raw > 0 AND raw < CAST('Infinity' AS DOUBLE)",
}


def _parameters(sql: str, keep: int, known: tuple[str, ...]) -> str:
    return sql.replace("{keep}", str(keep)).replace("{known}", "(" + ", ".join(f"'{k}'" for k in known) + ")")


def apply(name: str, events: DataFrame, keep: int = KEEP, known: tuple[str, ...] = KNOWN) -> DataFrame:
    spark = events.sparkSession
    return spark.sql(_parameters(OPERATORS[name], keep, known), trace=spark.sql(TRACE, events=events))


def oracle(name: str, keep: int = KEEP, known: tuple[str, ...] = KNOWN) -> str:
    return f"WITH trace AS ({TRACE.format(events='events')}) {_parameters(OPERATORS[name], keep, known).format(trace='trace')}"
