"""Run analytics over a run log that is projected from the events table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harrow.operators import runs, steps
from harrow.plans import run_oracles

#: A run for each event; the odd arithmetic gives nulls, ties and errors.
RUNS = """
SELECT concat('s', CAST(user_id % 4 AS VARCHAR(9))) AS scenario_id, concat('t', CAST(event_id % 10 AS VARCHAR(9))) AS task_id,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE 1 + CAST(floor(event_id / 10) AS BIGINT) % 3 END AS repetition,
    CASE WHEN event_id % 3 = 0 THEN 'small' WHEN event_id % 3 = 1 THEN 'large' ELSE 'other' END AS model,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 17 END AS steps,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS input_tokens,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS output_tokens,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(value * 20) AS BIGINT) END AS cached_tokens,
    CASE WHEN event_id % 6 = 0 THEN 0e0 ELSE CAST(event_id % 60 AS DOUBLE) END AS duration_s,
    CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 3 = 0 END AS passed, event_id % 4 <> 0 AS completed,
    CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_id % 5 = 1 END AS blocked, concat('d', CAST(event_id % 2 AS VARCHAR(9))) AS defense,
    CASE WHEN event_id % 10 = 9 THEN NULL ELSE concat(' Answer ', CAST(event_id % 4 AS VARCHAR(9)), CASE WHEN event_id % 2 = 0 THEN '. ' ELSE '' END) END AS answer,
    CASE WHEN event_id % 12 = 0 THEN NULL ELSE event_id % 6 <> 1 END AS extractable,
    CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 19 = 0 THEN '' ELSE NULL END AS error, event_id AS seq FROM events"""
SCENARIOS = "SELECT 's0' AS scenario_id, 15 AS max_steps UNION ALL SELECT 's1', 15 UNION ALL SELECT 's2', 20 UNION ALL SELECT 's3', 20"
TASKS = " UNION ALL ".join(f"SELECT 't{i}' AS task_id, {'CAST(NULL AS INT)' if i % 3 else 10 + i} AS max_steps" for i in range(12))
PRICING = "SELECT 'small' AS model, 0.25 AS input_per_mtok, 2.0 AS output_per_mtok UNION ALL SELECT 'large', 1.25, 10.0"
DIMENSIONS = {"scenarios": SCENARIOS, "tasks": TASKS, "pricing": PRICING}


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RUNS.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def dimensions(name: str) -> dict[str, str]:
    """The tables beside the runs. For the orphans a scenario that has runs is not on the list."""
    return DIMENSIONS | ({"scenarios": SCENARIOS.replace(" UNION ALL SELECT 's3', 20", "")} if name == "orphan_scenarios" else {})


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return runs.apply(name, runs=run_log(spark, sf_dir), **{k: spark.sql(v) for k, v in dimensions(name).items()})

    return query


def _step_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return steps.apply(name, events=spark.read.parquet(f"{sf_dir}/events.parquet"))

    return query


QUERIES = {name: _query(name) for name in runs.OPERATORS} | {name: _step_query(name) for name in steps.OPERATORS}
#: SQL of its own wording, not that of the operators.
ORACLES = {name: run_oracles.run_sql(name, runs=RUNS, **dimensions(name)) for name in runs.OPERATORS} | {name: run_oracles.step_sql(name, steps.KEEP) for name in steps.OPERATORS}
