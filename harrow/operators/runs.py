"""Analytics over agent runs: deduplication, cost, summaries, consensus, comparison and planning.

Each operator is SQL over named tables, given as DataFrames: ``apply("scenario_summary", runs=runs)``. A run row
has scenario_id, task_id, repetition, model, steps, input_tokens, output_tokens, cached_tokens, duration_s, passed
(null: not judged), completed, blocked, defense, answer, extractable, error (null: none) and seq, the order of
the log. Braces name tables, and angle brackets parameters (PARAMETERS): the two scenarios that are compared, the guarded ones,
repetitions, and what retention keeps. Averages skip nulls. Null, false, zero and the empty string differ: an error that is the empty string
counts as one in ``scenario_summary`` (not null) and not in ``cell_summary`` (not empty).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Last row of each (scenario, task, repetition), in the order in which the key was first seen; a null repetition is the first.
LATEST = """
SELECT * FROM (SELECT scenario_id, task_id, coalesce(repetition, 1) AS repetition, model, steps, input_tokens, output_tokens, cached_tokens, duration_s,
    passed, completed, blocked, defense, answer, extractable, error, seq,
    row_number() OVER (PARTITION BY scenario_id, task_id, coalesce(repetition, 1) ORDER BY seq DESC) AS newest,
    min(seq) OVER (PARTITION BY scenario_id, task_id, coalesce(repetition, 1)) AS first_seen FROM {runs}) x WHERE newest = 1"""

#: Answer without white space and ASCII punctuation at its ends, lower case; null when nothing is left.
NORM = r"nullif(lower(regexp_replace(regexp_replace(answer, '\s+', '', 'g'), '^[!-/:-@\[-`\x7b-\x7e]+|[!-/:-@\[-`\x7b-\x7e]+$', '', 'g')), '')"

#: Tokens and cost of a run; null tokens give null cost, a model without a price costs nothing.
TOKENS = "input_tokens + output_tokens"
PARAMETERS = {"a": "s0", "b": "s1", "guarded": ("s1", "s3"), "repetitions": 3, "keep": 5, "always": ("t0",), "force": False}

OPERATORS: dict[str, str] = {
    "dedupe_last_wins": "SELECT scenario_id, task_id, repetition, seq, first_seen FROM {latest}",
    "cost_usd": "SELECT seq, round(cost, 6) AS cost_usd, pricing_missing FROM {costs}",
    "scenario_summary": """SELECT scenario_id, count(*) AS runs, count(error) AS errored, count(passed) AS judged,
    CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS n_passed, CAST(sum(CASE WHEN blocked AND NOT coalesce(passed, FALSE) THEN 1 ELSE 0 END) AS BIGINT) AS n_blocked,
    CAST(sum(CASE WHEN completed AND error IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_completed,
    count(blocked) AS block_judged, round(sum(cost), 8) AS total_cost, round(avg(cost), 8) AS avg_cost,
    CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, round(avg(input_tokens + output_tokens), 6) AS avg_tokens, round(avg(input_tokens), 6) AS avg_input, round(avg(output_tokens), 6) AS avg_output,
    round(avg(coalesce(steps, 0)), 6) AS avg_steps, round(avg(nullif(duration_s, 0)), 6) AS avg_duration,
    round(100e0 * CAST(sum(cached_tokens) AS BIGINT) / nullif(CAST(sum(input_tokens) AS BIGINT), 0), 6) AS cache_hit_pct FROM {costs} GROUP BY scenario_id""",
    "cell_summary": """SELECT s.scenario_id, t.task_id, count(r.seq) AS runs, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS n_pass, CAST(sum(CASE WHEN NOT passed THEN 1 ELSE 0 END) AS BIGINT) AS n_fail,
    CAST(sum(CASE WHEN r.seq IS NOT NULL AND passed IS NULL AND coalesce(error, '') = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_ungraded,
    CAST(sum(CASE WHEN coalesce(error, '') <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_error, count(DISTINCT CASE WHEN blocked THEN defense END) AS n_defenses,
    CAST(sum(CASE WHEN completed AND coalesce(error, '') = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_completed, CAST(sum(CASE WHEN blocked THEN 1 ELSE 0 END) AS BIGINT) AS n_blocked,
    round(avg(input_tokens + output_tokens), 6) AS avg_tokens, round(avg(cost), 6) AS avg_cost, round(avg(steps), 6) AS avg_steps, round(avg(duration_s), 6) AS avg_duration, count(r.seq) > 0 AND CAST(sum(CASE WHEN coalesce(error, '') <> '' THEN 1 ELSE 0 END) AS BIGINT) = count(r.seq) AS errored_all
    FROM {scenarios} s CROSS JOIN {tasks} t LEFT JOIN {costs} r ON r.scenario_id = s.scenario_id AND r.task_id = t.task_id GROUP BY s.scenario_id, t.task_id""",
    "passing_cost": "SELECT scenario_id, round(avg(cost), 9) AS avg_cost, count(cost) AS n FROM {costs} WHERE passed GROUP BY scenario_id",
    "verdicts": """SELECT scenario_id, CASE WHEN error IS NOT NULL THEN 'error' WHEN passed THEN 'pass' WHEN NOT passed THEN 'fail' ELSE 'ungraded' END AS verdict, count(*) AS n
    FROM {latest} GROUP BY 1, 2""",
    "majority_answer": """SELECT scenario_id, task_id, answer AS majority, n FROM (
    SELECT *, row_number() OVER (PARTITION BY scenario_id, task_id ORDER BY n DESC, first_rep) AS place FROM (
    SELECT scenario_id, task_id, norm, count(*) AS n, min(repetition) AS first_rep, min_by(answer, repetition) AS answer FROM {answers} WHERE norm IS NOT NULL GROUP BY scenario_id, task_id, norm) a) b WHERE place = 1""",
    "within_cell_discrepancy": "SELECT scenario_id, task_id, count(DISTINCT norm) AS n_answers FROM {answers} GROUP BY scenario_id, task_id HAVING count(DISTINCT norm) >= 2",
    "task_modes": """SELECT task_id, norm, n FROM (SELECT task_id, norm, count(*) AS n, rank() OVER (PARTITION BY task_id ORDER BY count(*) DESC) AS place
    FROM {answers} WHERE norm IS NOT NULL AND extractable GROUP BY task_id, norm) m WHERE place = 1""",
    "consensus_match": """SELECT a.scenario_id, CAST(sum(CASE WHEN m.norm IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS matched, count(*) AS total
    FROM {answers} a JOIN (SELECT DISTINCT task_id FROM {modes}) t ON a.task_id = t.task_id LEFT JOIN {modes} m ON m.task_id = a.task_id AND m.norm = a.norm GROUP BY a.scenario_id""",
    "cross_scenario_discrepancy": "SELECT task_id, count(DISTINCT lower(majority)) AS n_majorities FROM {majority} GROUP BY task_id HAVING count(DISTINCT lower(majority)) >= 2",
    "guarded_severity": """SELECT task_id, greatest(max(CASE WHEN guarded THEN fails END) - avg(CASE WHEN NOT guarded THEN fails END), 0) AS extra_fails,
    round(coalesce(max(CASE WHEN guarded THEN cost END) / nullif(avg(CASE WHEN NOT guarded THEN cost END), 0), 0), 6) AS cost_ratio FROM (
    SELECT task_id, scenario_id, scenario_id IN <guarded> AS guarded, sum(CASE WHEN NOT passed THEN 1e0 ELSE 0e0 END) AS fails, avg(cost) AS cost FROM {costs} GROUP BY task_id, scenario_id) c GROUP BY task_id""",
    "ab_compare": """SELECT task_id, round(avg(CASE WHEN scenario_id = <a> THEN input_tokens + output_tokens END), 6) AS tokens_a, round(avg(CASE WHEN scenario_id = <b> THEN input_tokens + output_tokens END), 6) AS tokens_b,
    round(100e0 * (avg(CASE WHEN scenario_id = <b> THEN input_tokens + output_tokens END) - avg(CASE WHEN scenario_id = <a> THEN input_tokens + output_tokens END)) / nullif(avg(CASE WHEN scenario_id = <a> THEN input_tokens + output_tokens END), 0), 6) AS delta_pct,
    round(avg(CASE WHEN scenario_id = <a> THEN cost END), 6) AS cost_a, round(avg(CASE WHEN scenario_id = <b> THEN cost END), 6) AS cost_b, round(avg(CASE WHEN scenario_id = <a> THEN steps END), 6) AS steps_a, round(avg(CASE WHEN scenario_id = <b> THEN steps END), 6) AS steps_b,
    round(avg(CASE WHEN scenario_id = <a> THEN duration_s END), 6) AS duration_a, round(avg(CASE WHEN scenario_id = <b> THEN duration_s END), 6) AS duration_b,
    CAST(sum(CASE WHEN scenario_id = <a> AND passed THEN 1 ELSE 0 END) AS BIGINT) AS passes_a, CAST(sum(CASE WHEN scenario_id = <b> AND passed THEN 1 ELSE 0 END) AS BIGINT) AS passes_b FROM {costs} GROUP BY task_id""",
    "rep_delta": """SELECT coalesce(a.task_id, b.task_id) AS task_id, coalesce(a.repetition, b.repetition) AS repetition, b.input_tokens + b.output_tokens - a.input_tokens - a.output_tokens AS token_delta, b.steps - a.steps AS step_delta
    FROM (SELECT * FROM {latest} WHERE scenario_id = <a>) a FULL OUTER JOIN (SELECT * FROM {latest} WHERE scenario_id = <b>) b ON a.task_id = b.task_id AND a.repetition = b.repetition""",
    "guarded_token_delta": """SELECT round(avg(CASE WHEN guarded THEN tokens END) - avg(CASE WHEN NOT guarded THEN tokens END), 6) AS delta FROM (
    SELECT scenario_id, scenario_id IN <guarded> AS guarded, avg(input_tokens + output_tokens) AS tokens FROM {latest} GROUP BY scenario_id) m""",
    "variant_rollup": """SELECT scenario_id, round(avg(tokens), 6) AS mean_of_means, round(avg(cost), 9) AS mean_cost, CAST(sum(passes) AS BIGINT) AS passes, count(*) AS n_tasks FROM (
    SELECT scenario_id, task_id, avg(input_tokens + output_tokens) AS tokens, avg(cost) AS cost, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS passes FROM {costs} GROUP BY scenario_id, task_id) c
    WHERE task_id IN (SELECT task_id FROM {latest} GROUP BY task_id HAVING count(DISTINCT scenario_id) >= 2) GROUP BY scenario_id""",
    "work_grid": """SELECT s.scenario_id, t.task_id, r.repetition, coalesce(t.max_steps, s.max_steps) AS effective_max_steps
    FROM {scenarios} s CROSS JOIN {tasks} t CROSS JOIN (SELECT <repetitions> AS repetition) r""",
    "pending_units": """SELECT g.scenario_id, g.task_id, g.repetition FROM {grid} g LEFT JOIN {latest} r ON g.scenario_id = r.scenario_id AND g.task_id = r.task_id AND g.repetition = r.repetition AND r.error IS NULL
    WHERE r.seq IS NULL""",
    "pending_counts": """SELECT CAST(sum(CASE WHEN error IS NULL AND answer IS NOT NULL AND passed IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS to_judge, CAST(sum(CASE WHEN error IS NULL AND answer IS NOT NULL AND extractable IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS to_extract,
    CAST(sum(CASE WHEN blocked IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS to_block_check FROM {latest}""",
    "pending_judge": "SELECT scenario_id, task_id, repetition FROM {latest} WHERE error IS NULL AND answer IS NOT NULL AND (<force> OR passed IS NULL)",
    "pending_extract": "SELECT scenario_id, task_id, repetition FROM {latest} WHERE error IS NULL AND answer IS NOT NULL AND (<force> OR extractable IS NULL)",
    "pending_block": "SELECT scenario_id, task_id, repetition FROM {latest} WHERE error IS NULL AND (<force> OR blocked IS NULL)",
    "error_rows": "SELECT scenario_id, task_id, repetition, error FROM {latest} WHERE error IS NOT NULL",
    "all_rows": "SELECT scenario_id, task_id, repetition, steps, passed FROM {latest} ORDER BY scenario_id, task_id, repetition",
    "retention_keep": "SELECT scenario_id, seq, place <= <keep> OR task_id IN <always> AS keep FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY seq DESC) AS place FROM {latest}) x",
    "answer_norm": "SELECT seq, norm FROM {answers}",
    # Reports of scenarios that have no run, and what a clean-up would delete: runs beyond the newest and those named.
    "orphan_scenarios": "SELECT DISTINCT r.scenario_id FROM {latest} r LEFT ANTI JOIN {scenarios} s ON r.scenario_id = s.scenario_id",
    "cleanup_plan": "SELECT scenario_id, seq FROM {latest} EXCEPT SELECT scenario_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY seq DESC) AS place FROM {latest}) x WHERE place <= <keep> OR task_id IN <always>",
    # Guarded tasks, worst first.
    "severity_ranking": """SELECT row_number() OVER (ORDER BY extra_fails DESC, cost_ratio DESC, task_id) AS place, task_id FROM ({guarded_severity}) s""",
}
OPERATORS["severity_ranking"] = OPERATORS["severity_ranking"].replace("{guarded_severity}", OPERATORS["guarded_severity"])

#: Each latest run with its cost and whether its model has no price.
COSTS = """SELECT r.*, CASE WHEN input_tokens IS NULL OR output_tokens IS NULL THEN NULL
    ELSE input_tokens / 1e6 * coalesce(p.input_per_mtok, 0) + output_tokens / 1e6 * coalesce(p.output_per_mtok, 0) END AS cost, p.model IS NULL AS pricing_missing
    FROM {latest} r LEFT JOIN {pricing} p ON r.model = p.model"""


def _bound(sql: str, parameters: dict, spark: bool) -> str:
    """The SQL with its parameters as literals."""
    literal = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper()
    for name, value in (PARAMETERS | parameters).items():
        if name == "repetitions":
            said = f"explode(sequence(1, {value}))" if spark else f"CAST(unnest(range(1, {value + 1})) AS INTEGER)"
        else:
            said = "(" + ", ".join(map(literal, value)) + ")" if isinstance(value, tuple) else literal(value)
        sql = sql.replace(f"<{name}>", said)
    return sql


def _spark_norm() -> str:
    """NORM in Spark's dialect: its regexp_replace always replaces all, and string literals escape backslashes."""
    return NORM.replace(", 'g')", ")").replace("\\", "\\\\")


def tables(parameters: dict, **given: DataFrame) -> dict[str, DataFrame]:
    """``given`` and what is derived from the runs: latest, answers, modes, majority, grid, costs."""
    spark = given["runs"].sparkSession
    out = dict(given)
    out["latest"] = spark.sql(LATEST, runs=given["runs"])
    out["answers"] = spark.sql(f"SELECT scenario_id, task_id, repetition, seq, answer, extractable, {_spark_norm()} AS norm FROM {{latest}}", latest=out["latest"])
    for name, of in (("modes", "task_modes"), ("majority", "majority_answer")):
        out[name] = spark.sql(OPERATORS[of], answers=out["answers"])
    if "scenarios" in out and "tasks" in out:
        out["grid"] = spark.sql(_bound(OPERATORS["work_grid"], parameters, True), scenarios=out["scenarios"], tasks=out["tasks"])
    if "pricing" not in out:
        out["pricing"] = spark.createDataFrame([], "model string, input_per_mtok double, output_per_mtok double")
    out["costs"] = spark.sql(COSTS, latest=out["latest"], pricing=out["pricing"])
    return out


def apply(name: str, parameters: dict | None = None, **given: DataFrame) -> DataFrame:
    """One operator over tables of runs, and of scenarios, tasks and pricing where it names them."""
    have = tables(parameters or {}, **given)
    sql = _bound(OPERATORS[name], parameters or {}, True)
    return given["runs"].sparkSession.sql(sql, **{k: v for k, v in have.items() if f"{{{k}}}" in sql})


def oracle(name: str, **sql_of: str) -> str:
    """The operator as one statement of standard SQL over the given table definitions."""
    parts = dict(sql_of)
    parts["latest"] = LATEST
    parts["answers"] = f"SELECT scenario_id, task_id, repetition, seq, answer, extractable, {NORM} AS norm FROM {{latest}}"
    parts["modes"], parts["majority"], parts["grid"] = OPERATORS["task_modes"], OPERATORS["majority_answer"], OPERATORS["work_grid"]
    parts["costs"] = COSTS

    def plain(sql: str) -> str:
        for k in parts:
            sql = sql.replace(f"{{{k}}}", k)
        return _bound(sql, {}, False).replace("LEFT ANTI JOIN", "ANTI JOIN")

    return "WITH " + ", ".join(f"{k} AS ({plain(v)})" for k, v in parts.items()) + " " + plain(OPERATORS[name])

