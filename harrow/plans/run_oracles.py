"""Check SQL of the run and step analytics, worded apart from the operators: filtered aggregates, arg_max, lists and QUALIFY."""

from __future__ import annotations

#: Shared views: the latest row of each run, its cost, and its answer as compared. {runs} and the dimensions are given.
BASE = """WITH runs AS ({runs}), scenarios AS ({scenarios}), tasks AS ({tasks}), pricing AS ({pricing}),
lat AS (SELECT * REPLACE (coalesce(repetition, 1) AS repetition), min(seq) OVER same AS first_seen FROM runs WINDOW same AS (PARTITION BY scenario_id, task_id, coalesce(repetition, 1)) QUALIFY seq = max(seq) OVER same),
priced AS (SELECT lat.*, (SELECT count(*) FROM pricing p WHERE p.model = lat.model) = 0 AS unpriced,
    coalesce((SELECT max(input_per_mtok) FROM pricing p WHERE p.model = lat.model), 0) * (input_tokens / 1e6) + coalesce((SELECT max(output_per_mtok) FROM pricing p WHERE p.model = lat.model), 0) * (output_tokens / 1e6) AS usd, input_tokens + output_tokens AS tokens FROM lat),
said AS (SELECT scenario_id, task_id, repetition, seq, answer, extractable, nullif(trim(lower(regexp_replace(answer, '[[:space:]]', '', 'g')), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~'), '') AS key FROM lat)
"""

_CELLS = "(SELECT task_id, scenario_id, list(DISTINCT repetition) AS reps FROM lat GROUP BY ALL)"
_FAILS = "SELECT task_id, scenario_id, scenario_id IN ('s1', 's3') AS guarded, CAST(count(*) FILTER (passed = false) AS DOUBLE) AS fails, avg(usd) AS usd FROM priced GROUP BY ALL"
_SEVERITY = f"""SELECT task_id, greatest(max(fails) FILTER (guarded) - avg(fails) FILTER (NOT guarded), 0) AS extra_fails, round(coalesce(max(usd) FILTER (guarded) / nullif(avg(usd) FILTER (NOT guarded), 0), 0), 6) AS cost_ratio FROM ({_FAILS}) GROUP BY task_id"""
_MAJORITY = """SELECT scenario_id, task_id, list_sort(list({'n': -n, 'first': first_rep, 'answer': answer, 'times': n}))[1] AS best FROM
    (SELECT scenario_id, task_id, key, count(*) AS n, min(repetition) AS first_rep, arg_min(answer, repetition) AS answer FROM said WHERE key IS NOT NULL GROUP BY ALL) GROUP BY scenario_id, task_id"""
_MODES = """SELECT task_id, key, n FROM (SELECT task_id, key, count(*) AS n FROM said WHERE extractable AND key IS NOT NULL GROUP BY ALL) c WHERE NOT EXISTS (SELECT 1 FROM (SELECT task_id, count(*) AS m FROM said WHERE extractable AND key IS NOT NULL GROUP BY task_id, key) d WHERE d.task_id = c.task_id AND d.m > c.n)"""
_MEAN = "avg({0}) FILTER (scenario_id = '{1}')"
_A, _B = (lambda c: _MEAN.format(c, "s0")), (lambda c: _MEAN.format(c, "s1"))
_GRID = "SELECT scenario_id, task_id, CAST(rep AS INTEGER) AS repetition, CASE WHEN tasks.max_steps IS NOT NULL THEN tasks.max_steps ELSE scenarios.max_steps END AS effective_max_steps FROM scenarios, tasks, (VALUES (1), (2), (3)) r(rep)"
_KEPT = "(SELECT s.scenario_id, s.seq FROM lat s WHERE s.task_id = 't0' OR (SELECT count(*) FROM lat o WHERE o.scenario_id = s.scenario_id AND o.seq > s.seq) < 5)"

RUNS: dict[str, str] = {
    "dedupe_last_wins": "SELECT scenario_id, task_id, repetition, seq, first_seen FROM lat",
    "cost_usd": "SELECT seq, round(usd, 6) AS cost_usd, unpriced AS pricing_missing FROM priced",
    "scenario_summary": """SELECT scenario_id, count(*) AS runs, count(*) FILTER (error IS NOT NULL) AS errored, count(*) FILTER (passed IS NOT NULL) AS judged, count(*) FILTER (passed) AS n_passed, count(*) FILTER (blocked AND passed IS DISTINCT FROM true) AS n_blocked,
    count(*) FILTER (completed AND error IS NULL) AS n_completed, count(*) FILTER (blocked IS NOT NULL) AS block_judged, round(sum(usd), 8) AS total_cost, round(sum(usd) / count(usd), 8) AS avg_cost, CAST(sum(tokens) AS BIGINT) AS total_tokens,
    round(sum(tokens) / count(tokens), 6) AS avg_tokens, round(sum(input_tokens) / count(input_tokens), 6) AS avg_input, round(sum(output_tokens) / count(output_tokens), 6) AS avg_output, round(sum(steps) / CAST(count(*) AS DOUBLE), 6) AS avg_steps,
    round(avg(duration_s) FILTER (duration_s <> 0), 6) AS avg_duration, round(100.0 * sum(cached_tokens) / nullif(sum(input_tokens), 0), 6)::DOUBLE AS cache_hit_pct FROM priced GROUP BY scenario_id""",
    "cell_summary": """SELECT g.scenario_id, g.task_id, count(seq) AS runs, count(*) FILTER (passed) AS n_pass, count(*) FILTER (NOT passed) AS n_fail, count(*) FILTER (seq IS NOT NULL AND passed IS NULL AND (error IS NULL OR error = '')) AS n_ungraded,
    count(*) FILTER (error <> '') AS n_error, CAST(coalesce(len(list_distinct(list(defense) FILTER (blocked AND defense IS NOT NULL))), 0) AS BIGINT) AS n_defenses, count(*) FILTER (completed AND (error IS NULL OR error = '')) AS n_completed, count(*) FILTER (blocked) AS n_blocked,
    round(avg(tokens), 6) AS avg_tokens, round(avg(usd), 6) AS avg_cost, round(avg(steps), 6) AS avg_steps, round(avg(duration_s), 6) AS avg_duration, count(seq) > 0 AND bool_and(error IS NOT NULL AND error <> '') AS errored_all
    FROM (SELECT scenario_id, task_id FROM scenarios, tasks) g LEFT JOIN priced USING (scenario_id, task_id) GROUP BY g.scenario_id, g.task_id""",
    "passing_cost": "SELECT scenario_id, round(avg(usd), 9) AS avg_cost, count(usd) AS n FROM priced WHERE passed IS true GROUP BY scenario_id",
    "verdicts": "SELECT scenario_id, verdict, count(*) AS n FROM (SELECT scenario_id, if(error IS NOT NULL, 'error', if(passed IS NULL, 'ungraded', if(passed, 'pass', 'fail'))) AS verdict FROM lat) GROUP BY ALL",
    "majority_answer": f"SELECT scenario_id, task_id, best.answer AS majority, best.times AS n FROM ({_MAJORITY})",
    "within_cell_discrepancy": "SELECT scenario_id, task_id, CAST(len(keys) AS BIGINT) AS n_answers FROM (SELECT scenario_id, task_id, list_distinct(list(key)) AS keys FROM said GROUP BY ALL) WHERE len(keys) > 1",
    "task_modes": f"SELECT task_id, key AS norm, n FROM ({_MODES})",
    "consensus_match": f"""SELECT scenario_id, count(*) FILTER (list_contains(keys, key)) AS matched, count(*) AS total FROM said JOIN (SELECT task_id, list(key) AS keys FROM ({_MODES}) GROUP BY task_id) USING (task_id) GROUP BY scenario_id""",
    "cross_scenario_discrepancy": f"SELECT task_id, n AS n_majorities FROM (SELECT task_id, count(DISTINCT lower(best.answer)) AS n FROM ({_MAJORITY}) GROUP BY task_id) WHERE n > 1",
    "guarded_severity": _SEVERITY,
    "ab_compare": f"""SELECT task_id, round({_A('tokens')}, 6) AS tokens_a, round({_B('tokens')}, 6) AS tokens_b, round(({_B('tokens')} / nullif({_A('tokens')}, 0) - 1) * 100, 6) AS delta_pct, round({_A('usd')}, 6) AS cost_a, round({_B('usd')}, 6) AS cost_b,
    round({_A('steps')}, 6) AS steps_a, round({_B('steps')}, 6) AS steps_b, round({_A('duration_s')}, 6) AS duration_a, round({_B('duration_s')}, 6) AS duration_b, count(*) FILTER (scenario_id = 's0' AND passed) AS passes_a, count(*) FILTER (scenario_id = 's1' AND passed) AS passes_b FROM priced GROUP BY task_id""",
    "rep_delta": """SELECT task_id, repetition, any_value(tokens) FILTER (scenario_id = 's1' AND tokens IS NOT NULL) - any_value(tokens) FILTER (scenario_id = 's0' AND tokens IS NOT NULL) AS token_delta,
    any_value(steps) FILTER (scenario_id = 's1' AND steps IS NOT NULL) - any_value(steps) FILTER (scenario_id = 's0' AND steps IS NOT NULL) AS step_delta FROM priced WHERE scenario_id IN ('s0', 's1') GROUP BY task_id, repetition""",
    "guarded_token_delta": "SELECT round((SELECT avg(t) FROM m WHERE g) - (SELECT avg(t) FROM m WHERE NOT g), 6) AS delta FROM (SELECT 1)",
    "variant_rollup": """SELECT scenario_id, round(avg(t), 6) AS mean_of_means, round(avg(u), 9) AS mean_cost, CAST(sum(p) AS BIGINT) AS passes, count(*) AS n_tasks FROM (SELECT scenario_id, task_id, avg(tokens) AS t, avg(usd) AS u, count(*) FILTER (passed) AS p FROM priced GROUP BY ALL) c
    WHERE EXISTS (SELECT 1 FROM lat o WHERE o.task_id = c.task_id AND o.scenario_id <> c.scenario_id) GROUP BY scenario_id""",
    "work_grid": _GRID,
    "pending_units": f"SELECT scenario_id, task_id, repetition FROM ({_GRID}) g WHERE NOT EXISTS (SELECT 1 FROM lat WHERE lat.scenario_id = g.scenario_id AND lat.task_id = g.task_id AND lat.repetition = g.repetition AND error IS NULL)",
    "pending_counts": "SELECT count(*) FILTER (error IS NULL AND answer IS NOT NULL AND passed IS NULL) AS to_judge, count(*) FILTER (error IS NULL AND answer IS NOT NULL AND extractable IS NULL) AS to_extract, count(*) FILTER (blocked IS NULL) AS to_block_check FROM lat",
    "pending_judge": "SELECT scenario_id, task_id, repetition FROM lat WHERE NOT (error IS NOT NULL OR answer IS NULL OR passed IS NOT NULL)",
    "pending_extract": "SELECT scenario_id, task_id, repetition FROM lat WHERE NOT (error IS NOT NULL OR answer IS NULL OR extractable IS NOT NULL)",
    "pending_block": "SELECT scenario_id, task_id, repetition FROM lat WHERE NOT (error IS NOT NULL OR blocked IS NOT NULL)",
    "error_rows": "SELECT scenario_id, task_id, repetition, error FROM lat WHERE coalesce(error, 'none') = error",
    "all_rows": "SELECT scenario_id, task_id, repetition, steps, passed FROM lat",
    "retention_keep": f"SELECT scenario_id, seq, (scenario_id, seq) IN {_KEPT} AS keep FROM lat",
    "answer_norm": "SELECT seq, key AS norm FROM said",
    "orphan_scenarios": "SELECT scenario_id FROM lat EXCEPT SELECT scenario_id FROM scenarios",
    "cleanup_plan": f"SELECT scenario_id, seq FROM lat WHERE (scenario_id, seq) NOT IN {_KEPT}",
    "severity_ranking": f"SELECT i AS place, order_[i] AS task_id FROM (SELECT list(task_id ORDER BY extra_fails DESC NULLS LAST, cost_ratio DESC NULLS LAST, task_id) AS order_ FROM ({_SEVERITY})), range(1, 1 + (SELECT count(DISTINCT task_id) FROM lat)) r(i)",
}
#: Views that one query needs besides.
_MORE = {"guarded_token_delta": ", m AS (SELECT scenario_id IN ('s1', 's3') AS g, avg(tokens) AS t FROM priced GROUP BY scenario_id)\n"}

_SEEN = "(SELECT event_id AS seq, user_id % 20 AS tab_id, 'rule-' || (event_id % 6) AS rule_id, event_type NOT IN ('error', 'view') AS applied, event_type = 'error' AS opens, event_id % 9 AS r, value FROM events)"
STEPS: dict[str, str] = {
    "tab_rule_counts": f"SELECT tab_id, rule_id, count(*) AS n FROM {_SEEN} WHERE applied GROUP BY ALL",
    "trace_prune": f"SELECT tab_id, unnest(list_sort(list(seq), 'DESC')[:{{keep}}]) AS seq FROM {_SEEN} GROUP BY tab_id",
    "segment_attribution": f"SELECT a.tab_id, a.seq, (SELECT count(*) FROM {_SEEN} b WHERE b.tab_id = a.tab_id AND b.opens AND b.seq <= a.seq) AS segment FROM {_SEEN} a",
    "badge_text": f"SELECT tab_id, if(n = 0, '', if(n >= 1000, '999+', n::VARCHAR)) AS badge FROM (SELECT tab_id, count(*) FILTER (applied) AS n FROM {_SEEN} GROUP BY tab_id)",
    "count_sanitize": f"SELECT tab_id, seq, rule_id, CAST(floor(value + 0.5) AS BIGINT) AS n FROM {_SEEN} WHERE rule_id IN ('rule-1', 'rule-2', 'rule-3') AND r > 3 AND value + 0.5 > 0 AND isfinite(value) UNION ALL SELECT tab_id, seq, rule_id, CAST(floor(-value) AS BIGINT) FROM {_SEEN} WHERE rule_id IN ('rule-1', 'rule-2', 'rule-3') AND r = 2 AND value < 0",
}


def run_sql(name: str, **given: str) -> str:
    return BASE.format(**given).rstrip() + _MORE.get(name, "\n") + RUNS[name]


def step_sql(name: str, keep: int) -> str:
    return STEPS[name].replace("{keep}", str(keep))
