"""Outcome queries over the evaluation rounds of two runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from irquarry.operators import outcomes, reports
from irquarry.plans import views
from irquarry.plans.registry import query
from irquarry.plans.views import ctes


@query(
    ctes("ev")
    + """
SELECT idx, retry, count(*) FILTER (exec_a) AS n_executed, count(*) FILTER (comp) AS n_compiled, count(*) AS n_total
FROM ev GROUP BY 1, 2"""
)
def round_summary(spark, sf_dir):
    return outcomes.round_summary(views.evaluations(spark, sf_dir))


@query(
    ctes("ev")
    + """
SELECT idx, bool_or(comp) AS any_compile, bool_or(exec_a) AS any_execution,
  min(retry) FILTER (exec_a) AS first_round, coalesce(min(retry) FILTER (exec_a), 10) AS pass_round
FROM ev GROUP BY 1"""
)
def first_success(spark, sf_dir):
    return outcomes.record_summary(views.evaluations(spark, sf_dir))


@query(
    ctes("ev")
    + """
SELECT idx, retry, choice, llvm_ir FROM ev WHERE exec_a
QUALIFY row_number() OVER (PARTITION BY idx ORDER BY retry, choice) = 1"""
)
def first_executed(spark, sf_dir):
    rows = outcomes.first_executed(views.evaluations(spark, sf_dir))
    return rows.select("idx", "retry", "choice", "llvm_ir")


@query(
    ctes("ev")
    + """
SELECT idx, retry, choice, assembly FROM ev WHERE comp AND retry < 3
QUALIFY row_number() OVER (PARTITION BY idx ORDER BY retry <> 2, retry, choice) = 1"""
)
def best_compilable(spark, sf_dir):
    """Where round 3 would start: the best compiled candidate before it."""
    rows = outcomes.best_compilable(views.evaluations(spark, sf_dir), 3)
    return rows.select("idx", "retry", "choice", "assembly")


@query(
    ctes("ev")
    + """
, r AS (SELECT idx, retry, bool_or(exec_b) AS e FROM ev GROUP BY 1, 2),
l AS (SELECT idx, retry FROM r QUALIFY row_number() OVER (PARTITION BY idx ORDER BY retry DESC) = 1 AND NOT e)
SELECT idx, retry, choice, ev.llvm_ir, 'corpus/' || idx AS target_ir FROM ev JOIN l USING (idx, retry) WHERE comp"""
)
def failed_last_round(spark, sf_dir):
    """Compiled candidates of the records that failed to the end, with their targets."""
    rows = views.evaluations(spark, sf_dir, "b")
    targets = rows.select("idx").distinct().withColumn(
        "target_ir", F.concat(F.lit("corpus/"), F.col("idx").cast("string"))
    )
    return outcomes.failed_sample_export(rows, targets)


@query(ctes("ev") + " SELECT idx FROM ev GROUP BY 1 HAVING NOT bool_or(exec_b)")
def failed_records(spark, sf_dir):
    return outcomes.failed_records(views.evaluations(spark, sf_dir, "b"))


@query(ctes("ev") + " SELECT idx, llvm_ir FROM ev WHERE exec_a AND retry = -1 QUALIFY row_number() OVER (PARTITION BY idx ORDER BY choice) = 1")
def correct_code_of_round(spark, sf_dir):
    return outcomes.first_executed_of_round(views.evaluations(spark, sf_dir), -1)


_RUN = (
    ctes("ev")
    + """
, rd AS (SELECT idx, retry, bool_or(comp) AS c, bool_or(exec_b) AS e FROM ev GROUP BY 1, 2),
run AS (SELECT *, coalesce(bool_or(e) OVER (PARTITION BY idx ORDER BY retry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS solved FROM rd),
kept AS (SELECT *, max(retry) OVER (PARTITION BY idx) AS last FROM run WHERE NOT solved)"""
)


@query(
    _RUN
    + """
, st AS (SELECT retry + 1 AS step, c AND NOT coalesce(lag(c) OVER w, FALSE) AS newly,
    c AND NOT coalesce(bool_or(c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS fresh, e
  FROM kept WHERE retry >= 0 WINDOW w AS (PARTITION BY idx ORDER BY retry)
  UNION ALL SELECT 0, TRUE, TRUE, TRUE FROM kept WHERE last = -1),
ax AS (SELECT unnest(range(11)) AS step),
per AS (SELECT ax.step, count(*) FILTER (newly) AS a, count(*) FILTER (fresh) AS b, count(*) FILTER (e) AS d
  FROM ax LEFT JOIN st ON st.step = ax.step GROUP BY 1)
SELECT CAST(step AS INTEGER) AS step, CAST(sum(a) OVER (ORDER BY step) AS BIGINT) AS compile_accumulated,
  CAST(sum(b) OVER (ORDER BY step) AS BIGINT) AS first_compile_accumulated,
  CAST(sum(d) OVER (ORDER BY step) AS BIGINT) AS execution_accumulated FROM per"""
)
def accumulated_success(spark, sf_dir):
    """Accumulated success over the rounds a repair run would have kept."""
    return outcomes.accumulated_success(outcomes.run_rounds(views.evaluations(spark, sf_dir, "b")))


@query(
    ctes("ev")
    + """
, p AS (SELECT idx, retry, bool_or(comp) AS c, bool_or(exec_a) AS e FROM ev GROUP BY 1, 2),
r AS (SELECT retry, count(*) FILTER (c) AS c, count(*) FILTER (e) AS e FROM p GROUP BY 1)
SELECT retry, max(c) OVER (ORDER BY retry) AS predict_compile_max, max(e) OVER (ORDER BY retry) AS predict_execution_max FROM r"""
)
def running_max(spark, sf_dir):
    rows = views.evaluations(spark, sf_dir)
    progress = outcomes.round_progress(rows, rows)
    return outcomes.running_max(progress, ["predict_compile", "predict_execution"])


def _pairs(spark, sf_dir):
    return outcomes.side_by_side(views.evaluations(spark, sf_dir, "a"), views.evaluations(spark, sf_dir, "b"))


_PAIR = (
    ctes("ev")
    + """
, pr AS (SELECT idx, coalesce(min(retry) FILTER (exec_a), 10) AS ra, coalesce(min(retry) FILTER (exec_b), 10) AS rb,
  bool_or(exec_a) AS a, bool_or(exec_b) AS b, bool_or(comp) AS c FROM ev GROUP BY 1)"""
)


@query(
    _PAIR
    + """
SELECT count(*) FILTER (a AND b) AS both_true, count(*) FILTER (NOT a AND NOT b) AS both_false,
  count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b,
  count(*) FILTER (a = b) AS n_match, round(count(*) FILTER (a = b) * 100.0 / count(*), 1) AS match_rate FROM pr"""
)
def run_contingency(spark, sf_dir):
    return outcomes.contingency(_pairs(spark, sf_dir))


@query(
    _PAIR
    + """
SELECT idx, ra || '/' || rb AS rounds, CASE WHEN a THEN '✓' ELSE '✗' END AS a, CASE WHEN b THEN '✓' ELSE '✗' END AS b,
  CASE WHEN a = b THEN '✓' ELSE '✗' END AS match FROM pr"""
)
def run_side_by_side(spark, sf_dir):
    return reports.pass_table(_pairs(spark, sf_dir))


@query(_PAIR + " SELECT idx, NOT c AS compile_failed, c AS compiled_not_executed FROM pr WHERE NOT a")
def failed_sets(spark, sf_dir):
    return outcomes.failed_sets(_pairs(spark, sf_dir), "left")


@query(_PAIR + " SELECT idx, NOT c AS compile_failed, c AS compiled_not_executed FROM pr WHERE NOT a AND NOT b")
def failed_sets_both(spark, sf_dir):
    return outcomes.failed_sets(_pairs(spark, sf_dir), "both")


_CELLS = ", ".join(
    f"coalesce(CAST(sum(n) FILTER (retry = {r}) AS BIGINT)::VARCHAR, '-') AS retry_{str(r).replace('-', 'm')}"
    for r in range(-1, 11)
) + ", coalesce(CAST(sum(n) FILTER (retry > 10) AS BIGINT)::VARCHAR, '-') AS retry_later"


@query(
    ctes("ev")
    + f""", c AS (SELECT idx, retry, count(*) FILTER (comp) AS n FROM ev GROUP BY 1, 2)
SELECT idx, {_CELLS} FROM c GROUP BY 1"""
)
def pass_matrix(spark, sf_dir):
    """Record by round matrix of compiled choices."""
    return reports.compiled_matrix(views.evaluations(spark, sf_dir))


@query(
    ctes("ev")
    + """
SELECT idx, retry, choice, comp AS compiled, exec_a AS executed,
  CASE WHEN length(error_msg) > 50 THEN left(error_msg, 50) || '...' ELSE error_msg END AS error FROM ev"""
)
def generation_table(spark, sf_dir):
    return reports.generation_table(views.evaluations(spark, sf_dir))
