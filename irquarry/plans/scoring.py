"""Scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from irquarry.operators import records, scoring
from irquarry.operators.predicates import row_flags
from irquarry.plans import views
from irquarry.plans.registry import query
from irquarry.plans.views import ctes


@query(
    ctes("pred", "corpus")
    + """
SELECT count(*) AS n_records,
  count(*) FILTER (any_compile) AS predict_compile_success,
  count(*) FILTER (any_exec) AS predict_execution_success,
  count(*) FILTER (t_compile) AS target_compile_success,
  count(*) FILTER (t_exec) AS target_execution_success
FROM pred_last JOIN corpus USING (key)"""
)
def score_predictions(spark, sf_dir):
    """The scoring job: normalise, guard, join by key, count any-choice successes.

    Texts are judged before the join, so only keys and flags are shuffled.
    """
    predictions = records.normalize_predictions(views.predictions(spark, sf_dir))
    matched = scoring.match_predictions(
        scoring.guard_target(predictions), views.functions(spark, sf_dir)
    )
    return scoring.score_totals(matched)


@query(ctes("pred", "corpus") + " SELECT idx, row_idx, key, text AS first_predict FROM pred_last JOIN corpus USING (key)")
def matched_predictions(spark, sf_dir):
    predictions = records.normalize_predictions(views.predictions(spark, sf_dir))
    matched = scoring.match_predictions(predictions, views.functions(spark, sf_dir))
    return matched.select(
        "idx", F.col("row.idx").alias("row_idx"), "key", F.get("predict", F.lit(0)).alias("first_predict")
    )


@query(ctes("pred", "corpus") + " SELECT idx, key FROM pred_last ANTI JOIN corpus USING (key)")
def unmatched_predictions(spark, sf_dir):
    missing = scoring.unmatched_predictions(
        views.predictions(spark, sf_dir), views.functions(spark, sf_dir)
    )
    return missing.select("idx", "key")


@query(
    """
SELECT quality = 1 AS compiled, count(*) AS n_records,
  round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END) * 100, 1) AS toxic_flag_pct
FROM labels GROUP BY 1"""
)
def success_rates(spark, sf_dir):
    labels = views.table(spark, sf_dir, "labels").select(
        (F.col("quality") == 1).alias("compiled"), (F.col("toxic") == 1).alias("toxic_flag")
    )
    return scoring.success_rates(labels, ["toxic_flag"], by=["compiled"])


_SAMPLE = ctes("fn") + ", sample AS (SELECT idx, path, func_head FROM fn JOIN labels ON idx = doc_id)"


def _sample(spark, sf_dir):
    labels = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"))
    return views.functions(spark, sf_dir).select("idx", "path", "func_head").join(labels, "idx")


@query(
    _SAMPLE
    + """
SELECT idx, path, func_head FROM sample
WHERE EXISTS (SELECT 1 FROM fn v WHERE v.is_valid AND v.path = sample.path AND v.func_head = sample.func_head)"""
)
def leak_semi_join(spark, sf_dir):
    """Sample functions that the validation split holds too."""
    split = views.functions(spark, sf_dir).where("split = 'valid_synth'")
    return scoring.shared_functions(_sample(spark, sf_dir), split, False).select("idx", "path", "func_head")


@query(
    _SAMPLE
    + """
SELECT sample.idx, sample.path, sample.func_head, count(*) AS n_matches
FROM sample JOIN fn t ON NOT t.is_valid AND t.path = sample.path AND t.func_head = sample.func_head
GROUP BY ALL"""
)
def leak_inner_join(spark, sf_dir):
    """Matches of each sample function in the test split."""
    split = views.functions(spark, sf_dir).where("split = 'test_synth'")
    shared = scoring.shared_functions(_sample(spark, sf_dir), split, True)
    return shared.select("idx", "path", "func_head", "n_matches")


@query(
    """
WITH shown AS (SELECT doc_id AS idx, text FROM documents)
SELECT s.idx, s.text AS target_ir, s.text AS predict,
  l.quality = 1 AS predict_compile_success,
  l.quality = 1 AND l.toxic <> 1 AND s.idx % 3 = 0 AS predict_execution_success,
  l.quality = 1 AS target_compile_success, l.quality = 1 AND s.idx % 2 = 0 AS target_execution_success
FROM shown s JOIN labels l ON l.doc_id = s.idx"""
)
def sample_view(spark, sf_dir):
    """Flat viewer rows of the first prediction."""
    predictions = records.normalize_predictions(views.predictions(spark, sf_dir))
    rows = records.sample_view(views.functions(spark, sf_dir), predictions, 0)
    return rows.drop("path", "target_assembly", "message")


@query(
    """
SELECT o_orderkey AS idx, coalesce(bool_and(l_quantity = ceil(l_quantity) AND l_tax < 0.08), TRUE) AS io_success
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""
)
def io_verdict(spark, sf_dir):
    """All cases of a record pass; a record without cases passes.

    Cases are line items, reduced to a flag per record before the join with the records.
    """
    item = views.table(spark, sf_dir, "lineitem")
    case_ok = (F.col("l_quantity") == F.ceil("l_quantity")) & (F.col("l_tax") < 0.08)
    cases = item.select(
        F.col("l_orderkey").alias("idx"), F.lit("1").alias("expected"), case_ok.cast("int").cast("string").alias("observed")
    )
    known = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))
    return scoring.io_verdict_rows(known, cases)


@query(
    """
SELECT doc_id AS idx, quality = toxic AS io_success FROM labels"""
)
def io_verdict_arrays(spark, sf_dir):
    """The verdict over case arrays inside the record."""
    rows = views.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("idx"),
        F.array(F.lit(1), F.col("quality")).alias("expected"),
        F.array(F.lit(1), F.col("toxic")).alias("observed"),
    )
    return scoring.io_verdict(rows)


@query(
    """
WITH t AS (SELECT c.conv_id, c.turn, c.text, c.turn % 3 <> 0 AS compiled,
    c.text = d.text OR length(c.text) = length(d.text) AS perfect
  FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id),
p AS (SELECT conv_id, bool_or(compiled) AS c, coalesce(bool_or(coalesce(perfect, FALSE)), FALSE) AS p FROM t GROUP BY 1)
SELECT count(*) AS n_programs, count(*) FILTER (c) AS n_compiled, count(*) FILTER (c AND p) AS n_perfect FROM p"""
)
def program_totals(spark, sf_dir):
    """Programs with a compiled and with a perfect choice; text or compiled text must agree."""
    doc = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("target_ir"))
    turns = views.table(spark, sf_dir, "conversations").join(doc, "conv_id", "left")
    choices = turns.select(
        "conv_id",
        F.col("text").alias("predict_ir"),
        "target_ir",
        F.length("text").alias("predict_assembly"),
        F.length("target_ir").alias("target_assembly"),
        (F.col("turn") % 3 != 0).alias("compile_success"),
    )
    return scoring.program_totals(scoring.text_perfect(choices), "conv_id")


@query(
    ctes("fn")
    + """
SELECT idx, inst > 50 AS many_instructions, num_loops > 0 AS loops, n_called > 0 AS calls,
  n_unused = 0 AS no_unused_args, has_structs AS structs, has_structs AND NOT all_fields AS unread_fields,
  bbcount > 3 AS blocks, bbcount = 1 AS one_block, bbcount <= 20 AS small_function,
  token_length < 4096 AS short, length(code) > 0 AS has_code
FROM fn"""
)
def predicate_flags(spark, sf_dir):
    """Every structural predicate per record."""
    return row_flags(views.functions(spark, sf_dir))
