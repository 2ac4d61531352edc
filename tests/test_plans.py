"""Plans that must hold at scale: pruning before shuffles, narrow scans, no hot task."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from irquarry.operators import dedup, outcomes, predicates, ranking, scoring
from irquarry.plans import views

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keep_last_prunes_before_the_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("key"), F.col("id").alias("idx"))
    assert plan_of(ranking.keep_last(rows, ["key"])).count("WindowGroupLimit") == 2


def test_dedup_prunes_before_the_shuffle(spark):
    plan = plan_of(dedup.blocked_dedup(views.functions(spark, SF_DIR)))
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize(
    "name, columns",
    [
        ("differ_logs", {"doc_id", "text"}),
        ("round_summary", {"event_id", "event_type"}),
        ("cfg_sizes", {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"}),
        ("shard_counts", {"doc_id", "vec_id"}),
        ("topk_cosine", {"vec_id", "embedding"}),
    ],
)
def test_scans_read_only_what_they_need(spark, name, columns):
    plan = plan_of(contract.queries()[name](spark, SF_DIR))
    read = set()
    for part in plan.split("ReadSchema: struct<")[1:]:
        read |= {c.split(":")[0] for c in part.split(">")[0].split(",") if ":" in c}
    assert read == columns


def test_nested_fields_are_pruned(spark, tmp_path):
    path = str(tmp_path / "functions")
    views.functions(spark, SF_DIR).write.parquet(path)
    plan = plan_of(predicates.stage_counts(spark.read.parquet(path), predicates.hard_set_stages()))
    schema = plan.split("ReadSchema: ")[1]
    assert "func_info" in schema and "bb_list_size" in schema
    assert "asm" not in schema and "func_def" not in schema and "code" not in schema


def test_range_filter_reaches_the_scan(spark):
    plan = plan_of(views.table(spark, SF_DIR, "events").where("event_id >= 10 and event_id < 20"))
    assert "PushedFilters: [IsNotNull(event_id), GreaterThanOrEqual(event_id,10)" in plan


def test_stage_counts_are_one_pass(spark):
    plan = plan_of(contract.queries()["predicate_cascade"](spark, SF_DIR))
    assert plan.count("FileScan") == 1


def test_hot_key_scoring(spark):
    """Two thirds of the predictions and of the corpus share one key."""
    n = 120_000
    key = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    corpus = spark.range(n).select(F.col("id").alias("idx"), key.alias("path"), F.lit("t").alias("func_head_types"))
    predictions = corpus.select("idx", F.col("path").alias("file"), "func_head_types")
    matched = scoring.match_predictions(predictions, corpus)
    assert matched.count() == n // 3 + 1
    hot = matched.where("key = 'hot:t'").head()
    assert hot["idx"] == n - 1 and hot["row"]["idx"] == n - 1


def test_hot_record_outcomes(spark):
    n = 100_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id")).alias("idx"),
        (F.col("id") % 11 - 1).cast("int").alias("retry"),
        F.col("id").cast("int").alias("choice"),
        (F.col("id") % 2 == 0).alias("compile_success"),
        (F.col("id") == n - 2).alias("execution_success"),
    )
    row = outcomes.record_summary(rows).where("idx = -1").head()
    assert row["any_compile"] and row["first_round"] == ((n - 2) % 11) - 1
