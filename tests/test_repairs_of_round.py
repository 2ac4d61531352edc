"""Faults found by review: each case here once gave a wrong answer or a crash."""

import json

from pyspark.sql import functions as F
from test_graphs import _program

from irquarry.operators import graphs, matching, retrieval, stages
from irquarry.sources import readers

CELLS = "idx long, bbcount int, token_length int"


def test_positions_count_through_prediction_files(spark, tmp_path):
    for name, texts in (("a", ["p", "[rax"]), ("b", ["q"])):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"file": name, "predict": t} for t in texts]))
    rows = {r["idx"]: r["predict"] for r in readers.predictions(spark, str(tmp_path)).collect()}
    assert rows == {0: ["p"], 1: ["[rax"], 2: ["q"]}


def test_widening_match_with_gaps(table):
    probes = table([(0, None, 5), (1, 3, 5), (2, 3, None)], CELLS)
    candidates = table([(7, None, 5), (8, 4, None), (9, 4, 5)], CELLS)
    rows = {r["idx"]: r["matched_idx"] for r in matching.widening_match(probes, candidates).collect()}
    assert rows == {0: None, 1: 9, 2: None}
    without = matching.widening_match(probes, candidates.where("idx < 9")).collect()
    assert all(r["matched_idx"] is None for r in without)


def test_points_embed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return [[float(len(t))] for t in texts]

    texts = spark.range(5).select(F.lit(0).alias("shard"), F.col("id").alias("record_id"), F.lit("t").alias("text"))
    embedded = stages.embedding_stage(texts, "text", embed)
    points = retrieval.build_points(texts.withColumn("path", F.lit("p")), embedded).collect()
    assert sorted(r["point_id"] for r in points) == list(range(5)) and calls.value == 5


def test_a_failing_call_loses_its_own_rows_only(table):
    def broken(texts):
        if "bad" in texts:
            raise RuntimeError("no answer")
        return [[t, t] for t in texts]

    prompts = table([(0, 0, "good"), (1, 0, "bad"), (2, 0, "fine")], "idx long, retry int, prompt string")
    rows = stages.generation_stage(prompts, broken).collect()
    assert sorted({r["idx"] for r in rows}) == [0, 2] and len(rows) == 4


def test_first_executed_candidate_is_compared(table):
    wrong, right, later = (_program([1, n], [[1, n]]) for n in (2, 3, 4))
    evaluations = table(
        [(0, 0, 0, False, wrong), (0, 0, 1, True, right), (0, 1, 0, True, later)],
        "idx long, retry int, choice int, execution_success boolean, predict string",
    )
    targets = table([(0, _program([5, 6], [[5, 6]]))], "idx long, target string")
    edges = graphs.compare_first_executed(evaluations, targets, "predict", "target")
    assert {(r["side"], r["src"], r["dst"]) for r in edges.collect()} == {("predict", 1, 3), ("target", 5, 6)}
