"""Readers, writers and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from irquarry.operators import retrieval
from irquarry.schemas import FUNCTIONS, PREDICTIONS, struct
from irquarry.sources import readers, sinks
from irquarry.streaming import predictions as stream


def test_positions_follow_files_and_rows(spark, tmp_path):
    for name, lo in (("b", 100), ("a", 0)):
        spark.range(lo, lo + 50).coalesce(1).write.parquet(str(tmp_path / name))
    df = readers.positioned(spark, [str(tmp_path / "b"), str(tmp_path / "a")])
    rows = {r["idx"]: r["id"] for r in df.collect()}
    assert sorted(rows) == list(range(100)) and [rows[i] for i in range(50)] == list(range(50))


def test_merged_positions(spark):
    df = spark.createDataFrame([(1, 0, "c"), (0, 5, "b"), (0, 0, "a"), (1, 3, "d")], "shard int, idx long, v string")
    rows = {r["idx"]: r["v"] for r in readers.merged(df).collect()}
    assert rows == {0: "a", 1: "b", 2: "c", 3: "d"}


def test_shards_and_splits(spark, tmp_path):
    schema = struct(FUNCTIONS)
    for i in range(3):
        row = {f: None for f in schema.fieldNames()} | {"idx": 0, "path": f"p{i}", "split": "valid_synth" if i else "test_synth"}
        spark.createDataFrame([row], schema).write.parquet(str(tmp_path / f"part_{i}"))
    df = readers.shards(spark, str(tmp_path / "part_{idx}"), [0, 2])
    assert sorted((r["shard"], r["path"]) for r in df.collect()) == [(0, "p0"), (2, "p2")]
    out = str(tmp_path / "whole")
    readers.shards(spark, str(tmp_path / "part_{idx}"), [0, 1, 2]).write.partitionBy("split").parquet(out)
    assert readers.split(spark, out, "valid_synth").count() == 2


RECORDS = [
    {"file": "a.c", "func_head_types": "t", "predict": "one", "predict_compile_success": True, "output": ["x"], "target_compile_success": True},
    {"file": "b.c", "func_head_types": "t", "predict": ["p", "q"], "predict_compile_success": [True, False], "output": "y"},
]


def test_predictions_union_types(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps(RECORDS, indent=2))
    rows = {r["idx"]: r for r in readers.predictions(spark, str(path)).collect()}
    assert rows[0]["predict"] == ["one"] and rows[0]["predict_compile_success"] == [True] and rows[0]["output"] == ["x"]
    assert rows[1]["predict"] == ["p", "q"] and rows[1]["predict_compile_success"] == [True, False]
    assert rows[1]["output"] == ["y"] and rows[1]["predict_execution_success"] is None
    lines = tmp_path / "p.jsonl"
    lines.write_text("\n".join(json.dumps({"idx": i, **r}) for i, r in enumerate(RECORDS)))
    again = {r["idx"]: r for r in readers.predictions_lines(spark, str(lines)).collect()}
    assert again == rows


def test_error_files_and_manifest(spark, tmp_path):
    for sub in ("x/y", "z"):
        (tmp_path / sub).mkdir(parents=True)
        (tmp_path / sub / "error_predict.error").write_text(f"llc: error: a\n{sub}")
        (tmp_path / sub / "other.error").write_text("no")
    found = readers.error_files(spark, str(tmp_path)).collect()
    assert sorted(r["error_msg"].split("\n")[1] for r in found) == ["x/y", "z"]
    manifest = tmp_path / "list.txt"
    manifest.write_text(f"  {tmp_path}/z/error_predict.error \n\n")
    rows = readers.manifest_errors(spark, str(manifest), str(tmp_path), "*.error").collect()
    assert [r["error_msg"] for r in rows] == ["llc: error: a\nz"]


def test_project_counts(spark, tmp_path):
    spark.createDataFrame([("f", [1, 2]), ("g", None)], "name string, bbcount array<int>").write.parquet(str(tmp_path / "p"))
    assert [r[0] for r in readers.project_block_counts(spark, str(tmp_path / "p")).collect()] == [2]


def test_vector_store_replaces_only_given_shards(spark, tmp_path):
    path = str(tmp_path / "v")
    make = lambda rows: spark.createDataFrame(rows, "shard int, point_id long, record_id long, path string, embedding array<float>")
    sinks.save_vectors(make([(0, 0, 0, "a", [1.0]), (1, 0, 0, "b", [1.0])]), path)
    sinks.save_vectors(make([(1, 0, 5, "c", [2.0]), (1, 1, 6, "d", [2.0])]), path)
    assert sorted(tuple(r) for r in readers.collection_ids(spark, path).collect()) == [(0, 0), (1, 5), (1, 6)]


def test_sinks(spark, tmp_path):
    df = spark.range(20).select(
        F.col("id").alias("idx"),
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"),
        F.struct(F.array(F.lit("ir\n")).alias("code")).alias("llvm_ir"),
    )
    sinks.save_dataset(df, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 20
    sinks.save_sample(df, str(tmp_path / "s"), n=5)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 5
    with pytest.raises(Exception):
        sinks.save_sample(df, str(tmp_path / "s"), n=5)
    with pytest.raises(ValueError):
        sinks.save_sample(df, str(tmp_path / "t"), n=50)
    assert not (tmp_path / "t").exists()
    sinks.dump_ir(df, str(tmp_path / "ir"))
    assert spark.read.parquet(str(tmp_path / "ir")).where("idx = 3").head()["text"] == ";cpath: p3\nir\n"
    sinks.dump_ir_files(df.where("idx < 2"), str(tmp_path / "files"))
    text = next((tmp_path / "files" / "idx=1").glob("*.txt")).read_text()
    assert text.startswith(";cpath: p1\nir\n")
    sinks.save_results_json(df.select("idx", "path"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 20


def test_runs(spark, tmp_path):
    rows = [(0, -1, 0, True, True, "", "a", "s"), (0, 0, 1, True, False, "", "b", "s")]
    ddl = "idx long, retry int, choice int, compile_success boolean, execution_success boolean, error_msg string, llvm_ir string, assembly string"
    df = spark.createDataFrame(rows, ddl)
    sinks.save_run(df, str(tmp_path))
    assert readers.run_results(spark, str(tmp_path)).count() == 2
    assert readers.saved_responses(spark, str(tmp_path)).count() == 0
    sinks.export_correct_ir(df, -1, str(tmp_path / "ok"))
    assert spark.read.parquet(str(tmp_path / "ok")).head()["llvm_ir"] == "a"
    targets = spark.createDataFrame([(0, "t")], "idx long, target_ir string")
    sinks.export_failed_samples(df, targets, str(tmp_path / "bad"))
    got = spark.read.parquet(str(tmp_path / "bad")).head()
    assert (got["retry"], got["llvm_ir"], got["target_ir"]) == (0, "b", "t")


def test_embedding_input(spark):
    df = spark.createDataFrame(
        [(0, 1, "p", {"code": ["a", "nop # c\n"]}), (1, 1, "q", {"code": []})],
        "idx long, shard int, path string, asm struct<code: array<string>>",
    )
    assert [tuple(r) for r in retrieval.embedding_input(df).collect()] == [(1, 0, "p", "nop\n")]


def test_stream_scores_each_prediction_once(spark, tmp_path):
    corpus = spark.createDataFrame([(0, "a.c", "t"), (1, "b.c", "t")], "idx long, path string, func_head_types string")
    source, store = str(tmp_path / "in"), str(tmp_path / "scores")

    def drop(rows):
        schema = struct(PREDICTIONS)
        full = [{f: None for f in schema.fieldNames()} | r for r in rows]
        spark.createDataFrame(full, schema).coalesce(1).write.mode("append").parquet(source)

    def follow(checkpoint):
        stream.score_stream(spark, source, corpus, store, str(tmp_path / checkpoint), "r1").awaitTermination()
        return {r["idx"]: r["predict_compile"] for r in spark.read.parquet(store).collect()}, spark.read.parquet(store).count()

    one = dict(file="a.c", func_head_types="t", predict=["x"], predict_compile_success=[True], predict_execution_success=[False])
    drop([{"idx": 0, **one}])
    assert follow("c") == ({0: True}, 1)
    drop([{"idx": 1, **one, "file": "b.c"}, {"idx": 2, **one, "file": "zz"}])
    assert follow("c") == ({0: True, 1: True}, 2)
    assert follow("fresh")[1] == 2  # a replay from scratch appends nothing
