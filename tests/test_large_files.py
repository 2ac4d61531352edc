"""Files read in splits, and files read by a list."""

import json
import random

import pytest

from pyspark.sql import functions as F

from irquarry.plans import stores
from irquarry.sources import readers


def _array(rng, n):
    text = lambda: "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "é", "中", "\n", "a", " "]) for _ in range(rng.randint(0, 12)))
    rows = []
    for i in range(n):
        row = {"file": f"f{i}", "predict": rng.choice([text(), [text(), text()], []]), "input": text(), "predict_compile_success": [True]}
        if rng.random() < 0.3:
            row["extra"] = {"deep": {"er": text()}, "list": [{"x": text()}, {}]}
        rows.append(row)
    return rows


@pytest.mark.parametrize("split_bytes", [97, 1000, 1 << 20])
def test_json_arrays_in_splits(spark, tmp_path, split_bytes):
    rng = random.Random(split_bytes)
    files = {f"p{i}.json": _array(rng, n) for i, n in enumerate((40, 0, 1, 25))}
    for i, (name, rows) in enumerate(files.items()):
        (tmp_path / name).write_text(json.dumps(rows, indent=[None, 2][i % 2], ensure_ascii=i > 1))
    (tmp_path / "q.json").write_text("")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        elements = readers.json_array_elements(spark, str(tmp_path))
        got = {}
        for r in elements.collect():
            got.setdefault(r["file"].rsplit("/", 1)[1], {})[r["element"]] = json.loads(r["text"])
        assert got == {name: dict(enumerate(rows)) for name, rows in files.items() if rows}
        predictions = {r["idx"]: r for r in readers.predictions(spark, str(tmp_path)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    rows = [row for name in sorted(files) for row in files[name]]
    assert sorted(predictions) == list(range(len(rows)))
    for i, row in enumerate(rows):
        assert (predictions[i]["file"], predictions[i]["input"]) == (row["file"], row["input"])


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"file": f"f{i}", "predict": "x" * 100} for i in range(200)]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 5
        assert readers.predictions(spark, str(tmp_path)).count() == 200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def _files_opened(df):
    """Files that the scans of an executed plan have read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_only_listed_files_are_opened(spark, tmp_path):
    names = ["plain.txt", "with space.txt", "a=b.txt", "per%cent.txt", "ünï.txt"] + [f"other{i}.txt" for i in range(20)]
    for name in names:
        (tmp_path / "d").mkdir(exist_ok=True)
        (tmp_path / "d" / name).write_text(name)
    wanted = [str(tmp_path / "d" / n) for n in names[:5]]
    files = readers._named_files(spark, str(tmp_path), "*.txt")
    chosen = lambda: readers.listed_files(files, wanted, str(tmp_path)).select("value")
    assert sorted(r[0] for r in chosen().collect()) == sorted(names[:5])
    assert _files_opened(chosen()) == 5 and _files_opened(files.select("value")) == 25
    manifest = tmp_path / "list"
    manifest.write_text("\n".join([*wanted, wanted[0], f"file://{wanted[1]}", str(tmp_path / "d" / "missing.txt")]))
    for batch in (10_000, 2):
        rows = readers.manifest_errors(spark, str(manifest), str(tmp_path), "*.txt", batch).collect()
        assert sorted(r["error_msg"] for r in rows) == sorted(names[:5])
    (tmp_path / "none").write_text("\n")
    assert readers.manifest_errors(spark, str(tmp_path / "none"), str(tmp_path), "*.txt").count() == 0


def test_error_files_are_written_and_listed_by_several_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(90).select(F.col("id").alias("s_suppkey"), (F.col("id") % 3).alias("s_nationkey"), F.lit("s").alias("s_name"))
    rows.coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(stores, "FILES_A_TASK", 10)
    before = spark.conf.get(readers._LISTING)
    found = stores.error_file_tree(spark, str(tmp_path)).collect()
    assert sorted(r["supplier"] for r in found) == list(range(90)) and {r["n_lines"] for r in found} == {3}
    files = [r["file"] for r in readers.error_paths(spark, stores._error_files(spark, str(tmp_path)), "part-*.txt").collect()]
    assert len(files) == 90 and len({f.split("/part-")[1][:5] for f in files}) > 4
    assert spark.conf.get(readers._LISTING) == before


def test_a_batch_asks_for_each_found_file_once(spark, tmp_path, monkeypatch):
    for i in range(6):
        (tmp_path / f"e{i}.txt").write_text(str(i))
    (tmp_path / "list").write_text("\n".join(str(tmp_path / f"e{i}.txt") for i in range(9)))
    asked = []
    isin = type(F.lit(1)).isin
    monkeypatch.setattr(type(F.lit(1)), "isin", lambda self, *paths: asked.extend(paths[0]) or isin(self, *paths))
    rows = readers.manifest_errors(spark, str(tmp_path / "list"), str(tmp_path), "*.txt").collect()
    assert sorted(r["error_msg"] for r in rows) == [str(i) for i in range(6)]
    assert len(asked) == 6


def test_files_are_listed_by_batches_of_folders(spark, tmp_path, monkeypatch):
    """However many files lie below a folder, only some are listed at once, and the same ones as in one piece."""
    names = ["a/x/1.txt", "a/x/2.txt", "a/y/3.txt", "a/4.txt", "b/5.txt", "b/5.log", "c [1]{2}*/6 7.txt", "8.txt", "_a=b/9.txt", "e/.h/10.txt"]
    names += ["_hidden/11.txt", "_12.txt", ".13.txt", "d/14.txt._COPYING_", *(f"many/{i}.txt" for i in range(100, 112))]
    for name in names:
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_text(name)
    (tmp_path / "root" / "empty").mkdir()
    root = str(tmp_path / "root")
    whole = sorted(r["file"] for r in readers.error_paths(spark, root, "*.txt").collect())
    assert len(whole) == 8 + 12
    (tmp_path / "list").write_text("\n".join(f"{root}/{n}" for n in names))
    listed, lists = [], readers._named_files

    def counted(spark, root, name, source="text"):
        files = lists(spark, root, "*", source)
        listed.append(files.select("_metadata.file_path").count())
        return lists(spark, root, name, source)

    monkeypatch.setattr(readers, "_named_files", counted)
    for most in (3, 1):
        monkeypatch.setattr(readers, "LISTED_FILES", most, raising=False)
        assert sorted(r["file"] for r in readers.error_paths(spark, root, "*.txt").collect()) == whole
        rows = readers.manifest_errors(spark, str(tmp_path / "list"), root, "*.txt", 2).collect()
        assert sorted(r["file"] for r in rows) == whole
        assert sorted(r["error_msg"] for r in rows) == sorted(n for n in names if (n.endswith(".txt") and "_hidden" not in n and "/." not in n and n[:2] not in ("_1", ".1")))
        assert max(listed) <= most and len(listed) > 2 * len(whole) // most
        listed.clear()
