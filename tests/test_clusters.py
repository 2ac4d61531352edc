"""Classes of linked rows and of similar sets, canonical names: brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from irquarry.operators import clusters, dedup


def _classes(n, linked):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return [root(i) for i in range(n)]


def test_connected(table):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (99, 99)]
    got = {r["node"]: r["label"] for r in clusters.connected(table(edges, "left long, right long")).collect()}
    want = _classes(200, edges)
    assert got == {n: want[n] for e in edges for n in e}
    assert clusters.connected(table([], "left long, right long")).count() == 0
    assert [tuple(r) for r in clusters.connected(table([(5, 5)], "left long, right long")).collect()] == [(5, 5)]


def _sets(n, seed):
    rng = random.Random(seed)
    bases = [rng.sample(range(200), rng.randint(1, 25)) for _ in range(8)]
    rows = []
    for i in range(n):
        found = set(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            found ^= {rng.randrange(200)}
        rows.append((i, rng.randrange(2), [*found, *list(found)[:2]]))
    return rows + [(n, 0, []), (n + 1, 0, []), (n + 2, 1, [1])]


@pytest.mark.parametrize(("least", "cell"), [(0.8, 4096), (0.8, 20), (0.5, 4096), (1.0, 4096)])
def test_similar_classes(table, monkeypatch, least, cell):
    monkeypatch.setattr(clusters, "CELL_ROWS", cell)
    monkeypatch.setattr(clusters, "BLOCK", 16)
    monkeypatch.setattr(clusters, "COLUMNS", 10)
    rows = _sets(150, 4)
    linked = [
        (a, b)
        for a, block, x in rows
        for b, other, y in rows
        if a < b and block == other and (set(x) == set(y) or set(x) and len(set(x) & set(y)) >= least * len(set(x) | set(y)) - 1e-9)
    ]
    got = clusters.similar_classes(table(rows, "idx long, block int, elements array<long>"), least)
    want = _classes(len(rows), linked)
    assert {r["idx"]: r["first"] for r in got.collect()} == dict(enumerate(want))


def test_only_rows_that_may_be_similar_are_compared(table, monkeypatch):
    """Rare words in common make chains of whole blocks; only sets that can be similar are handed on and compared."""
    words = random.Random(1).sample(range(1 << 40), 4100)
    rows = [(i, 0, words[20 * i : 20 * i + 40]) for i in range(200)]
    rows += [(200, 0, rows[7][2][:-1] + [1]), (201, 1, rows[7][2])]
    compared, cells = [], clusters.cells

    def seen(members):
        compared.extend(r["node"] for r in members.select("node").collect())
        return cells(members)

    monkeypatch.setattr(clusters, "cells", seen)
    got = clusters.similar_classes(table(rows, "idx long, block int, elements array<long>"), 0.8)
    assert {r["idx"]: r["first"] for r in got.collect()} == {i: 7 if i == 200 else i for i in range(202)}
    assert sorted(compared) == [7, 200]


def test_crowded_meetings(spark, table, monkeypatch):
    """Rows of a key that spread over batches, or are too many to be compared in one task, lose no link."""
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = _sets(150, 5)
        found = {}
        for most in (3, 2048):
            monkeypatch.setattr(clusters, "MEETING_ROWS", most)
            got = clusters.similar_classes(table(rows, "idx long, block int, elements array<long>"), 0.8)
            found[most] = {r["idx"]: r["first"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    linked = [
        (a, b)
        for a, block, x in rows
        for b, other, y in rows
        if a < b and block == other and (set(x) == set(y) or set(x) and len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y)) - 1e-9)
    ]
    assert found[3] == found[2048] == dict(enumerate(_classes(len(rows), linked)))


def test_rows_grow_with_a_group(table):
    found = {}
    for n in (300, 600):
        rows = [(0, i, list(range(40)) + [1000 + i]) for i in range(n)]
        found[n] = clusters.cells(table(rows, "group long, node long, elements array<long>")).count()
    assert found == {300: 300, 600: 600}


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets[:11]] for a in sets]
    assert clusters.shared_counts(sets, sets[:11]).tolist() == want


IR = "; ModuleID = 'm'\nsource_filename = \"x\"\ndefine i32 @f(i32 %a, i32 %b) {\nentry:\n  %s = add i32 %a, %b ; sum\n  br label %done\ndone:\n  ret i32 %s, !dbg !12\n}"


def test_canonical_names(evaluate):
    form = lambda text: evaluate(dedup.canonical_names(F.col("t")), t=text)
    assert form(IR) == "define i32 @1(i32 %1, i32 %2) {\n%3:\n  %4 = add i32 %1, %2\n  br label %5\n%5:\n  ret i32 %4, !1\n}".replace(
        "ret i32 %4, !1", "ret i32 %4, !dbg !1"
    )
    renamed = IR.replace("%a", "%\"first one\"").replace("%s", "%0").replace("done", "exit.1").replace("@f", "@g").replace("!12", "!3")
    assert form(renamed) == form(IR)
    assert form(IR.replace("%a, %b ; sum", "%a, %a")) != form(IR)
    assert form(IR.replace("label %done", "label %entry")) != form(IR)
    assert form(IR.replace("add", "sub")) != form(IR)
    assert form("") == "" and form(None) is None


def test_modes_of_equality(spark):
    ir = lambda names: "define @{0}() {{\n  %{1} = add i32 %{2}, %{3}\n}}".format(*names)
    rows = [(0, ir("fabc")), (1, ir("gxyz")), (2, ir("fabb")), (3, ir("fabc"))]
    df = spark.createDataFrame(rows, "idx long, text string").select(
        "idx",
        F.struct(
            F.array("text").alias("code"),
            F.struct(F.lit("f").alias("func_name"), F.lit(1).alias("bbcount"), F.array(F.lit(3)).alias("bb_list_size")).alias("bb_count"),
        ).alias("llvm_ir"),
    )
    kept = {mode: sorted(r["idx"] for r in dedup.blocked_dedup(df, mode).collect()) for mode in ("exact", "canonical", "structural")}
    assert kept == {"exact": [0, 1, 2], "canonical": [0, 2], "structural": [0]}
    words = F.transform(F.split(F.get("llvm_ir.code", F.lit(0)), r"\s+"), lambda w: F.xxhash64(w))
    assert sorted(r["idx"] for r in dedup.fuzzy_dedup(df, words, 0.9).collect()) == [0, 1, 2]
    assert sorted(r["idx"] for r in dedup.fuzzy_dedup(df, words, 0.75).collect()) == [0, 1]
    assert sorted(r["idx"] for r in dedup.fuzzy_dedup(df, words, 0.9, max_inst=2).collect()) == [0, 1, 2, 3]
