"""Matched sampling, ranks and deduplication against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from irquarry.operators import dedup, matching, ranking, sampling

SCHEMA = "idx long, bbcount int, token_length int"


def best(probe, candidates, step, with_blocks):
    _, bb, tok = probe
    if not tok:
        return None, None
    options = [
        (max(abs(cb - bb) if with_blocks else 0, abs(ct - tok) * step // tok), ci)
        for ci, cb, ct in candidates
    ]
    return min(options)


@pytest.mark.parametrize("step, with_blocks, seed", [(10, True, 1), (10, True, 2), (100, False, 3), (100, False, 4)])
def test_widening_match(spark, table, step, with_blocks, seed):
    rng = random.Random(seed)
    probes = [(i, rng.randint(1, 40), rng.choice([0, 1, 7, rng.randint(1, 5000)])) for i in range(120)]
    candidates = [(i, rng.randint(1, 12), rng.randint(0, 900)) for i in range(40)]
    got = matching.widening_match(table(probes, SCHEMA), table(candidates, SCHEMA), step, with_blocks)
    rows = {r["idx"]: (r["level"], r["matched_idx"]) for r in got.collect()}
    assert rows == {p[0]: best(p, candidates, step, with_blocks) for p in probes}


def test_widening_steps_follow_the_loop(table):
    """The closed form equals widening both thresholds one step at a time."""

    def widen(probe, candidates):
        k = 0
        while True:
            for ci, cb, ct in candidates:
                if abs(cb - probe[1]) < 1 + k and abs(ct - probe[2]) * 10 < (1 + k) * probe[2]:
                    return k, ci
            k += 1

    rng = random.Random(8)
    candidates = [(i, rng.randint(1, 9), rng.randint(1, 400)) for i in range(30)]
    probes = [(i, rng.randint(1, 9), rng.randint(1, 400)) for i in range(50)]
    got = matching.widening_match(table(probes, SCHEMA), table(candidates, SCHEMA))
    rows = {r["idx"]: (r["level"], r["matched_idx"]) for r in got.collect()}
    assert rows == {p[0]: widen(p, candidates) for p in probes}


def test_no_candidates(table):
    probes = table([(0, 1, 5)], SCHEMA)
    row = matching.widening_match(probes, probes.where("false")).head()
    assert (row["level"], row["matched_idx"]) == (None, None)


def test_one_value_holds_most_rows(spark, table):
    candidates = spark.range(200_000).select(
        F.col("id").alias("idx"),
        F.when(F.col("id") % 3 > 0, 5).otherwise((F.col("id") % 50).cast("int")).alias("bbcount"),
        F.when(F.col("id") % 3 > 0, 100).otherwise((F.col("id") % 900).cast("int")).alias("token_length"),
    )
    probes = table([(i, 5, 100) for i in range(500)] + [(999, 49, 899)], SCHEMA)
    got = {r["idx"]: (r["level"], r["matched_idx"]) for r in matching.widening_match(probes, candidates).collect()}
    assert got[0] == (0, 1) and got[499] == (0, 1) and got[999][0] == 0 and len(got) == 501


def test_rule_similar(table):
    schema = "idx long, n_called int, num_loops int, n_blocks int"
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 1), rng.randint(0, 2), rng.randint(1, 9)) for i in range(80)]
    probes, candidates = rows[:50], rows[60:]

    def alike(a, b):
        return (
            (a[1] == 0) == (b[1] == 0)
            and (a[2] == 0) == (b[2] == 0)
            and (a[3] == 1) == (b[3] == 1)
            and abs(a[3] - b[3]) <= 2
        )

    want = {p[0]: next((c[0] for c in candidates if alike(p, c)), None) for p in probes}
    got = matching.rule_similar(table(probes, schema), table(candidates, schema)).collect()
    assert {r["idx"]: r["similar_idx"] for r in got} == want


def test_replace_failed(table):
    schema = "idx long, path string"
    sample = table([(0, "a"), (1, "b"), (2, "c"), (3, "d")], schema)
    candidates = table([(10, "b"), (11, "x"), (12, "x"), (13, "y")], schema)
    failed = table([(1,), (2,), (3,)], "idx long")
    got = {r["idx"]: (r["path"], r["replaced"]) for r in matching.replace_failed(sample, failed, candidates).collect()}
    assert got == {0: ("a", False), 1: ("x", True), 2: ("y", True), 3: ("d", False)}


def test_chunked_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7 + 3).alias("idx"), (F.col("id") % 3).alias("k"))
    ranked = ranking.chunked_rank(df, "idx", "r", by=["k"], chunk_rows=50).collect()
    for k in range(3):
        mine = sorted((r["idx"], r["r"]) for r in ranked if r["k"] == k)
        assert [r for _, r in mine] == list(range(1, len(mine) + 1))


def test_sample(spark):
    df = spark.range(500).withColumnRenamed("id", "idx")
    one = [r["idx"] for r in sampling.seeded_sample(df, 20, seed=1).collect()]
    assert one == [r["idx"] for r in sampling.seeded_sample(df.repartition(7), 20, seed=1).collect()]
    assert len(set(one)) == 20 and one != [r["idx"] for r in sampling.seeded_sample(df, 20, seed=2).collect()]
    with pytest.raises(ValueError):
        sampling.seeded_sample(df, 501, check=True)


def _functions(spark, rows):
    return spark.createDataFrame(
        [(i, dict(code=[c], bb_count=None if s is None else dict(bbcount=len(s), bb_list_size=s))) for i, c, s in rows],
        "idx long, llvm_ir struct<code: array<string>, bb_count: struct<bbcount: int, bb_list_size: array<int>>>",
    )


def test_blocked_dedup(spark):
    rows = [
        (0, "; ModuleID = 'a'\nret", [3]),
        (1, "; ModuleID = 'b'\nret", [3]),
        (2, "; ModuleID = 'b'\nret", [4]),
        (3, "x", [10]),
        (4, "x", [10]),
        (5, "x", [2, 2]),
        (6, "x", [2, 2]),
        (7, "x", [0]),
        (8, "x", None),
        (9, "other", [3]),
    ]
    df = _functions(spark, rows)
    assert sorted(r["idx"] for r in dedup.blocked_dedup(df).collect()) == [0, 2, 3, 4, 5, 6, 9]
    report = {r["inst_count"]: (r["n_before"], r["n_after"]) for r in dedup.dedup_report(df).collect()}
    assert report == {3: (3, 2), 4: (1, 1)}
    sizes = [(r["inst_count"], r["n"], r["first_idx"]) for r in dedup.class_sizes(df).collect()]
    assert sizes == [(3, 2, 0), (3, 1, 9), (4, 1, 2)]
    assert dedup.blocked_dedup(df.where("idx = 100")).count() == 0


def test_structural_fingerprint(spark):
    a = "define i32 @f(i32 %x) {\n  %1 = add i32 %x, 1 ; c\n  ret i32 %1\n}"
    b = a.replace("@f", "@g").replace("%x", "%y").replace(" ; c", "")
    df = _functions(spark, [(0, a, [2]), (1, b, [2]), (2, a.replace("add", "sub"), [2])])
    assert sorted(r["idx"] for r in dedup.blocked_dedup(df).collect()) == [0, 1, 2]
    assert sorted(r["idx"] for r in dedup.blocked_dedup(df, "structural").collect()) == [0, 2]


def test_joined_rows_are_reduced_without_a_sort(table):
    """Pairs of cells that meet are many; they are aggregated by hash, and only a row per level is sorted."""
    probes = table([(1, 100)], "p_bb long, p_tok long")
    cells = table([(1, 100 + i, i) for i in range(5)], "c_bb long, c_tok long, c_idx long")
    best = matching._search(probes, cells, 10, True, 8)
    assert best.head()["best"] == (0, 0)
    plan = best._jdf.queryExecution().executedPlan().toString()
    above_join = plan[: plan.index("Join")].rstrip().splitlines()
    assert any("HashAggregate(keys=[p_bb" in line and "level" in line for line in above_join)
    assert "HashAggregate(keys=[p_bb" in [line for line in above_join if "Aggregate" in line][-1]
