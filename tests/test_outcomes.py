"""Outcomes over rounds, checked against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from irquarry.operators import error_stats, histograms, outcomes, reports

EV = "idx long, retry int, choice int, compile_success boolean, execution_success boolean, error_msg string, llvm_ir string, assembly string"


def _rows(flags):
    """flags: {idx: {retry: [(compiled, executed), ...]}}"""
    return [
        (i, r, c, comp, ex, "" if comp else "llc: error: x", f"ir{i}.{r}.{c}", f"asm{i}.{r}.{c}")
        for i, rounds in flags.items()
        for r, choices in rounds.items()
        for c, (comp, ex) in enumerate(choices)
    ]


N, C, E = (False, False), (True, False), (True, True)


@pytest.fixture(scope="module")
def evaluations(spark):
    return spark.createDataFrame(
        _rows(
            {
                0: {-1: [E, N]},
                1: {-1: [N, N], 0: [C, N], 1: [N, N], 2: [N, C], 3: [E, N]},
                2: {-1: [C, N], 0: [N, N], 1: [N, N]},
                3: {-1: [N, N], 0: [N, N], 9: [C, E]},
            }
        ),
        EV,
    )


def by_idx(df, *cols):
    return {r["idx"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_record_summary(evaluations):
    got = by_idx(outcomes.record_summary(evaluations), "any_compile", "any_execution", "first_round", "pass_round")
    assert got == {0: (True, True, -1, -1), 1: (True, True, 3, 3), 2: (True, False, None, 10), 3: (True, True, 9, 9)}


def test_first_executed_and_best(evaluations):
    assert by_idx(outcomes.first_executed(evaluations), "retry", "choice") == {0: (-1, 0), 1: (3, 0), 3: (9, 1)}
    assert by_idx(outcomes.best_compilable(evaluations, 2), "retry", "choice") == {0: (-1, 0), 1: (0, 0), 2: (-1, 0)}
    assert by_idx(outcomes.best_compilable(evaluations, 3), "retry")[1] == (2,)


def test_last_round(evaluations):
    assert by_idx(outcomes.failed_in_last_round(evaluations), "retry") == {2: (1,)}
    assert [r["idx"] for r in outcomes.failed_records(evaluations).collect()] == [2]


def test_accumulated(evaluations):
    curve = outcomes.accumulated_success(outcomes.run_rounds(evaluations)).orderBy("step").collect()
    assert [r["compile_accumulated"] for r in curve] == [1, 2, 2, 3, 3, 3, 3, 3, 3, 3, 4]
    assert [r["first_compile_accumulated"] for r in curve] == [1, 2, 2, 2, 2, 2, 2, 2, 2, 2, 3]
    assert [r["execution_accumulated"] for r in curve] == [1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 3]


def test_accumulated_against_loop(spark):
    rng = random.Random(3)
    flags = {}
    for i in range(60):
        flags[i] = {}
        for r in range(-1, 10):
            flags[i][r] = [rng.choice([N, N, N, C, E]) for _ in range(2)]
            if any(e for _, e in flags[i][r]):
                break
    want_c, want_e = [0] * 11, [0] * 11
    for rounds in flags.values():
        if list(rounds) == [-1]:
            want_c[0] += 1
            want_e[0] += 1
            continue
        before = False
        for r in range(10):
            if r in rounds:
                now = any(c for c, _ in rounds[r])
                want_c[r + 1] += now and not before
                want_e[r + 1] += any(e for _, e in rounds[r])
                before = now
    df = spark.createDataFrame(_rows(flags), EV)
    curve = outcomes.accumulated_success(outcomes.run_rounds(df)).orderBy("step").collect()
    assert [r["compile_accumulated"] for r in curve] == [sum(want_c[: i + 1]) for i in range(11)]
    assert [r["execution_accumulated"] for r in curve] == [sum(want_e[: i + 1]) for i in range(11)]


def test_contingency_with_uneven_runs(spark, evaluations):
    right = spark.createDataFrame(_rows({0: {-1: [E]}, 1: {-1: [N]}, 2: {-1: [N]}}), EV)
    pairs = outcomes.side_by_side(evaluations, right)
    row = outcomes.contingency(pairs).head()
    assert tuple(row) == (1, 1, 2, 0, 2, 66.7)
    table = {r["idx"]: tuple(r) for r in reports.pass_table(pairs).collect()}
    assert table[3] == (3, "9/-", "✓", "✗", "✗") and table[0] == (0, "-1/-1", "✓", "✓", "✓")


def test_failed_sets(spark, evaluations):
    right = spark.createDataFrame(_rows({2: {-1: [E]}, 1: {-1: [N]}}), EV)
    pairs = outcomes.side_by_side(evaluations, right)
    assert by_idx(outcomes.failed_sets(pairs, "left"), "compile_failed") == {2: (False,)}
    assert by_idx(outcomes.failed_sets(pairs, "both"), "compile_failed") == {}
    assert set(by_idx(outcomes.failed_sets(pairs, "right"), "compile_failed")) == {0, 1, 3}


def test_matrix(evaluations):
    row = reports.compiled_matrix(evaluations).where("idx = 3").head()
    assert (row["retry_m1"], row["retry_0"], row["retry_1"], row["retry_9"]) == ("0", "0", "-", "2")
    row = reports.compiled_matrix(evaluations, 1).where("idx = 3").head()
    assert (row["retry_0"], row["retry_1"], row["retry_later"]) == ("0", "-", "2")


def test_targets_and_reports(spark, evaluations, tmp_path):
    targets = spark.createDataFrame([(0, -1, True, True), (0, 0, False, False)], "idx long, retry int, compile_success boolean, execution_success boolean")
    assert [tuple(r) for r in outcomes.target_flags(targets).collect()] == [(0, True, True)]
    path = tmp_path / "report.md"
    report = reports.generation_table(evaluations).where("idx = 0")
    reports.write_markdown(report, str(path), ["retry", "choice"], "Run", "end")
    lines = [line for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]
    assert lines[0] == "# Run" and lines[2].startswith("| idx | retry") and len(lines) == 8
    assert lines[4].startswith("| 0 | -1 | 0") and lines[-1] == "end"
    chart = reports.chart_rows(outcomes.round_summary(evaluations), "a", "retry", ["n_executed"])
    assert chart.columns == ["series", "x", "y"]


def test_folding(spark):
    def fold(counts):
        df = spark.createDataFrame(list(counts.items()), "category string, n long")
        return {r["slice"]: r["n"] for r in error_stats.folded_slices(df).collect()}

    assert fold({"a": 90, "b": 6, "c": 4}) == {"a": 90, "b": 6, "other": 4}
    assert fold({"a": 50, "b": 50}) == {"a": 50, "b": 50, "other": 0}
    many = {f"c{i}": 1 for i in range(25)}
    assert fold(many) == {"other": 25}


def test_error_index_and_unfixed(spark):
    rows = [
        (0, 0, False, "llc: error: x: error: expected value token"),
        (0, 1, True, ""),
        (1, 0, False, " \n"),
        (1, 1, False, "llc: error: x: error: odd"),
    ]
    df = spark.createDataFrame(rows, "idx long, choice int, compile_success boolean, error_msg string")
    index = error_stats.error_index(df, ["idx", "choice"])
    assert sorted(tuple(r) for r in index.collect()) == [("expected value token", 0, 0), ("odd", 1, 1)]
    unfixed = error_stats.error_counts(error_stats.typed_errors(error_stats.unfixed_only(df)))
    assert [tuple(r) for r in unfixed.collect()] == [("odd", 1)]
    assert error_stats.category_counts(unfixed).count() == 0


def test_length_buckets(spark):
    df = spark.createDataFrame(
        [(0, [True], [True]), (255, [False], [False]), (256, [True], None), (4096, [True], [False]), (4097, [True], [True])],
        "predict_length int, predict_compile_success array<boolean>, predict_execution_success array<boolean>",
    )
    rows = {r["length_from"]: tuple(r)[1:] for r in histograms.length_buckets(df).collect()}
    assert len(rows) == 18 and rows[4097] == (1, 1, 1, 0, 0)
    assert histograms.length_rates(histograms.length_buckets(df)).head()["total"] == 5
    assert rows[0] == (2, 1, 1, 0, 1) and rows[256] == (1, 1, 0, 1, 0) and rows[4096] == (1, 1, 0, 1, 0)


def test_equal_width(spark):
    df = spark.range(11).select(F.col("id").alias("v"))
    got = [r["n"] for r in histograms.equal_width(df, F.col("v"), 10).orderBy("bin").collect()]
    assert got == [1] * 9 + [2]
    flat = histograms.equal_width(df.select(F.lit(3).alias("v")), F.col("v"), 2, True).orderBy("bin").collect()
    assert [(r["n"], r["bin_from"]) for r in flat] == [(0, 2.5), (11, 3.0)]


def test_clipped_percent(spark):
    df = spark.createDataFrame([("a", 18), ("a", 20), ("a", 21), ("b", 19)], "dataset string, v int")
    rows = {(r["dataset"], r["v"]): (r["n"], r["percent"]) for r in histograms.clipped_percent(df, "dataset", "v").collect()}
    assert rows[("a", 18)] == (1, 33.333333) and rows[("a", 19)] == (0, 0.0) and rows[("b", 19)] == (1, 100.0)
    assert rows[("a", 21)] == (1, 33.333333) and rows[("b", 21)] == (0, 0.0)
    assert len(rows) == 8


def test_joint_histogram_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(histograms, "AXIS_CHUNK", 4)
    df = spark.createDataFrame([("a", 3), ("a", 3), ("b", 14), ("c", 90)], "dataset string, v int")
    rows = {r["v"]: (r["a"], r["b"]) for r in histograms.joint_histogram(df, "dataset", "v", ["a", "b"]).collect()}
    assert rows == {v: (2 * (v == 3), int(v == 14)) for v in range(3, 15)}


def test_running_max(spark):
    df = spark.createDataFrame([(0, 3), (1, 1), (2, 5)], "retry int, n int")
    assert [r["n_max"] for r in outcomes.running_max(df, ["n"]).orderBy("retry").collect()] == [3, 3, 5]
