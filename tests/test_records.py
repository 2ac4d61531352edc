"""Record enrichment, predicates, scoring on literal rows."""

import pytest
from pyspark.sql import functions as F

from irquarry.operators import predicates, records, scoring
from irquarry.schemas import FUNCTIONS, struct


def _entry(**kw):
    base = dict(
        name="f",
        called_functions=[],
        num_loops=0,
        has_defined_structs=False,
        has_globals=False,
        struct_args=False,
        unused_args=[],
        bbcount=[],
        all_struct_fields_accessed=True,
    )
    return {**base, **kw}


def _record(idx, functions=None, sizes=(1,), codes=("ir",), **kw):
    return dict(
        idx=idx,
        path=kw.pop("path", f"p{idx}"),
        func_head="h",
        func_head_types="t",
        asm=dict(code=list(kw.pop("asm", ("asm",))), target=[]),
        llvm_ir=dict(
            code=list(codes),
            target=[],
            bb_count=None if sizes is None else dict(func_name="f", bbcount=len(sizes), bb_list_size=list(sizes)),
        ),
        func_info=dict(functions=[_entry()] if functions is None else functions),
        **kw,
    )


@pytest.fixture
def functions(spark):
    def make(*rows):
        schema = struct(FUNCTIONS)
        return spark.createDataFrame([{f: r.get(f) for f in schema.fieldNames()} for r in rows], schema)

    return make


def flags(df, **tests):
    return {r["idx"]: tuple(r[n] for n in tests) for r in df.select("idx", *[t.alias(n) for n, t in tests.items()]).collect()}


def test_predicates(functions):
    df = functions(
        _record(0, [_entry(unused_args=[1])]),
        _record(1, [_entry(), _entry(num_loops=2, called_functions=["g"])], sizes=(30, 21)),
        _record(2, [], sizes=None, codes=(), asm=()),
        _record(3, [_entry(has_defined_structs=True, all_struct_fields_accessed=False, bbcount=[1] * 21)], sizes=(50,)),
    )
    got = flags(
        df,
        clean=predicates.no_unused_args(),
        loops=predicates.has_loops(),
        calls=predicates.has_calls(),
        first=predicates.first_function_calls(),
        many=predicates.many_instructions(),
        structs=predicates.uses_structs(),
        unread=predicates.leaves_struct_fields_unread(),
        small=predicates.some_function_at_most(20),
        one=predicates.one_block(),
        code=predicates.last_code_present("llvm_ir"),
    )
    assert got[0] == (False, False, False, False, False, False, False, True, True, True)
    assert got[1] == (True, True, True, False, True, False, False, True, False, True)
    assert got[2] == (True, False, False, False, False, False, False, False, False, False)
    assert got[3] == (True, False, False, False, False, True, True, False, True, True)


def test_stage_counts_and_min_blocks(functions):
    df = functions(*[_record(i, [_entry(bbcount=[0] * (i * 5))], sizes=(1,) * (i + 1)) for i in range(5)])
    counts = predicates.stage_counts(df, {"a": predicates.more_blocks_than(1), "b": predicates.more_blocks_than(3)}).head()
    assert (counts["n_input"], counts["n_a"], counts["n_b"]) == (5, 4, 2)
    assert [tuple(r) for r in predicates.min_block_counts(df).collect()] == [
        (5, 4, 80.0),
        (10, 3, 60.0),
        (20, 1, 20.0),
        (50, 0, 0.0),
    ]


def test_tool_predicates(spark):
    df = spark.createDataFrame(
        [(0, 0, 0, 1), (1, 1, 0, 0), (2, 0, 1, 1), (3, 0, 0, 0)], "idx long, c int, p int, n int"
    ).select(
        "idx",
        F.struct(F.col("c").alias("rc")).alias("compile"),
        F.struct(F.col("p").alias("rc")).alias("parse"),
        F.struct(F.expr("array_repeat(1, n)").alias("functions")).alias("info"),
    )
    got = flags(df, ok=predicates.source_parses("compile", "parse", "info"))
    assert got == {0: (True,), 1: (True,), 2: (False,), 3: (False,)}


def test_training_pairs_cut_before_filter(functions):
    df = functions(*[_record(i, codes=() if i == 1 else ("first", "last"), asm=("a", "z")) for i in range(4)])
    rows = records.training_pairs(df, 0, 3).orderBy("idx").collect()
    assert [(r["idx"], r["input"], r["output"]) for r in rows] == [(0, "z", "first"), (2, "z", "first")]


def test_normalize_record(spark):
    raw = spark.sql("select 'p' as path, named_struct('code', array('x')) as asm_raw, 3 as token_length")
    row = records.normalize_record(raw).head()
    assert row["path"] == "p" and row["signature"] == [] and row["asm"]["code"] == []
    assert row["func_info"]["functions"] == [] and row["llvm_ir"]["bb_count"] is None
    assert row["synth_io_pairs"]["input"] == [] and row["token_length"] == 3


def test_func_info_default(functions):
    df = functions(_record(0), _record(1), _record(2)).withColumn(
        "info",
        F.when(F.col("idx") == 0, '{"functions": [{"name": "g", "called_functions": ["h"], "unused_args": []}]}')
        .when(F.col("idx") == 1, "not json")
        .otherwise('{"other": 1}'),
    )
    rows = {r["idx"]: r["func_info"] for r in records.attach_func_info(df, "info").collect()}
    assert rows[0]["functions"][0]["name"] == "g"
    for i in (1, 2):
        entry = rows[i]["functions"][0]
        assert (entry["name"], entry["called_functions"], entry["num_loops"]) == ("", [], 0)


def test_single_function_view_quarantines(functions):
    df = functions(_record(0), _record(1, [_entry(), _entry()]), _record(2, []))
    rows = {r["idx"]: r["quarantine"] for r in records.single_function_view(df).collect()}
    assert rows == {0: None, 1: "functions: 2", 2: "functions: 0"}


def test_function_name(functions):
    df = functions(_record(0, [_entry(name="g")]), _record(7, []))
    assert [r[0] for r in df.orderBy("idx").select(records.function_name()).collect()] == ["g", "func_7"]


PRED = "idx long, file string, func_head_types string, predict array<string>, predict_compile_success array<boolean>, predict_execution_success array<boolean>, target_compile_success boolean, target_execution_success boolean"


def test_scoring_keeps_last_and_guards(spark, functions):
    aarch = 'target triple = "aarch64-linux"'
    rows = [
        (0, "p0", "t", ["<code>a</code> code"], [False], [False], True, True),
        (1, "p0", "t", ["x", "<code>b</code>"], [False, True], [False, False], True, False),
        (2, "p1", "t", [aarch], [True], [True], None, None),
        (3, "zz", "t", ["code without tags"], [True], [True], True, True),
        (4, "p2", "t", ["y"], None, None, True, True),
    ]
    predictions = records.normalize_predictions(spark.createDataFrame(rows, PRED))
    corpus = functions(_record(0), _record(1), _record(2), _record(9, path="p0"))
    matched = scoring.guard_target(scoring.match_predictions(predictions, corpus))
    got = {r["idx"]: (r["row"]["idx"], r["predict"]) for r in matched.collect()}
    assert got == {1: (9, ["x", "b"]), 2: (1, [aarch]), 4: (2, ["y"])}
    total = scoring.score_totals(matched).head()
    assert tuple(total) == (3, 1, 0, 2, 1)
    missing = scoring.unmatched_predictions(predictions, corpus).collect()
    assert [(r["idx"], r["predict"]) for r in missing] == [(3, ["code without tags"])]


def test_io_verdict(spark):
    df = spark.createDataFrame(
        [(0, [], []), (1, ["a"], ["a"]), (2, ["a"], ["b"]), (3, ["a", "b"], ["a"])],
        "idx long, expected array<string>, observed array<string>",
    )
    assert {r[0]: r[1] for r in scoring.io_verdict(df).collect()} == {0: True, 1: True, 2: False, 3: False}


def test_sample_view_reports_range(spark, functions):
    predictions = spark.createDataFrame([(0, "p", "t", ["a"], [True], [False], True, True)], PRED)
    row = records.sample_view(functions(_record(0)), predictions, 1).head()
    assert (row["predict"], row["message"], row["predict_compile_success"]) == ("", "choice out of range", False)


def test_missing_positions(spark):
    present = spark.createDataFrame([(0, 0), (0, 2), (1, 0)], "shard int, record_id long")
    totals = spark.createDataFrame([(0, 4), (1, 1), (2, 0)], "shard int, n long")
    assert sorted(tuple(r) for r in scoring.missing_positions(present, totals).collect()) == [(0, 1), (0, 3)]


def test_evaluate_predictions(spark):
    aarch = 'target triple = "aarch64-linux"'
    rows = [(0, "p", "t", ["good", aarch, "bad"], None, None, True, True), (1, "q", "t", [], None, None, True, True)]

    def evaluate(choices):
        good = F.col("llvm_ir") == "good"
        return choices.withColumns({"compile_success": F.lit(True), "execution_success": good})

    done = scoring.evaluate_predictions(spark.createDataFrame(rows, PRED), evaluate)
    got = {r["idx"]: (r["predict_compile_success"], r["predict_execution_success"]) for r in done.collect()}
    assert got == {0: ([True, False, True], [True, False, False]), 1: (None, None)}
    assert tuple(scoring.score_totals(done).head())[:3] == (2, 1, 1)


def test_choice_rows_and_names(spark, functions):
    responses = spark.createDataFrame([(0, -1, 0, "a"), (0, -1, 1, "b")], "idx long, retry int, choice int, content string")
    evaluations = spark.createDataFrame([(0, -1, 1, True)], "idx long, retry int, choice int, compile_success boolean")
    records_ = functions(_record(0, [_entry(name="g"), _entry(name="h")]))
    row = scoring.choice_rows(responses, evaluations, records_).head()
    assert (row["content"], row["path"]) == ("b", "p0")
    assert records_.select(records.function_names()).head()[0] == ["g", "h"]
