"""Whole runs, reports and long listings."""

import time

import pytest
from pyspark.sql import functions as F
from test_listings import context_by_lines, functions_by_lines
from test_repair import SCRIPT, make_run

from irquarry.config import JobConfig
from irquarry.functions.text import split_lines
from irquarry.operators import listings, repair, reports, scoring, stages
from irquarry.streaming.predictions import current_scores


@pytest.fixture
def records(table):
    rows = [(i, f"P{i}", f"target {i}", "ir") for i in range(4)]
    return table(rows, "idx long, prompt string, target_assembly string, target_ir string")


def test_batch_totals(records, tmp_path):
    row = repair.run_batch(records, make_run(tmp_path, SCRIPT, JobConfig(num_generate=2, num_retry=3))).head()
    # the scripted evaluator knows the first choice of the first round of record 1 alone
    assert tuple(row) == (4, 3, 3, 1, 0)


def test_rerun_analyses_first(spark, records, tmp_path):
    config = JobConfig(num_generate=2, num_retry=1)
    before = repair.repair_loop(records, make_run(tmp_path / "a", SCRIPT, config))
    run = make_run(tmp_path / "b", {(1, -1, 0): "C"}, config)
    repair.rerun_compiled_only(records, before, run).count()
    kinds = {r["retry"]: r["prompt_type"] for r in spark.read.parquet(run.path("prompts")).collect()}
    assert kinds == {-1: "in-context-learning", 0: "llm-fix"}


def test_failed_prompts_are_set_aside(spark, table, tmp_path):
    asked = table([(0, -1, "a"), (1, -1, "bad"), (1, 0, "b")], "idx long, retry int, prompt string")

    def generate(batch):
        if "bad" in batch:
            raise RuntimeError("refused")
        return [[p] for p in batch]

    left = stages.unanswered(asked, stages.generation_stage(asked, generate))
    assert [tuple(r) for r in left.collect()] == [(1, -1, "bad")]


def test_targets_in_generation_table(table):
    rows = table([(0, -1, 0, True, False, "x" * 60)], "idx long, retry int, choice int, compile_success boolean, execution_success boolean, error_msg string")
    targets = table([(0, -1, True, None)], "idx long, retry int, compile_success boolean, execution_success boolean")
    got = {r["choice"]: tuple(r)[3:] for r in reports.generation_table(rows, targets).collect()}
    assert got == {0: (True, False, "x" * 50 + "..."), None: (True, False, "")}


def test_last_score_of_a_key(table):
    rows = table([("r", 1, "k", True), ("r", 5, "k", False), ("s", 2, "k", True)], "run string, idx long, key string, predict_compile boolean")
    assert {(r["run"], r["idx"]) for r in current_scores(rows).collect()} == {("r", 5), ("s", 2)}


def test_matches_without_pairs(table):
    schema = "idx long, path string, func_head string"
    sample = table([(0, "p", "h"), (1, "p", "h"), (2, "q", None)], schema)
    split = table([(10, "p", "h"), (11, "p", "h"), (12, "p", "g"), (13, "q", None)], schema)
    assert {r["idx"] for r in scoring.matching_rows(sample, split).collect()} == {10, 11}


def _long_listing(functions):
    body = "\t.globl\tf{0}\nf{0}:\n\tmovl\t$1, %edi\n\tleaq\t8(%rsp), %rsi\n\tcallq\tg@PLT\n\tnop\n\t.cfi_endproc"
    return "\n".join(body.format(i % (functions - 1)) for i in range(functions))


def test_long_listings_take_linear_time(table):
    texts = {n: _long_listing(n) for n in (1000, 10000)}
    seconds = {}
    for n, text in texts.items():
        df = table([(0, text, "g")], "doc long, text string, symbol string")
        start = time.perf_counter()
        found = listings.split_functions(df, "doc", "text").collect()
        numbers = df.select(listings.call_context(split_lines(F.col("text")), F.col("symbol"))).head()[0]
        seconds[n] = time.perf_counter() - start
        assert {r["name"]: r["lines"] for r in found} == functions_by_lines(text)
        lines = text.splitlines()
        assert len(numbers) == 3 * n and numbers[:3] == [3, 4, 5] and lines[numbers[-1] - 1] == "\tcallq\tg@PLT"
    assert [i + 1 for i in context_by_lines(texts[1000].splitlines()[:700], "g", r"(movl|leaq).*")] == [
        7 * k + j for k in range(100) for j in (3, 4, 5)
    ]
    assert seconds[10000] < 30 * max(seconds[1000], 0.3)
