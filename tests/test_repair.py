"""The retry dataflow with a scripted generator and evaluator."""

import pytest
from pyspark.sql import functions as F

from irquarry.config import JobConfig
from irquarry.operators import prompt_texts, prompts, repair, stages


def scripted(script, log=None):
    """Evaluator whose outcome per (idx, retry, choice) is scripted: N, C or E."""

    def evaluate(rows):
        cells = [F.lit(k) for item in script.items() for k in (":".join(map(str, item[0])), item[1])]
        place = F.concat_ws(":", *[F.col(c).cast("string") for c in ("idx", "retry", "choice")])
        state = F.coalesce(F.try_element_at(F.create_map(*cells), place), F.lit("N"))
        return rows.withColumns(
            {
                "compile_success": state != "N",
                "execution_success": state == "E",
                "error_msg": F.when(state == "N", F.concat(F.lit("err "), place)).otherwise(F.lit("")),
                "assembly": F.when(state == "N", F.lit("")).otherwise(F.concat(F.lit("asm "), place, F.lit(" # c"))),
            }
        )

    return evaluate


def make_run(tmp_path, script, config, calls=None, embed=None):
    def generate(batch):
        if calls is not None:
            calls.add(len(batch))
        return [[f"```llvm\n{len(p)}-{i}\n```" for i in range(config.num_generate)] for p in batch]

    return repair.RepairRun(
        store=str(tmp_path / "run"),
        config=config,
        generate=lambda df: stages.generation_stage(df, generate),
        evaluate=scripted(script),
        embed=embed,
    )


@pytest.fixture
def records(table):
    return table([(i, f"P{i}", f"target {i}") for i in range(4)], "idx long, prompt string, target_assembly string")


SCRIPT = {
    (0, -1, 1): "E",
    (1, -1, 0): "C",
    (1, 1, 0): "E",
    (2, 2, 1): "E",
}


def rounds(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["idx"], set()).add(r["retry"])
    return out


def test_loop_stops_per_record(spark, records, tmp_path):
    run = make_run(tmp_path, SCRIPT, JobConfig(num_generate=2, num_retry=3))
    got = repair.repair_loop(records, run)
    assert rounds(got) == {0: {-1}, 1: {-1, 0, 1}, 2: {-1, 0, 1, 2}, 3: {-1, 0, 1, 2}}
    solved = {r["idx"]: (r["retry"], r["choice"]) for r in repair.corrected_code(got).collect()}
    assert solved == {0: (-1, 1), 1: (1, 0), 2: (2, 1)}  # success in the last round counts


def test_fix_prompts(spark, records, tmp_path):
    run = make_run(tmp_path, SCRIPT, JobConfig(num_generate=2, num_retry=1))
    repair.repair_loop(records, run)
    text = {r["idx"]: r["prompt"] for r in spark.read.parquet(run.path("prompts")).where("retry = 0").collect()}
    code = "2-0"  # length of "P1" and choice 0
    assert text[1] == "P1" + prompt_texts.EXECUTION_ERROR.format(predict=code, predict_assembly="asm 1:-1:0")
    assert text[2] == "P2" + prompt_texts.COMPILE_ERROR.format(predict=code, error_msg="err 2:-1:0")
    assert 0 not in text


def test_rerun_appends_nothing(spark, records, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    run = make_run(tmp_path, SCRIPT, JobConfig(num_generate=2, num_retry=3), calls)
    first = repair.repair_loop(records, run).count()
    asked = calls.value
    assert repair.repair_loop(records, run).count() == first
    assert calls.value == asked
    assert repair.rescore(spark, run).count() == first
    assert repair.rescore(spark, run, 0).count() == 8


def test_two_stage_fix(spark, records, tmp_path):
    config = JobConfig(num_generate=2, num_retry=1, fix_prompt_type="llm-fix")
    run = make_run(tmp_path, SCRIPT, config)
    repair.repair_loop(records, run)
    text = {r["idx"]: r["prompt"] for r in spark.read.parquet(run.path("prompts")).where("retry = 0").collect()}
    assert "analyze the reason" in text[1] and "asm 1:-1:0 # c" in text[1]
    assert text[2].startswith("P2" + prompt_texts.COMPILE_ERROR[:30])
    assert spark.read.parquet(run.path("analyses")).select("idx").distinct().count() == 1


def test_most_similar_candidate_is_repaired(spark, records, tmp_path):
    script = {(1, -1, 0): "C", (1, -1, 1): "C"}

    def embed(rows):
        own = F.when(F.col("choice") == 1, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
        return rows.withColumns({"embedding": own, "target_embedding": F.array(F.lit(1.0), F.lit(0.1))})

    run = make_run(tmp_path, script, JobConfig(num_generate=2, num_retry=1), embed=embed)
    repair.repair_loop(records, run)
    row = spark.read.parquet(run.path("prompts")).where("retry = 0 and idx = 1").head()
    assert "asm 1:-1:1" in row["prompt"]


def test_rerun_of_compiled_only(spark, records, tmp_path):
    config = JobConfig(num_generate=2, num_retry=1)
    before = repair.repair_loop(records, make_run(tmp_path / "a", SCRIPT, config))
    again = repair.rerun_compiled_only(records, before, make_run(tmp_path / "b", {}, config))
    assert set(rounds(again)) == {1}


def test_targets_once(table):
    df = table([(0, "ir")], "idx long, target_ir string")
    row = repair.evaluate_targets(df, scripted({(0, -1, 0): "E"})).head()
    assert (row["retry"], row["execution_success"]) == (-1, True)


def test_unsupported_types_fail_early(table):
    with pytest.raises(ValueError):
        JobConfig(prompt_type="other")
    basis = "n_compiled int, first_predict string, failed struct<predict: string, error: string>, "
    basis += "best struct<llvm_ir: string, assembly: string>"
    fix = prompts.fix_prompt(JobConfig(prompt_type="basic"), F.lit("x"))
    rows = [(n, "p", {"predict": "p", "error": "e"}, {"llvm_ir": "p", "assembly": "a"}) for n in (0, 1)]
    bases = table(rows, basis)
    assert bases.where("n_compiled = 0").select(fix).head()[0].startswith("x")
    with pytest.raises(Exception, match="no fix prompt"):
        bases.select(fix).collect()
    df = table([("basic",), ("odd",)], "prompt_type string")
    with pytest.raises(Exception, match="unknown prompt type"):
        prompts.validated_types(df).collect()


def test_analysis_sections(evaluate):
    full = evaluate(prompts.analysis_prompt(F.col("t"), F.col("p"), F.col("a"), F.col("e")), t="T", p="P", a="A", e="E")
    assert [s.split("\n\n")[-1] for s in full.split(prompt_texts.ANALYSIS_PREDICTED)[:1]]
    bare = evaluate(prompts.analysis_prompt(F.col("t"), F.col("p"), F.col("a"), F.col("e")), t="", p="P", a=None, e=" \n")
    assert bare == "\n\n".join([prompt_texts.ANALYSIS_ROLE, prompt_texts.ANALYSIS_PREDICTED + "P", prompt_texts.ANALYSIS_INSTRUCTIONS])


def test_trace_prompt(evaluate):
    parts = [F.col(c) for c in "ipabc"]
    got = evaluate(prompts.trace_fix(*parts), i="I", p="P", a="A", b="B", c="C")
    assert got == "I" + prompt_texts.TRACE_FIX.format(
        predict_llvm_ir="P", predict_assembly="A", target_execution_trace="B", predict_execution_trace="C"
    )


def test_a_round_reads_only_the_records_still_open(spark, tmp_path):
    """Each round hands on the records that failed; a store not written yet is not joined."""

    def generate(df):
        return df.select("idx", "retry", F.lit(0).alias("choice"), F.lit("x").alias("content"), F.lit(None).cast("string").alias("reasoning"))

    def evaluate(df):
        ok = F.col("idx") <= F.col("retry") + 1
        return df.withColumns(
            {"compile_success": ok, "execution_success": ok, "error_msg": F.lit("e"), "assembly": F.lit("a")}
        )

    records = spark.range(4).select(F.col("id").alias("idx"), F.lit("p").alias("prompt"), F.lit("t").alias("target_assembly"))
    run = repair.RepairRun(store=str(tmp_path / "run"), config=JobConfig(), generate=generate, evaluate=evaluate)
    stored, write = [], repair._stored
    repair._stored = lambda df, name: stored.append(write(df, name)) or stored[-1]
    try:
        rows = repair.repair_loop(records, run)
    finally:
        repair._stored = write
    assert sorted((r["idx"], r["retry"]) for r in rows.collect()) == [(i, r - 1) for i in range(4) for r in range(i + 1)]
    assert [df.count() for df in stored] == [3, 2, 1, 0]
