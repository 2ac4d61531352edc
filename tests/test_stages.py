"""Stages: commands, compiler presets, chains, embedding, generation, caching."""

import shutil
import time

import pytest

from pyspark.sql import functions as F

from irquarry.operators import stages

GOOD_IR = "define i32 @f(i32 %x) {\n  %y = add i32 %x, 1\n  ret i32 %y\n}\n"


def test_command_results(table):
    df = table([(0, "b\na\n"), (1, "")], "idx long, text string")
    rows = {r["idx"]: r["tool"] for r in stages.command_stage(df, ["sort"], "text", tasks=2).collect()}
    assert rows[0]["stdout"] == "a\nb\n" and rows[0]["rc"] == 0 and not rows[0]["timed_out"]
    row = stages.command_stage(df, ["no-such-command"], "text").head()["tool"]
    assert row["rc"] is None and "no-such-command" in row["stderr"]
    row = stages.command_stage(df, ["sleep", "5"], "text", timeout=0.2).head()["tool"]
    assert row["timed_out"] and row["rc"] is None


def test_command_files_need_a_shared_folder(table, tmp_path):
    df = table([(0, "x\n")], "idx long, text string")
    argv = ["cp", "{input}", "{output}"]
    row = stages.command_stage(df, argv, "text", work_dir=str(tmp_path)).head()["tool"]
    assert row["output"] == "x\n" and not list(tmp_path.iterdir())
    with pytest.raises(Exception, match="work_dir"):
        stages.command_stage(df, argv, "text").collect()


def test_chain_stops_at_first_failure(table):
    df = table([(0, "a"), (1, "b")], "idx long, text string")
    steps = [("find", ["grep", "a"]), ("count", ["wc", "-c"])]
    rows = {r["idx"]: (r["result"], r["error"]) for r in stages.command_chain(df, "text", steps).collect()}
    assert rows == {0: ("2\n", None), 1: (None, "find: ")}


def test_two_variants(table):
    df = table([(0, "b")], "idx long, text string")
    row = stages.two_variants(df, "text", {"same": ["cat"], "none": ["false"]}).head()
    assert (row["same"], row["none"]) == ("b", "")


@pytest.mark.skipif(shutil.which("llc") is None, reason="no IR compiler here")
def test_compile_stage(table):
    df = table([(0, GOOD_IR), (1, "define broken"), (2, None)], "idx long, ir string")
    rows = {r["idx"]: r for r in stages.compile_stage(df, "ir").collect()}
    assert rows[0]["compile_success"] and "f:" in rows[0]["assembly"] and rows[0]["error_msg"] == ""
    assert not rows[1]["compile_success"] and "error:" in rows[1]["error_msg"] and rows[1]["assembly"] is None
    assert (rows[2]["compile_success"], rows[2]["assembly"], rows[2]["error_msg"]) == (False, None, "")


def test_embedding_drops_failures(table):
    calls = table([(i, "x" * i) for i in range(10)], "idx long, text string")

    def embed(batch):
        assert len(batch) <= 4
        return [None if len(t) == 3 else [float(len(t))] for t in batch]

    rows = {r["idx"]: r["embedding"] for r in stages.embedding_stage(calls, "text", embed, batch_size=4).collect()}
    assert 3 not in rows and rows[9] == [9.0] and len(rows) == 9


def test_cached_stage_appends_once(spark, table, tmp_path):
    store, seen = str(tmp_path / "store"), spark.sparkContext.accumulator(0)
    df = table([(0, "a"), (1, "b")], "idx long, text string")

    def derive(rows):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(count, rows.schema)

    ddl = "idx long, text string"
    assert stages.cached_stage(df, ["idx"], store, ddl, derive).count() == 2
    more = df.unionByName(table([(2, "c")], ddl))
    assert stages.cached_stage(more, ["idx"], store, ddl, derive).count() == 3
    assert stages.cached_stage(more, ["idx"], store, ddl, derive).count() == 3
    assert seen.value == 3


def test_a_hanging_call_ends_at_its_deadline(table):
    prompts = table([(i, -1, "hang" if i == 3 else "slow once" if i == 5 else f"p{i}") for i in range(8)], "idx long, retry int, prompt string")

    def generate(texts):
        if "hang" in texts:
            time.sleep(60)
        return [[t.upper()] for t in texts]

    start = time.monotonic()
    answers = stages.generation_stage(prompts.coalesce(1), generate, batch_size=4, timeout=1.0).cache()
    assert sorted((r["idx"], r["content"]) for r in answers.collect()) == sorted((i, "SLOW ONCE" if i == 5 else f"P{i}") for i in range(8) if i != 3)
    assert time.monotonic() - start < 30
    assert [r["idx"] for r in stages.unanswered(prompts, answers).collect()] == [3]
    answers.unpersist()


def test_the_second_attempt_answers_for_a_hanging_first():
    calls = []

    def call(texts):
        calls.append(texts)
        if len(calls) == 1:
            time.sleep(60)
        return [t + "!" for t in texts]

    assert stages.with_deadline(call, 20, 0.1)(["a"]) == ["a!"] and len(calls) == 2
    with pytest.raises(TimeoutError):
        stages.with_deadline(lambda texts: time.sleep(5), 0.2)(["a"])
    failures = []

    def broken(texts):
        failures.append(texts)
        raise ValueError("no")

    with pytest.raises(ValueError):
        stages.with_deadline(broken, 20, 0.1)(["a"])
    assert len(failures) == 1


def test_strategy_outcomes(table):
    df = table([(0, True, None, True, False, None)], "idx long, predict_compile_success boolean, predict_execution_success boolean, target_compile_success boolean, target_execution_success boolean, error string")
    assert tuple(stages.strategy_outcomes(df).head()) == (0, True, False, True, False, "")


def test_commands_read_and_write_files(table):
    """No pipes, whose set-up takes longer than a short command; large texts need no reader beside the writer."""
    kinds = stages.run_command(["stat", "-L", "-c", "%F", "/dev/stdin", "/dev/stdout"], "x", 10)
    assert kinds["rc"] == 0 and all(line.startswith("regular") for line in kinds["stdout"].splitlines())
    text = "é" * (1 << 20)
    assert stages.run_command(["cat"], text, 10)["stdout"] == text
    late = stages.run_command(["sh", "-c", "echo early; exec sleep 9"], "x", 0.3)
    assert (late["rc"], late["stdout"], late["timed_out"]) == (None, "early\n", True)


def test_batches_are_computed_in_bounded_parts(spark):
    """Many long texts of one batch are never held with all their results."""
    df = spark.range(0, 64, 1, 1).select("id", F.repeat(F.lit("x"), 1 << 18).alias("text"))
    seen = stages._with_column(df, "rows", "LONG", lambda batch: [batch.num_rows] * batch.num_rows)
    sizes = [r["rows"] for r in seen.select("id", "rows").orderBy("id").collect()]
    assert len(sizes) == 64 and max(sizes) <= stages.PART_BYTES >> 18
