"""Batched stages for what runs outside Spark: commands, embedding, generation.

Each stage takes Arrow batches and adds a column; passed-through columns stay in Arrow.  Failures
of single rows become values of the row, never failures of the task.
"""

from __future__ import annotations

import os
import queue
import select
import subprocess
import tempfile
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack
from typing import BinaryIO

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from irquarry.config import Timeouts
from irquarry.schemas import TOOL_RESULT, struct

INPUT, OUTPUT = "{input}", "{output}"
_TOOL_FIELDS = ("rc", "stdout", "stderr", "output", "timed_out")


def _text(raw: bytes | str | None) -> str:
    if raw is None:
        return ""
    return raw.decode("utf-8", "replace") if isinstance(raw, bytes) else raw


def _scratch(name: str) -> BinaryIO:
    """A file of no name, in memory where the system has that."""
    if hasattr(os, "memfd_create"):
        return open(os.memfd_create(name), "w+b", buffering=0)
    return tempfile.TemporaryFile(buffering=0)


def _ended(process: subprocess.Popen, timeout: float) -> bool:
    """Whether the process ends in time; waits on its handle where the system has one, not in steps."""
    try:
        handle = os.pidfd_open(process.pid)
    except (AttributeError, OSError):
        try:
            process.wait(timeout)
        except subprocess.TimeoutExpired:
            return False
        return True
    try:
        waiting = select.poll()
        waiting.register(handle, select.POLLIN)
        return bool(waiting.poll(None if timeout is None else timeout * 1000))
    finally:
        os.close(handle)


def _finished(command: list[str], stdin: bytes | None, timeout: float) -> tuple[int | None, bytes, bytes]:
    """Exit code (null when time ran out), output and errors; streams are files, as pipes to a short command take longer than itself."""
    with ExitStack() as files:
        source = None
        if stdin is not None:
            source = files.enter_context(_scratch("stdin"))
            rest = memoryview(stdin)
            while rest:
                rest = rest[source.write(rest) :]
            source.seek(0)
        out, err = (files.enter_context(_scratch(name)) for name in ("stdout", "stderr"))
        process = subprocess.Popen(command, stdin=source, stdout=out, stderr=err)
        in_time = False
        try:
            in_time = _ended(process, timeout)
        finally:
            if not in_time:
                process.kill()
            process.wait()
        for stream in (out, err):
            stream.seek(0)
        return process.returncode if in_time else None, out.read(), err.read()


def run_command(
    argv: Sequence[str], text: str | None, timeout: float, work_dir: str | None = None
) -> dict:
    """Run one command on one text; time-outs and missing commands are results too.

    The text goes to standard input.  Where ``argv`` names ``{input}`` or ``{output}``, the text is
    written to a file and the output file is read back, inside a folder below ``work_dir``.
    """

    def call(command: Sequence[str], stdin: str | None, output: str | None) -> dict:
        result = dict(rc=None, stdout="", stderr="", output=None, timed_out=False)
        try:
            rc, out, err = _finished(list(command), None if stdin is None else stdin.encode("utf-8"), timeout)
            result.update(rc=rc, stdout=_text(out), stderr=_text(err), timed_out=rc is None)
        except OSError as broken:
            result.update(stderr=str(broken))
        if output is not None and os.path.exists(output):
            with open(output, "rb") as handle:
                result["output"] = _text(handle.read())
        return result

    if not any(INPUT in a or OUTPUT in a for a in argv):
        return call(argv, text, None)
    if work_dir is None:
        raise ValueError("a command that names files needs a work_dir in the shared folder")
    with tempfile.TemporaryDirectory(dir=work_dir) as folder:
        source, target = os.path.join(folder, "input"), os.path.join(folder, "output")
        with open(source, "w", encoding="utf-8") as handle:
            handle.write(text or "")
        command = [a.replace(INPUT, source).replace(OUTPUT, target) for a in argv]
        return call(command, None, target)


#: Bytes of a batch whose results are held at once.
PART_BYTES = 4 << 20


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most PART_BYTES, a row that is larger alone."""
    if batch.num_rows <= 1 or batch.nbytes <= PART_BYTES:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from _parts(batch.slice(0, half))
        yield from _parts(batch.slice(half))


def _with_column(df: DataFrame, name: str, ddl: str, compute: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """Append a column computed from parts of batches; None entries drop nothing."""
    schema = StructType(list(df.schema.fields)).add(name, struct(f"x {ddl}")["x"].dataType)
    arrow_type = to_arrow_type(schema[name].dataType)

    def each(batches):
        for batch in (part for whole in batches for part in _parts(whole)):
            values = pa.array(compute(batch) if batch.num_rows else [], type=arrow_type)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, values], names=[*batch.schema.names, name]
            )

    return df.mapInArrow(each, schema)


def command_stage(
    df: DataFrame,
    argv: Sequence[str],
    stdin: str,
    out: str = "tool",
    timeout: float = Timeouts.command,
    threads: int = 1,
    tasks: int | None = None,
    key: str = "idx",
    run_if: str | None = None,
    work_dir: str | None = None,
) -> DataFrame:
    """Run a command per row on the text of column ``stdin``; the result struct is column ``out``.

    ``tasks`` spreads slow rows by hash of ``key`` first.  Rows whose ``run_if`` is not true get a
    null result.
    """
    if tasks:
        df = df.repartition(tasks, key)

    def compute(batch: pa.RecordBatch) -> list:
        texts = batch.column(stdin).to_pylist()
        wanted = batch.column(run_if).to_pylist() if run_if else [True] * len(texts)

        def one(row):
            text, go = row
            return run_command(argv, text, timeout, work_dir) if go else None

        with ThreadPoolExecutor(max_workers=threads) as pool:
            return list(pool.map(one, zip(texts, wanted)))

    return _with_column(df, out, TOOL_RESULT, compute)


def compile_stage(
    df: DataFrame,
    ir: str,
    compiler: Sequence[str] = ("llc",),
    flags: Sequence[str] = (),
    timeout: float = Timeouts.compile,
    **kwargs,
) -> DataFrame:
    """Compile column ``ir`` to assembly and to an object; the object's exit code is the verdict.

    Adds compile_success, assembly and error_msg.  Null code fails with an empty message, and
    messages are kept for failures only.
    """
    kwargs = dict(timeout=timeout, **kwargs)
    rows = df.withColumn("_present", F.col(ir).isNotNull())
    rows = command_stage(rows, [*compiler, *flags, "-", "-o", "-"], ir, "_asm", run_if="_present", **kwargs)
    kwargs.pop("tasks", None)
    rows = command_stage(
        rows, [*compiler, *flags, "-", "-filetype=obj", "-o", "/dev/null"], ir, "_obj", run_if="_present", **kwargs
    )
    ok = F.coalesce(F.col("_obj.rc") == 0, F.lit(False))
    return (
        rows.withColumn("compile_success", ok)
        .withColumn("assembly", F.when(ok, F.col("_asm.stdout")))
        .withColumn("error_msg", F.when(ok, F.lit("")).otherwise(F.coalesce("_obj.stderr", F.lit(""))))
        .drop("_present", "_asm", "_obj")
    )


def two_variants(
    df: DataFrame, text: str, variants: dict[str, Sequence[str]], **kwargs
) -> DataFrame:
    """Run several command variants per row; each output column is empty on failure."""
    out = df
    for name, argv in variants.items():
        out = command_stage(out, argv, text, "_tool", **kwargs)
        good = F.coalesce(F.col("_tool.rc") == 0, F.lit(False))
        out = out.withColumn(name, F.when(good, F.col("_tool.stdout")).otherwise(F.lit(""))).drop("_tool")
    return out


def command_chain(
    df: DataFrame, text: str, steps: list[tuple[str, Sequence[str]]], **kwargs
) -> DataFrame:
    """Feed each step's output to the next; a row stops at its first failure.

    Adds ``result`` (output of the last step, null after a failure) and ``error``.
    """
    out = df.withColumns({"result": F.col(text), "error": F.lit(None).cast("string")})
    for name, argv in steps:
        out = out.withColumn("_go", F.col("error").isNull() & F.col("result").isNotNull())
        out = command_stage(out, argv, "result", "_tool", run_if="_go", **kwargs)
        failed = F.col("_go") & ~F.coalesce(F.col("_tool.rc") == 0, F.lit(False))
        reason = F.when(F.col("_tool.timed_out"), F.lit("timed out")).otherwise(F.col("_tool.stderr"))
        out = out.withColumns(
            {
                "error": F.coalesce("error", F.when(failed, F.concat(F.lit(f"{name}: "), reason))),
                "result": F.when(F.col("_go") & ~failed, F.col("_tool.stdout")),
            }
        ).drop("_go", "_tool")
    return out


def _isolated(call: Callable[[list[str]], list], texts: list[str]) -> list:
    """Results of a batched call; a failing batch is repeated one by one, and what still fails is null."""
    try:
        return list(call(texts))
    except Exception:
        return [None] if len(texts) == 1 else [r for t in texts for r in _isolated(call, [t])]


def with_deadline(call: Callable[[list[str]], list], deadline: float, hedge: float | None = None) -> Callable[[list[str]], list]:
    """``call`` that raises TimeoutError after ``deadline`` seconds; a second attempt starts beside it after ``hedge`` seconds.

    The first answer counts.  An attempt that comes late runs on in a thread of its own, and what it returns is dropped.
    """
    hedge = deadline / 2 if hedge is None else hedge

    def bounded(texts: list[str]) -> list:
        answers: queue.SimpleQueue = queue.SimpleQueue()

        def attempt() -> None:
            try:
                answers.put((list(call(texts)), None))
            except Exception as failure:
                answers.put((None, failure))

        end, running, started = time.monotonic() + deadline, 0, 0
        while True:
            if started < 2 and (not started or running):
                threading.Thread(target=attempt, daemon=True).start()
                started, running = started + 1, running + 1
            wait = end - time.monotonic()
            try:
                answer, failure = answers.get(timeout=max(min(wait, hedge) if started < 2 else wait, 0))
            except queue.Empty:
                if time.monotonic() >= end:
                    raise TimeoutError(f"no answer within {deadline} s") from None
                continue
            running -= 1
            if failure is None:
                return answer
            if not running:
                raise failure

    return bounded


def embedding_stage(
    df: DataFrame,
    text: str,
    embed: Callable[[list[str]], list[list[float] | None]],
    batch_size: int = 64,
    out: str = "embedding",
) -> DataFrame:
    """Embed a text column in calls of ``batch_size``; rows the model gives no vector are dropped.

    A call that fails is repeated text by text, so only the texts that fail alone are lost.
    """

    def compute(batch: pa.RecordBatch) -> list:
        texts = batch.column(text).to_pylist()
        vectors: list = []
        for start in range(0, len(texts), batch_size):
            vectors.extend(_isolated(embed, texts[start : start + batch_size]))
        return vectors

    return _with_column(df, out, "ARRAY<FLOAT>", compute).where(F.col(out).isNotNull())


def generation_stage(
    prompts: DataFrame,
    generate: Callable[[list[str]], list[list[str]]],
    batch_size: int = 64,
    tasks: int | None = None,
    timeout: float = Timeouts.generation,
    hedge: float | None = None,
) -> DataFrame:
    """Generate choices per prompt: ``prompts(idx, retry, prompt)`` to one row per choice.

    ``tasks`` spreads the slow calls by hash of the record first.  A call has ``timeout`` seconds, and after ``hedge`` (half of
    them unless given) a second attempt starts beside it.  A batch that fails or comes late is asked again prompt by prompt; a prompt
    whose call fails or hangs, alone too, gives no row, so a later run of the stage asks again.
    """
    if tasks:
        prompts = prompts.repartition(tasks, "idx")
    generate = with_deadline(generate, timeout, hedge)

    def compute(batch: pa.RecordBatch) -> list:
        texts = batch.column("prompt").to_pylist()
        answers: list = []
        for start in range(0, len(texts), batch_size):
            answers.extend(_isolated(generate, texts[start : start + batch_size]))
        return answers

    answered = _with_column(prompts, "_choices", "ARRAY<STRING>", compute)
    return answered.select(
        "idx", "retry", F.posexplode("_choices").alias("choice", "content")
    ).withColumn("reasoning", F.lit(None).cast("string"))


def unanswered(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Prompts without any response: their calls failed, alone too."""
    return prompts.join(responses.select("idx", "retry").distinct(), ["idx", "retry"], "left_anti")


def _found_store(spark, path: str, ddl: str) -> DataFrame | None:
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_store(spark, path: str, ddl: str) -> DataFrame:
    """A stored table, empty while nothing was written."""
    found = _found_store(spark, path, ddl)
    return spark.createDataFrame([], struct(ddl)) if found is None else found


def cached_stage(
    df: DataFrame,
    keys: list[str],
    store: str,
    ddl: str,
    derive: Callable[[DataFrame], DataFrame],
    partition_by: list[str] | None = None,
    only: Column | None = None,
) -> DataFrame:
    """Derive only rows whose key the store lacks, append them, and read the store.

    Files of a job that dies before its commit are not read; running it again appends what is still lacking.
    ``only`` restricts the stored rows looked at, e.g. to one round's partition.
    """
    spark = df.sparkSession

    def stored() -> DataFrame:
        table = read_store(spark, store, ddl)
        return table if only is None else table.where(only)

    # a store not written yet lacks every row: none is shuffled to find that out
    new = _found_store(spark, store, ddl) is None
    todo = df if new else df.join(stored().select(*keys).distinct(), keys, "left_anti")
    names = struct(ddl).fieldNames()
    writer = derive(todo).select(*names).write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(store)
    return stored()


def strategy_outcomes(results: DataFrame) -> DataFrame:
    """Outcome rows of an external strategy: four flags and the error text per record."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return results.select(
        "idx",
        flag("predict_compile_success"),
        flag("predict_execution_success"),
        flag("target_compile_success"),
        flag("target_execution_success"),
        F.coalesce("error", F.lit("")).alias("error_msg"),
    )
