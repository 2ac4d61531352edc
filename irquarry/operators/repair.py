"""The retry dataflow: generate, evaluate, and repair what failed, round by round.

Every round is three table appends partitioned by round (prompts, responses, evaluations) in the
run's store.  The next round reads only the partition before it, so plans stay short, lost
executors re-read files, and a run that was cut off resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irquarry.config import JobConfig
from irquarry.functions.code import response_code, strip_think
from irquarry.operators.outcomes import (
    best_compilable,
    first_executed,
    record_summary,
    round_summary,
    target_flags,
)
from irquarry.operators.prompts import analysis_fix, analysis_prompt, fix_basis, fix_prompt
from irquarry.operators.stages import cached_stage, read_store, unanswered
from irquarry.schemas import EVALUATIONS, PROMPTS, RESPONSES
from irquarry.session import new_work_path

ROUND = ["retry"]
RECORD_ROUND = ["idx", "retry"]


@dataclass(frozen=True)
class RepairRun:
    """Where a run is stored and how it generates and evaluates.

    ``generate`` maps (idx, retry, prompt) rows to response rows; ``evaluate`` adds
    compile_success, execution_success, error_msg and assembly to (idx, retry, choice, llvm_ir)
    rows; ``embed``, if given, adds embedding and target_embedding to evaluation rows.
    """

    store: str
    config: JobConfig
    generate: Callable[[DataFrame], DataFrame]
    evaluate: Callable[[DataFrame], DataFrame]
    embed: Callable[[DataFrame], DataFrame] | None = None

    def path(self, table: str) -> str:
        return f"{self.store.rstrip('/')}/{table}"


def _run_round(run: RepairRun, prompts: DataFrame, retry: int) -> DataFrame | None:
    """Store a round's prompts, responses and evaluations; what is stored already is kept.

    Without any prompt there is no round.
    """
    now = F.col("retry") == retry
    kept = cached_stage(
        prompts, RECORD_ROUND, run.path("prompts"), PROMPTS, lambda df: df, ROUND, now
    )
    if kept.isEmpty():
        return None
    responses = cached_stage(
        kept.select("idx", "retry", "prompt"),
        RECORD_ROUND,
        run.path("responses"),
        RESPONSES,
        run.generate,
        ROUND,
        now,
    )

    def evaluated(df: DataFrame) -> DataFrame:
        code = response_code(F.coalesce("content", F.lit("")))
        return run.evaluate(df.select("idx", "retry", "choice", code.alias("llvm_ir")))

    return cached_stage(
        responses,
        RECORD_ROUND,
        run.path("evaluations"),
        EVALUATIONS,
        evaluated,
        ROUND,
        now,
    )


def evaluations(spark, run: RepairRun) -> DataFrame:
    return read_store(spark, run.path("evaluations"), EVALUATIONS)


def _failed_basis(run: RepairRun, previous: DataFrame) -> DataFrame:
    """What the fix prompts need, for the records whose previous round has no executed choice.

    Embeddings cost external calls, so solved records are dropped before them.
    """
    if run.embed is not None:
        failed = round_summary(previous).where("n_executed = 0").select("idx")
        rows = run.embed(previous.join(failed, "idx", "left_semi"))
    else:
        unknown = F.lit(None).cast("array<double>")
        rows = previous.withColumns({"embedding": unknown, "target_embedding": unknown})
    return fix_basis(rows).where("n_executed = 0")


def _analysis_prompts(run: RepairRun, records: DataFrame, failed: DataFrame, spark, retry: int) -> DataFrame:
    """Two-stage prompts of the records that have a compiled candidate in some earlier round."""
    earlier = evaluations(spark, run).join(failed, "idx", "left_semi")
    best = best_compilable(earlier, retry).select("idx", "llvm_ir", "assembly", "error_msg")
    rows = records.join(best, "idx")
    request = analysis_prompt(
        F.col("target_assembly"), F.col("llvm_ir"), F.col("assembly"), F.col("error_msg")
    )
    asked = rows.select("idx", F.lit(retry).alias("retry"), request.alias("prompt"))
    now = F.col("retry") == retry
    answers = cached_stage(
        asked, RECORD_ROUND, run.path("analyses"), RESPONSES, run.generate, ROUND, now
    )
    first = answers.where("choice = 0").select(
        "idx", strip_think(F.coalesce("content", F.lit(""))).alias("analysis")
    )
    prompt = analysis_fix(
        F.col("prompt"), F.col("llvm_ir"), F.col("assembly"), F.col("analysis")
    )
    return rows.join(first, "idx").select("idx", prompt.alias("next_prompt"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def repair_loop(records: DataFrame, run: RepairRun) -> DataFrame:
    """Run the first attempt and up to ``num_retry`` repair rounds; returns all evaluations.

    ``records(idx, prompt, target_assembly[, c_code])``.  A record leaves the loop when a choice
    executed, in whichever round, the last one included.  The records are stored first: their
    prompts may come from a search, which must not run again in every round.  A round hands on the
    records that failed, so later ones do not read and shuffle the texts of the solved.
    """
    spark = records.sparkSession
    config = run.config
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema)
    records = cached_stage(records, ["idx"], run.path("records"), ddl, lambda df: df)
    if config.fix_prompt_type != "llm-fix":
        records = records.drop("target_assembly")
    first = records.select(
        "idx",
        F.lit(-1).alias("retry"),
        F.lit(config.prompt_type).alias("prompt_type"),
        "prompt",
    )
    previous = _run_round(run, first, -1)
    still_open = records
    for retry in range(config.num_retry):
        if previous is None:
            break
        basis = _failed_basis(run, previous)
        rows = _stored(still_open.join(basis, "idx"), "open")
        still_open = rows.select(*records.columns)
        basis = rows.select(*basis.columns)
        if config.fix_prompt_type == "llm-fix":
            analysed = _analysis_prompts(run, still_open, basis.select("idx"), spark, retry)
            rows = rows.join(analysed, "idx", "left")
            # Records without any compiled candidate get the compile fix.
            prompt = F.coalesce("next_prompt", fix_prompt(config, F.col("prompt")))
        else:
            prompt = fix_prompt(config, F.col("prompt"))
        prompts = rows.select(
            "idx",
            F.lit(retry).alias("retry"),
            F.lit(config.fix_prompt_type).alias("prompt_type"),
            prompt.alias("prompt"),
        )
        previous = _run_round(run, prompts, retry)
    return evaluations(spark, run)


def corrected_code(all_evaluations: DataFrame) -> DataFrame:
    """The first executed code of each solved record."""
    return first_executed(all_evaluations).select("idx", "retry", "choice", "llvm_ir")


def rescore(spark, run: RepairRun, num_retry: int | None = None) -> DataFrame:
    """Evaluate stored responses of the rounds -1..num_retry-1 again; absent rounds are skipped."""
    limit = run.config.num_retry if num_retry is None else num_retry
    responses = read_store(spark, run.path("responses"), RESPONSES).where(F.col("retry") < limit)
    code = response_code(F.coalesce("content", F.lit("")))
    return run.evaluate(responses.select("idx", "retry", "choice", code.alias("llvm_ir")))


def rerun_compiled_only(
    records: DataFrame, previous_run: DataFrame, run: RepairRun, fix_prompt_type: str = "llm-fix"
) -> DataFrame:
    """Repair again, with the two-stage fix, the records that compiled but never executed."""
    summary = record_summary(previous_run)
    ids = summary.where("any_compile and not any_execution").select("idx")
    again = replace(run, config=replace(run.config, fix_prompt_type=fix_prompt_type))
    return repair_loop(records.join(ids, "idx", "left_semi"), again)


def quarantined_prompts(spark, run: RepairRun) -> DataFrame:
    """Prompts of the run that no stored response answers."""
    asked = read_store(spark, run.path("prompts"), PROMPTS)
    return unanswered(asked, read_store(spark, run.path("responses"), RESPONSES))


def run_totals(evaluations: DataFrame, targets: DataFrame) -> DataFrame:
    """Records of a run, those with a compiled and an executed choice, and the same of their targets."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    truth = target_flags(targets).select(
        "idx", F.col("compile_success").alias("target_compile"), F.col("execution_success").alias("target_execution")
    )
    rows = record_summary(evaluations).join(truth, "idx", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if("any_compile").alias("predict_compile_success"),
        F.count_if("any_execution").alias("predict_execution_success"),
        F.count_if(flag("target_compile")).alias("target_compile_success"),
        F.count_if(flag("target_execution")).alias("target_execution_success"),
    )


def run_batch(records: DataFrame, run: RepairRun) -> DataFrame:
    """The whole job: the repair loop over ``records`` (with target_ir), and the totals of its outcome."""
    truth = evaluate_targets(records, run.evaluate)
    return run_totals(repair_loop(records, run), truth)


def evaluate_targets(records: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Flags of the ground truth, evaluated once per record with the same evaluator."""
    rows = records.select(
        "idx", F.lit(-1).alias("retry"), F.lit(0).alias("choice"), F.col("target_ir").alias("llvm_ir")
    )
    return evaluate(rows).select("idx", "retry", "compile_success", "execution_success", "assembly")
