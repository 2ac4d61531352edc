"""Outcomes of generate-evaluate-repair runs.

The long table ``evaluations(idx, retry, choice, compile_success, execution_success, ...)`` is
reduced to one row per (record, round) with partial aggregation.  Windows then run over the
rounds of one record, whose number is bounded by the retry limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _false(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def round_summary(evaluations: DataFrame) -> DataFrame:
    """Executed, compiled and total choices per (record, round)."""
    return evaluations.groupBy("idx", "retry").agg(
        F.count_if(_false("execution_success")).alias("n_executed"),
        F.count_if(_false("compile_success")).alias("n_compiled"),
        F.count(F.lit(1)).alias("n_total"),
    )


def record_summary(evaluations: DataFrame, num_retry: int = 10) -> DataFrame:
    """Per record: any success over all rounds and the first executed round.

    ``pass_round`` repeats the first round with ``num_retry`` in place of "never".
    """
    first = F.min(F.when(F.col("execution_success"), F.col("retry")))
    return evaluations.groupBy("idx").agg(
        F.bool_or(_false("compile_success")).alias("any_compile"),
        F.bool_or(_false("execution_success")).alias("any_execution"),
        first.alias("first_round"),
        F.coalesce(first, F.lit(num_retry)).alias("pass_round"),
    )


def target_flags(targets: DataFrame) -> DataFrame:
    """Target flags as recorded with the first attempt."""
    return targets.where("retry = -1").select("idx", "compile_success", "execution_success")


def first_executed(evaluations: DataFrame) -> DataFrame:
    """The first executed evaluation of each record, in round and choice order."""
    row = F.struct(*evaluations.columns)
    return (
        evaluations.where(_false("execution_success"))
        .groupBy("idx")
        .agg(F.min_by(row, F.struct("retry", "choice")).alias("r"))
        .select("r.*")
    )


def first_executed_of_round(evaluations: DataFrame, retry: int) -> DataFrame:
    """Code of the first executed choice of one round."""
    return (
        evaluations.where((F.col("retry") == retry) & _false("execution_success"))
        .groupBy("idx")
        .agg(F.min_by("llvm_ir", "choice").alias("llvm_ir"))
    )


def best_compilable(evaluations: DataFrame, retry: int) -> DataFrame:
    """Per record the first compiled choice of the previous round, else of any earlier one."""
    row = F.struct(*evaluations.columns)
    order = F.struct(F.col("retry") != retry - 1, F.col("retry"), F.col("choice"))
    return (
        evaluations.where(_false("compile_success") & (F.col("retry") < retry))
        .groupBy("idx")
        .agg(F.min_by(row, order).alias("r"))
        .select("r.*")
    )


def failed_records(evaluations: DataFrame) -> DataFrame:
    """Records no round of which executed."""
    return record_summary(evaluations).where(~F.col("any_execution")).select("idx")


def failed_in_last_round(evaluations: DataFrame) -> DataFrame:
    """Records whose last round has no executed choice, with that round."""
    return (
        round_summary(evaluations)
        .groupBy("idx")
        .agg(F.max(F.struct("retry", "n_executed")).alias("last"))
        .where("last.n_executed = 0")
        .select("idx", F.col("last.retry").alias("retry"))
    )


def failed_sample_export(evaluations: DataFrame, targets: DataFrame) -> DataFrame:
    """Compiled candidates of the last round of finally failed records, with the target IR."""
    failed = failed_in_last_round(evaluations)
    return (
        evaluations.join(failed, ["idx", "retry"])
        .where(_false("compile_success") & (F.coalesce("llvm_ir", F.lit("")) != ""))
        .select("idx", "retry", "choice", "llvm_ir")
        .join(targets.select("idx", "target_ir"), "idx")
    )


def failed_targets(outcomes: DataFrame) -> DataFrame:
    """Positions whose target did not execute."""
    return outcomes.where(~_false("target_execution_success")).select("idx")


def run_rounds(evaluations: DataFrame) -> DataFrame:
    """Round summaries up to and including the first executed round: what a repair run keeps."""
    rounds = round_summary(evaluations)
    earlier = Window.partitionBy("idx").orderBy("retry").rowsBetween(Window.unboundedPreceding, -1)
    solved = F.coalesce(F.max(F.col("n_executed") > 0).over(earlier), F.lit(False))
    return rounds.withColumn("_solved", solved).where("not _solved").drop("_solved")


def accumulated_success(rounds: DataFrame, num_retry: int = 10) -> DataFrame:
    """Accumulated compile and execution counts over the repair rounds.

    ``rounds`` is one row per (record, round).  Step 0 counts the records that needed no repair.
    Step r + 1 adds, for repair round r, records compiling after a round that did not, and records
    executing.  A record that loses and regains compilation counts again;
    ``first_compile_accumulated`` counts each record once.
    """
    by_round = Window.partitionBy("idx").orderBy("retry")
    flags = rounds.select(
        "idx",
        "retry",
        (F.col("n_compiled") > 0).alias("compiles"),
        (F.col("n_executed") > 0).alias("executes"),
        F.max("retry").over(Window.partitionBy("idx")).alias("_last"),
    )
    repair = flags.where("retry >= 0")
    before = F.lag("compiles").over(by_round)
    earlier = by_round.rowsBetween(Window.unboundedPreceding, -1)
    steps = repair.select(
        (F.col("retry") + 1).alias("step"),
        (F.col("compiles") & ~F.coalesce(before, F.lit(False))).alias("newly"),
        (
            F.col("compiles") & ~F.coalesce(F.max("compiles").over(earlier), F.lit(False))
        ).alias("first_time"),
        F.col("executes").alias("executes"),
    ).where(F.col("step") <= num_retry)
    start = flags.where("retry = -1 and _last = -1").select(
        F.lit(0).alias("step"),
        F.lit(True).alias("newly"),
        F.lit(True).alias("first_time"),
        F.lit(True).alias("executes"),
    )
    per_step = (
        steps.unionByName(start)
        .groupBy("step")
        .agg(
            F.count_if("newly").alias("compiled"),
            F.count_if("first_time").alias("first_compiled"),
            F.count_if("executes").alias("executed"),
        )
    )
    spark = rounds.sparkSession
    axis = spark.range(num_retry + 1).select(F.col("id").cast("int").alias("step"))
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    filled = axis.join(per_step, "step", "left").na.fill(0)
    return filled.select(
        "step",
        F.sum("compiled").over(upto).alias("compile_accumulated"),
        F.sum("first_compiled").over(upto).alias("first_compile_accumulated"),
        F.sum("executed").over(upto).alias("execution_accumulated"),
    )


def running_max(progress: DataFrame, counters: list[str], order: str = "retry") -> DataFrame:
    """Running maximum of counters over the rounds; ``progress`` has one row per round."""
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return progress.select(order, *[F.max(c).over(upto).alias(f"{c}_max") for c in counters])


def round_progress(evaluations: DataFrame, targets: DataFrame) -> DataFrame:
    """Per round: records with a compiled and an executed choice, and the targets' counts."""
    predicted = (
        round_summary(evaluations)
        .groupBy("retry")
        .agg(
            F.count_if(F.col("n_compiled") > 0).alias("predict_compile"),
            F.count_if(F.col("n_executed") > 0).alias("predict_execution"),
        )
    )
    truth = targets.groupBy("retry").agg(
        F.count_if(_false("compile_success")).alias("target_compile"),
        F.count_if(_false("execution_success")).alias("target_execution"),
    )
    return predicted.join(truth, "retry", "left")


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two runs per record; a record absent from one run has null there and never matches."""
    a = record_summary(left).select("idx", F.col("pass_round").alias("round_a"), F.col("any_execution").alias("pass_a"), F.col("any_compile").alias("compile_a"))
    b = record_summary(right).select("idx", F.col("pass_round").alias("round_b"), F.col("any_execution").alias("pass_b"), F.col("any_compile").alias("compile_b"))
    return a.join(b, "idx", "full_outer").withColumn(
        "match", F.coalesce(F.col("pass_a") == F.col("pass_b"), F.lit(False))
    )


def contingency(pairs: DataFrame) -> DataFrame:
    """Both, neither, only one run passing; the match rate is over the shorter run."""
    a, b = _false("pass_a"), _false("pass_b")
    n_a = F.count("pass_a")
    n_b = F.count("pass_b")
    matches = F.count_if("match")
    return pairs.agg(
        F.count_if(a & b).alias("both_true"),
        F.count_if(~a & ~b).alias("both_false"),
        F.count_if(a & ~b).alias("only_a"),
        F.count_if(~a & b).alias("only_b"),
        matches.alias("n_match"),
        F.round(F.try_divide(matches * 100.0, F.least(n_a, n_b)), 1).alias("match_rate"),
    )


def failed_sets(pairs: DataFrame, side: str = "left") -> DataFrame:
    """Failure class per record: not compiled, or compiled but not executed.

    ``side`` is the run that must fail: ``left``, ``right``, or ``both``.
    """
    a_exec, a_comp = _false("pass_a"), _false("compile_a")
    b_exec, b_comp = _false("pass_b"), _false("compile_b")
    executed, compiled = {
        "left": (a_exec, a_comp),
        "right": (b_exec, b_comp),
        "both": (a_exec | b_exec, a_comp | b_comp),
    }[side]
    return pairs.where(~executed).select(
        "idx",
        (~compiled).alias("compile_failed"),
        compiled.alias("compiled_not_executed"),
    )
