"""Keyed joins between predictions and the corpus, and the scores over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irquarry.functions.code import composite_key, targets_aarch64
from irquarry.operators.ranking import keep_last


def with_prediction_key(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("key", composite_key(F.col("file"), F.col("func_head_types")))


def with_corpus_key(functions: DataFrame) -> DataFrame:
    return functions.withColumn("key", composite_key(F.col("path"), F.col("func_head_types")))


def match_predictions(predictions: DataFrame, functions: DataFrame) -> DataFrame:
    """Predictions joined to their corpus rows; the last row of a repeated key wins on each side.

    Both sides hold one row per key when they meet, so no key can multiply rows.
    """
    left = keep_last(with_prediction_key(predictions), ["key"])
    corpus = with_corpus_key(functions)
    # keys and positions alone decide which rows are fetched; the others' texts stay where they are
    last = corpus.groupBy(F.col("key").alias("_key")).agg(F.max("idx").alias("_idx"))
    asked = with_prediction_key(predictions).select(F.col("key").alias("_key"))
    wanted = last.join(asked, "_key", "left_semi")
    same = (F.col("key") == F.col("_key")) & F.col("idx").eqNullSafe(F.col("_idx"))
    right = keep_last(corpus.join(wanted, same, "left_semi"), ["key"]).select(
        "key", F.struct(*[c for c in functions.columns]).alias("row")
    )
    return left.join(right, "key")


def unmatched_predictions(predictions: DataFrame, functions: DataFrame) -> DataFrame:
    """Predictions, one per key, whose key the corpus does not hold."""
    left = keep_last(with_prediction_key(predictions), ["key"])
    known = with_corpus_key(functions).select("key").distinct()
    return left.join(known, "key", "left_anti")


def any_true(flags: Column) -> Column:
    return F.coalesce(F.exists(flags, lambda x: x), F.lit(False))


def guard_target(predictions: DataFrame) -> DataFrame:
    """Predictions for the other architecture count as failed, whatever was recorded."""

    def guarded(flag: str) -> Column:
        return F.zip_with(
            F.col(flag), F.col("predict"), lambda ok, p: F.coalesce(ok, F.lit(False)) & ~targets_aarch64(p)
        )

    return predictions.withColumns(
        {f: guarded(f) for f in ("predict_compile_success", "predict_execution_success")}
    )


def evaluate_predictions(
    matched: DataFrame, evaluate: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Flags of every prediction of matched records, evaluated one choice per row.

    ``evaluate`` adds compile_success and execution_success to (idx, choice, llvm_ir) rows.  Code
    for the other architecture is not evaluated and counts as failed.  The flag lists are as long
    as the record's own prediction list.
    """
    choices = matched.select("idx", F.posexplode("predict").alias("choice", "llvm_ir"))
    runnable = choices.where(~targets_aarch64(F.col("llvm_ir")))
    done = evaluate(runnable).select("idx", "choice", "compile_success", "execution_success")
    flags = choices.select("idx", "choice").join(done, ["idx", "choice"], "left")
    names = ("compile_success", "execution_success")
    cell = F.struct("choice", *[F.coalesce(n, F.lit(False)).alias(n) for n in names])
    lists = flags.groupBy("idx").agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
    return (
        matched.drop(*[f"predict_{n}" for n in names])
        .join(lists, "idx", "left")
        .withColumns({f"predict_{n}": F.col(f"_cells.{n}") for n in names})
        .drop("_cells")
    )


def score_totals(scored: DataFrame) -> DataFrame:
    """Records whose any choice compiled or executed, and the same for the targets.

    A record without flags counts as failed.
    """
    return scored.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(any_true(F.col("predict_compile_success"))).alias("predict_compile_success"),
        F.count_if(any_true(F.col("predict_execution_success"))).alias("predict_execution_success"),
        F.count_if(F.coalesce("target_compile_success", F.lit(False))).alias("target_compile_success"),
        F.count_if(F.coalesce("target_execution_success", F.lit(False))).alias("target_execution_success"),
    )


def success_rates(outcomes: DataFrame, flags: list[str], by: list[str] | None = None) -> DataFrame:
    """Share of true flags in percent, one decimal."""
    return outcomes.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_records"),
        *[
            F.round(F.avg(F.coalesce(F.col(f), F.lit(False)).cast("double")) * 100, 1).alias(f"{f}_pct")
            for f in flags
        ],
    )


def shared_functions(sample: DataFrame, split: DataFrame, all_matches: bool) -> DataFrame:
    """Sample rows found in a split by path and head: once each, or once per match."""
    keys = ["path", "func_head"]
    if not all_matches:
        return sample.join(split.select(*keys).distinct(), keys, "left_semi")
    # One row per key on the right: a frequent key neither multiplies rows nor fills a task.
    per_key = split.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_matches"))
    return sample.join(per_key, keys)


def matching_rows(sample: DataFrame, split: DataFrame) -> DataFrame:
    """All rows of a split that share path and head with a sample row.

    With the sample's own path and head they are the matches in full; the pairs of a key are not written out.
    """
    keys = ["path", "func_head"]
    return split.join(sample.select(*keys).distinct(), keys, "left_semi")


def io_verdict(cases: DataFrame, record: str = "idx") -> DataFrame:
    """All cases of a record pass; ``cases`` holds arrays of expected and observed outputs."""
    pairs = F.arrays_zip(F.col("expected"), F.col("observed"))
    equal = F.forall(pairs, lambda p: p["expected"].eqNullSafe(p["observed"]))
    complete = F.size("expected") == F.size("observed")
    return cases.select(record, F.coalesce(complete & equal, F.lit(False)).alias("io_success"))


def io_verdict_rows(records: DataFrame, cases: DataFrame, record: str = "idx") -> DataFrame:
    """The same verdict over one row per case; records without cases pass."""
    equal = F.col("expected").eqNullSafe(F.col("observed"))
    per_record = cases.groupBy(record).agg(F.bool_and(equal).alias("_ok"))
    return records.join(per_record, record, "left").select(
        record, F.coalesce("_ok", F.lit(True)).alias("io_success")
    )


def text_perfect(predictions: DataFrame) -> DataFrame:
    """Per choice: equal to the target as text, or equal after compilation of both."""
    same_text = F.col("predict_ir") == F.col("target_ir")
    same_asm = F.col("predict_assembly") == F.col("target_assembly")
    return predictions.withColumn(
        "perfect", F.coalesce(same_text, F.lit(False)) | F.coalesce(same_asm, F.lit(False))
    )


def program_totals(choices: DataFrame, program: str = "file") -> DataFrame:
    """Programs, those with a compiled choice, and those with a perfect choice that compiled."""
    per_program = choices.groupBy(program).agg(
        F.bool_or("compile_success").alias("compiled"), F.bool_or("perfect").alias("perfect")
    )
    return per_program.agg(
        F.count(F.lit(1)).alias("n_programs"),
        F.count_if("compiled").alias("n_compiled"),
        F.count_if(F.col("compiled") & F.col("perfect")).alias("n_perfect"),
    )


def missing_positions(
    present: DataFrame, totals: DataFrame, shard: str = "shard"
) -> DataFrame:
    """Positions ``0..n-1`` of each shard that the collection does not hold.

    The expected positions are generated in chunks inside the job, then anti-joined.
    """
    chunk = 1 << 16
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long")))
    expected = (
        totals.where("n > 0")
        .select(shard, "n", starts.alias("_start"))
        .select(
            shard,
            F.explode(
                F.sequence(F.col("_start"), F.least(F.col("_start") + chunk, F.col("n")) - 1)
            ).alias("record_id"),
        )
    )
    return expected.join(present.select(shard, "record_id"), [shard, "record_id"], "left_anti")


def shard_count_check(present: DataFrame, totals: DataFrame, shard: str = "shard") -> DataFrame:
    """Collection size against corpus size per shard."""
    held = present.groupBy(shard).agg(F.count(F.lit(1)).alias("n_points"))
    return totals.join(held, shard, "full_outer").select(
        shard,
        F.coalesce("n", F.lit(0)).alias("n_records"),
        F.coalesce("n_points", F.lit(0)).alias("n_points"),
        (F.coalesce("n", F.lit(0)) == F.coalesce("n_points", F.lit(0))).alias("complete"),
    )


def choice_rows(responses: DataFrame, evaluations: DataFrame, functions: DataFrame) -> DataFrame:
    """Responses joined to their evaluations and records by (idx, retry, choice)."""
    return responses.join(evaluations, ["idx", "retry", "choice"]).join(functions, "idx")
