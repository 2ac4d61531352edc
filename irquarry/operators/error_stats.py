"""Error statistics.  The inverted index stays a long table: no list per error type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irquarry.functions.errors import CATEGORIES, category, error_type
from irquarry.functions.text import is_blank

SMALL_SLICE = 0.05


def typed_errors(messages: DataFrame, message: str = "error_msg") -> DataFrame:
    """Rows with a message that can be typed, with column ``error_type``."""
    return (
        messages.where(~is_blank(F.coalesce(F.col(message), F.lit(""))))
        .withColumn("error_type", error_type(F.col(message)))
        .where(F.col("error_type").isNotNull())
    )


def unfixed_only(evaluations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of records (or record rounds) none of whose choices compiled."""
    keys = keys or ["idx"]
    failed = (
        evaluations.groupBy(*keys)
        .agg(F.bool_or(F.coalesce("compile_success", F.lit(False))).alias("_ok"))
        .where("not _ok")
        .select(*keys)
    )
    return evaluations.join(failed, keys, "left_semi")


def error_index(messages: DataFrame, ids: list[str]) -> DataFrame:
    """(error_type, id...) rows: the inverted index in long form."""
    return typed_errors(messages).select("error_type", *ids)


def error_counts(typed: DataFrame) -> DataFrame:
    return typed.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


def category_counts(counts: DataFrame) -> DataFrame:
    """Counts per category; types of no category are dropped."""
    return (
        counts.withColumn("category", category(F.col("error_type")))
        .where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.sum("n").alias("n"))
    )


def folded_slices(counts: DataFrame, name: str = "category", least: float = SMALL_SLICE) -> DataFrame:
    """Slices below ``least`` of the total folded into "other", which is always there."""
    total = counts.agg(F.sum("n")).scalar()
    small = F.col("n") / total < least
    label = F.when(small, F.lit("other")).otherwise(F.col(name))
    always = counts.sparkSession.range(1).select(
        F.lit("other").alias("slice"), F.lit(0).cast("long").alias("n")
    )
    return (
        counts.select(label.alias("slice"), F.col("n"))
        .unionByName(always)
        .groupBy("slice")
        .agg(F.sum("n").alias("n"))
    )


def category_table(spark) -> DataFrame:
    """The fixed categories in matching order."""
    rows = [(i, c) for i, c in enumerate(CATEGORIES)]
    return spark.createDataFrame(rows, "position int, category string")
