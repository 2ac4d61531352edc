"""Chart data: histograms and distributions as long tables.

Rows are first reduced to one row per distinct value with partial aggregation, so a value held
by a large part of the rows costs one row per task, and everything behind that is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from irquarry.operators.records import inst_count
from irquarry.operators.scoring import any_true

# Widths, supports and clips of the charts.
LENGTH_BUCKET, MAX_LENGTH = 256, 4096
BLOCK_SUPPORT, INST_SUPPORT = 2, 4
CLIP = 20
# Values of an axis made from one row.
AXIS_CHUNK = 1 << 16


def value_counts(df: DataFrame, value: Column, name: str, more_than: int = 0) -> DataFrame:
    """Rows per value, values of at most ``more_than`` rows dropped, null values skipped."""
    return (
        df.select(value.alias(name))
        .where(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > more_than)
    )


def block_histogram(functions: DataFrame) -> DataFrame:
    return value_counts(functions, F.col("llvm_ir.bb_count.bbcount"), "bbcount", BLOCK_SUPPORT)


def instruction_histogram(functions: DataFrame) -> DataFrame:
    """Rows per instruction count among one-block records."""
    one = functions.where("llvm_ir.bb_count.bbcount = 1")
    return value_counts(one, inst_count(), "inst_count", INST_SUPPORT)


def length_buckets(
    predictions: DataFrame,
    length: str = "predict_length",
    width: int = LENGTH_BUCKET,
    longest: int = MAX_LENGTH,
) -> DataFrame:
    """Total, compiled and executed rows per length bucket, empty buckets included.

    Rows longer than ``longest`` are counted in one more bucket that starts at ``longest + 1``; rows
    without a length are not counted.  The last columns split each bucket into executable, compilable only,
    and error.
    """
    last = longest // width
    place = F.when(F.col(length) > longest, F.lit(last + 1)).otherwise(F.expr(f"cast(div({length}, {width}) as int)"))
    compiled = any_true(F.col("predict_compile_success"))
    executed = any_true(F.col("predict_execution_success"))
    counted = (
        predictions.where(F.col(length).isNotNull())
        .groupBy(place.alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(compiled).alias("compiled"),
            F.count_if(executed).alias("executed"),
        )
    )
    axis = predictions.sparkSession.range(last + 2).select(
        F.col("id").cast("int").alias("bucket")
    )
    filled = axis.join(counted, "bucket", "left").na.fill(0)
    return filled.select(
        F.when(F.col("bucket") > last, F.lit(longest + 1)).otherwise(F.col("bucket") * width).alias("length_from"),
        "total",
        "compiled",
        "executed",
        (F.col("compiled") - F.col("executed")).alias("compilable_only"),
        (F.col("total") - F.col("compiled")).alias("error"),
    )


def length_rates(buckets: DataFrame) -> DataFrame:
    """Totals of the buckets and the overall rates."""
    total, compiled, executed = (F.sum(c) for c in ("total", "compiled", "executed"))
    return buckets.agg(
        total.alias("total"),
        compiled.alias("compiled"),
        executed.alias("executed"),
        F.round(F.try_divide(compiled.cast("double"), total), 6).alias("compile_rate"),
        F.round(F.try_divide(executed.cast("double"), total), 6).alias("execution_rate"),
    )


def equal_width(df: DataFrame, value: Column, bins: int, density: bool = False) -> DataFrame:
    """Equal-width histogram over min..max with a closed last bin, empty bins included.

    A single distinct value is charted over a range of one around it.
    """
    counts = value_counts(df, value.cast("double"), "v")
    # one value read by both sides: first edge, width, and the number of rows
    ends = counts.agg(F.min("v").alias("_low"), F.max("v").alias("_high"), F.sum("n").alias("_total"))
    flat = F.col("_low") == F.col("_high")
    first = F.when(flat, F.col("_low") - 0.5).otherwise(F.col("_low"))
    step = F.when(flat, F.lit(1.0)).otherwise(F.col("_high") - F.col("_low")) / bins
    frame = ends.select(F.struct(first.alias("low"), step.alias("width"), F.col("_total").alias("total"))).scalar()
    low, width, total = (F.col("_frame").getField(f) for f in ("low", "width", "total"))
    placed = (
        counts.withColumn("_frame", frame)
        .select(F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int").alias("bin"), "n")
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
    )
    axis = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    filled = axis.join(placed, "bin", "left").na.fill(0, ["n"]).withColumn("_frame", frame)
    shown = [F.col("bin"), F.round(low + F.col("bin") * width, 6).alias("bin_from"), F.col("n")]
    if density:
        shown.append(F.round(F.try_divide(F.col("n"), total * width), 9).alias("density"))
    return filled.select(shown)


def _axis(ends: DataFrame, value: str, keep: list[str]) -> DataFrame:
    """Every integer from ``_low`` to ``_high`` of each row, made in chunks."""
    kind = ends.schema["_low"].dataType
    low, high = F.col("_low").cast("long"), F.col("_high").cast("long")
    starts = F.explode(F.sequence(low, high, F.lit(AXIS_CHUNK).cast("long")))
    chunks = ends.where(low.isNotNull() & (low <= high)).select(*keep, high.alias("_high"), starts.alias("_start"))
    steps = F.sequence(F.col("_start"), F.least(F.col("_start") + AXIS_CHUNK - 1, F.col("_high")))
    return chunks.select(*keep, F.explode(steps.cast(ArrayType(kind))).alias(value))


def joint_histogram(df: DataFrame, dataset: str, value: str, names: list[str]) -> DataFrame:
    """Rows per integer value and dataset, side by side over the joint min..max, zero-filled."""
    counts = (
        df.where(F.col(value).isNotNull() & F.col(dataset).isin(names))
        .groupBy(value)
        .pivot(dataset, names)
        .agg(F.count(F.lit(1)))
    )
    axis = _axis(counts.agg(F.min(value).alias("_low"), F.max(value).alias("_high")), value, [])
    return axis.join(counts, value, "left").na.fill(0, names)


def clipped_percent(df: DataFrame, dataset: str, value: str, clip: int = CLIP) -> DataFrame:
    """Rows per integer value and dataset, and percent of the dataset.

    Values above ``clip`` are counted together under ``clip + 1``; null values are skipped.
    """
    kind = df.schema[value].dataType
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(dataset, F.least(F.col(value), F.lit(clip + 1)).cast(kind).alias(value))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    low = counts.agg(F.min(value)).scalar()
    ends = counts.select(dataset).distinct().withColumns({"_low": low, "_high": F.lit(clip + 1).cast(kind)})
    axis = _axis(ends, value, [dataset])
    totals = counts.groupBy(F.col(dataset).alias("_of")).agg(F.sum("n").alias("_total"))
    held = counts.select(F.col(dataset).alias("_set"), F.col(value).alias("_value"), "n")
    same = F.col(dataset).eqNullSafe(F.col("_set")) & (F.col(value) == F.col("_value"))
    filled = axis.join(held, same, "left").na.fill(0, ["n"])
    return filled.join(totals, F.col(dataset).eqNullSafe(F.col("_of"))).select(
        dataset, value, "n", F.round(F.try_divide(F.col("n") * 100.0, "_total"), 6).alias("percent")
    )


def sorted_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """The sorted values of several columns as (column, value, n) rows."""
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in columns]))
    )
    return long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n")).orderBy("name", "value")
