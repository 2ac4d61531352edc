"""Mixing sources to target weights along a time-varying curriculum.

Every source has a schedule: its share of demand as a function of training time 0..1, given as straight pieces between
knots.  The integral of the schedule is the source's cumulative demand; a document of the source starts at the
word count of those before it, and the inverse of the cumulative demand turns that count into a training position.
Documents are then range-sorted by position.

Targets: sources by code point, null last, take the weights in turn and share the words of all documents; a target
stops at ``max_repeats`` times its source's words and the excess is shared out again by weight.  A source below its
target is read through again; the last reading stops when the demand is met, inside a document if need be.

Null text has no words.  Repeated rows are separate documents.  Documents of no words take nothing and have no
position.  The order inside a source is that of md5(doc_id), so reruns agree; rows equal in id and words are
interchangeable.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from irquarry.llm.common import count_words, named, stored

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Relative demand at times 0, 1/2 and 1 of the sources of each weight: the heavy ones early, the light ones late.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
BUCKET_ROWS = 4096


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``target`` and ``turn`` (index of the weight) from source and source_size.

    One row per source: the windows below see the catalogue of sources, never documents.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")
    ranked = sources.withColumn("turn", turn)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("turn") + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    # sources in the order in which a common level, demand per weight, would reach their caps
    order = [F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    level = rest / F.sum("weight").over(later)
    leveled = ranked.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # past the first source below its cap the level only falls, so the greatest one is the common level
    shared = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return leveled.select(
        "source",
        "source_size",
        "turn",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared * F.col("weight")).alias("target"),
    )


def demand_pieces(schedule: tuple[float, ...]) -> list[tuple[float, float, float, float, float]]:
    """(time, length, demand before, rate at start, change of rate) of each straight piece, total demand 1."""
    step = 1.0 / (len(schedule) - 1)
    area = sum((a + b) / 2 * step for a, b in zip(schedule, schedule[1:]))
    pieces, before = [], 0.0
    for i, (a, b) in enumerate(zip(schedule, schedule[1:])):
        pieces.append((i * step, step, before, a / area, (b - a) / area / step))
        before += (a + b) / 2 * step / area
    return pieces


def inverted(demand: Column, schedule: tuple[float, ...]) -> Column:
    """The time at which the cumulative demand (0..1) is reached: a quadratic per piece."""
    answer = F.lit(0.0)
    for time, length, before, rate, change in demand_pieces(schedule):
        more = F.greatest(demand - before, F.lit(0.0))
        # rate * t + change / 2 * t^2 = more, in the form that holds for change 0 as well
        root = F.sqrt(F.greatest(F.lit(rate * rate) + 2.0 * change * more, F.lit(0.0)))
        spent = F.least(F.lit(time) + 2.0 * more / (F.lit(rate) + root), F.lit(time + length))
        answer = F.when(demand >= before, spent).otherwise(answer)
    return answer


def assigned(
    docs: DataFrame,
    row: list[str],
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    schedules: tuple[tuple[float, ...], ...] = SCHEDULES,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """doc_id, size, source_size, target, whole (copies), part_words, taken and positions, with the ``row`` columns.

    ``positions`` has the training time (0..1) of each copy, the partial one last.
    """
    sized = docs.select(
        named(doc_id).alias("doc_id"),
        named(source).alias("source"),
        count_words(named(text)).alias("size"),
        F.md5(F.coalesce(named(doc_id).cast("string"), F.lit(""))).alias("order_key"),
        *[named(c) for c in row],
    )
    sized = stored(sized, "mix-sizes")
    buckets = sized.count() // BUCKET_ROWS + 1
    # buckets are intervals of the order, each with about BUCKET_ROWS rows of all sources
    place = F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long")
    sized = sized.withColumn("bucket", F.floor(place * buckets / float(1 << 32)).cast("long"))
    sums = stored(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-sums")
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeats)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("of"), "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start")
    )
    starts = starts.join(plan, F.col("of").eqNullSafe(F.col("source"))).drop("source")
    inside = Window.partitionBy("source", "bucket").orderBy("order_key", "doc_id", "size")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("inside", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    joined = sized.join(
        starts.withColumnRenamed("bucket", "in_bucket"),
        F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in_bucket")),
    )
    wanted = F.round("target").cast("long")
    readings = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("long")
    rest = wanted - F.col("readings") * F.col("source_size")
    last = F.greatest(F.least(rest - F.col("offset"), F.col("size")), F.lit(0)).cast("long")
    read = joined.withColumn("offset", F.col("start") + F.col("inside"))
    read = read.withColumn("readings", readings).withColumn("last", last)
    full = F.when(F.col("size") > 0, F.col("readings") + (F.col("last") == F.col("size")).cast("long")).otherwise(0)
    part = F.when(F.col("last") < F.col("size"), F.col("last")).otherwise(0)
    read = read.withColumn("whole", full.cast("int")).withColumn("part_words", part.cast("long"))
    copies = F.col("whole") + (F.col("part_words") > 0).cast("int")

    def position(copy: Column) -> Column:
        demand = (F.col("offset") + copy * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1.0))
        answer = inverted(demand, schedules[0])
        for i, schedule in enumerate(schedules[1:], 1):
            answer = F.when(F.col("turn") == i, inverted(demand, schedule)).otherwise(answer)
        return answer

    each = F.transform(F.sequence(F.lit(0), copies - 1), position)
    times = F.when(copies > 0, each).otherwise(F.array().cast("array<double>"))
    return read.select(
        *row,
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "whole",
        "part_words",
        (F.col("whole") * F.col("size") + F.col("part_words")).cast("long").alias("taken"),
        times.alias("positions"),
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents in training order, a row per copy; a last partial copy of half a document or more is a copy.

    The input is stored with row numbers, so that copies are joined to exactly their row.
    """
    whole_row = F.struct(*[named(c).alias(c) for c in docs.columns]).alias("row")
    rows = stored(docs.select(whole_row, F.monotonically_increasing_id().alias("row_key")), "mix-documents")
    wanted = {"doc_id": doc_id, "source": source, "text": text}
    plain = rows.select("row_key", *[F.col("row").getField(c).alias(name) for name, c in wanted.items()])
    planned = assigned(plain, ["row_key"])
    copies = F.col("whole") + (2 * F.col("part_words") >= F.greatest(F.col("size"), F.lit(1))).cast("int")
    timed = planned.select("row_key", F.explode(F.slice("positions", F.lit(1), copies)).alias("position"))
    timed = stored(timed, "mix-positions")
    placed = rows.join(timed, "row_key").repartitionByRange("position", "row_key")
    placed = placed.sortWithinPartitions("position", "row_key")
    return placed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
