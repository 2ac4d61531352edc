"""Position ranks that never sort a whole table in one task.

Rows are cut into chunks by an integer position.  Every chunk is numbered on its own and the
chunk sizes, one small row per chunk, give the offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 16


def chunked_rank(
    df: DataFrame,
    position: str,
    name: str,
    by: list[str] | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``name``: 1, 2, ... by ascending unique ``position`` within ``by``."""
    keys = list(by or [])
    chunk = F.expr(f"div(`{position}`, {chunk_rows})")
    rows = df.withColumn("_chunk", chunk)
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy(position)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    return (
        rows.withColumn("_place", F.row_number().over(in_chunk).cast("long"))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_place") + F.col("_offset"))
        .drop("_chunk", "_place", "_offset")
    )


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row per key.

    A rank filtered to one is pruned inside every map task before the shuffle, so a key that
    holds a large part of all rows costs one row per task.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def keep_last(df: DataFrame, keys: list[str], position: str = "idx") -> DataFrame:
    """The last row per key by position."""
    return keep_first(df, keys, [F.col(position).desc()])
