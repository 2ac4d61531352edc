"""Hierarchical weighted hash tree: a document descends region, rack and shard by weighted hash draws.

At each level every child draws ``-ln(u) / weight`` with u from a hash of (child, key), and the smallest draw wins;
a child's weight is the sum of its shards' weights.  A draw depends on nothing but the child, its weight and the
key, so documents move only between the children of a node whose weights change: growth that opens a
new region takes rows into that region only.

All columns are Spark expressions.  A null key draws like an empty text, a null text has no bytes, and
equal keys always share a shard.  Repeated rows get slots of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from irquarry.llm.common import named, stored

RACK_SHARDS = 4
REGION_RACKS = 2
#: Bytes a row needs besides its text.
ROW_BYTES = 8


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    number: int
    weight: float = 1.0


def topology(shards: int, rack_shards: int = RACK_SHARDS, region_racks: int = REGION_RACKS) -> list[Shard]:
    """Shards 0.. filled into racks and regions in order, all of weight 1."""
    per_region = rack_shards * region_racks
    return [Shard(s // per_region, s % per_region // rack_shards, s) for s in range(shards)]


def grown(tree: list[Shard]) -> list[Shard]:
    """One more shard, in a region of its own: rows move into it and nowhere else."""
    return [*tree, Shard(max(s.region for s in tree) + 1, 0, max(s.number for s in tree) + 1)]


def _draw(key: Column, path: str, weight: float) -> Column:
    # 52 bits of md5: another engine can repeat it
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{path}:"), key)), 1, 13), 16, 10).cast("double")
    return -F.log((digits + 1.0) / float(1 << 52)) / F.lit(weight)


def _winner(draws: list[tuple[Column, Column]]) -> Column:
    """The value of the smallest draw; the earlier one on a tie."""
    if len(draws) == 1:
        return draws[0][1]
    options = [F.struct(d.alias("draw"), F.lit(i).alias("at"), v.alias("value")) for i, (d, v) in enumerate(draws)]
    return F.least(*options).getField("value")


def assigned(key: Column, tree: list[Shard]) -> Column:
    """Shard of a key: the winner of the region, then of its rack, then of its shard."""
    text = F.coalesce(key.cast("string"), F.lit(""))

    def among(shards: list[Shard], path: str, level: int) -> Column:
        if level == 2:
            return _winner([(_draw(text, f"{path}/{s.number}", s.weight), F.lit(s.number)) for s in shards])
        children: dict[int, list[Shard]] = {}
        for s in shards:
            children.setdefault((s.region, s.rack)[level], []).append(s)
        draws = [
            (_draw(text, f"{path}/{c}", sum(s.weight for s in below)), F.lit(c)) for c, below in children.items()
        ]
        # only the winner's subtree is evaluated
        choice = None
        winner = _winner(draws)
        for c, below in children.items():
            inner = among(below, f"{path}/{c}", level + 1)
            choice = F.when(winner == c, inner) if choice is None else choice.when(winner == c, inner)
        return choice

    return among(tree, "", 0)


def with_slots(placed: DataFrame, shard: str = "shard") -> DataFrame:
    """``slot``: gapless numbers from 0 in each shard.

    Rows are numbered inside (shard, scan part), then each part gets the sum of the parts before it, so no task
    holds a shard.
    """
    marked = placed.select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")
    )
    rows = stored(marked, "shard-rows")
    sizes = rows.groupBy(shard, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(shard, "_part").orderBy("_row")) - 1
    numbered = rows.withColumn("_inside", inside).join(starts, [shard, "_part"])
    slot = (F.col("_start") + F.col("_inside")).cast("long")
    return numbered.withColumn("slot", slot).select(*placed.columns, "slot")


def shard_documents(
    docs: DataFrame, tree: list[Shard], doc_id: str = "doc_id", text: str = "text", seed: str = ""
) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard and slot of every document."""
    key, body = named(doc_id), named(text)
    draw_key = F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))
    placed = docs.select(
        key.alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        assigned(draw_key, tree).cast("int").alias("shard"),
        assigned(draw_key, grown(tree)).cast("int").alias("grown_shard"),
    )
    return with_slots(placed)
