"""Matched sampling: find for each probe the nearest candidate under widening thresholds.

No probe is compared with the whole candidate table.  Candidates are first reduced to cells, one
row per distinct (blocks, tokens) pair holding the smallest position, which is all a match needs.
Probes are reduced to distinct cells too, so a frequent value costs one row on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from irquarry.operators.ranking import chunked_rank
from irquarry.session import new_work_path

# Threshold steps and the allowed difference of the rule match.
TOKEN_STEP = 10  # thresholds grow by a tenth of the probe's tokens
FINE_TOKEN_STEP = 100  # or by a hundredth
MAX_BLOCK_DIFFERENCE = 2
GROWTH = 8


def _level(step: int, with_blocks: bool) -> Column:
    """The smallest widening level that admits a candidate; integer arithmetic throughout."""
    tokens = F.expr(f"div(abs(c_tok - p_tok) * {step}, p_tok)")
    return F.greatest(F.abs(F.col("c_bb") - F.col("p_bb")), tokens) if with_blocks else tokens


def _token_bucket(tokens: Column, step: int, reach: int) -> Column:
    """Geometric token buckets; a band of levels below ``reach`` touches a few of them."""
    ratio = min(2.0, step / (step - reach)) if reach < step else 2.0
    return F.floor(F.ln(F.greatest(tokens, F.lit(1)).cast("double")) / F.ln(F.lit(ratio)))


def _search(probes: DataFrame, cells: DataFrame, step: int, with_blocks: bool, reach: int) -> DataFrame:
    """Best (level, position) per probe cell among candidates of a level below ``reach``."""
    low = F.expr(f"p_tok - div(p_tok * {reach}, {step})")
    high = F.expr(f"p_tok + div(p_tok * {reach}, {step})")
    buckets = F.sequence(
        _token_bucket(F.greatest(low, F.lit(1)), step, reach), _token_bucket(high, step, reach)
    )
    left = probes.withColumn("_t", F.explode(buckets))
    right = cells.withColumn("_t", _token_bucket(F.col("c_tok"), step, reach))
    keys = ["_t"]
    if with_blocks:
        left = left.withColumn(
            "_b",
            F.explode(
                F.sequence(
                    F.expr(f"div(p_bb - {reach - 1}, {reach})"),
                    F.expr(f"div(p_bb + {reach - 1}, {reach})"),
                )
            ),
        )
        right = right.withColumn("_b", F.expr(f"div(c_bb, {reach})"))
        keys.append("_b")
    # plain numbers are reduced by hash as they are joined; only a row per level is left to the structs, which need a sort
    levels = (
        left.join(right, keys)
        .withColumn("level", _level(step, with_blocks))
        .where(F.col("level") < reach)
        .groupBy("p_bb", "p_tok", "level")
        .agg(F.min("c_idx").alias("idx"))
    )
    return levels.groupBy("p_bb", "p_tok").agg(F.min(F.struct("level", "idx")).alias("best"))


def _stored(df: DataFrame, name: str, ddl: str) -> tuple[DataFrame, int]:
    """The table written to the shared folder and read back, with its row count."""
    spark = df.sparkSession
    path = new_work_path(spark, name)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema(ddl).parquet(path), seen.get["n"]


def widening_match(
    probes: DataFrame,
    candidates: DataFrame,
    step: int = TOKEN_STEP,
    with_blocks: bool = True,
    bb: str = "bbcount",
    tok: str = "token_length",
    idx: str = "idx",
) -> DataFrame:
    """Smallest-position candidate of the smallest level, per probe; candidates may repeat.

    Level k admits a block difference below 1 + k and a token difference below (1 + k)/step of
    the probe's tokens.  The search tries levels below 1, 8, 64, ... and takes to the next try
    only the cells still open, so dense tables are done after one or two joins.  Probes without
    tokens or block count, and all probes when there is no candidate, get null; candidates without
    either match nothing.
    """
    block = F.col(bb) if with_blocks else F.lit(0)
    cells = candidates.groupBy(block.cast("long").alias("c_bb"), F.col(tok).cast("long").alias("c_tok")).agg(
        F.min(F.col(idx).cast("long")).alias("c_idx")
    )
    p_cells = probes.select(
        block.cast("long").alias("p_bb"), F.col(tok).cast("long").alias("p_tok")
    ).distinct()
    cells = cells.where("c_bb IS NOT NULL AND c_tok IS NOT NULL")
    # Written once and read by every try: retries read files, not the lineage of the inputs.
    cells, n_cells = _stored(cells, "cells", "c_bb long, c_tok long, c_idx long")
    p_cells, n_open = _stored(p_cells.where("p_tok > 0 AND p_bb IS NOT NULL"), "probes", "p_bb long, p_tok long")
    found, still_open, reach = None, p_cells, 1
    while n_cells > 0 and n_open > 0:
        hit, n_hit = _stored(
            _search(still_open, cells, step, with_blocks, reach),
            "matched",
            "p_bb long, p_tok long, best struct<level: long, idx: long>",
        )
        n_open -= n_hit
        found = hit if found is None else found.unionByName(hit)
        still_open = p_cells.join(found, ["p_bb", "p_tok"], "left_anti")
        reach *= GROWTH
    if found is None:
        return probes.withColumns(
            {"level": F.lit(None).cast("long"), "matched_idx": F.lit(None).cast("long")}
        )
    keyed = probes.withColumns({"p_bb": block.cast("long"), "p_tok": F.col(tok).cast("long")})
    return (
        keyed.join(found, ["p_bb", "p_tok"], "left")
        .withColumns({"level": F.col("best.level"), "matched_idx": F.col("best.idx")})
        .drop("best", "p_bb", "p_tok")
    )


def rule_similar(probes: DataFrame, candidates: DataFrame, max_difference: int = MAX_BLOCK_DIFFERENCE) -> DataFrame:
    """Per probe the first candidate alike in calls, loops and one-block shape, blocks close.

    Both inputs have idx, n_called, num_loops and n_blocks.  A block difference band is a handful
    of exact block counts, so the join is an equality over cells.
    """

    def shape(df: DataFrame) -> DataFrame:
        return df.select(
            F.col("idx").cast("long").alias("idx"),
            (F.col("n_called") == 0).alias("no_calls"),
            (F.col("num_loops") == 0).alias("no_loops"),
            (F.col("n_blocks") == 1).alias("one_block"),
            F.col("n_blocks").cast("long").alias("n_blocks"),
        )

    flags = ["no_calls", "no_loops", "one_block"]
    cells = shape(candidates).groupBy(*flags, "n_blocks").agg(F.min("idx").alias("c_idx"))
    p_cells = shape(probes).select(*flags, "n_blocks").distinct()
    near = F.sequence(F.col("n_blocks") - max_difference, F.col("n_blocks") + max_difference)
    answers = (
        p_cells.withColumn("_near", F.explode(near))
        .join(cells.withColumnRenamed("n_blocks", "_near"), [*flags, "_near"])
        .groupBy(*flags, "n_blocks")
        .agg(F.min("c_idx").alias("similar_idx"))
    )
    return (
        shape(probes).join(answers, [*flags, "n_blocks"], "left").select("idx", "similar_idx")
    )


def replace_failed(sample: DataFrame, failed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Replace the k-th failed sample row by the k-th candidate whose path the sample lacks.

    Failed rows beyond the last unused candidate stay as they are.  Output: idx, path and whether
    the row was replaced.
    """
    firsts = (
        candidates.groupBy("path")
        .agg(F.min("idx").alias("idx"))
        .join(sample.select("path").distinct(), "path", "left_anti")
    )
    ranked = chunked_rank(firsts, "idx", "_k").select("_k", F.col("path").alias("_path"))
    broken = chunked_rank(sample.join(failed.select("idx"), "idx", "left_semi").select("idx"), "idx", "_k")
    swaps = broken.join(ranked, "_k").drop("_k")
    return sample.join(swaps, "idx", "left").select(
        "idx",
        F.coalesce("_path", "path").alias("path"),
        F.col("_path").isNotNull().alias("replaced"),
    )
