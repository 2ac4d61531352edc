"""Blocked removal of equal functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from irquarry.functions.text import let, normalize_module
from irquarry.operators.clusters import similar_classes
from irquarry.operators.records import inst_count, last_code

MIN_INST, MAX_INST = 1, 9

# What the structural fingerprint blanks out, in this order.
STRUCTURAL_RULES = (
    (r"(?m)^(?:; ModuleID|source_filename|target (?:datalayout|triple)).*$\n?", ""),
    (r"(?m)[ \t]*;.*$", ""),
    (r"@[\w.$]+", "@g"),
    (r"%[\w.$]+", "%l"),
    (r"(?m)^[\w.$]+:", "b:"),
    (r"![0-9]+", "!m"),
)


# A label's definition, and the names and numbers the canonical fingerprint counts.
LABEL_RULE = (r"(?m)^([\w.$]+|\"[^\"]*\"):", "%$1:")
NAMES = r"[@%]\"[^\"]*\"|[@%][\w.$]+|![0-9]+"


def canonical_names(text: Column) -> Column:
    """IR text without headers and comments, its names numbered by first use: globals, locals with labels, and metadata apart.

    Two texts agree exactly when a one-to-one renaming turns one into the other.
    """
    for pattern, blank in (*STRUCTURAL_RULES[:2], LABEL_RULE):
        text = F.regexp_replace(text, pattern, blank)

    def numbered(found: Column) -> Column:
        kinds = F.transform(F.array(*map(F.lit, "@%!")), lambda k: F.filter(F.array_distinct(found), lambda n: n.startswith(k)))
        return let(kinds, lambda names: F.transform(found, lambda name: number(names, name)))

    def number(names: Column, name: Column) -> Column:
        kind = F.left(name, F.lit(1))
        return F.concat(kind, F.array_position(F.get(names, F.instr(F.lit("@%!"), kind) - 1), name).cast("string"))

    gaps = F.split(text, NAMES, -1)
    names = let(F.regexp_extract_all(text, F.lit(f"({NAMES})"), F.lit(1)), numbered)
    return F.array_join(F.zip_with(gaps, names, lambda gap, name: F.concat(gap, F.coalesce(name, F.lit("")))), "")


def fingerprint(mode: str = "exact") -> Column:
    """Hash of the last IR text: ``exact`` after header normalisation, ``canonical`` or ``structural``.

    The canonical form joins functions that differ in headers, comments and a one-to-one renaming.  The structural form blanks
    names, so it joins more than a differ would; class sizes show by how much.
    """
    text = normalize_module(last_code("llvm_ir"))
    if mode == "canonical":
        text = canonical_names(text)
    elif mode == "structural":
        for pattern, blank in STRUCTURAL_RULES:
            text = F.regexp_replace(text, pattern, blank)
    elif mode != "exact":
        raise ValueError(f"unknown fingerprint mode: {mode}")
    return F.sha2(text, 256)


def with_block(functions: DataFrame, mode: str = "exact", min_inst: int = MIN_INST, max_inst: int = MAX_INST) -> DataFrame:
    """Add block columns; ``_fp`` is set only for rows that take part in deduplication.

    One-block rows of ``min_inst..max_inst`` instructions are compared; longer one-block rows
    and all other block counts are kept whole; rows without counts or below the range are lost.
    """
    blocks = F.col("llvm_ir.bb_count.bbcount")
    rows = functions.withColumn("_inst", inst_count()).where(blocks.isNotNull())
    compared = (blocks == 1) & F.col("_inst").between(min_inst, max_inst)
    kept_whole = (blocks != 1) | (F.col("_inst") > max_inst)
    return rows.where(compared | kept_whole).withColumn(
        "_fp", F.when(compared, fingerprint(mode))
    )


def blocked_dedup(
    functions: DataFrame,
    mode: str = "exact",
    by: list[str] | None = None,
    min_inst: int = MIN_INST,
    max_inst: int = MAX_INST,
) -> DataFrame:
    """First row of each class of equal functions, all rows outside the compared range.

    Only compared rows are shuffled.  The rank is pruned in the map tasks, so a class holding a
    third of the table moves one row per task.  ``by`` adds keys such as the shard.
    """
    rows = with_block(functions, mode, min_inst, max_inst)
    same = Window.partitionBy(*(by or []), "_inst", "_fp").orderBy("idx")
    compared = (
        rows.where(F.col("_fp").isNotNull())
        .withColumn("_rank", F.row_number().over(same))
        .where("_rank = 1")
        .drop("_rank")
    )
    whole = rows.where(F.col("_fp").isNull())
    return compared.unionByName(whole).drop("_inst", "_fp")


def class_sizes(functions: DataFrame, mode: str = "exact", by: list[str] | None = None, **bounds) -> DataFrame:
    """Size of every class, largest first within its instruction count."""
    keys = list(by or [])
    sizes = (
        with_block(functions, mode, **bounds)
        .where(F.col("_fp").isNotNull())
        .groupBy(*keys, F.col("_inst").alias("inst_count"), "_fp")
        .agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"))
    )
    return sizes.drop("_fp").orderBy(*keys, "inst_count", F.desc("n"), "first_idx")


def dedup_report(functions: DataFrame, mode: str = "exact", **bounds) -> DataFrame:
    """Compared rows before and after, per instruction count."""
    classes = (
        with_block(functions, mode, **bounds)
        .where(F.col("_fp").isNotNull())
        .groupBy(F.col("_inst").alias("inst_count"), "_fp")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return classes.groupBy("inst_count").agg(
        F.sum("n").alias("n_before"), F.count(F.lit(1)).alias("n_after")
    )


def fuzzy_dedup(
    functions: DataFrame, elements: Column, least: float, min_inst: int = MIN_INST, max_inst: int = MAX_INST
) -> DataFrame:
    """First row of each class of similar functions of one instruction count, all rows outside the compared range.

    ``elements``: an array of longs per function.  Functions are linked if the Jaccard similarity of their elements is
    ``least`` or more; a class is what links join.  Runs jobs.
    """
    rows = with_block(functions, "exact", min_inst, max_inst)
    compared = rows.where(F.col("_fp").isNotNull())
    classes = similar_classes(compared.select("idx", F.col("_inst").alias("block"), elements.alias("elements")), least)
    first = compared.join(classes.where("idx = first").select("idx").distinct(), "idx", "left_semi")
    return first.unionByName(rows.where(F.col("_fp").isNull())).drop("_inst", "_fp")
