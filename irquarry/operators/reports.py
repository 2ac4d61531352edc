"""Report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irquarry.functions.text import preview


def compiled_matrix(evaluations: DataFrame, num_retry: int = 10) -> DataFrame:
    """Record by round matrix of compiled choices; a round that did not run is ``-``.

    Rounds after ``num_retry`` are summed in ``retry_later``.
    """
    rounds = [-1, *range(num_retry + 2)]
    compiled = F.count_if(F.coalesce("compile_success", F.lit(False)))
    # Reduced to one row per (record, round) before it is turned into columns.
    round_or_later = F.least("retry", F.lit(num_retry + 1)).alias("retry")
    cells = evaluations.groupBy("idx", round_or_later).agg(compiled.alias("n"))
    wide = cells.groupBy("idx").pivot("retry", rounds).agg(F.first("n"))

    def cell(retry: int) -> Column:
        name = "retry_later" if retry > num_retry else f"retry_{retry}".replace("-", "m")
        return F.coalesce(F.col(f"`{retry}`").cast("string"), F.lit("-")).alias(name)

    return wide.select("idx", *[cell(r) for r in rounds])


def pass_table(pairs: DataFrame) -> DataFrame:
    """Side-by-side marks of two runs per record."""

    def mark(flag: str) -> Column:
        return F.when(F.coalesce(F.col(flag), F.lit(False)), "✓").otherwise("✗")

    rounds = F.concat_ws(
        "/",
        F.coalesce(F.col("round_a").cast("string"), F.lit("-")),
        F.coalesce(F.col("round_b").cast("string"), F.lit("-")),
    )
    return pairs.select(
        "idx",
        rounds.alias("rounds"),
        mark("pass_a").alias("a"),
        mark("pass_b").alias("b"),
        mark("match").alias("match"),
    )


def generation_table(evaluations: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Per generation: compiled, executed, and the start of its error text.

    ``targets`` adds a line per target, which has no choice and no error text.
    """

    def lines(df: DataFrame, choice: Column, error: Column) -> DataFrame:
        return df.select(
            "idx",
            "retry",
            choice.alias("choice"),
            F.coalesce("compile_success", F.lit(False)).alias("compiled"),
            F.coalesce("execution_success", F.lit(False)).alias("executed"),
            error.alias("error"),
        )

    table = lines(evaluations, F.col("choice"), preview(F.coalesce("error_msg", F.lit(""))))
    if targets is None:
        return table
    return table.unionByName(lines(targets, F.lit(None).cast("int"), F.lit("")))


def sample_report(functions: DataFrame, outcomes: DataFrame, idx: int) -> DataFrame:
    """One sample with its path, head and four flags."""
    flags = [
        "predict_compile_success",
        "predict_execution_success",
        "target_compile_success",
        "target_execution_success",
    ]
    one = functions.where(F.col("idx") == idx).select("idx", "path", "func_head")
    return one.join(outcomes.select("idx", *flags), "idx")


def chart_rows(df: DataFrame, series: str, x: str, values: list[str]) -> DataFrame:
    """A chart table in long form: (series, x, y) rows."""
    pairs = F.array(
        *[
            F.struct(F.lit(f"{series}:{v}").alias("series"), F.col(x).cast("string").alias("x"), F.col(v).cast("double").alias("y"))
            for v in values
        ]
    )
    return df.select(F.inline(pairs))


def markdown_lines(df: DataFrame, order: list[str], title: str = "", notes: str = "") -> DataFrame:
    """A report table as the lines of a Markdown text, its rows in ``order``."""
    head = [f"# {title}", ""] if title else []
    head += ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    places = [F.col(c).alias(f"_by{i}") for i, c in enumerate(order)]
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns]
    body = df.select(
        F.lit(1).alias("_part"),
        F.lit(0).alias("_line"),
        *places,
        F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"),
    )
    for part, fixed in ((0, head), (2, ["", notes] if notes else [])):
        if fixed:
            texts = F.posexplode(F.array(*map(F.lit, fixed))).alias("_line", "line")
            body = body.unionByName(
                df.sparkSession.range(1).select(F.lit(part).alias("_part"), texts), allowMissingColumns=True
            )
    return body.orderBy("_part", "_line", *[f"_by{i}" for i in range(len(order))]).select("line")


def write_markdown(df: DataFrame, path: str, order: list[str], title: str = "", notes: str = "") -> None:
    """Write a report table as Markdown; the files of the folder in name order are the text."""
    markdown_lines(df, order, title, notes).write.mode("overwrite").text(path)
