"""Writers.  Spark's commit protocol keeps partial output out of sight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irquarry.operators.outcomes import failed_sample_export, first_executed_of_round
from irquarry.operators.records import last_code
from irquarry.operators.sampling import seeded_sample


def save_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_sample(df: DataFrame, path: str, n: int = 100, seed: int = 42) -> None:
    """A seeded sample; an existing target or a table that is too small is an error."""
    seeded_sample(df, n, seed, check=True).write.mode("errorifexists").parquet(path)


def dump_ir(functions: DataFrame, path: str) -> None:
    """IR texts with a path header.

    Rows are (idx, text) lines of one table: a file per row would drown a file system at scale;
    ``dump_ir_files`` writes single files for small sets.
    """
    functions.select("idx", _with_header()).write.mode("overwrite").parquet(path)


def _with_header() -> Column:
    return F.concat(F.lit(";cpath: "), F.col("path"), F.lit("\n"), last_code("llvm_ir")).alias("text")


def dump_ir_files(functions: DataFrame, path: str) -> None:
    """One folder ``idx=<n>`` with one text file per row, for sets meant to be opened by hand."""
    functions.select("idx", _with_header()).write.mode("overwrite").partitionBy("idx").text(path)


def save_results_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def save_vectors(points: DataFrame, path: str) -> None:
    """Replace the shards that ``points`` holds; other shards stay as they are.

    Rows are brought together by shard in pieces of the advisory size: a large shard gets many files.
    """
    (
        points.hint("rebalance", F.col("shard"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("shard")
        .parquet(path)
    )


def save_run(evaluations: DataFrame, run_dir: str) -> None:
    evaluations.write.mode("overwrite").partitionBy("retry").parquet(f"{run_dir}/evaluations")


def export_correct_ir(evaluations: DataFrame, retry: int, path: str) -> None:
    """The first executed code of each record of one round."""
    first_executed_of_round(evaluations, retry).write.mode("overwrite").parquet(path)


def export_failed_samples(evaluations: DataFrame, targets: DataFrame, path: str) -> None:
    """Compiled candidates of finally failed records with their targets."""
    failed_sample_export(evaluations, targets).write.mode("overwrite").parquet(path)
