"""Seeded samples without replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seeded_sample(df: DataFrame, n: int, seed: int = 42, key: str = "idx", check: bool = False) -> DataFrame:
    """``n`` rows in the order of a seeded hash of ``key``.

    The size is the feature: every task keeps its own best ``n`` before they are merged.  With
    ``check`` a table smaller than ``n`` is an error.
    """
    if check and df.count() < n:
        raise ValueError(f"cannot sample {n} rows from a smaller table")
    token = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("_token", token).orderBy("_token", key).limit(n).drop("_token")
