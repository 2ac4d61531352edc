"""Score prediction files as they arrive, each prediction once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from irquarry.operators.ranking import keep_last
from irquarry.operators.scoring import any_true, guard_target, match_predictions
from irquarry.operators.stages import cached_stage
from irquarry.schemas import PREDICTIONS

SCORES = (
    "run STRING, idx BIGINT, key STRING, predict_compile BOOLEAN, predict_execution BOOLEAN, "
    "target_compile BOOLEAN, target_execution BOOLEAN"
)


def scored(predictions: DataFrame, corpus: DataFrame, run: str) -> DataFrame:
    """One flat score row per matched prediction."""
    rows = match_predictions(guard_target(predictions), corpus)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.select(
        F.lit(run).alias("run"),
        "idx",
        "key",
        any_true(F.col("predict_compile_success")).alias("predict_compile"),
        any_true(F.col("predict_execution_success")).alias("predict_execution"),
        flag("target_compile_success").alias("target_compile"),
        flag("target_execution_success").alias("target_execution"),
    )


def current_scores(scores: DataFrame) -> DataFrame:
    """Of a key that several batches scored, the row with the greatest position."""
    return keep_last(scores, ["run", "key"])


def score_stream(
    spark: SparkSession, source: str, corpus: DataFrame, store: str, checkpoint: str, run: str
) -> StreamingQuery:
    """Follow a folder of prediction tables; each batch appends the scores its keys still lack.

    A batch that is replayed after a failure finds its keys stored and appends nothing.  A key that comes again
    in a later batch keeps both rows; ``current_scores`` reads the last.
    """

    def each(batch: DataFrame, _epoch: int) -> None:
        cached_stage(
            scored(batch, corpus, run),
            ["run", "idx"],
            store,
            SCORES,
            lambda df: df,
            only=F.col("run") == run,
        )

    return (
        spark.readStream.schema(PREDICTIONS)
        .parquet(source)
        .writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
