"""A training corpus from raw documents: two filters, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irquarry.llm import curriculum, near_dedup, packing, quality_rules, queries, rule_ensemble
from irquarry.llm.common import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the rule ensemble, fitted on the labels that may be learned from, takes for good."""
    model = rule_ensemble.fit(docs, queries.learnable(table(spark, sf_dir, "labels"), "quality"))
    rows = rule_ensemble.with_statistics(docs, docs.columns)
    return rows.where(model.score(lambda name: F.col(f"out.{name}")) >= queries.GOOD_FROM).select("row.*")


def compression_bands(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the base rule and the compression bands, fitted on the labels that may be learned from."""
    raw = table(spark, sf_dir, "documents")
    bands = quality_rules.fitted(raw, queries.learnable(table(spark, sf_dir, "labels"), "quality"))
    return quality_rules.judged(docs, bands=bands).where("out.kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return near_dedup.keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, repeated or left out as the sources' targets demand."""
    return curriculum.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", compression_bands),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's output is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
