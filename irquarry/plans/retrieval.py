"""Retrieval queries over the whole vector table."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from irquarry.operators import retrieval, scoring, stages, vector_index
from irquarry.plans import views
from irquarry.plans.registry import query
from irquarry.plans.sqltext import UNCOMMENTED

_PAIRS = """
WITH v AS (SELECT vec_id AS id, CAST(vec_id % 8 AS INTEGER) AS shard, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT q.id AS query_id, p.id AS point_id, p.shard, q.label AS query_label, p.label,
    round(list_cosine_similarity(q.e, p.e), 9) AS score FROM v q JOIN v p ON q.id <> p.id)"""


def _queries(spark, sf_dir):
    return views.vectors(spark, sf_dir).select(F.col("point_id").alias("query_id"), "embedding")


def _shown(hits):
    return hits.withColumn("score", F.round("score", 6))


@query(
    _PAIRS
    + """
, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM pairs)
SELECT query_id, point_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""
)
def topk_cosine(spark, sf_dir):
    """The three nearest other vectors of every vector."""
    hits = retrieval.topk(_queries(spark, sf_dir), views.vectors(spark, sf_dir), 3, skip_self=True)
    return _shown(hits)


@query(
    _PAIRS
    + """
, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM pairs)
SELECT query_id, point_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""
)
def topk_cosine_blocks(spark, sf_dir):
    """The same search with smaller blocks, so that every vector meets several."""
    vectors, queries = views.vectors(spark, sf_dir), _queries(spark, sf_dir)
    partial = retrieval.topk_blocks(queries, vectors, 3, [], True, block_rows=512)
    return _shown(retrieval.best_of(partial, 3, []))


@query(
    _PAIRS
    + """
, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, shard ORDER BY score DESC, point_id) AS rank FROM pairs)
SELECT query_id, shard, point_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2"""
)
def topk_by_shard(spark, sf_dir):
    """The two nearest vectors in every shard."""
    hits = retrieval.topk(_queries(spark, sf_dir), views.vectors(spark, sf_dir), 2, "shard", True)
    return _shown(hits)


@query(
    _PAIRS
    + """
, w AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id, shard ORDER BY score DESC, point_id) = 1),
s AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shard) = 2)
SELECT query_id, shard, point_id, round(score, 6) AS score, label FROM s"""
)
def second_of_shard_winners(spark, sf_dir):
    """The retrieved example of every vector, with the record behind it."""
    vectors = views.vectors(spark, sf_dir)
    hits = retrieval.second_of_winners(_queries(spark, sf_dir), vectors, skip_self=True)
    return _shown(retrieval.lookup_records(hits, vectors.select("shard", "point_id", "label")))


@query(
    _PAIRS
    + """
, b AS (SELECT query_id, max(score) AS score FROM pairs GROUP BY 1)
SELECT count(*) AS n_queries, count(*) FILTER (score > 0.9) AS n_covered FROM b"""
)
def coverage_count(spark, sf_dir):
    hits = retrieval.topk(_queries(spark, sf_dir), views.vectors(spark, sf_dir), 3, "shard", True)
    return retrieval.covered_count(hits)


@query(
    """
WITH v AS (SELECT vec_id AS id, vec_id % 8 AS shard, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
b AS (SELECT q.id, p.shard, max(round(list_cosine_similarity(q.e, p.e), 9)) AS score FROM v q CROSS JOIN v p GROUP BY 1, 2)
SELECT count(*) FILTER (score > 0.95) AS n_near FROM b"""
)
def self_similarity(spark, sf_dir):
    """Near copies per collection, the vector itself included in its own."""
    hits = retrieval.topk(_queries(spark, sf_dir), views.vectors(spark, sf_dir), 1, "shard")
    return retrieval.near_copies(hits, ["shard"])


def _totals(spark, sf_dir):
    return (
        views.functions(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    )


_TOTALS = """
WITH t AS (SELECT CAST(doc_id % 8 AS INTEGER) AS shard, count(*) AS n FROM documents GROUP BY 1),
p AS (SELECT CAST(vec_id % 8 AS INTEGER) AS shard, vec_id // 8 AS record_id FROM embeddings)"""


@query(
    _TOTALS
    + """
SELECT t.shard, r.record_id FROM t, LATERAL (SELECT unnest(range(t.n)) AS record_id) r
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.shard = t.shard AND p.record_id = r.record_id)"""
)
def missing_points(spark, sf_dir):
    """Corpus positions that have no vector."""
    return scoring.missing_positions(views.vectors(spark, sf_dir), _totals(spark, sf_dir))


@query(
    _TOTALS
    + """
, h AS (SELECT shard, count(*) AS n_points FROM p GROUP BY 1)
SELECT shard, coalesce(n, 0) AS n_records, coalesce(n_points, 0) AS n_points,
  coalesce(n, 0) = coalesce(n_points, 0) AS complete FROM t FULL JOIN h USING (shard)"""
)
def shard_counts(spark, sf_dir):
    return scoring.shard_count_check(views.vectors(spark, sf_dir), _totals(spark, sf_dir))


@query(
    """
WITH v AS (SELECT vec_id // 8 AS idx, CAST(vec_id % 8 AS INTEGER) AS choice, label % 3 <> 0 AS ok,
    CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
t AS (SELECT idx, e AS te FROM v WHERE choice = 0),
s AS (SELECT v.idx, choice, ok, CASE WHEN ok THEN round(list_cosine_similarity(e, te), 9) ELSE -2 END AS score FROM v JOIN t USING (idx))
SELECT idx, choice, count(*) FILTER (ok) OVER (PARTITION BY idx) AS n_compiled FROM s
QUALIFY row_number() OVER (PARTITION BY idx ORDER BY ok DESC, score DESC, choice) = 1"""
)
def repair_candidate(spark, sf_dir):
    """Per record of eight vectors the compiled one most like the first."""
    rows = views.vectors(spark, sf_dir).select(
        F.col("record_id").alias("idx"),
        F.col("shard").alias("choice"),
        (F.col("label") % 3 != 0).alias("compile_success"),
        "embedding",
    )
    target = rows.where("choice = 0").select("idx", F.col("embedding").alias("target_embedding"))
    return retrieval.repair_candidate(rows.join(target, "idx"))


@query(
    """
SELECT CAST(doc_id % 8 AS INTEGER) AS shard, doc_id AS record_id,
  row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) - 1 AS point_id, length(text) AS n_text
FROM documents WHERE substr(md5(text), 1, 1) <> '0'"""
)
def build_points(spark, sf_dir):
    """Points of the documents an embedding function accepts, ids compacted per shard."""

    def embed(batch):
        out = []
        for text in batch:
            digest = hashlib.md5(text.encode("utf-8")).hexdigest()
            out.append(None if digest[0] == "0" else [float(len(text)), 1.0])
        return out

    doc = views.table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 8).cast("int").alias("shard"),
        F.col("doc_id").alias("record_id"),
        F.col("source").alias("path"),
        "text",
    )
    embedded = stages.embedding_stage(doc, "text", embed)
    points = retrieval.build_points(doc.drop("text"), embedded)
    return points.select("shard", "record_id", "point_id", F.get("embedding", F.lit(0)).cast("long").alias("n_text"))


@query(
    f"""
SELECT CAST(doc_id % 8 AS INTEGER) AS shard, doc_id AS record_id, {UNCOMMENTED.format("text")} AS text FROM documents"""
)
def embedding_input(spark, sf_dir):
    """Texts to embed: listings without comments."""
    return retrieval.embedding_input(views.functions(spark, sf_dir)).drop("path")


@query()
def approx_topk_recall(spark, sf_dir):
    """How many of the exact hits the hashed search finds."""
    vectors, queries = views.vectors(spark, sf_dir), _queries(spark, sf_dir)
    exact = retrieval.topk(queries, vectors, 3, skip_self=True)
    found = retrieval.approximate_topk(queries, vectors, 3, dim=64, bucket_rows=125, skip_self=True)
    return retrieval.recall(exact, found)


@query(
    _PAIRS
    + """
, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM pairs)
SELECT query_id, point_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""
)
def topk_cosine_pruned(spark, sf_dir):
    """The same search over blocks by direction, those passed over that cannot hold a better score."""
    hits, _ = vector_index.pruned_topk(_queries(spark, sf_dir), views.vectors(spark, sf_dir), 3, skip_self=True)
    return _shown(hits)


@query(
    """
SELECT CAST(3 * count(*) FILTER (vec_id % 20 = 0) AS BIGINT) AS n_exact, TRUE AS recall_reached, TRUE AS few_scored
FROM embeddings"""
)
def indexed_neighbours(spark, sf_dir):
    """The three nearest vectors of ids divisible by 20 from the index: nine tenths found, at most a tenth of the vectors scored."""
    vectors = views.vectors(spark, sf_dir)
    queries = _queries(spark, sf_dir).where("query_id % 20 = 0")
    exact = retrieval.topk(queries, vectors, 3, skip_self=True)
    index = vector_index.fit(vectors)
    probes, count = vector_index.tuned(index, queries, vectors, 3, skip_self=True)
    candidates = index.candidates(queries, index.entries(vectors), probes, count, skip_self=True)
    found = vector_index.rescored(candidates, queries, vectors, 3)
    row = retrieval.recall(exact, found).withColumns(
        {
            "n_scored": candidates.agg(F.count(F.lit(1))).scalar(),
            "n_pairs": queries.agg(F.count(F.lit(1))).scalar() * vectors.agg(F.count(F.lit(1))).scalar(),
        }
    )
    return row.select(
        "n_exact",
        (F.col("n_found") >= 0.9 * F.col("n_exact")).alias("recall_reached"),
        (F.col("n_scored") <= 0.1 * F.col("n_pairs")).alias("few_scored"),
    )
