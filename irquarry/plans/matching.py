"""Matched-sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from irquarry.operators import matching, predicates, records, sampling
from irquarry.plans import views
from irquarry.plans.registry import query
from irquarry.plans.views import ctes

SAMPLE_SIZE = 164


def _flat(rows):
    return rows.select("idx", F.col("llvm_ir.bb_count.bbcount").alias("bbcount"), "token_length")


def _set(spark, sf_dir, name):
    test = predicates.motivation_sets()[name]
    return _flat(views.functions(spark, sf_dir).where(test))


_SETS = (
    ctes("fn")
    + """
, loops AS (SELECT * FROM fn WHERE token_length < 4096 AND num_loops > 0),
plain AS (SELECT * FROM fn WHERE token_length < 4096 AND num_loops = 0),
one AS (SELECT * FROM fn WHERE token_length < 4096 AND bbcount = 1),
probe AS (SELECT * FROM loops ORDER BY md5(idx || ':42'), idx LIMIT 164)"""
)

_MATCH = """
, m AS (SELECT p.idx, greatest(abs(c.bbcount - p.bbcount), abs(c.token_length - p.token_length) * 10 // p.token_length) AS level, c.idx AS c
  FROM {probe} p CROSS JOIN plain c)
SELECT idx, CAST(level AS BIGINT) AS level, c AS matched_idx FROM m
QUALIFY row_number() OVER (PARTITION BY idx ORDER BY level, c) = 1"""


@query(_SETS + _MATCH.format(probe="probe"))
def matched_sample(spark, sf_dir):
    """A seeded sample with loops, each matched by a function without loops."""
    probes = sampling.seeded_sample(_set(spark, sf_dir, "loops"), SAMPLE_SIZE)
    matched = matching.widening_match(probes, _set(spark, sf_dir, "without_loops"))
    return matched.select("idx", "level", "matched_idx")


@query(_SETS + _MATCH.format(probe="loops"))
def matched_all(spark, sf_dir):
    """Every function with loops matched by one without."""
    matched = matching.widening_match(
        _set(spark, sf_dir, "loops"), _set(spark, sf_dir, "without_loops")
    )
    return matched.select("idx", "level", "matched_idx")


@query(
    _SETS
    + """
, m AS (SELECT p.idx, abs(c.token_length - p.token_length) * 100 // p.token_length AS level, c.idx AS c
  FROM loops p CROSS JOIN one c)
SELECT idx, CAST(level AS BIGINT) AS level, c AS matched_idx FROM m
QUALIFY row_number() OVER (PARTITION BY idx ORDER BY level, c) = 1"""
)
def matched_by_length(spark, sf_dir):
    """Every function with loops matched by a one-block function of similar length."""
    matched = matching.widening_match(
        _set(spark, sf_dir, "loops"),
        _set(spark, sf_dir, "one_block"),
        step=matching.FINE_TOKEN_STEP,
        with_blocks=False,
    )
    return matched.select("idx", "level", "matched_idx")


def _shape(spark, sf_dir, split):
    rows = records.single_function_view(views.functions(spark, sf_dir).where(F.col("split") == split))
    return rows.select(
        "idx",
        F.size("called_functions").alias("n_called"),
        "num_loops",
        F.size("bb_count_list").alias("n_blocks"),
    )


@query(
    ctes("fn")
    + """
SELECT p.idx, min(c.idx) AS similar_idx FROM fn p LEFT JOIN fn c
  ON NOT c.is_valid AND (p.n_called = 0) = (c.n_called = 0) AND (p.num_loops = 0) = (c.num_loops = 0)
  AND (p.bbcount = 1) = (c.bbcount = 1) AND abs(p.bbcount - c.bbcount) <= 2
WHERE p.is_valid GROUP BY 1"""
)
def rule_similar(spark, sf_dir):
    """For every validation function the first test function of like shape."""
    return matching.rule_similar(_shape(spark, sf_dir, "valid_synth"), _shape(spark, sf_dir, "test_synth"))


@query(
    ctes("fn")
    + """
, sample AS (SELECT * FROM fn WHERE token_length < 4096 ORDER BY md5(idx || ':42'), idx LIMIT 164),
unused AS (SELECT path, min(idx) AS idx FROM fn WHERE num_loops > 0 AND path NOT IN (SELECT path FROM sample) GROUP BY 1),
u AS (SELECT path, row_number() OVER (ORDER BY idx) AS k FROM unused),
b AS (SELECT idx, row_number() OVER (ORDER BY idx) AS k FROM sample WHERE idx % 5 < 2)
SELECT s.idx, coalesce(u.path, s.path) AS path, u.path IS NOT NULL AS replaced
FROM sample s LEFT JOIN b ON b.idx = s.idx LEFT JOIN u ON u.k = b.k"""
)
def replace_failed(spark, sf_dir):
    """Sample rows whose target failed, replaced by unused functions in order."""
    rows = views.functions(spark, sf_dir)
    sample = sampling.seeded_sample(rows.where(predicates.short_enough()).select("idx", "path"), SAMPLE_SIZE)
    failed = sample.where("idx % 5 < 2").select("idx")
    return matching.replace_failed(sample, failed, rows.where(predicates.has_loops()))


@query(
    """
SELECT doc_id AS idx, md5(text) AS digest FROM documents ORDER BY md5(doc_id || ':42'), doc_id LIMIT 100"""
)
def seeded_sample(spark, sf_dir):
    rows = sampling.seeded_sample(views.functions(spark, sf_dir).select("idx", "func_def"), 100)
    return rows.select("idx", F.md5("func_def").alias("digest"))


@query(
    ctes("fn")
    + """
SELECT idx AS own_idx, shard, row_number() OVER (ORDER BY shard, idx) - 1 AS idx FROM fn WHERE shard < 7"""
)
def merged_shards(spark, sf_dir):
    """Seven shards as one table in shard order, with their positions in the whole."""
    from irquarry.sources.readers import merged

    rows = views.functions(spark, sf_dir).where("shard < 7").select("idx", F.col("idx").alias("own_idx"), "shard")
    return merged(rows)
