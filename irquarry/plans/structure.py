"""Structure queries: cascades, histograms, blocked deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from irquarry.functions.code import dependency_text
from irquarry.functions.text import newline_split
from irquarry.operators import clusters, dedup, histograms, predicates, records
from irquarry.plans import views
from irquarry.plans.registry import query
from irquarry.plans.views import ctes

# The stand-in's one-block records are longer than the default range of 1..9 instructions.
DEDUP_BOUNDS = dict(min_inst=1, max_inst=400)


@query(
    ctes("fn")
    + """
SELECT count(*) AS n_input,
  count(*) FILTER (n_unused = 0) AS n_no_unused_args,
  count(*) FILTER (n_unused = 0 AND n_called > 0) AS n_first_calls,
  count(*) FILTER (n_unused = 0 AND n_called > 0 AND bbcount > 3) AS n_blocks,
  count(*) FILTER (n_unused = 0 AND n_called > 0 AND bbcount > 3 AND has_structs) AS n_structs,
  count(*) FILTER (n_unused = 0 AND n_called > 0 AND bbcount > 3 AND has_structs AND inst > 50) AS n_instructions
FROM fn"""
)
def predicate_cascade(spark, sf_dir):
    """Rows left after each stage of the hard set, in one pass."""
    return predicates.stage_counts(views.functions(spark, sf_dir), predicates.hard_set_stages())


@query(
    ctes("fn")
    + """
SELECT idx, path, bbcount, inst AS inst_count FROM fn
WHERE n_unused = 0 AND n_called > 0 AND bbcount > 3 AND has_structs AND inst > 50"""
)
def hard_set(spark, sf_dir):
    rows = predicates.cascade(views.functions(spark, sf_dir), predicates.hard_set_stages())
    return rows.select(
        "idx", "path", F.col("llvm_ir.bb_count.bbcount").alias("bbcount"), records.inst_count().alias("inst_count")
    )


@query(
    ctes("fn")
    + """
SELECT is_valid, count(*) FILTER (token_length < 4096 AND num_loops > 0) AS loops,
  count(*) FILTER (token_length < 4096 AND num_loops = 0) AS without_loops,
  count(*) FILTER (token_length < 4096 AND bbcount = 1) AS one_block,
  count(*) FILTER (token_length < 4096 AND n_called > 0 AND idx % 7 > 0) AS calls,
  count(*) FILTER (token_length < 4096 AND n_called = 0 AND idx % 7 > 0) AS without_calls
FROM fn GROUP BY 1"""
)
def motivation_sets(spark, sf_dir):
    """Sizes of the evaluation sets per split, in one pass."""
    rows = views.functions(spark, sf_dir).withColumns(
        {"target_compile_success": F.lit(True), "target_execution_success": F.col("idx") % 7 > 0}
    )
    return rows.groupBy((F.col("split") == "valid_synth").alias("is_valid")).agg(
        *[F.count_if(test).alias(name) for name, test in predicates.motivation_sets().items()]
    )


@query(
    ctes("fn")
    + """
, t AS (SELECT unnest([5, 10, 20, 50]) AS threshold)
SELECT CAST(threshold AS INTEGER) AS threshold, count(*) FILTER (bbcount >= threshold) AS n_records,
  round(count(*) FILTER (bbcount >= threshold) * 100.0 / count(*), 2) AS percent
FROM t, fn GROUP BY 1"""
)
def min_block_counts(spark, sf_dir):
    return predicates.min_block_counts(views.functions(spark, sf_dir))


@query(ctes("fn") + " SELECT bbcount, count(*) AS n FROM fn GROUP BY 1 HAVING count(*) > 2")
def bb_histogram(spark, sf_dir):
    return histograms.block_histogram(views.functions(spark, sf_dir))


@query(
    ctes("fn")
    + " SELECT inst AS inst_count, count(*) AS n FROM fn WHERE bbcount = 1 GROUP BY 1 HAVING count(*) > 4"
)
def inst_histogram(spark, sf_dir):
    return histograms.instruction_histogram(views.functions(spark, sf_dir))


def _blocks(spark, sf_dir):
    return views.functions(spark, sf_dir).select(
        F.col("split").alias("dataset"), F.col("llvm_ir.bb_count.bbcount").alias("bbcount")
    )


@query(
    ctes("fn")
    + """
, axis AS (SELECT unnest(range(lo, hi + 1)) AS bbcount FROM (SELECT min(bbcount) AS lo, max(bbcount) AS hi FROM fn))
SELECT CAST(a.bbcount AS INTEGER) AS bbcount, count(idx) FILTER (is_valid) AS valid_synth,
  count(idx) FILTER (NOT is_valid) AS test_synth
FROM axis a LEFT JOIN fn USING (bbcount) GROUP BY 1"""
)
def joint_histogram(spark, sf_dir):
    """Both splits over their joint range."""
    return histograms.joint_histogram(
        _blocks(spark, sf_dir), "dataset", "bbcount", ["valid_synth", "test_synth"]
    )


@query(
    ctes("fn")
    + """
, c AS (SELECT is_valid, least(bbcount, 21) AS bbcount FROM fn),
axis AS (SELECT unnest(range(lo, 22)) AS bbcount FROM (SELECT min(bbcount) AS lo FROM c)),
g AS (SELECT d.is_valid, a.bbcount, count(c.bbcount) AS n
  FROM axis a CROSS JOIN (SELECT DISTINCT is_valid FROM c) d
  LEFT JOIN c ON c.bbcount = a.bbcount AND c.is_valid = d.is_valid GROUP BY 1, 2)
SELECT CASE WHEN is_valid THEN 'valid_synth' ELSE 'test_synth' END AS dataset,
  CAST(bbcount AS INTEGER) AS bbcount, n, round(n * 100.0 / sum(n) OVER (PARTITION BY is_valid), 6) AS percent
FROM g"""
)
def clipped_percent(spark, sf_dir):
    return histograms.clipped_percent(_blocks(spark, sf_dir), "dataset", "bbcount")


@query(
    """
WITH v AS (SELECT CAST(n_chars AS DOUBLE) AS v FROM documents),
b AS (SELECT min(v) AS lo, (max(v) - min(v)) / 10 AS w, count(*) AS total FROM v),
axis AS (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin),
c AS (SELECT CAST(least(floor((v - lo) / w), 9) AS INTEGER) AS bin, count(*) AS n FROM v, b GROUP BY 1)
SELECT bin, round(lo + bin * w, 6) AS bin_from, coalesce(n, 0) AS n,
  round(coalesce(n, 0) / (total * w), 9) AS density
FROM axis LEFT JOIN c USING (bin), b"""
)
def equal_width_hist(spark, sf_dir):
    """Ten equal bins of the token lengths, as a density."""
    return histograms.equal_width(
        views.functions(spark, sf_dir), F.col("token_length"), 10, density=True
    )


@query(
    ctes("fn")
    + """
SELECT 'token_length' AS name, CAST(token_length AS BIGINT) AS value, count(*) AS n FROM fn GROUP BY 2
UNION ALL SELECT 'bbcount', bbcount, count(*) FROM fn GROUP BY 2"""
)
def sorted_values(spark, sf_dir):
    """The sorted values of two columns with their frequency."""
    rows = views.functions(spark, sf_dir).select(
        "token_length", F.col("llvm_ir.bb_count.bbcount").alias("bbcount")
    )
    return histograms.sorted_values(rows, ["token_length", "bbcount"])


_LENGTHS = """
WITH p AS (SELECT n_chars AS len, quality = 1 AS c, quality = 1 AND toxic <> 1 AND doc_id % 3 = 0 AS e
  FROM documents JOIN labels USING (doc_id)),
axis AS (SELECT unnest(range(18)) AS bucket),
b AS (SELECT CASE WHEN len > 4096 THEN 17 ELSE len // 256 END AS bucket, count(*) AS total, count(*) FILTER (c) AS compiled, count(*) FILTER (e) AS executed
  FROM p WHERE len IS NOT NULL GROUP BY 1),
h AS (SELECT CAST(CASE WHEN a.bucket = 17 THEN 4097 ELSE a.bucket * 256 END AS INTEGER) AS length_from, coalesce(total, 0) AS total,
  coalesce(compiled, 0) AS compiled, coalesce(executed, 0) AS executed FROM axis a LEFT JOIN b USING (bucket))"""


def _buckets(spark, sf_dir):
    doc = views.table(spark, sf_dir, "documents").join(views.table(spark, sf_dir, "labels"), "doc_id")
    quality = F.col("quality") == 1
    rows = doc.select(
        F.col("n_chars").alias("predict_length"),
        F.array(quality).alias("predict_compile_success"),
        F.array(quality & (F.col("toxic") != 1) & (F.col("doc_id") % 3 == 0)).alias("predict_execution_success"),
    )
    return histograms.length_buckets(rows)


@query(_LENGTHS + " SELECT *, compiled - executed AS compilable_only, total - compiled AS error FROM h")
def length_buckets(spark, sf_dir):
    return _buckets(spark, sf_dir)


@query(
    _LENGTHS
    + """
SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(compiled) AS BIGINT) AS compiled,
  CAST(sum(executed) AS BIGINT) AS executed, round(sum(compiled) / sum(total), 6) AS compile_rate,
  round(sum(executed) / sum(total), 6) AS execution_rate FROM h"""
)
def length_rates(spark, sf_dir):
    return histograms.length_rates(_buckets(spark, sf_dir))


@query(
    """
SELECT doc_id AS idx, len(regexp_extract_all(text, '[a-zA-Z0-9_]+')) AS token_length FROM documents"""
)
def token_lengths(spark, sf_dir):
    """Default length measure of every record."""
    return records.attach_token_length(views.functions(spark, sf_dir)).select("idx", F.col("token_length").cast("long"))


_DEDUP = (
    ctes("fn")
    + """
, cmp AS (SELECT *, row_number() OVER (PARTITION BY shard, inst, md5(code) ORDER BY idx) AS rn
  FROM fn WHERE bbcount = 1 AND inst BETWEEN 1 AND 400)"""
)


@query(
    _DEDUP
    + """
SELECT idx, bbcount, inst AS inst_count FROM cmp WHERE rn = 1
UNION ALL SELECT idx, bbcount, inst FROM fn WHERE bbcount <> 1 OR inst > 400"""
)
def blocked_dedup(spark, sf_dir):
    """First of each class of equal one-block records per shard, all other records whole."""
    kept = dedup.blocked_dedup(views.functions(spark, sf_dir), by=["shard"], **DEDUP_BOUNDS)
    return kept.select(
        "idx", F.col("llvm_ir.bb_count.bbcount").alias("bbcount"), records.inst_count().alias("inst_count")
    )


@query(
    ctes("fn")
    + """
SELECT inst AS inst_count, count(*) AS n_before, count(DISTINCT md5(code)) AS n_after
FROM fn WHERE bbcount = 1 AND inst BETWEEN 1 AND 400 GROUP BY 1"""
)
def dedup_by_inst(spark, sf_dir):
    return dedup.dedup_report(views.functions(spark, sf_dir), **DEDUP_BOUNDS)


@query(
    ctes("fn")
    + """
SELECT inst AS inst_count, count(*) AS n, min(idx) AS first_idx
FROM fn WHERE bbcount = 1 AND inst BETWEEN 1 AND 400 GROUP BY inst, md5(code)"""
)
def class_sizes(spark, sf_dir):
    return dedup.class_sizes(views.functions(spark, sf_dir), **DEDUP_BOUNDS)


def _line_functions(spark, sf_dir):
    """Every line of every document as a one-block function: each word is computed from the one before it."""
    doc = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = doc.select("doc_id", F.posexplode(newline_split(F.col("text"))).alias("line", "words"))
    words = F.transform(F.split("words", " ", -1), lambda w: F.concat(F.lit("w"), F.regexp_replace(w, "[^A-Za-z]", "")))
    rows = rows.withColumn("words", words)

    def step(word, i):
        before = F.when(i > 0, F.get("words", i - 1)).otherwise(F.lit("entry"))
        return F.concat(F.lit("  %"), word, F.lit(" = add i32 %"), before, F.lit(", 1 ; step "), i.cast("string"))

    text = F.array_join(
        F.concat(
            F.array(F.lit("; ModuleID = 'x'"), F.concat(F.lit("define i32 @"), F.get("words", F.lit(0)), F.lit("() {")), F.lit("entry:")),
            F.transform("words", step),
            F.array(F.lit("  ret void, !dbg !7"), F.lit("}")),
        ),
        "\n",
    )
    count = F.struct(F.lit("f").alias("func_name"), F.lit(1).alias("bbcount"), F.array(F.size("words")).alias("bb_list_size"))
    return rows.select(
        (F.col("doc_id") * 1_000_000 + F.col("line")).alias("idx"),
        F.struct(F.array(text).alias("code"), count.alias("bb_count")).alias("llvm_ir"),
    )


@query(
    """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
f AS (SELECT doc_id * 1000000 + generate_subscripts(ls, 1) - 1 AS idx, string_split(unnest(ls), ' ') AS ws FROM l),
w AS (SELECT idx, list_transform(ws, lambda x: 'w' || regexp_replace(x, '[^A-Za-z]', '', 'g')) AS ws FROM f WHERE len(ws) <= 9),
t AS (SELECT idx, len(ws) AS inst_count, ['entry'] || flatten(list_transform(ws, lambda x, i: [x, CASE WHEN i > 1 THEN ws[i - 1] ELSE 'entry' END])) AS names FROM w)
SELECT inst_count, count(*) AS n, min(idx) AS first_idx FROM t
GROUP BY inst_count, list_transform(names, lambda x: list_position(names, x))"""
)
def canonical_classes(spark, sf_dir):
    """Classes of functions that agree after a one-to-one renaming."""
    sizes = dedup.class_sizes(_line_functions(spark, sf_dir), "canonical")
    return sizes.withColumn("inst_count", F.col("inst_count").cast("long"))


@query(
    """
WITH RECURSIVE d AS (SELECT doc_id, list_distinct(string_split(text, ' ')) AS w, len(string_split(text, ' ')) AS n FROM documents),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b ON a.n = b.n AND a.doc_id <> b.doc_id
  WHERE len(list_intersect(a.w, b.w)) >= 0.8 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 0.000001),
reach AS (SELECT doc_id AS idx, doc_id AS seen FROM d UNION SELECT idx, b FROM reach JOIN link ON seen = a)
SELECT idx, min(seen) AS first FROM reach GROUP BY idx"""
)
def fuzzy_classes(spark, sf_dir):
    """Documents of one word count linked by four fifths of their words."""
    doc = views.table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ", -1).alias("words"))
    sets = doc.select(
        F.col("doc_id").alias("idx"), F.size("words").alias("block"), F.transform("words", lambda w: F.xxhash64(w)).alias("elements")
    )
    return clusters.similar_classes(sets, 0.8)


def _with_info(spark, sf_dir):
    """Records with analysis output as text; every eleventh one could not be parsed, every seventh has two functions."""
    rows = views.functions(spark, sf_dir)
    twice = F.struct(F.concat("func_info.functions", "func_info.functions").alias("functions"))
    text = (
        F.when(F.col("idx") % 11 == 0, F.lit("parser stopped"))
        .when(F.col("idx") % 7 == 0, F.to_json(twice))
        .otherwise(F.to_json("func_info"))
    )
    return records.attach_func_info(rows.withColumn("info", text), "info")


@query(
    ctes("fn")
    + """
SELECT idx, CASE WHEN idx % 11 = 0 THEN '' ELSE 'f' || idx END AS func_name,
  CASE WHEN idx % 11 = 0 THEN 0 ELSE n_called END AS n_called, CASE WHEN idx % 11 = 0 THEN 0 ELSE num_loops END AS num_loops,
  CASE WHEN idx % 11 = 0 THEN 0 ELSE n_unused END AS n_unused, idx % 11 <> 0 AND has_structs AS has_structs,
  CASE WHEN idx % 11 <> 0 AND idx % 7 = 0 THEN 'functions: 2' END AS quarantine FROM fn"""
)
def function_info(spark, sf_dir):
    """Typed view of the parsed analysis output, the default entry where parsing failed."""
    rows = records.single_function_view(_with_info(spark, sf_dir))
    return rows.select(
        "idx",
        "func_name",
        F.size("called_functions").cast("long").alias("n_called"),
        F.col("num_loops").cast("long").alias("num_loops"),
        F.size("unused_args").cast("long").alias("n_unused"),
        F.col("has_defined_structs").alias("has_structs"),
        "quarantine",
    )


@query(
    """
SELECT d.doc_id AS idx, CASE WHEN l.doc_id IS NOT NULL THEN quality + 2 END AS bbcount,
  text || chr(10) || source || chr(10) AS deps FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def attached_counts(spark, sf_dir):
    """Block counts attached by position, null where there is none, and the dependency text."""
    counts = views.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("idx"),
        F.struct(
            F.lit("f").alias("func_name"),
            (F.col("quality") + 2).cast("int").alias("bbcount"),
            F.array(F.lit(1)).alias("bb_list_size"),
        ).alias("bb_count"),
    )
    source = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "source")
    rows = records.attach_bb_count(views.functions(spark, sf_dir), counts).join(source, "idx")
    return rows.select(
        "idx",
        F.col("llvm_ir.bb_count.bbcount").alias("bbcount"),
        dependency_text(F.concat(F.lit("typedef int bool;"), "func_def"), F.array("source")).alias("deps"),
    )
