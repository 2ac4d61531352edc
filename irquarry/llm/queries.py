"""The operators over the given tables, and the SQL where SQL can say them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from irquarry.llm import (
    curriculum,
    debruijn,
    filter_audit,
    lexical,
    lm_scoring,
    near_dedup,
    packing,
    quality_rules,
    rule_ensemble,
    sharding,
    tiff,
    toxicity,
    warc,
)
from irquarry.llm.common import crc_remainder, measured, sliced, table, texts
from irquarry.session import new_work_path

Plan = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids, a row per piece."""
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    schema = StructType.fromDDL(
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {name: batch.column(i) for i, name in enumerate(columns)}
            ids = rows["ids"].flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            stops = np.cumsum(rows["length"].to_numpy()).tolist()
            spans = zip([0, *stops], stops)
            rows["ids_crc32"] = pa.array([zlib.crc32(ids[4 * a : 4 * b]) for a, b in spans], pa.int64())
            arrays = [rows[name].cast(pa.int64()) for name in schema.fieldNames()]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return pieces.select(columns).mapInArrow(digest, schema)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the interpolated model of the training part."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = crc_remainder(F.col("doc_id"), 5)
    part = (
        F.when(remainder == 1, lm_scoring.UNSEEN).when(remainder == 4, lm_scoring.HELD).otherwise(lm_scoring.COUNTED)
    )
    scores = lm_scoring.score(docs, part)
    held_out = crc_remainder(F.col("doc_id"), 5) == 1
    return scores.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by key, and where they would go with one more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shard_documents(docs, sharding.topology(24))
    law = F.lit("key").alias("law")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", "grown_shard")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the verdict of the compression bands for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bands = quality_rules.fitted(docs, learnable(table(spark, sf_dir, "labels"), "quality"))
    judged = quality_rules.judged(docs, ["doc_id"], bands=bands)
    return judged.select("row.doc_id", "out.*")


#: Unit of a payload: a page is PAGE_WIDTH wide.
PAYLOAD_UNIT = 576
PAGE_WIDTH = 64


def _media(body: bytes) -> tuple[bytes, int]:
    """A text as a one-page file, and its UTF-8 length; codec, layout and predictor follow the payload's checksum."""
    units = max(1, -(-len(body) // PAYLOAD_UNIT))
    payload = body.ljust(units * PAYLOAD_UNIT, b"\xff")
    choice = zlib.crc32(payload) % 16
    codec = {0: tiff.PACKBITS, 1: tiff.LZW, 2: tiff.LZW, 3: tiff.PACKBITS}.get(choice, tiff.DEFLATE)
    image = np.frombuffer(payload, np.uint8).reshape(-1, PAGE_WIDTH)
    return tiff.encode([image], codec, predictor=1 + choice % 2, tile=64 if choice in (2, 3, 4, 5) else 0), len(body)


def op6_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a TIFF page and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = measured(
        docs, "text", "media binary, n_bytes long", lambda bodies: [_media(b or b"") for b in bodies], ["doc_id"]
    )
    pages = tiff.pages(files.select("row.doc_id", "out.media", "out.n_bytes"), keep=["doc_id", "n_bytes", "media"])
    schema = StructType.fromDDL(
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string"
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 2):
                found = []
                for media, pixels, width, height in zip(
                    texts(part.column(2)), texts(part.column(3)), part.column(4).to_pylist(), part.column(5).to_pylist()
                ):
                    found.append(
                        (
                            len(pixels),
                            hashlib.sha256(pixels).hexdigest(),
                            zlib.crc32(pixels[-32:]),
                            len(media),
                            hashlib.sha256(media).hexdigest(),
                            tiff.signature(pixels, width, height),
                        )
                    )
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                arrays = [pa.array(c, k) for c, k in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=schema.fieldNames())

    flat = pages.select("row.doc_id", "row.n_bytes", "row.media", "page.pixels", "page.width", "page.height")
    return flat.mapInArrow(digest, schema)


def learnable(labels: DataFrame, column: str) -> DataFrame:
    """Labels that may be learned from."""
    return labels.where(crc_remainder(F.col("doc_id"), 4) != 2).select("doc_id", F.col(column).alias("label"))


def _judged(score: Column, threshold: float) -> list[Column]:
    held_out = (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return [F.col("doc_id"), held_out, score.alias("score"), (score >= threshold).cast("int").alias("predicted")]


TOXIC_FROM = 0.3
GOOD_FROM = 0.7


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, learnable(table(spark, sf_dir, "labels"), "toxic"))
    scored = toxicity.scored(docs, model, ["doc_id"]).select("row.doc_id", "out.score")
    return scored.select(_judged(F.col("score"), TOXIC_FROM))


def op8_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, in the order of first use."""
    plan = curriculum.assigned(table(spark, sf_dir, "documents"), [])
    first = F.get("positions", F.lit(0))
    rows = plan.select("doc_id", "size", "source_size", "target", "taken", first.alias("position"))
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived and read back."""
    folder = new_work_path(spark, "archive")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select(
        F.col("page").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rule_ensemble.fit(docs, learnable(table(spark, sf_dir, "labels"), "quality"))
    rows = rule_ensemble.with_statistics(docs, ["doc_id"])
    scored = rows.select("row.doc_id", model.score(lambda name: F.col(f"out.{name}")).alias("score"))
    return scored.select(_judged(F.col("score"), GOOD_FROM))


def op11_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the windows of smaller ids."""
    found = debruijn.repeated_spans(table(spark, sf_dir, "documents"), keep=["doc_id", "text"])
    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1):
                rows = []
                for body, spans in zip(texts(part.column(1)), part.column(2).to_pylist()):
                    words = (body or b"").split()
                    kept = debruijn.kept_words(words, spans)
                    rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=schema.fieldNames())

    return found.select("row.doc_id", "row.text", "spans").mapInArrow(digest, schema)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep and lose in every order, per source."""
    found = filter_audit.words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(found)


QUERIES: dict[str, Plan] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_lm_scoring,
        op3_near_dedup,
        op4_sharding,
        op5_quality_rules,
        op6_tiff,
        op7_toxicity,
        op8_curriculum,
        op9_warc,
        op10_rule_ensemble,
        op11_debruijn,
        op12_lexical,
        op13_filter_audit,
    )
}

ORACLE: dict[str, str] = {
    "op9_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (
  SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (digest)""",
    "op8_curriculum": r"""
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, 3 * source_size AS cap, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) AS turn,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER e, 0)) / (sum(w) OVER a) AS level FROM r
  WINDOW e AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         a AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (
  SELECT source, source_size, turn,
         CASE WHEN cap <= level * w THEN CAST(cap AS DOUBLE)
              ELSE w * max(level) FILTER (WHERE cap > level * w) OVER () END AS target FROM l),
o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.turn, CAST(round(t.target) AS BIGINT) AS wanted,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (
  SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS readings FROM o),
y AS (
  SELECT *, readings * size + greatest(least(wanted - readings * source_size - off, size), 0) AS taken,
         off / greatest(target, 1.0) AS q FROM x)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken = 0 THEN NULL
            WHEN turn = 1 THEN least(q, 1.0)
            WHEN turn = 0 THEN least(2 * q / (1.5 + sqrt(greatest(2.25 - 2 * q, 0))), 1.0)
            ELSE least(2 * q / (0.5 + sqrt(0.25 + 2 * q)), 1.0) END AS position
FROM y""",
}


ORACLE["op11_debruijn"] = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
p AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p),
f AS (
  SELECT s, min(doc_id) AS first_id FROM g GROUP BY s),
c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (s) WHERE first_id < doc_id),
x AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (
  SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.i = c.i
  GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

ORACLE["op12_lexical"] = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
qt AS (
  SELECT item_id, term, count(*) AS qtf FROM q GROUP BY ALL),
tf AS (
  SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
c AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS occurrences FROM n),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, c GROUP BY term, docs),
s AS (
  SELECT item_id, doc_id,
         CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // occurrences)))) AS BIGINT) AS score
  FROM qt JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER o <= 10"""

ORACLE["op13_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (
  SELECT d.doc_id, part,
         [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
          100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'),
          coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM d),
b AS (
  SELECT part, fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad
  FROM f LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT filter_order, step, instr('ABCDE', filter_order[step]) AS place,
         [instr('ABCDE', x) FOR x IN string_split(filter_order[1:step - 1], '') IF x <> ''] AS earlier
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, place, fails[place] AS failed, len([i FOR i IN earlier IF fails[i]]) > 0 AS gone,
         len([i FOR i IN [1, 2, 3, 4, 5] IF i <> place AND fails[i]]) = 0 AS others_pass, good, bad
  FROM b, s),
g AS (
  SELECT part, filter_order, step, place, count(*) FILTER (NOT gone AND NOT failed) AS kept,
         count(*) FILTER (NOT gone AND failed) AS removed, count(*) FILTER (gone AND failed) AS redundant,
         count(*) FILTER (failed AND others_pass) AS unique_fails, count(*) FILTER (NOT gone AND failed AND good) AS good_lost,
         count(*) FILTER (NOT gone AND failed AND bad) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, place)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, place) AS BIGINT) AS shapley
FROM g"""


def queries() -> dict[str, Plan]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
