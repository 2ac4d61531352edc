"""Content-addressed archive: payload bytes once per strong digest, record headers apart, records by a join.

An archive is two Parquet tables below one folder: ``payloads`` (digest, payload) has each distinct payload once, and
``headers`` (digest, header) the exact header bytes of each record.  Of the records with equal payloads of at least
``min_bytes``, the one with the smallest id is a response and the others revisit it.  Reading recomputes the SHA-256 of every
stored payload and fails on any that differs from its address.

All columns are Spark expressions.  Null payload counts as empty.  A null id never is the smallest; where all ids of a
payload are null, all its records are responses.  Rows that repeat the smallest id are all responses.  Control bytes in a URL
are written as %XX.  An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from irquarry.llm.common import named

MIN_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(text: Column) -> Column:
    digest = F.md5(text)
    parts = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _record_key(record_id: Column) -> Column:
    return _urn(F.concat(F.lit("record:"), F.coalesce(record_id.cast("string"), F.lit(""))))


def records(pages: DataFrame, record_id: str, url: str, payload: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(digest, n_bytes, payload, header_head...): what is to be written, one row per page."""
    body = F.coalesce(named(payload).cast("binary"), F.lit(b""))
    return pages.select(
        named(record_id).alias("record_id"), named(url).cast("string").alias("url"), body.alias("payload")
    ).select(
        "*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes")
    )


def headers(rows: DataFrame, min_bytes: int = MIN_BYTES, date: str = DATE) -> DataFrame:
    """(digest, header): the header block of each record.

    The smallest id per digest is aggregated before the shuffle; the join back carries no payload and its large side may be
    split where a digest is hot.
    """
    small = rows.select("record_id", "url", "digest", "n_bytes")
    shared = small.where((F.col("n_bytes") >= min_bytes) & F.col("record_id").isNotNull())
    first = shared.groupBy("digest").agg(F.min("record_id").alias("first_id"))
    joined = small.join(first, "digest", "left")
    revisit = F.coalesce(
        (F.col("n_bytes") >= min_bytes) & ~F.col("record_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(),
        F.lit(False),
    )
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    optional = lambda line, when: F.when(when, line).otherwise(F.lit(""))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_key(F.col("record_id"))),
        _line("WARC-Date", F.lit(date)),
        optional(_line("WARC-Target-URI", uri), F.col("url").isNotNull()),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        optional(_line("WARC-Refers-To", _record_key(F.col("first_id"))), revisit),
        optional(_line("WARC-Refers-To-Page", F.col("first_id").cast("string")), revisit),
        optional(_line("WARC-Profile", F.lit(PROFILE)), revisit),
        optional(_line("WARC-Page", F.col("record_id").cast("string")), F.col("record_id").isNotNull()),
        F.lit("Content-Type: text/html\r\n"),
        _line("Content-Length", F.when(revisit, "0").otherwise(F.col("n_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    return joined.select("digest", header.cast("binary").alias("header"))


def write(pages: DataFrame, folder: str, record_id: str = "page_id", url: str = "url", payload: str = "html",
          min_bytes: int = MIN_BYTES) -> None:
    """Write the archive of ``pages`` into a new folder."""
    rows = records(pages, record_id, url, payload, min_bytes)
    headers(rows, min_bytes).write.parquet(f"{folder}/headers")
    rows.select("digest", "payload").dropDuplicates(["digest"]).write.parquet(f"{folder}/payloads")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """header, record_type, page, refers_to, url, payload, payload_bytes and payload_digest of every record.

    The facts of a payload are computed once per stored payload, before the join.
    """
    checked = F.sha2("payload", 256)
    wrong = F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("digest")))
    payloads = spark.read.parquet(f"{folder}/payloads").select(
        "digest",
        "payload",
        F.when(checked == F.col("digest"), checked).otherwise(wrong.cast("string")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    lines = F.col("header").cast("string")

    def value(name: str) -> Column:
        found = F.regexp_extract(lines, f"\r\n{name}: ([^\r]*)\r\n", 1)
        return F.when(found != "", found)

    stored = spark.read.parquet(f"{folder}/headers").select(
        "digest",
        "header",
        value("WARC-Type").alias("record_type"),
        value("WARC-Page").alias("page"),
        value("WARC-Refers-To-Page").alias("refers_to"),
        value("WARC-Target-URI").alias("url"),
    )
    return stored.join(payloads, "digest")


def restored(spark: SparkSession, folder: str) -> DataFrame:
    """The records as they stand in a WARC file: header, block (none for a revisit) and two line ends."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    whole = F.concat(F.col("header"), block, F.lit(b"\r\n\r\n"))
    return read(spark, folder).select("*", whole.alias("record"))
