"""What the operators of this package share: text as UTF-8, row-wise Arrow passes, stored tables.

Words are maximal runs of bytes other than ASCII white space (20, 09-0D), which is what
``bytes.split()`` yields; ``bytes.lower()`` lowers A-Z only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from irquarry.session import new_work_path

# Texts handed to Python at a time: a batch is cut into slices of about so many bytes.
SLICE_BYTES = 8 << 20

# The words of a text, for Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written below the shared folder and read back: lineage ends here."""
    path = new_work_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:6]}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def count_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key's text modulo a number; a null key counts as empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def sliced(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about SLICE_BYTES of the given string or binary column."""
    body, start, size = batch.column(column), 0, 0
    lengths = pc.binary_length(body).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        size += n
        if size >= SLICE_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < len(lengths):
        yield batch.slice(start)


def texts(body: pa.Array) -> list[bytes | None]:
    return body.cast(pa.binary()).to_pylist()


def measured(
    docs: DataFrame,
    text: str,
    fields: str,
    compute: Callable[[list[bytes | None]], list[tuple]],
    keep: list[str] | None = None,
) -> DataFrame:
    """``row`` (the kept columns) and ``out`` (one computed tuple of ``fields`` per text).

    Both are structs, so no column of the input can clash with a computed one.  Nothing is shuffled.
    """
    kept = docs.columns if keep is None else keep
    row = F.struct(*[named(c).alias(c) for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    packed = docs.select(row.alias("row"), named(text).alias("body"))
    out = StructType.fromDDL(fields)
    schema = StructType([StructField("row", packed.schema["row"].dataType), StructField("out", out)])
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [f.type for f in to_arrow_schema(out)]
        for batch in batches:
            for part in sliced(batch, 1):
                columns = list(zip(*compute(texts(part.column(1)))))
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.StructArray.from_arrays(arrays, names)], names=["row", "out"]
                )

    return packed.mapInArrow(run, schema)


def one_text(rows: DataFrame) -> DataFrame:
    """One row per doc_id, the smallest ``body`` of those that are not null; the other columns follow the id."""
    others = [c for c in rows.columns if c != "body"]
    return rows.groupBy(*others).agg(F.min("body").alias("body"))


def total_bytes(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(named(text)).cast("long"))).head()[0] or 0
