"""Listings of any length: lines in bounded chunks, summaries of the chunks combined in order, results per chunk.

A chunk is a row of at most CHUNK_LINES lines, so a listing of millions of lines is spread over tasks.  Listings of one chunk are
searched within their row.  What a chunk of a longer one
needs to know of those before or after it (the name that is armed, the function that is open, whether an
argument set-up goes on to a call) is a last or first known value, which combines associatively: it is sought within
the chunk, and otherwise in a window over the listing's chunks, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from irquarry.functions.text import let, split_lines
from irquarry.operators.listing_lines import (
    END,
    END_LINE,
    GLOBL,
    GLOBL_LINE,
    LABEL_LINE,
    call_context,
    call_pattern,
    function_bodies,
    function_spans,
    may_call,
    setup_lines,
)
from irquarry.session import new_work_path

CHUNK_LINES = 4096


def line_chunks(listings: DataFrame, doc: str, text: str, keep: list[str] | None = None, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """``doc`` and the kept columns, n_lines, chunk (from 0), before (lines in earlier chunks) and lines.

    Rows are dealt by listing and chunk and stored, so that what follows reads them in as many tasks as there are chunks,
    and every listing is cut once.
    """

    def cut(lines: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lines) / chunk_lines).cast("int") - 1, F.lit(0)))
        return F.transform(
            numbers,
            lambda c: F.struct(
                F.size(lines).alias("n_lines"),
                c.alias("chunk"),
                (c * chunk_lines).alias("before"),
                F.slice(lines, c * chunk_lines + 1, F.lit(chunk_lines)).alias("lines"),
            ),
        )

    rows = listings.select(doc, *(keep or []), F.inline(let(split_lines(F.col(text)), cut)))
    return _stored(rows.repartition(doc, "chunk"), "chunks")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def last_known(rows: DataFrame, doc: str, value: Column, name: str, order: list[str], later: bool = False) -> DataFrame:
    """``rows`` (doc, chunk, ...) with the last ``value`` that is not null among earlier rows, or the first among later ones.

    Earlier rows of the chunk are looked at first, then the chunks before it, which give one row each.
    """
    turn = (lambda c: F.col(c).desc()) if later else F.col
    inside = Window.partitionBy(doc, "chunk").orderBy(*map(turn, order)).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(doc).orderBy(turn("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_value", value)
    place = F.when(F.col("_value").isNotNull(), F.struct(*order))
    edge = (F.min_by if later else F.max_by)("_value", place)
    carried = rows.groupBy(doc, "chunk").agg(edge.alias("_edge"))
    carried = carried.select(doc, "chunk", F.last("_edge", ignorenulls=True).over(across).alias("_carried")).where("_carried is not null")
    near = F.last("_value", ignorenulls=True).over(inside)
    found = rows.withColumn(name, near).join(carried, [doc, "chunk"], "left")
    return found.withColumn(name, F.coalesce(name, "_carried")).drop("_value", "_carried")


def _matched(line: str, marker: str, pattern: str) -> Column:
    """Group 1 of a pattern in lines that contain its marker, else null."""
    found = F.regexp_extract(line, pattern, 1)
    return F.when(F.col(line).contains(marker), F.when(found != "", found))


def marks(chunks: DataFrame, doc: str) -> DataFrame:
    """Rows (doc, chunk, n_lines, n, kind, name) of lines that arm a name, are a label, or end a function; n counts from one."""
    lines = chunks.select(doc, "chunk", "n_lines", "before", F.posexplode("lines").alias("_at", "line"))
    lines = lines.where(F.col("line").contains(GLOBL) | F.col("line").contains(":") | F.col("line").contains(END))
    ends = F.when(F.col("line").contains(END) & F.col("line").rlike(END_LINE), F.lit(""))
    values = (ends, _matched("line", GLOBL, GLOBL_LINE), _matched("line", ":", LABEL_LINE))
    kinds = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), v.alias("name"))) for k, v in enumerate(values)])
    found = lines.select(doc, "chunk", "n_lines", (F.col("before") + F.col("_at") + 1).alias("n"), F.explode(kinds).alias("_mark"))
    return found.where("_mark is not null").select(doc, "chunk", "n_lines", "n", "_mark.*")


#: Kinds of marks, in the order in which marks of one line count.
ENDS, ARMS, LABELS, OPENS = 0, 1, 2, 3


def _long(chunks: DataFrame) -> DataFrame:
    """The chunks of listings that have several."""
    return chunks.where(F.col("n_lines") > F.size("lines"))


def functions(chunks: DataFrame, doc: str, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """doc, name, first_line, last_line and lines of every function, lines that arm a name left out; of a reopened name the last."""
    short = chunks.where(F.col("n_lines") <= F.size("lines")).select(doc, F.inline(function_bodies(F.col("lines"))))
    long = _long(chunks)
    if long.isEmpty():
        return short
    return short.unionByName(bodies(long, last_spans(spans(long, doc, chunk_lines), doc), doc, chunk_lines))


def names(chunks: DataFrame, doc: str, last_only: bool = True, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """doc, name and first line of every function; of a reopened name the last unless ``last_only`` is off."""
    found = chunks.where(F.col("n_lines") <= F.size("lines")).select(doc, F.inline(function_spans(F.col("lines"), last_only)))
    long = _long(chunks)
    if not long.isEmpty():
        of_long = spans(long, doc, chunk_lines)
        found = found.unionByName(last_spans(of_long, doc) if last_only else of_long)
    return found.select(doc, "name", "first")


def spans(chunks: DataFrame, doc: str, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Functions of every listing: doc, name, first, last (line numbers from one); reopened names each time.

    A name is armed by its marker line; the first label after it with this name opens the function, unless another
    name is armed before.  The function ends with its end marker, before the next opening, or with the listing.
    """
    found = _stored(marks(chunks, doc), "marks")
    armed = last_known(found, doc, F.when(F.col("kind") == ARMS, F.struct("n", "name")), "_armed", ["n", "kind"])
    opened = armed.where((F.col("kind") == LABELS) & (F.col("_armed.name") == F.col("name")))
    opened = opened.groupBy(doc, "_armed.n").agg(F.min(F.struct("n", "name", "n_lines")).alias("_first"))
    opened = opened.select(doc, "_first.*").withColumns({"kind": F.lit(OPENS), "chunk": F.floor((F.col("n") - 1) / chunk_lines).cast("int")})
    opened = _stored(opened, "openings")
    turns = found.where(F.col("kind") == ENDS).unionByName(opened)
    turns = last_known(turns, doc, F.when(F.col("kind") == OPENS, F.col("n")), "_open", ["n", "kind"])
    last = F.when(F.col("kind") == ENDS, F.col("n")).otherwise(F.col("n") - 1)
    closed = turns.where("_open is not null").select(doc, F.col("_open").alias("first"), last.alias("last"))
    begun = opened.select(doc, F.col("n").alias("first"), "name", "n_lines")
    whole = begun.unionByName(closed, allowMissingColumns=True).groupBy(doc, "first")
    whole = whole.agg(F.max("name").alias("name"), F.coalesce(F.min("last"), F.max("n_lines")).alias("last"))
    return whole.select(doc, "name", "first", "last")


def last_spans(found: DataFrame, doc: str) -> DataFrame:
    """Of functions that open a name again the last one."""
    kept = found.groupBy(doc, "name").agg(F.max(F.struct("first", "last")).alias("_span"))
    return kept.select(doc, "name", "_span.*")


def bodies(chunks: DataFrame, found: DataFrame, doc: str, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """doc, name, first_line, last_line and lines of the functions, lines that arm a name left out.

    Chunks cut their part of each function; only functions that cross chunks are put together.
    """
    chunk_of = lambda c: F.floor((F.col(c) - 1) / chunk_lines).cast("int")
    asked = found.withColumns({"_from": chunk_of("first"), "_to": chunk_of("last")})
    asked = asked.withColumn("chunk", F.explode(F.sequence("_from", "_to")))
    start = F.greatest(F.col("first") - F.col("before"), F.lit(1))
    size = F.least(F.col("last") - F.col("before"), F.size("lines")) - start + 1
    kept = F.filter(F.slice("lines", start.cast("int"), size.cast("int")), lambda line: ~(line.contains(GLOBL) & line.rlike(GLOBL_LINE)))
    asked = _stored(asked, "spans")
    pieces = chunks.join(asked, [doc, "chunk"]).select(
        doc, "name", F.col("first").alias("first_line"), F.col("last").alias("last_line"), "chunk", (F.col("_from") == F.col("_to")).alias("_whole"), kept.alias("lines")
    )
    key = [doc, "name", "first_line", "last_line"]
    joined = pieces.where("not _whole").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("chunk", "lines"))).alias("_parts"))
    return pieces.where("_whole").select(*key, "lines").unionByName(joined.select(*key, F.flatten("_parts.lines").alias("lines")))


def call_lines(chunks: DataFrame, doc: str, symbol: str, arch: str) -> DataFrame:
    """doc, symbol, line_no and line of the calls of each listing's ``symbol`` and the argument set-up directly above each.

    The set-up lines at a chunk's end belong to a call if the next chunk's first line that is no set-up line is one; a chunk of
    set-up lines alone passes this on from the chunk after it.
    """
    plain, calls = setup_lines(arch), call_pattern(F.col(symbol))
    rows, long = chunks, _long(chunks)
    goes_on = None
    if not long.isEmpty():
        is_call = lambda line: may_call(line) & F.regexp_like(line, F.col("_calls"))
        first = let(F.get(F.filter("lines", lambda line: is_call(line) | ~plain(line)), F.lit(0)), is_call)
        heads = long.withColumn("_calls", calls).select(doc, "chunk", first.alias("_reaches"))
        after = last_known(heads, doc, F.col("_reaches"), "_goes_on", ["chunk"], later=True)
        rows = chunks.join(after.where("_goes_on").select(doc, "chunk", "_goes_on"), [doc, "chunk"], "left")
        goes_on = F.col("_goes_on").isNotNull()
    related = call_context(F.col("lines"), F.col(symbol), arch, goes_on)
    entry = lambda n: F.struct((F.col("before") + n).alias("line_no"), F.element_at("lines", n).alias("line"))
    return rows.select(doc, symbol, F.inline(F.transform(related, entry)))
