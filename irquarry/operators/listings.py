"""Assembly listings: callees, functions, call sites.

``doc`` is the key of a listing, a text cell.  Its lines are cut into bounded chunks that are dealt over the tasks; see ``listing_chunks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irquarry.functions.code import strip_plt
from irquarry.operators.listing_chunks import call_lines, functions, line_chunks, names
from irquarry.operators.listing_lines import call_context, called_symbols, setup_pattern

__all__ = [
    "call_context", "call_contexts", "call_edges", "called_symbols", "callers_of", "listing_report", "setup_pattern", "split_functions",
]


def call_edges(listings: DataFrame, doc: str, text: str) -> DataFrame:
    """(listing, callee) rows."""
    return listings.select(doc, F.explode(called_symbols(F.col(text))).alias("callee"))


def split_functions(listings: DataFrame, doc: str, text: str) -> DataFrame:
    """One row per (listing, function): name, place and body lines without ``.globl`` lines."""
    return functions(line_chunks(listings, doc, text), doc)


def call_contexts(
    listings: DataFrame, doc: str, text: str, symbol: str, arch: str = "amd64_sysv"
) -> DataFrame:
    """(listing, symbol, line number, line) rows related to calls of each listing's ``symbol``."""
    return call_lines(line_chunks(listings, doc, text, [symbol]), doc, symbol, arch)


def _under_test(listings: DataFrame, doc: str, text: str) -> DataFrame:
    """doc and the name of the function that its listing opens first."""
    found = names(line_chunks(listings, doc, text), doc, last_only=False)
    return found.groupBy(doc).agg(strip_plt(F.min_by("name", "first")).alias("under_test"))


def listing_report(records: DataFrame, doc: str, listing: str, wrapper: str) -> DataFrame:
    """Per record that calls something: callees, wrapper functions in order of place, undefined callees, the
    function under test, and whether the wrapper defines ``main``."""
    defined = names(line_chunks(records, doc, wrapper), doc).groupBy(doc)
    defined = defined.agg(F.sort_array(F.collect_list(F.struct("first", "name"))).alias("_names"))
    rows = records.select(doc, called_symbols(F.col(listing)).alias("callees")).where(F.size("callees") > 0)
    rows = rows.join(defined, doc, "left").join(_under_test(records, doc, listing), doc, "left")
    rows = rows.withColumn("wrapper_functions", F.coalesce("_names.name", F.array().cast("array<string>")))
    return rows.select(
        doc,
        "callees",
        "wrapper_functions",
        "under_test",
        F.array_except(F.transform("callees", strip_plt), "wrapper_functions").alias("undefined"),
        F.array_contains("wrapper_functions", "main").alias("has_main"),
    )


def callers_of(
    records: DataFrame, doc: str, listing: str, wrapper: str, arch: str = "amd64_sysv"
) -> DataFrame:
    """How the wrapper's functions call the function under test: one row per related line."""

    def lines(symbol: Column) -> Column:
        return F.transform(call_context(F.col("lines"), symbol, arch), lambda n: F.element_at("lines", n))

    rows = split_functions(records, doc, wrapper).join(_under_test(records, doc, listing), doc)
    return rows.select(
        doc, F.col("name").alias("caller"), F.col("under_test").alias("symbol"), F.explode(lines(F.col("under_test"))).alias("line")
    )
