"""Listing queries: callees, functions, call sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from irquarry.operators import listings
from irquarry.plans import views
from irquarry.plans.registry import query
from irquarry.plans.views import ctes


@query(ctes("lst") + " SELECT DISTINCT doc_id, callee || '@PLT' AS callee FROM fun")
def called_symbols(spark, sf_dir):
    """Call-graph edges of every listing."""
    return listings.call_edges(views.listings(spark, sf_dir), "doc_id", "listing")


@query(
    ctes("lst")
    + """
, lastfun AS (SELECT doc_id, nm, max(i) AS i FROM lst GROUP BY 1, 2)
SELECT doc_id, nm AS name, CAST(min(n) AS INTEGER) AS first_line, count(*) AS n_lines,
  string_agg(txt, chr(10) ORDER BY n) AS body
FROM lst JOIN lastfun USING (doc_id, nm, i)
WHERE k >= 2 AND (k <= 7 OR w % 3 = 0) GROUP BY 1, 2"""
)
def split_functions(spark, sf_dir):
    """Functions of every listing with their bodies; the last of a reopened name."""
    rows = listings.split_functions(views.listings(spark, sf_dir), "doc_id", "listing")
    return rows.select(
        "doc_id",
        "name",
        "first_line",
        F.size("lines").cast("long").alias("n_lines"),
        F.array_join("lines", "\n").alias("body"),
    )


@query(
    ctes("lst")
    + """
, sym AS (SELECT doc_id, callee AS symbol FROM fun WHERE i = 1)
SELECT doc_id, symbol, CAST(n AS INTEGER) AS line_no, txt AS line FROM lst JOIN sym USING (doc_id)
WHERE lower(callee) = lower(symbol) AND (k = 6 OR (w % 2 = 0 AND k IN (3, 4)) OR (w % 2 = 1 AND k = 5))"""
)
def call_context(spark, sf_dir):
    """Calls of each listing's first callee with their argument set-up."""
    return listings.call_contexts(views.listings(spark, sf_dir), "doc_id", "listing", "symbol")


def _with_wrapper(spark, sf_dir):
    rows = views.listings(spark, sf_dir)
    first = F.regexp_extract("listing", r"^\t\.globl\t(\S+)", 1)
    main = F.concat(F.lit("\n\t.globl\tmain\nmain:\n\tpushq\t%rax, %rdi\n\tcallq\t"), first, F.lit("\n\t.cfi_endproc"))
    return rows.withColumn("wrapper", F.concat("listing", main))


_FIRST = ", ft AS (SELECT doc_id, nm AS under_test FROM fun WHERE i = 1)"


@query(
    ctes("lst")
    + _FIRST
    + """
SELECT f.doc_id, any_value(under_test) AS under_test, count(DISTINCT callee) AS n_callees,
  count(DISTINCT nm) + 1 AS n_functions, count(DISTINCT callee) AS n_undefined, TRUE AS has_main
FROM fun f JOIN ft USING (doc_id) GROUP BY 1"""
)
def listing_report(spark, sf_dir):
    """Per record: callees, wrapper functions, undefined callees, the function under test."""
    report = listings.listing_report(_with_wrapper(spark, sf_dir), "doc_id", "listing", "wrapper")
    count = lambda c: F.size(c).cast("long")
    return report.select(
        "doc_id",
        "under_test",
        count("callees").alias("n_callees"),
        count("wrapper_functions").alias("n_functions"),
        count("undefined").alias("n_undefined"),
        "has_main",
    )


@query(
    ctes("lst")
    + _FIRST
    + """
SELECT doc_id, 'main' AS caller, under_test AS symbol, unnest([
  chr(9) || 'pushq' || chr(9) || '%rax, %rdi', chr(9) || 'callq' || chr(9) || under_test]) AS line FROM ft"""
)
def wrapper_callers(spark, sf_dir):
    """How each wrapper calls the function under test."""
    return listings.callers_of(_with_wrapper(spark, sf_dir), "doc_id", "listing", "wrapper")
