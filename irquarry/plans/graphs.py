"""Control-flow graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from irquarry.functions.text import newline_split
from irquarry.operators import graphs
from irquarry.plans import views
from irquarry.plans.registry import query
from irquarry.plans.views import ctes

_FLAGS = (
    ctes("edge")
    + """
, ef AS (SELECT graph_id, src, dst, bool_or(side = 'predict') AS p, bool_or(side = 'target') AS t FROM edge GROUP BY 1, 2, 3),
nf AS (SELECT graph_id, node, bool_or(side = 'predict') AS p, bool_or(side = 'target') AS t FROM node GROUP BY 1, 2)"""
)


@query(
    _FLAGS
    + """
, a AS (SELECT graph_id, count(*) FILTER (p) AS predict_nodes, count(*) FILTER (t) AS target_nodes,
  count(*) FILTER (t AND NOT p) AS missing_nodes, count(*) FILTER (p AND NOT t) AS extra_nodes FROM nf GROUP BY 1),
b AS (SELECT graph_id, count(*) FILTER (p) AS predict_edges, count(*) FILTER (t) AS target_edges,
  count(*) FILTER (t AND NOT p) AS missing_edges, count(*) FILTER (p AND NOT t) AS extra_edges FROM ef GROUP BY 1)
SELECT * FROM a JOIN b USING (graph_id)"""
)
def cfg_sizes(spark, sf_dir):
    return graphs.cfg_sizes(views.cfg_edges(spark, sf_dir))


@query(
    _FLAGS
    + """
SELECT graph_id, 'node' AS kind, node AS src, NULL AS dst, CASE WHEN t THEN 'missing' ELSE 'extra' END AS status FROM nf WHERE p <> t
UNION ALL
SELECT graph_id, 'edge', src, dst, CASE WHEN t THEN 'missing' ELSE 'extra' END FROM ef WHERE p <> t"""
)
def cfg_diff(spark, sf_dir):
    return graphs.cfg_diff(views.cfg_edges(spark, sf_dir))


@query(
    ctes("edge")
    + """
SELECT graph_id, node, 'BB' || (row_number() OVER (PARTITION BY graph_id ORDER BY node) - 1) AS label
FROM (SELECT DISTINCT graph_id, node FROM node)"""
)
def cfg_labels(spark, sf_dir):
    edges = views.cfg_edges(spark, sf_dir)
    nodes = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node"))
    return graphs.block_labels(nodes)


_ROUNDS = "".join(
    f"""
, c{r} AS (SELECT c.graph_id, c.side, c.node, md5(c.colour || '|' ||
    coalesce((SELECT string_agg(f.colour, ',' ORDER BY f.colour) FROM edge e JOIN c{r - 1} f
      ON f.graph_id = e.graph_id AND f.side = e.side AND f.node = e.dst
      WHERE e.graph_id = c.graph_id AND e.side = c.side AND e.src = c.node), '') || '|' ||
    coalesce((SELECT string_agg(f.colour, ',' ORDER BY f.colour) FROM edge e JOIN c{r - 1} f
      ON f.graph_id = e.graph_id AND f.side = e.side AND f.node = e.src
      WHERE e.graph_id = c.graph_id AND e.side = c.side AND e.dst = c.node), '')) AS colour FROM c{r - 1} c)"""
    for r in (1, 2, 3)
)


@query(
    ctes("edge")
    + ", c0 AS (SELECT graph_id, side, node, '0' AS colour FROM node)"
    + _ROUNDS
    + """
, g AS (SELECT graph_id, side, string_agg(colour, ',' ORDER BY colour) AS s FROM c3 GROUP BY 1, 2)
SELECT p.graph_id, p.s = t.s AS wl_equal FROM g p JOIN g t ON t.graph_id = p.graph_id AND t.side = 'target' WHERE p.side = 'predict'"""
)
def wl_equal(spark, sf_dir):
    """Label-free comparison of both sides after three refinement rounds."""
    return graphs.wl_equal(views.cfg_edges(spark, sf_dir), rounds=3)


@query(
    ctes("edge").replace("WITH", "WITH RECURSIVE", 1)
    + """
, n AS (SELECT graph_id, side, node, row_number() OVER (PARTITION BY graph_id, side ORDER BY node) AS i FROM node),
e AS (SELECT e.graph_id, e.side, list_sort(list(a.i * 8 + b.i)) AS es, list_sort(list(a.i)) AS o, list_sort(list(b.i)) AS t FROM edge e
  JOIN n a ON a.graph_id = e.graph_id AND a.side = e.side AND a.node = e.src
  JOIN n b ON b.graph_id = e.graph_id AND b.side = e.side AND b.node = e.dst GROUP BY 1, 2),
g AS (SELECT graph_id, side, es, list_max(o || t) AS size,
  list_sort(list_transform(range(1, list_max(o || t) + 1), lambda i: len(list_filter(o, lambda x: x = i)) * 8 + len(list_filter(t, lambda x: x = i)))) AS degrees
  FROM e),
pair AS (SELECT p.graph_id, p.size, p.es AS pe, t.es AS te, p.degrees = t.degrees AS alike FROM g p JOIN g t
  ON t.graph_id = p.graph_id AND t.side = 'target' WHERE p.side = 'predict'),
renaming AS (
  SELECT CAST([] AS BIGINT[]) AS names
  UNION ALL
  SELECT list_append(names, x) FROM renaming, (SELECT unnest(range(1, 8)) AS x) WHERE len(names) < 7 AND NOT list_contains(names, x)),
shown AS (SELECT DISTINCT graph_id FROM pair JOIN renaming ON len(names) = size AND list_max(names) = size
  WHERE alike AND list_sort(list_transform(pe, lambda x: names[x // 8] * 8 + names[x % 8])) = te)
SELECT graph_id, graph_id IN (SELECT graph_id FROM shown) AS isomorphic FROM pair"""
)
def isomorphic_graphs(spark, sf_dir):
    """Exact label-free equality of both sides; the SQL tries every renaming of the nodes."""
    return graphs.isomorphic(views.cfg_edges(spark, sf_dir))


def cfg_json(spark, sf_dir):
    doc = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = newline_split(F.col("text"))
    n = F.size(lines)
    nodes = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("string")), ",")
    edges = F.array_join(
        F.transform(
            lines,
            lambda line, i: F.concat(
                F.lit("["), i.cast("string"), F.lit(","), (F.size(F.split(line, " ", -1)) % n).cast("string"), F.lit("]")
            ),
        ),
        ",",
    )
    json = F.concat(
        F.lit('{"skipped": {"x": "1"}, "prog": {"arch": "x86-64", "meta": {"elapsed_time": 1.0}, "0x'),
        F.hex("doc_id"),
        F.lit('": {"elapsed_time": 0.5, "nodes": ['),
        nodes,
        F.lit('], "edges": ['),
        edges,
        F.lit("]}}}"),
    )
    return doc.select("doc_id", json.alias("json"))


@query(
    """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS src, len(string_split(unnest(ls), ' ')) % len(ls) AS dst FROM l)
SELECT doc_id, 'x86-64' AS arch, '0x' || hex(doc_id) AS address, src, dst FROM e"""
)
def cfg_from_json(spark, sf_dir):
    """Graphs parsed from program texts, as edges with their function's address."""
    parsed = graphs.parse_cfg(cfg_json(spark, sf_dir), "json")
    named = parsed.withColumns({"arch": F.col("cfg.arch"), "address": F.col("cfg.address")})
    return graphs.cfg_edges(named, ["doc_id", "arch", "address"])


@query(
    """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
b AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS node, unnest(ls) AS line FROM l),
w AS (SELECT *, list_transform(string_split(line, ' '), lambda x: lower(x)) AS ws FROM b)
SELECT doc_id, node, strlen(replace(line, ' ', '')) AS bb_len, array_to_string(ws, ' ') AS bb_mnems,
  array_to_string(list_transform(ws, lambda x, i: CASE WHEN i % 2 = 1 THEN x || '_[eax+himm],himm' ELSE x END), ' ') AS bb_norm,
  array_to_string(list_transform(ws, lambda x, i: CASE WHEN i % 2 = 1 THEN x || ' [eax+0x1F], #-3' ELSE x END), ';') AS bb_disasm,
  base64(encode(replace(line, ' ', ''))) AS b64_bytes, len(ws) - 1 AS last_head FROM w"""
)
def block_features(spark, sf_dir):
    """Feature rows of blocks made of text lines, an instruction per word."""
    doc = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    # a document is many blocks: they are dealt over the tasks before the work on each
    blocks = doc.select("doc_id", F.posexplode(newline_split(F.col("text"))).alias("node", "line")).repartition("doc_id", "node")
    instructions = F.transform(
        F.split("line", " ", -1),
        lambda w, i: F.struct(
            w.alias("mnemonic"),
            F.when(i % 2 == 0, F.lit("[eax+0x1F], #-3")).otherwise(F.lit("")).alias("operands"),
            i.cast("long").alias("address"),
            w.cast("binary").alias("bytes"),
        ),
    )
    rows = graphs.block_features(blocks.withColumn("instructions", instructions), ["doc_id", "node"])
    return rows.select(
        "doc_id",
        F.col("node").cast("long").alias("node"),
        F.col("bb_len").cast("long").alias("bb_len"),
        F.array_join("bb_mnems", " ").alias("bb_mnems"),
        F.array_join("bb_norm", " ").alias("bb_norm"),
        F.array_join("bb_disasm", ";").alias("bb_disasm"),
        "b64_bytes",
        F.element_at("bb_heads", -1).alias("last_head"),
    )
