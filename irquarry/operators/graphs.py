"""Control-flow graphs as edge tables.

All work is keyed by (graph, node) or finer and reduced with partial sums, so a graph or a node
that holds a large part of the edges is aggregated in the map tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from irquarry.functions.instructions import base64_text, normalized_at_once, normalized_each, with_operands
from irquarry.functions.text import let
from irquarry.operators.ranking import chunked_rank
from irquarry.schemas import CFG_FUNCTION
from irquarry.operators.outcomes import first_executed
from irquarry.session import new_work_path

SIDES = ("predict", "target")


def parse_cfg(df: DataFrame, json: str) -> DataFrame:
    """Parse a program-to-functions text and keep its first function graph.

    Programs without an architecture and functions without nodes are passed over; ``cfg`` is null
    when nothing is left.
    """
    programs = F.map_entries(F.from_json(F.col(json), "MAP<STRING, MAP<STRING, STRING>>"))
    known = F.filter(programs, lambda p: F.map_contains_key(p["value"], "arch"))
    functions = F.flatten(
        F.transform(
            known,
            lambda p: F.transform(
                F.filter(F.map_entries(p["value"]), lambda f: f["key"] != "arch"),
                lambda f: F.struct(
                    p["value"]["arch"].alias("arch"),
                    f["key"].alias("address"),
                    F.from_json(f["value"], CFG_FUNCTION).alias("body"),
                ),
            ),
        )
    )
    usable = F.filter(functions, lambda f: f["body"]["nodes"].isNotNull())
    return df.withColumn("cfg", F.get(usable, F.lit(0)))


def cfg_nodes(parsed: DataFrame, keys: list[str]) -> DataFrame:
    return parsed.select(*keys, F.explode(F.array_distinct("cfg.body.nodes")).alias("node"))


def cfg_edges(parsed: DataFrame, keys: list[str]) -> DataFrame:
    edges = parsed.select(*keys, F.explode(F.array_distinct("cfg.body.edges")).alias("_e"))
    return edges.select(*keys, F.col("_e")[0].alias("src"), F.col("_e")[1].alias("dst"))


def cfg_blocks(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Block feature rows of the parsed graphs."""
    blocks = parsed.select(*keys, F.explode("cfg.body.basic_blocks").alias("_node", "_b"))
    return blocks.select(*keys, F.col("_node").cast("long").alias("node"), "_b.*")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges with the sides they occur on; one partial aggregate instead of two distincts."""
    return edges.groupBy("graph_id", "src", "dst").agg(
        *[F.bool_or(F.col("side") == s).alias(f"in_{s}") for s in SIDES]
    )


def distinct_nodes(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes with their sides; end points of edges are nodes, ``nodes`` adds isolated ones."""
    ends = edges.select(
        "graph_id", "side", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node")
    )
    if nodes is not None:
        ends = ends.unionByName(nodes.select("graph_id", "side", "node"))
    return ends.groupBy("graph_id", "node").agg(
        *[F.bool_or(F.col("side") == s).alias(f"in_{s}") for s in SIDES]
    )


def _per_side(flagged: DataFrame, what: str) -> DataFrame:
    p, t = F.col("in_predict"), F.col("in_target")
    return flagged.groupBy("graph_id").agg(
        F.count_if(p).alias(f"predict_{what}"),
        F.count_if(t).alias(f"target_{what}"),
        F.count_if(t & ~p).alias(f"missing_{what}"),
        F.count_if(p & ~t).alias(f"extra_{what}"),
    )


def cfg_sizes(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes and edges of both graphs, and how many are missing or extra."""
    return (
        _per_side(distinct_nodes(edges, nodes), "nodes")
        .join(_per_side(distinct_edges(edges), "edges"), "graph_id", "left")
        .na.fill(0)
    )


def cfg_diff(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Missing and extra nodes and edges, one row each; ``dst`` is null for nodes."""
    status = F.when(F.col("in_target"), "missing").otherwise("extra")
    one_sided = F.col("in_target") != F.col("in_predict")
    node_rows = distinct_nodes(edges, nodes).select(
        "graph_id", F.lit("node").alias("kind"), F.col("node").alias("src"), F.lit(None).cast("long").alias("dst"), "in_predict", "in_target"
    )
    edge_rows = distinct_edges(edges).select(
        "graph_id", F.lit("edge").alias("kind"), "src", "dst", "in_predict", "in_target"
    )
    return (
        node_rows.unionByName(edge_rows)
        .where(one_sided)
        .select("graph_id", "kind", "src", "dst", status.alias("status"))
    )


def block_labels(nodes: DataFrame) -> DataFrame:
    """Labels BB0, BB1, ... by ascending address within a graph."""
    unique = nodes.select("graph_id", "node").distinct()
    ranked = chunked_rank(unique, "node", "_rank", by=["graph_id"])
    label = F.concat(F.lit("BB"), (F.col("_rank") - 1).cast("string"))
    return ranked.select("graph_id", "node", label.alias("label"))


def _digest(hashed: Column) -> list[Column]:
    """Order-free digest of a group of 64-bit hashes: the count and the sums of both halves.

    Half sums are plain longs that cannot overflow, and partial sums travel instead of lists.
    """
    return [
        F.count(hashed).alias("_n"),
        F.sum(hashed.bitwiseAND(F.lit(0xFFFFFFFF))).alias("_low"),
        F.sum(F.shiftright(hashed, 32)).alias("_high"),
    ]


def _coded(df: DataFrame) -> DataFrame:
    """The side as one byte, its place in ``SIDES``: narrow keys for the shuffles."""
    return df.withColumn("side", (F.col("side") == SIDES[1]).cast("byte"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back."""
    spark = df.sparkSession
    path = new_work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def refine_colours(
    edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 3, store_last: bool = True
) -> DataFrame:
    """Label-free colours of the nodes of both sides after some refinement rounds.

    ``edges`` are distinct and coded.  In a round every node hashes the multiset of the colours at
    the far ends of its arcs and its own colour: one join and one aggregate.  Rounds are written to
    the shared folder, so the plan does not grow and lost tasks re-read files.
    """
    key = ["graph_id", "side", "node"]
    out, back = (F.lit(way).cast("byte").alias("way") for way in (0, 1))
    src, dst = F.col("src"), F.col("dst")
    arc = lambda a, far, way: F.struct(a.alias("node"), far.alias("far"), way)
    arcs = edges.select("graph_id", "side", F.inline(F.array(arc(src, dst, out), arc(dst, src, back))))
    # Nodes without edges enter with a null hash, which counts for nothing.
    seen = arcs.select(*key, F.xxhash64("way").alias("_h"))
    if nodes is not None:
        seen = seen.unionByName(_coded(nodes).select(*key, F.lit(None).cast("long").alias("_h")))
    colours = None
    for number in range(1, rounds + 1):
        if colours is not None:
            far = colours.withColumnsRenamed({"node": "far", "colour": "far_colour"})
            seen = arcs.join(far, ["graph_id", "side", "far"]).select(
                *key, F.xxhash64("way", "far_colour").alias("_h")
            )
            own = colours.select(*key, F.xxhash64(F.lit(2).cast("byte"), "colour").alias("_h"))
            seen = seen.unionByName(own)
        refined = seen.groupBy(*key).agg(*_digest(F.col("_h")))
        colours = refined.select(*key, F.xxhash64("_n", "_low", "_high").alias("colour"))
        if store_last or number < rounds:
            colours = _stored(colours, "colours")
    return colours


def _stored_edges(edges: DataFrame) -> DataFrame:
    """Distinct coded edges, written once for all rounds and comparisons."""
    return _stored(_coded(edges.select("graph_id", "side", "src", "dst")).distinct(), "edges")


def wl_equal(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 3) -> DataFrame:
    """Per graph: the colour multisets of both sides agree.

    Agreement is necessary for isomorphism, not sufficient.
    """
    unique = _stored_edges(edges)
    graphs = _stored(_first_round(unique, nodes), "graphs")
    still_open = graphs.where("_alike and not _same").select("graph_id")
    unique = _stored(unique.join(still_open, "graph_id", "left_semi"), "edges")
    if nodes is not None:
        nodes = nodes.join(still_open, "graph_id", "left_semi")
    colours = refine_colours(unique, nodes, rounds, store_last=False)
    refined = _compare(colours, F.col("colour"), ["graph_id"]).select("graph_id", "wl_equal")
    # nodes of no graph (null) meet in no join: for them the first round is the last
    settled = F.when(F.col("graph_id").isNull(), F.col("_alike")).otherwise(F.col("_same"))
    return graphs.join(refined, "graph_id", "left").select("graph_id", F.coalesce("wl_equal", settled).alias("wl_equal"))


def _first_round(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Per graph whether both sides agree as they are (``_same``) and in the colours of the first round (``_alike``), without a join.

    Sides that differ in these colours differ in those of all later rounds.
    """
    key = ["graph_id", "side", "node"]
    arc = lambda a, far, way: F.struct(F.col(a).alias("node"), F.col(far).alias("far"), F.lit(way).cast("byte").alias("way"))
    arcs = edges.select("graph_id", "side", F.inline(F.array(arc("src", "dst", 0), arc("dst", "src", 1))))
    seen = arcs.select(*key, F.xxhash64("way").alias("_h"), F.xxhash64("way", "far").alias("_named"))
    if nodes is not None:
        none = [F.lit(None).cast("long").alias(c) for c in ("_h", "_named")]
        seen = seen.unionByName(_coded(nodes).select(*key, *none))
    of_node = seen.groupBy(*key).agg(
        F.xxhash64(*_digest(F.col("_h"))).alias("colour"), F.xxhash64(*_digest(F.col("_named"))).alias("_named")
    )

    def agree(value: Column) -> Column:
        sides = [F.struct(*_digest(F.when(F.col("side") == code, value))) for code in range(len(SIDES))]
        return sides[0] == sides[1]

    same = agree(F.xxhash64("node", "_named"))
    return of_node.groupBy("graph_id").agg(agree(F.col("colour")).alias("_alike"), same.alias("_same"))


def _compare(coloured: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """Per ``by``: whether both sides have equal value multisets, the largest multiplicity of a value, values and rows of a side."""
    classes = coloured.groupBy(*by, "side", value.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    low, high = F.col("_v").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("_v", 32)
    per_side = classes.groupBy(*by, "side").agg(
        F.sum("_c").alias("_n"),
        F.sum(F.col("_c") * low).alias("_low"),
        F.sum(F.col("_c") * high).alias("_high"),
        F.max("_c").alias("_most"),
        F.count(F.lit(1)).alias("_v"),
    )
    digest = F.struct("_n", "_low", "_high", "_v")
    pair = per_side.groupBy(*by).agg(
        *[F.max(F.when(F.col("side") == code, digest)).alias(side) for code, side in enumerate(SIDES)],
        F.max("_most").alias("_most"),
        F.max("_v").alias("_classes"),
        F.max("_n").alias("_nodes"),
    )
    same = F.coalesce(F.col("predict") == F.col("target"), F.lit(False))
    return pair.select(*by, same.alias("wl_equal"), "_most", "_classes", "_nodes")


#: Rows (edges and isolated nodes of both sides) of a graph that is compared within a row, at most.
SMALL_GRAPH = 64
#: Rounds of refinement between two stored tables, and rows of coloured nodes that one graph's branches may take at once.
ROUNDS_A_STEP = 4
BRANCH_ROWS = 1 << 16

_BRANCH = ["graph_id", "branch"]


def isomorphic(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Exact label-free equality of both sides of every graph.

    Graphs of at most SMALL_GRAPH rows become one row each after a single shuffle, and almost all of them are settled there (``_settled``).
    Larger ones, those with nulls, and what that leaves open go to ``_searched``, as edge tables.
    """
    edges = _stored(edges.select("graph_id", "side", "src", "dst"), "edges")
    isolated = nodes if nodes is None else _stored(nodes.select("graph_id", "side", "node"), "nodes")
    parts = [_coded(df) for df in (edges, isolated) if df is not None]
    odd = lambda df: reduce(Column.__or__, [F.col(c).isNull() for c in df.columns])
    counted = reduce(DataFrame.unionByName, [df.select("graph_id", odd(df).alias("_odd")) for df in parts])
    sizes = counted.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n"), F.max("_odd").alias("_odd"))
    large = _stored(sizes.where((F.col("_n") > SMALL_GRAPH) | F.col("_odd")).select("graph_id"), "large")
    if not large.isEmpty():
        parts = [_of_graphs(df, large, "left_anti") for df in parts]
    settled = _stored(_small_equal(*parts), "graphs")
    rest = _stored(large.unionByName(settled.where("isomorphic is null").select("graph_id")), "open")
    if rest.isEmpty():
        return settled
    edges = _of_graphs(edges, rest, "left_semi")
    isolated = isolated if isolated is None else _of_graphs(isolated, rest, "left_semi")
    return settled.where("isomorphic is not null").unionByName(_searched(edges, isolated))


def _of_graphs(df: DataFrame, graphs: DataFrame, how: str) -> DataFrame:
    """Rows of these graphs, or of all others; null is a graph, too."""
    asked = graphs.select(F.col("graph_id").alias("_graph"))
    return df.join(asked, F.col("graph_id").eqNullSafe(F.col("_graph")), how)


def _small_equal(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``isomorphic`` of graphs without nulls that have few coded rows, null where it stays open."""
    none = lambda df, *names: [F.lit(None).cast(dict(df.dtypes)[n]).alias(n) for n in names]
    rows = edges.select("graph_id", "side", "src", "dst", *([F.lit(None).cast("long").alias("node")] if nodes is None else none(nodes, "node")))
    if nodes is not None:
        rows = rows.unionByName(nodes.select("graph_id", "side", *none(edges, "src", "dst"), "node"))
    sets = {}
    for code in range(len(SIDES)):
        mine = F.col("side") == code
        sets[f"edges{code}"] = F.collect_set(F.when(mine & F.col("src").isNotNull(), F.struct("src", "dst")))
        if nodes is not None:
            sets[f"nodes{code}"] = F.collect_set(F.when(mine, F.col("node")))
    found = rows.groupBy("graph_id").agg(*[held.alias(name) for name, held in sets.items()])
    fields = []
    for code in range(len(SIDES)):
        held = F.sort_array(f"edges{code}")
        ends = [F.col(f"edges{code}.src"), F.col(f"edges{code}.dst"), *([F.col(f"nodes{code}")] if nodes is not None else [])]
        fields += [held.alias(f"edges{code}"), F.sort_array(F.array_distinct(F.concat(*ends))).alias(f"nodes{code}")]
    return found.select("graph_id", let(F.struct(*fields), _settled).alias("isomorphic"))


def _settled(graph: Column) -> Column:
    """Whether two small graphs (sorted edges and nodes of each side) are equal, null if that stays open.

    Sides that agree as they are, or differ in size, need no more.  For others the nodes of both sides, numbered in one sequence, are
    coloured anew round by round from their own colour and the multisets of those at the far ends of their arcs.  Sides that disagree
    differ; where every colour is unique the edges decide; where no class has split, a node of the smallest class is singled out on
    both sides, at first with each node of the class on the other side in turn, later with the first one only: so a graph that differs in
    every turn is open if a turn singled out twice.
    """
    n = F.size(graph["nodes0"])
    fits = (n == F.size(graph["nodes1"])) & (F.size(graph["edges0"]) == F.size(graph["edges1"]))
    same = (graph["edges0"] == graph["edges1"]) & (graph["nodes0"] == graph["nodes1"])

    def place(code: int, node: Column) -> Column:
        return (F.array_position(graph[f"nodes{code}"], node) - 1).cast("int") + (n if code else F.lit(0))

    def placed(code: int) -> Column:
        return F.transform(
            graph[f"edges{code}"], lambda e: F.struct(place(code, e["src"]).alias("src"), place(code, e["dst"]).alias("dst"))
        )

    def far(code: int, arcs: Column, here: str, there: str, at: Column) -> Column:
        return F.transform(F.filter(arcs[f"arcs{code}"], lambda e: e[here] == at), lambda e: e[there])

    def neighbours(code: int, arcs: Column) -> Column:
        both = lambda at: F.struct(far(code, arcs, "src", "dst", at).alias("out"), far(code, arcs, "dst", "src", at).alias("back"))
        return F.transform(F.sequence(n * code, n * (code + 1) - 1), both)

    def ends(arcs: Column) -> Column:
        return F.concat(*[neighbours(code, arcs) for code in range(len(SIDES))])

    def searched(arcs: Column, ends: Column) -> Column:
        no, none = F.lit(False), F.lit(0)
        # loops and arcs that go both ways tell nodes apart that refinement alone does not
        own = lambda end, at: F.size(F.array_intersect(end["out"], end["back"])) * 2 + F.array_contains(end["out"], at).cast("int")
        fields = [F.lit(1).alias("classes"), none.alias("guesses"), none.alias("choices"), no.alias("over"), no.alias("equal")]
        start = F.struct(F.transform(ends, lambda end, at: own(end, at).cast("long")).alias("colours"), *fields)

        def tried(trial: Column) -> Column:
            # a step ends the search or makes a class more
            steps = F.sequence(F.lit(1), n + 1)
            return F.aggregate(steps, start, lambda state, _: F.when(state["over"], state).otherwise(step(arcs, ends, state, trial)))

        def after(trial: Column, found: Column) -> Column:
            sure = found["over"] & (found["equal"] | (found["guesses"] < 2))
            over = found["equal"] | ~sure | (trial >= found["choices"])
            return F.struct(over.alias("over"), sure.alias("sure"), found["equal"].alias("equal"))

        begin = F.struct(*[no.alias(c) for c in ("over", "sure", "equal")])
        last = F.aggregate(
            F.sequence(F.lit(1), n),
            begin,
            lambda state, trial: F.when(state["over"], state).otherwise(let(tried(trial), lambda found: after(trial, found))),
        )
        return let(last, lambda state: F.when(state["over"] & state["sure"], state["equal"]))

    def step(arcs: Column, ends: Column, state: Column, trial: Column) -> Column:
        before = state["colours"]
        colours_at = lambda places: F.sort_array(F.transform(places, lambda at: F.get(before, at)))
        # the number between the two lists keeps them apart
        refined = F.transform(
            ends, lambda end, at: F.xxhash64(F.get(before, at), colours_at(end["out"]), F.lit(0), colours_at(end["back"]))
        )
        return let(refined, lambda colours: let(F.sort_array(F.slice(colours, 1, n)), lambda first: judged(arcs, state, colours, first, trial)))

    def judged(arcs: Column, state: Column, colours: Column, first: Column, trial: Column) -> Column:
        def end(equal: Column) -> Column:
            return going(colours, state["classes"], state["guesses"], state["choices"], F.lit(True), equal)

        def going(colours: Column, classes: Column, guesses: Column, choices: Column, over: Column = F.lit(False), equal: Column = F.lit(False)) -> Column:
            named = dict(colours=colours, classes=classes, guesses=guesses, choices=choices, over=over, equal=equal)
            return F.struct(*[value.alias(name) for name, value in named.items()])

        def mapped(code: int) -> Column:
            pairs = lambda e: F.struct(F.get(colours, e["src"]).alias("src"), F.get(colours, e["dst"]).alias("dst"))
            return F.sort_array(F.transform(arcs[f"arcs{code}"], pairs))

        def guessed(cell: Column, classes: Column) -> Column:
            here = F.array_position(first_side, cell["c"]).cast("int") - 1
            members = F.filter(F.sequence(n, 2 * n - 1), lambda at: F.get(colours, at) == cell["c"])
            there = F.get(members, F.when(state["guesses"] == 0, trial - 1).otherwise(0))
            single = lambda chosen: F.transform(
                colours, lambda colour, at: F.when(F.array_contains(chosen, at), F.xxhash64(colour, F.lit(-1))).otherwise(colour)
            )
            choices = F.when(state["guesses"] == 0, cell["n"]).otherwise(state["choices"])
            return going(let(F.array(here, there), single), classes + 1, state["guesses"] + 1, choices)

        first_side = F.slice(colours, 1, n)
        size_of = lambda colour: F.size(F.filter(first, lambda other: other == colour))
        cells = lambda seen: F.transform(seen, lambda colour: F.struct(size_of(colour).alias("n"), colour.alias("c")))
        smallest = lambda seen: F.array_min(F.filter(cells(seen), lambda cell: cell["n"] > 1))

        def goes_on(seen: Column) -> Column:
            k = F.size(seen)
            return (
                F.when(k == n, end(mapped(0) == mapped(1)))
                .when(k > state["classes"], going(colours, k, state["guesses"], state["choices"]))
                .otherwise(let(smallest(seen), lambda cell: guessed(cell, k)))
            )

        agree = first == F.sort_array(F.slice(colours, n + 1, n))
        return F.when(agree, let(F.array_distinct(first), goes_on)).otherwise(end(F.lit(False)))

    arcs = F.struct(*[placed(code).alias(f"arcs{code}") for code in range(len(SIDES))])
    tried = let(arcs, lambda arcs: let(ends(arcs), lambda found: searched(arcs, found)))
    return F.when(~fits, F.lit(False)).when(same, F.lit(True)).otherwise(tried)


def _searched(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The same for graphs of any size, as edge tables.

    Sides that agree without renaming are equal.  For others colours are refined until no class splits; graphs whose sides disagree differ.  Where every colour is unique on a side,
    colours are a mapping of the nodes and the edges decide.  Other graphs branch: a node is singled out on one side
    and, in a branch each, the nodes of its class on the other; branches are refined alike, all as rows of the same joins,
    and those whose sides disagree end.  Before that, the whole class is paired by node number, which settles
    interchangeable nodes and repeated pieces in one step.  A graph is equal if any branch maps its edges.
    """
    unique = _stored_edges(edges)
    src, dst = F.col("src"), F.col("dst")
    ends = F.array(*[F.struct(a.alias("node"), far.alias("far"), F.lit(way).cast("byte").alias("way")) for way, a, far in ((0, src, dst), (1, dst, src))])
    arcs = _stored(unique.select("graph_id", "side", F.inline(ends)), "arcs")
    known = arcs.select("graph_id", "side", "node")
    if nodes is not None:
        known = known.unionByName(_coded(nodes).select("graph_id", "side", "node"))
    known = _stored(known.distinct(), "nodes")
    # sides that agree as they are need no mapping, sides of different sizes have none
    sides = known.groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("_in"), F.sum(F.when(F.col("side") == 0, 1).otherwise(-1)).alias("_more"))
    nodes_alike = sides.groupBy("graph_id").agg((F.min("_in") == 2).alias("_same"), (F.sum("_more") == 0).alias("_fits"))
    pairs = unique.groupBy("graph_id", "src", "dst").agg(F.count(F.lit(1)).alias("_in"), F.sum(F.when(F.col("side") == 0, 1).otherwise(-1)).alias("_more"))
    edges_alike = pairs.groupBy("graph_id").agg((F.min("_in") == 2).alias("_same_edges"), (F.sum("_more") == 0).alias("_fit_edges"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(True))
    graphs = nodes_alike.join(edges_alike, "graph_id", "left").select(
        "graph_id", (F.col("_same") & yes("_same_edges")).alias("_same"), (F.col("_fits") & yes("_fit_edges")).alias("_fits")
    )
    graphs = _stored(graphs, "graphs")
    # nor have sides whose nodes differ in their numbers of arcs; the rounds read the arcs of the graphs that are left
    alike = _first_round(unique, nodes).where("_alike").select("graph_id")
    still_open = _stored(graphs.where("_fits and not _same").select("graph_id").join(alike, "graph_id", "left_semi"), "open")
    unique, arcs = (_stored(df.join(still_open, "graph_id", "left_semi"), name) for df, name in ((unique, "edges"), (arcs, "arcs")))
    start = known.join(still_open, "graph_id", "left_semi")
    start = start.withColumns({"branch": F.lit(0).cast("long"), "colour": F.lit(0).cast("long")})
    start = _stored(start.select("graph_id", "branch", "side", "node", "colour"), "colours")
    equal = _search(unique, arcs, *_refined(arcs, start)).withColumn("isomorphic", F.lit(True))
    graphs = graphs.join(equal, "graph_id", "left").withColumn("isomorphic", F.coalesce("isomorphic", "_same"))
    return graphs.select("graph_id", F.coalesce("isomorphic", F.lit(False)).alias("isomorphic"))


def _round(arcs: DataFrame, colours: DataFrame) -> DataFrame:
    """Every node's colour from its own and the multiset of those at the far ends of its arcs, in every branch."""
    key = [*_BRANCH, "side", "node"]
    far = colours.withColumnsRenamed({"node": "far", "colour": "far_colour"})
    seen = arcs.join(far, ["graph_id", "side", "far"]).select(*key, F.xxhash64("way", "far_colour").alias("_h"))
    own = colours.select(*key, F.xxhash64(F.lit(2).cast("byte"), "colour").alias("_h"))
    refined = seen.unionByName(own).groupBy(*key).agg(*_digest(F.col("_h")))
    return refined.select(*key, F.xxhash64("_n", "_low", "_high").alias("colour"))


def _refined(arcs: DataFrame, colours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stable colours of the branches whose sides agree, and their largest class (``_most``) and nodes a side (``_nodes``).

    A branch leaves the rounds when its sides disagree or no class has split.
    """
    done: list[tuple[DataFrame, DataFrame]] = []
    last = None
    while True:
        for _ in range(ROUNDS_A_STEP):
            colours = _round(arcs, colours)
        colours = _stored(colours, "colours")
        state = _stored(_compare(colours, F.col("colour"), _BRANCH).where("wl_equal"), "branches")
        moving = state.where("_most > 1")
        if last is not None:
            before = last.select(*_BRANCH, F.col("_classes").alias("_before"))
            moving = moving.join(before, _BRANCH).where("_classes > _before").drop("_before")
        moving = _stored(moving, "moving")
        resting = state.join(moving, _BRANCH, "left_anti")
        done.append((colours.join(resting, _BRANCH, "left_semi"), resting.select(*_BRANCH, "_most", "_nodes")))
        if moving.isEmpty():
            break
        colours, last = colours.join(moving, _BRANCH, "left_semi"), moving
    parts = [list(side) for side in zip(*done)]
    for side in parts:
        while len(side) > 1:
            side.append(side.pop(0).unionByName(side.pop(0)))
    return _stored(parts[0][0], "colours"), _stored(parts[1][0], "branches")


def _mapped(edges: DataFrame, colours: DataFrame, branches: DataFrame) -> DataFrame:
    """graph_id of the graphs with a branch of unique colours that maps the edges of one side onto those of the other."""
    leaves = branches.where("_most = 1").select(*_BRANCH)
    mine = colours.join(leaves, _BRANCH, "left_semi")
    ends = [
        mine.select(*_BRANCH, "side", F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))
        for end in ("src", "dst")
    ]
    coloured = edges.join(ends[0], ["graph_id", "side", "src"]).join(ends[1], [*_BRANCH, "side", "dst"])
    both = coloured.groupBy(*_BRANCH, "src_colour", "dst_colour").agg(F.countDistinct("side").alias("_sides"))
    wrong = both.where("_sides = 1").select(*_BRANCH)
    return leaves.join(wrong, _BRANCH, "left_anti").select("graph_id").distinct()


def _search(edges: DataFrame, arcs: DataFrame, colours: DataFrame, branches: DataFrame) -> DataFrame:
    """graph_id of the graphs that one of these branches, or one below them, shows to be equal."""
    found = _stored(_mapped(edges, colours, branches), "equal")
    waiting = branches.where("_most > 1")
    nth = Window.partitionBy("graph_id").orderBy("branch")
    waiting = _stored(waiting.withColumn("_nth", F.row_number().over(nth)), "branches")
    first, width = 1, 1
    while True:
        waiting = waiting.where(F.col("_nth") >= first).join(found, "graph_id", "left_anti")
        if waiting.isEmpty():
            return found
        # equal branches are many in symmetric graphs: few are tried first, then more
        now = waiting.where(F.col("_nth") < first + width)
        mine = _stored(colours.join(now, _BRANCH, "left_semi"), "colours")
        found = _tried(edges, arcs, mine, now, found)
        first, width = first + width, 4 * width


def _tried(edges: DataFrame, arcs: DataFrame, colours: DataFrame, branches: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` and the graphs that are equal below these branches: the smallest shared class is paired, then singled out."""
    key = [*_BRANCH, "side", "node"]
    classes = colours.where("side = 0").groupBy(*_BRANCH, "colour").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    cell = classes.groupBy(*_BRANCH).agg(F.min(F.struct("_n", "colour")).alias("_cell"))
    cell = cell.select(*_BRANCH, "_cell.*")
    members = colours.join(cell, [*_BRANCH, "colour"]).select(*key, "_n")
    members = _stored(chunked_rank(members, "node", "_rank", by=[*_BRANCH, "side"]), "members")
    marked = colours.join(members.select(*key, "_rank"), key, "left")

    paired = F.when(F.col("_rank").isNull(), F.col("colour")).otherwise(F.xxhash64("colour", "_rank"))
    below = _search(edges, arcs, *_refined(arcs, marked.select(*key, paired.alias("colour"))))
    found = _stored(found.unionByName(below).distinct(), "equal")

    at_once = F.greatest(F.lit(1), F.floor(F.lit(BRANCH_ROWS) / F.col("_nodes")))
    trials = members.where("side = 1").join(branches.select(*_BRANCH, "_nodes"), _BRANCH)
    trials = trials.select(*_BRANCH, F.col("_rank").alias("_trial"), F.ceil(F.col("_rank") / at_once).alias("_turn"))
    trials = _stored(trials, "trials")
    turn = 1
    while True:
        now = trials.where(F.col("_turn") == turn).join(found, "graph_id", "left_anti")
        if now.isEmpty():
            return found
        single = (F.col("_rank") == F.when(F.col("side") == 0, F.lit(1)).otherwise(F.col("_trial")))
        colour = F.when(F.coalesce(single, F.lit(False)), F.xxhash64("colour", F.lit(-1))).otherwise(F.col("colour"))
        child = marked.join(now, _BRANCH).select(
            "graph_id", F.xxhash64("branch", "_trial").alias("branch"), "side", "node", colour.alias("colour")
        )
        below = _search(edges, arcs, *_refined(arcs, child))
        found = _stored(found.unionByName(below).distinct(), "equal")
        turn += 1


def block_features(blocks: DataFrame, keys: list[str], instructions: str = "instructions") -> DataFrame:
    """Feature row per block from its instruction list (mnemonic, operands, address, bytes)."""

    def field(name: str) -> Column:
        return F.col(instructions)[name]

    # strings hold any bytes: joined as they are
    raw = F.array_join(field("bytes").cast("array<string>"), "").cast("binary")
    parts = blocks.select(
        *keys,
        raw.alias("_raw"),
        F.transform(field("mnemonic"), F.lower).alias("bb_mnems"),
        field("operands").alias("_operands"),
        normalized_at_once(field("operands")).alias("_normalized"),
        field("address").alias("bb_heads"),
    )
    return parts.select(
        *keys,
        F.octet_length("_raw").alias("bb_len"),
        "bb_mnems",
        with_operands(F.col("bb_mnems"), normalized_each(F.col("_operands"), F.col("_normalized")), "_").alias("bb_norm"),
        with_operands(F.col("bb_mnems"), F.col("_operands"), " ").alias("bb_disasm"),
        base64_text(F.col("_raw")).alias("b64_bytes"),
        "bb_heads",
    )


def compare_first_executed(evaluations: DataFrame, targets: DataFrame, cfg_json: str, target_json: str) -> DataFrame:
    """Both parsed graphs of each record's first executed candidate, as an edge table with sides.

    Evaluations without rounds and choices hold one candidate per record already.
    """
    if {"retry", "choice", "execution_success"} <= set(evaluations.columns):
        evaluations = first_executed(evaluations)
    predicted = parse_cfg(evaluations, cfg_json)
    truth = parse_cfg(targets, target_json)
    rows = [
        cfg_edges(df, ["idx"]).withColumn("side", F.lit(side)).withColumnRenamed("idx", "graph_id")
        for side, df in (("predict", predicted), ("target", truth))
    ]
    return rows[0].unionByName(rows[1])
