"""Graph jobs against brute force."""

import itertools
import json
import random
import time

from pyspark.sql import functions as F

from irquarry.functions.instructions import disassembly, normalize_instruction
from irquarry.operators import graphs

EDGES = "graph_id long, side string, src long, dst long"


def same_shape(a, b):
    """Try every mapping of the nodes."""
    na, nb = (sorted({n for e in g for n in e}) for g in (a, b))
    if len(na) != len(nb) or len(a) != len(b):
        return False
    return any(
        {(m[x], m[y]) for x, y in a} == b
        for p in itertools.permutations(nb)
        for m in [dict(zip(na, p))]
    )


def test_isomorphic(table):
    rng = random.Random(5)
    pairs = {}
    for g in range(120):
        n = rng.randint(1, 5)
        a = {(rng.randint(1, n), rng.randint(1, n)) for _ in range(rng.randint(1, 6))}
        if rng.random() < 0.5:
            names = list(range(1, n + 1))
            rng.shuffle(names)
            b = {(names[x - 1] + 10, names[y - 1] + 10) for x, y in a}
        else:
            b = {(rng.randint(1, n), rng.randint(1, n)) for _ in range(len(a))}
        pairs[g] = (a, b)
    # Two triangles against a hexagon: refinement alone cannot tell them apart.
    ring = lambda ns: {(x, y) for x, y in zip(ns, ns[1:] + ns[:1])}
    pairs[500] = (ring([1, 2, 3]) | ring([4, 5, 6]), ring([1, 2, 3, 4, 5, 6]))
    rows = [(g, s, x, y) for g, ab in pairs.items() for s, edges in zip(graphs.SIDES, ab) for x, y in edges]
    df = table(rows, EDGES)
    got = {r["graph_id"]: r["isomorphic"] for r in graphs.isomorphic(df).collect()}
    assert got == {g: same_shape(*ab) for g, ab in pairs.items()}
    wl = {r["graph_id"]: r["wl_equal"] for r in graphs.wl_equal(df).collect()}
    assert wl[500] and all(wl[g] for g, same in got.items() if same)


def test_symmetric_graphs_of_any_size(table):
    ring = lambda ns: {(x, y) for x, y in zip(ns, ns[1:] + ns[:1])}
    numbers = lambda a, b: list(range(a, b))
    fan = lambda start, n: {(start, start + i) for i in range(1, n)} | {(start + i, start + n) for i in range(1, n)}
    cube = {(x, x ^ (1 << b)) for x in range(16) for b in range(4)}
    renamed = {(3 * x % 16 + 100, 3 * y % 16 + 100) for x, y in cube}
    # 4-regular on 16 nodes as well, but a torus whose rows are shifted
    torus = {(4 * r + c, t) for r in range(4) for c in range(4) for t in (4 * r + (c + 1) % 4, 4 * r + (c + 3) % 4)}
    shifted = lambda r, c, up: 4 * ((r + up) % 4) + (c + (up if (r, up) in ((3, 1), (0, -1)) else 0)) % 4
    torus |= {(4 * r + c, shifted(r, c, up)) for r in range(4) for c in range(4) for up in (1, -1)}
    pairs = {
        0: (ring(numbers(0, 70)), ring(numbers(200, 270))),
        1: (ring(numbers(0, 12)) | ring(numbers(20, 32)), ring(numbers(0, 10)) | ring(numbers(20, 34))),
        2: (ring(numbers(0, 40)) | ring(numbers(50, 90)), ring(numbers(300, 340)) | ring(numbers(500, 540))),
        3: (fan(0, 300), fan(1000, 300)),
        4: (cube, renamed),
        5: (cube, torus),
    }
    rows = [(g, s, x, y) for g, ab in pairs.items() for s, edges in zip(graphs.SIDES, ab) for x, y in edges]
    start = time.monotonic()
    got = {r["graph_id"]: r["isomorphic"] for r in graphs.isomorphic(table(rows, EDGES)).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: True, 5: False}
    assert time.monotonic() - start < 120


def test_edgeless_graphs(table):
    edges = table([], EDGES)
    nodes = table([(0, "predict", 1), (0, "predict", 2), (0, "target", 7), (0, "target", 8), (1, "predict", 1)], "graph_id long, side string, node long")
    got = {r["graph_id"]: r["isomorphic"] for r in graphs.isomorphic(edges, nodes).collect()}
    assert got == {0: True, 1: False}


def test_sizes_and_diff(table):
    df = table([(0, "predict", 1, 2), (0, "predict", 1, 2), (0, "target", 1, 3), (0, "target", 1, 2)], EDGES)
    row = graphs.cfg_sizes(df).head().asDict()
    assert row == dict(
        graph_id=0, predict_nodes=2, target_nodes=3, missing_nodes=1, extra_nodes=0,
        predict_edges=1, target_edges=2, missing_edges=1, extra_edges=0,
    )
    diff = sorted((r["kind"], r["src"], r["dst"], r["status"]) for r in graphs.cfg_diff(df).collect())
    assert diff == [("edge", 1, 3, "missing"), ("node", 3, None, "missing")]


def _program(nodes, edges):
    return json.dumps(
        {
            "no_arch": {"0x1": {"nodes": [9], "edges": []}},
            "prog": {
                "arch": "x86-64",
                "0x0": {"elapsed_time": 1.0},
                "0x10": {"nodes": nodes, "edges": edges, "basic_blocks": {"16": {"bb_len": 3, "bb_mnems": ["mov"]}}},
            },
        }
    )


def test_parse_cfg(table):
    df = table([(0, _program([16, 20], [[16, 20], [16, 20]])), (1, "broken"), (2, '{"p": {"arch": "x"}}')], "idx long, j string")
    parsed = graphs.parse_cfg(df, "j")
    assert {r["idx"]: r["cfg"] is None for r in parsed.collect()} == {0: False, 1: True, 2: True}
    assert [tuple(r) for r in graphs.cfg_edges(parsed, ["idx"]).collect()] == [(0, 16, 20)]
    assert sorted(r["node"] for r in graphs.cfg_nodes(parsed, ["idx"]).collect()) == [16, 20]
    block = graphs.cfg_blocks(parsed, ["idx"]).head()
    assert (block["node"], block["bb_len"], block["bb_mnems"]) == (16, 3, ["mov"])


def test_first_executed_graphs(table):
    evaluations = table([(0, _program([1, 2], [[1, 2]]))], "idx long, predict string")
    targets = table([(0, _program([5, 6], [[5, 6]]))], "idx long, target string")
    edges = graphs.compare_first_executed(evaluations, targets, "predict", "target")
    assert graphs.isomorphic(edges).head()["isomorphic"] is True


def test_labels(table):
    df = table([(0, 40), (0, 8), (0, 40), (1, 70000), (1, 5)], "graph_id long, node long")
    got = {(r["graph_id"], r["node"]): r["label"] for r in graphs.block_labels(df).collect()}
    assert got == {(0, 8): "BB0", (0, 40): "BB1", (1, 5): "BB0", (1, 70000): "BB1"}


def test_block_features(spark):
    df = spark.sql(
        "select 0 as g, array(named_struct('mnemonic', 'MOV', 'operands', 'EAX, 0x1', 'address', 16L, 'bytes', X'B801'),"
        " named_struct('mnemonic', 'RET', 'operands', '', 'address', 18L, 'bytes', X'C3')) as instructions"
    )
    row = graphs.block_features(df, ["g"]).head()
    assert row["bb_len"] == 3 and row["b64_bytes"] == "uAHD" and row["bb_heads"] == [16, 18]
    assert row["bb_norm"] == ["mov_EAX,himm", "ret"] and row["bb_disasm"] == ["mov EAX, 0x1", "ret"]


def test_block_features_normalise_a_block_at_once(spark):
    """The rows of the expressions per instruction, whose patterns are looked for in a block's joined operands instead."""
    texts = ["EAX, 0x1F", "", None, "0x", "#-3, 0xffg", "a\x01b 0x1", "\x01", " , _", ",", "#", "é 0xé", "-3", "x\n#1"]
    literal = lambda t: "null" if t is None else "'" + t.replace("\x01", "\\u0001").replace("\n", "\\n") + "'"
    item = lambda i, t: (
        f"named_struct('mnemonic', {literal(['MOV', None, '', 'Ä'][i % 4])}, 'operands', {literal(t)}, 'address', {i}L, 'bytes', {['X\'B8FF\'', 'null', 'X\'\''][i % 3]})"
    )
    blocks = [texts, texts[:5], [*texts[:5], *texts[7:]], texts[5:6], texts[1:3], texts[2:7], []]
    arrays = ["array(" + ", ".join(item(i, t) for i, t in enumerate(b)) + ")" for b in blocks]
    arrays[-1] = f"slice({arrays[0]}, 1, 0)"
    arrays += [f"if(true, null, {arrays[0]})", f"array({item(0, 'q 0x2')}, null, {item(1, 'r')})"]
    df = spark.sql(" union all ".join(f"select {g} as g, {a} as instructions" for g, a in enumerate(arrays)))
    each = df.select(
        "g",
        F.transform("instructions", lambda i: normalize_instruction(i["mnemonic"], i["operands"])).alias("bb_norm"),
        F.transform("instructions", lambda i: disassembly(i["mnemonic"], i["operands"])).alias("bb_disasm"),
        F.unhex(F.array_join(F.transform("instructions", lambda i: F.hex(i["bytes"])), "")).alias("raw"),
    ).withColumns({"bb_len": F.octet_length("raw"), "b64_bytes": F.base64("raw")})
    names = ["g", "bb_norm", "bb_disasm", "bb_len", "b64_bytes"]
    got = graphs.block_features(df, ["g"])
    assert sorted(map(repr, got.select(*names).collect())) == sorted(map(repr, each.select(*names).collect()))


def test_settled_graphs_leave_the_rounds(spark, monkeypatch):
    """Sides that agree as they are, or differ in the arcs of their nodes, are not refined any further."""
    both = lambda g, predict, target: [(g, s, a, b) for s, es in (("predict", predict), ("target", target)) for a, b in es]
    path = [(1, 2), (2, 3), (3, 4)]
    rows = both(1, path, path) + both(2, path, [(1, 2), (1, 3), (1, 4)]) + both(3, path, [(5, 6), (6, 7), (7, 8)]) + both(4, path, [])
    edges = spark.createDataFrame(rows, "graph_id long, side string, src long, dst long")
    refined, refine = set(), graphs.refine_colours

    def seen(rest, *more, **named):
        refined.update(r["graph_id"] for r in rest.select("graph_id").distinct().collect())
        return refine(rest, *more, **named)

    monkeypatch.setattr(graphs, "refine_colours", seen)
    got = {r["graph_id"]: r["wl_equal"] for r in graphs.wl_equal(edges).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False} and refined == {3}
    assert {r["graph_id"]: r["isomorphic"] for r in graphs.isomorphic(edges).collect()} == got


def test_small_graphs_are_settled_in_their_rows(table, monkeypatch):
    """Graphs of few rows need no refinement rounds over edge tables, whatever their symmetry."""
    rng = random.Random(11)
    ring = lambda ns: {(x, y) for x, y in zip(ns, ns[1:] + ns[:1])}
    pairs = {0: (ring([1, 2, 3]) | ring([4, 5, 6]), ring([1, 2, 3, 4, 5, 6])), 1: (ring([1, 2]) | ring([3]), ring([1, 2, 3]))}
    pairs[2] = (ring([1, 2, 3]) | ring([4, 5, 6]), ring([11, 13, 15]) | ring([12, 14, 16]))
    pairs[3] = ({(1, 2), (3, 2), (4, 2)}, set())
    for g in range(10, 90):
        n = rng.randint(2, 6)
        a = {(x, rng.randint(1, n)) for x in range(1, n + 1)}
        names = rng.sample(range(1, 9), n)
        b = {(names[x - 1], names[y - 1]) for x, y in a} if g % 2 else {(x, rng.randint(1, n)) for x in range(1, n + 1)}
        pairs[g] = (a, b)
    # every edge twice
    rows = [(g, s, x, y) for g, ab in pairs.items() for s, edges in zip(graphs.SIDES, ab) for x, y in edges] * 2

    def refused(*_):
        raise AssertionError("a small graph went to the rounds")

    monkeypatch.setattr(graphs, "_refined", refused)
    got = {r["graph_id"]: r["isomorphic"] for r in graphs.isomorphic(table(rows, EDGES)).collect()}
    assert got == {g: same_shape(*ab) for g, ab in pairs.items()}


def test_small_and_large_graphs_have_one_result(table, monkeypatch):
    """In rows, as edge tables, or some of each: the same result, with nulls and nodes without edges as well."""
    rng = random.Random(3)
    rows, nodes = [], []
    for g in [*range(24), None]:
        for side in graphs.SIDES:
            ends = [(rng.randint(1, 4), rng.randint(1, 4)) for _ in range(rng.randint(1, 4))]
            rows += [(g, side, x, None if g and g % 8 == 7 else y) for x, y in ends]
            nodes += [(g, side, rng.randint(1, 6)) for _ in range(rng.randint(0, 2))]
    edges, nodes = table(rows, EDGES), table(nodes, "graph_id long, side string, node long")
    for isolated in (None, nodes):
        results = []
        for limit in (0, 5, 64):
            monkeypatch.setattr(graphs, "SMALL_GRAPH", limit)
            results.append(sorted(map(repr, graphs.isomorphic(edges, isolated).collect())))
        assert results[0] == results[1] == results[2] and len(results[0]) == 25
