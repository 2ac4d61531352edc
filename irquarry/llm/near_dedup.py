"""SimHash fingerprints linked within a Hamming radius, found with vantage-point trees.

A fingerprint has a bit set if over half of the text's shingle hashes have it.  Two fingerprints within
``radius`` differ by at most ``radius // BLOCKS`` bits in one of BLOCKS blocks of bits, so each block is
a metric space of its own with a small radius, and pairs are verified over all bits.

Per block a vantage-point tree halves the fingerprints by their distance to a vantage point.  Its upper
nodes come from a bounded sample, deeper ones from a rule, and its depth grows with the number of
fingerprints.  A fingerprint lives in one shard (leaf) and is sent as a query to each shard
whose ball its own ball meets: by the triangle inequality no other shard holds a partner.  Inside a shard the
same halving goes on over arrays until few pairs are left to compare.  A shard that is too large is dealt
out as a grid of parts, so no task holds more than a bounded number of rows.

``keep_one`` links texts by the exact Jaccard similarity of their shingle sets instead: texts that are similar lie up to 13
bits apart, farther than a tree can prune, so min-hash bands give its candidates besides the links of the fingerprints.

Shards give spanning edges instead of pairs; contraction rounds, each stored, join them into components.
Only distinct fingerprints take part: exact copies, however many, are one row.

Null text counts as empty; a text without words has fingerprint zero and is linked like any other.  Null ids
never become a component's id unless all its ids are null.  Repeated rows give repeated rows.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irquarry.llm.common import measured, named, stored
from irquarry.operators.clusters import similar_blocks

SHINGLE_WORDS = 4
#: Words of a shingle and least Jaccard similarity of ``keep_one``, and its min-hash bands.  At the least similarity a
#: pair shares none with probability (1 - 0.8 ** 6) ** 30, about 0.0001.
STAGE_WORDS = 5
SIMILARITY = 0.8
BANDS = 30
BAND_ROWS = 6
HASH_SEED = 42
RADIUS = 4
#: Pairs that a left text meets in one task; members and bytes of a part of a group of near copies.
PAIR_ROWS = 4096
CELL_ROWS = 4096
CELL_BYTES = 16 << 20
#: (shift, width) of the blocks of a fingerprint.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints a shard is meant to hold, rows a task is given, and fingerprints the upper tree is fitted on.
SHARD_HOMES = 4096
PART_ROWS = 1 << 17
SAMPLE = 16384
#: Comparisons made at once, and homes below which a node is compared whole.
COMPARE = 1 << 20
SMALL = 48


def fingerprint(body: bytes, words_per_shingle: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """64 bits; bit i is set if over half of the shingles' XXH64 hashes, repeats included, have it."""
    words = body.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: -words_per_shingle] + 1).tolist()]
        stops = ends[words_per_shingle - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, stops)]
    total = np.zeros(64, np.int64)
    found = np.array(hashes, dtype="<u8")
    for at in range(0, len(found), 1 << 16):
        part = found[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (the kept columns) and ``print`` (the fingerprint as a signed long)."""

    def compute(bodies: list[bytes | None]) -> list[tuple]:
        return [(_signed(fingerprint(b or b"")),) for b in bodies]

    return measured(docs, text, "print long", compute, keep).select("row", F.col("out.print").alias("print"))


def _distance(values: np.ndarray, point: int | np.ndarray) -> np.ndarray:
    return np.bitwise_count(values ^ point)


class Tree:
    """A vantage-point tree over one block: nodes 1, 2-3, 4-7, ... each with a point and a ball radius."""

    def __init__(self, sample: np.ndarray, width: int, depth: int, reach: int):
        self.width, self.depth, self.reach = width, depth, reach
        self.nodes: dict[int, tuple[int, int]] = {}
        self._fit(1, sample)

    def _fit(self, node: int, sample: np.ndarray) -> None:
        if node >= 1 << self.depth or len(sample) < 32:
            return
        point = int(sample[len(sample) // 2])
        distance = _distance(sample, np.uint64(point))
        radius = int(np.median(distance))
        self.nodes[node] = (point, radius)
        self._fit(2 * node, sample[distance <= radius])
        self._fit(2 * node + 1, sample[distance > radius])

    def ball(self, node: int) -> tuple[int, int]:
        """Below the sample's reach, a point by rule and half of the bits as radius."""
        found = self.nodes.get(node)
        if found is None:
            point = xxhash.xxh64_intdigest(node.to_bytes(8, "little")) & ((1 << self.width) - 1)
            found = self.nodes[node] = (point, (self.width - 1) // 2)
        return found

    def shards(self, values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, places, whether they live there) for every leaf that some value's ball meets."""
        stack = [(1, np.arange(len(values)), np.ones(len(values), bool))]
        while stack:
            node, places, home = stack.pop()
            if len(places) == 0:
                continue
            if node >= 1 << self.depth:
                yield node, places, home
                continue
            point, radius = self.ball(node)
            distance = _distance(values[places], np.uint64(point))
            inner, outer = distance <= radius + self.reach, distance > radius - self.reach
            stack.append((2 * node, places[inner], home[inner] & (distance[inner] <= radius)))
            stack.append((2 * node + 1, places[outer], home[outer] & (distance[outer] > radius)))


def _block(prints: np.ndarray, block: int) -> np.ndarray:
    shift, width = BLOCKS[block]
    return (prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)


def _close_pairs(
    homes: np.ndarray, queries: np.ndarray, block: int, reach: int, radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(home, query) fingerprints within the radius, home the smaller one, near in the block."""
    stack = [(homes, queries, 0)]
    while stack:
        own, asked, tried = stack.pop()
        if len(own) == 0 or len(asked) == 0:
            continue
        if len(own) > SMALL and len(own) * len(asked) > COMPARE // 16 and tried < 4:
            values = _block(own, block)
            point = values[xxhash.xxh32_intdigest(str((len(own), len(asked), tried))) % len(values)]
            here, there = _distance(values, point), _distance(_block(asked, block), point)
            middle = int(np.median(here))
            inside, near, far = here <= middle, there <= middle + reach, there > middle - reach
            if inside.all():
                stack.append((own, asked[near], tried + 1))
            else:
                stack.append((own[inside], asked[near], 0))
                stack.append((own[~inside], asked[far], 0))
            continue
        step = max(1, COMPARE // len(own))
        for at in range(0, len(asked), step):
            part = asked[at : at + step]
            q, h = np.nonzero((_distance(part[:, None], own[None, :]) <= radius) & (part[:, None] > own[None, :]))
            if len(q):
                yield own[h], part[q]


class _Forest:
    """Spanning edges of the pairs seen so far: each value points to a smaller one of its component."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.label = np.arange(len(self.values))

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        a, b = np.searchsorted(self.values, left), np.searchsorted(self.values, right)
        while True:
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            if not apart.any():
                return
            low, high = np.minimum(la, lb)[apart], np.maximum(la, lb)[apart]
            np.minimum.at(self.label, high, low)
            while True:
                jumped = self.label[self.label]
                if np.array_equal(jumped, self.label):
                    break
                self.label = jumped

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.values[moved], self.values[self.label[moved]]


def links(prints: DataFrame, radius: int = RADIUS, shard_homes: int = SHARD_HOMES, sample: int = SAMPLE) -> DataFrame:
    """Edges (left, right) that connect exactly what the pairs of ``print`` within the radius connect.

    ``prints`` holds distinct fingerprints.
    """
    reach = radius // len(BLOCKS)
    known = prints.count()
    depth = max(0, int(np.ceil(np.log2(max(known, 1) / shard_homes))))
    drawn = prints.orderBy(F.xxhash64("print"), "print").limit(sample).collect() if depth else []
    points = np.array([r["print"] for r in drawn], dtype=np.int64).view(np.uint64)
    trees = [Tree(_block(points, b), BLOCKS[b][1], depth, reach) for b in range(len(BLOCKS))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for b, tree in enumerate(trees):
                for leaf, places, home in tree.shards(_block(values, b)):
                    n = len(places)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, b, np.int32)),
                            pa.array(np.full(n, leaf, np.int64)),
                            pa.array(values[places].view(np.int64)),
                            pa.array(home),
                        ],
                        names=["block", "leaf", "print", "home"],
                    )

    placed = prints.select("print").mapInArrow(place, "block int, leaf long, print long, home boolean")
    if depth:
        # an overfull shard becomes a grid: home part by query part
        sizes = placed.groupBy("block", "leaf").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
        placed = placed.join(sizes, ["block", "leaf"])
    else:
        placed = placed.withColumn("parts", F.lit(max(1, -(-2 * known // PART_ROWS))))
    mine = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    as_home = F.when(F.col("home"), F.transform(every, lambda other: mine * F.col("parts") + other))
    as_query = F.transform(every, lambda other: other * F.col("parts") + mine)
    cells = placed.select(
        "block",
        "leaf",
        "print",
        F.inline(
            F.concat(
                F.transform(F.coalesce(as_home, F.array().cast("array<int>")), lambda c: F.struct(c.alias("cell"), F.lit(True).alias("home"))),
                F.transform(as_query, lambda c: F.struct(c.alias("cell"), F.lit(False).alias("home"))),
            )
        ),
    )

    def search(shard: pa.Table) -> pa.Table:
        block = shard["block"][0].as_py()
        values = shard["print"].to_numpy().view(np.uint64)
        home = shard["home"].to_numpy()
        forest = _Forest(values)
        for left, right in _close_pairs(values[home], values[~home], block, reach, radius):
            forest.add(left, right)
        left, right = forest.edges()
        return pa.table({"left": left.view(np.int64), "right": right.view(np.int64)})

    return cells.groupBy("block", "leaf", "cell").applyInArrow(search, "left long, right long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): nodes of one component share a label.  Nodes without an edge are left out.

    Each round joins every node to the neighbour (or itself) that comes first in an order drawn anew, so long paths
    shrink by a constant share; a node's neighbours are only ever aggregated, never gathered.
    """
    spark = edges.sparkSession
    edges = stored(edges.where(F.col("left") != F.col("right")).distinct(), "dedup-edges")
    labels = None
    turn = 0
    while not edges.isEmpty():
        turn += 1
        ends = edges.select("left", "right").union(edges.select("right", "left"))
        drawn = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("draw"), F.col(c).alias("node"))
        first = ends.groupBy(F.col("left").alias("node")).agg(F.min(drawn("right")).alias("other"))
        heads = stored(
            first.select("node", F.least("other", drawn("node")).getField("node").alias("head")), "dedup-heads"
        )
        if labels is None:
            labels = heads.withColumnRenamed("head", "label")
        else:
            moved = heads.withColumnRenamed("node", "label")
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("head", "label").alias("label"))
            labels = stored(labels, "dedup-labels")
        left = heads.select(F.col("node").alias("left"), F.col("head").alias("new_left"))
        right = heads.select(F.col("node").alias("right"), F.col("head").alias("new_right"))
        joined = edges.join(left, "left").join(right, "right").where(F.col("new_left") != F.col("new_right"))
        low, high = F.least("new_left", "new_right"), F.greatest("new_left", "new_right")
        edges = stored(joined.select(low.alias("left"), high.alias("right")).distinct(), "dedup-edges")
    return labels if labels is not None else spark.createDataFrame([], "node long, label long")


def labelled(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``rows`` (with ``print``; a stored table, read several times) with ``label``, one per component."""
    linked = components(links(rows.select("print").distinct(), radius))
    return rows.join(linked.withColumnRenamed("node", "print"), "print", "left").withColumn(
        "label", F.coalesce("label", "print")
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id of all that are linked to it."""
    rows = fingerprints(docs, [doc_id], text).select(F.col("row").getField(doc_id).alias("doc_id"), "print")
    rows = stored(rows, "dedup-prints")
    firsts = rows.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    per_print = labelled(firsts, radius)
    smallest = per_print.groupBy("label").agg(F.min("first_id").alias("component_id"))
    answer = per_print.select("print", "label").join(smallest, "label").select("print", "component_id")
    found = rows.join(answer, "print")
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(body: bytes, words_per_shingle: int = STAGE_WORDS, seed: int = HASH_SEED) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; a shorter text is one shingle, one without words has none."""
    words = body.lower().split()
    if not words:
        return np.array([], np.uint64)
    digest = xxhash.xxh64_intdigest
    last = max(1, len(words) - words_per_shingle + 1)
    found = [digest(b" ".join(words[i : i + words_per_shingle]), seed) for i in range(last)]
    return np.unique(np.array(found, dtype=np.uint64))


def similar(left: np.ndarray, right: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two shingle sets is at least ``least``."""
    if not len(left) or not len(right):
        return len(left) == len(right)
    common = len(np.intersect1d(left, right, assume_unique=True))
    return common >= least * (len(left) + len(right) - common) - 1e-9


_LAW = np.random.default_rng(HASH_SEED).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64)
_TIMES, _PLUS = (2 * _LAW[0] + np.uint64(1))[:, None], _LAW[1][:, None]


def bands(shingles: np.ndarray) -> list[int]:
    """A signed long per band, the digest of BAND_ROWS minima; two sets share one with probability J ** BAND_ROWS."""
    if not len(shingles):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 1024):
        mixed = (shingles[None, at : at + 1024] ^ _PLUS) * _TIMES
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, (mixed >> np.uint64(16)).min(axis=1), out=least)
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), band)) for band, row in enumerate(least.reshape(BANDS, -1))]


def _similar_pairs(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (left, right; a stored table) of nodes whose texts, from ``bodies`` (node, body), are similar.

    A left text goes once to every part of its pairs, and parts are as many as bound the pairs of one.
    """
    parts = pairs.count() // PAIR_ROWS + 1
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("right"), F.lit(parts)))
    one = dealt.select("left", "part").distinct().join(bodies.withColumnsRenamed({"node": "left", "body": "left_body"}), "left")
    two = bodies.withColumnsRenamed({"node": "right", "body": "right_body"})
    joined = dealt.join(two, "right").join(one, ["left", "part"]).select("left", "right", "left_body", "right_body")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, np.ndarray] = (None, np.array([], np.uint64))
        for batch in batches:
            lefts, found = batch.column(0).to_pylist(), []
            for i, left in enumerate(lefts):
                if left != known[0]:  # rows of one left side mostly follow each other
                    known = (left, shingle_set(batch.column(2)[i].as_py()))
                found.append(similar(known[1], shingle_set(batch.column(3)[i].as_py())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["left", "right"]).filter(
                pa.array(found, pa.bool_())
            )

    return joined.mapInArrow(check, "left long, right long")


def cells(members: DataFrame, bodies: DataFrame) -> DataFrame:
    """``members`` (node, label, group) with their texts, dealt into cells: all of a small group, a pair of parts of a large one.

    A member has one row for each part of its group, and a part holds about CELL_ROWS members or CELL_BYTES of text.
    """
    rows = members.join(bodies, "node")
    size = F.greatest(F.ceil(F.count("*") / CELL_ROWS), F.ceil(F.sum(F.octet_length("body").cast("long")) / CELL_BYTES), F.lit(1))
    sizes = rows.groupBy("group").agg(size.cast("int").alias("parts"))
    rows = rows.join(sizes, "group").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("group", low.alias("row"), high.alias("col"), "part", "node", "label", "body")


def _similar_in_groups(members: DataFrame, bodies: DataFrame) -> DataFrame:
    """Spanning edges (left, right) of the similar members of each group, labels included."""

    def compare(cell: pa.Table) -> pa.Table:
        node, label, part = (cell[c].to_numpy() for c in ("node", "label", "part"))
        sets = [shingle_set(b) for b in cell["body"].to_pylist()]
        row, col = cell["row"][0].as_py(), cell["col"][0].as_py()
        sides = [np.flatnonzero(part == p) for p in (row, col)]
        forest = _Forest(np.concatenate([node, label]))
        forest.add(node, label)
        if len(sides[0]) and len(sides[1]):
            for a, b in similar_blocks(*([sets[i] for i in side] for side in sides), SIMILARITY):
                forest.add(node[sides[0][a]], node[sides[1][b]])
        left, right = forest.edges()
        return pa.table({"left": left, "right": right})

    return cells(members, bodies).groupBy("group", "row", "col").applyInArrow(compare, "left long, right long")


def similar_components(rows: DataFrame) -> DataFrame:
    """(node, label) of the nodes linked with another by texts of similarity SIMILARITY or more.

    ``rows`` (stored; read several times) has row_key, node, print, bands and body.  Candidates are what SimHash links and what
    shares a band, and every link is checked on both texts.  Members of a bucket meet its first member; labels that still share
    a bucket make a group, whose members are compared within bounded cells.  Each step has a row per member and bucket at
    most, and a cell hands on spanning edges only; a group of n members costs n rows, or n for each CELL_ROWS members of a large one.
    """
    nodes = rows.groupBy("node").agg(F.min(F.struct("row_key", "print", "bands")).alias("it")).select("node", "it.*")
    nodes = stored(nodes, "dedup-nodes")
    firsts = nodes.groupBy("print").agg(F.min("node").alias("first"))
    by_print = nodes.join(firsts, "print").select(F.col("first").alias("left"), F.col("node").alias("right"))
    ends = [firsts.select(F.col("print").alias(side), F.col("first").alias(f"{side}_node")) for side in ("left", "right")]
    linked = links(firsts.select("print")).join(ends[0], "left").join(ends[1], "right")
    by_link = linked.select(F.least("left_node", "right_node").alias("left"), F.greatest("left_node", "right_node").alias("right"))

    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = stored(keyed.join(sizes, ["band", "key"]).select("band", "key", "node", "first"), "dedup-shared")
    by_band = shared.select(F.col("first").alias("left"), F.col("node").alias("right"))
    candidates = by_print.union(by_link).union(by_band).where("left <> right").distinct()
    candidates = stored(candidates, "dedup-candidates")
    asked = candidates.select(F.col("left").alias("node")).union(candidates.select("right")).union(shared.select("node"))
    asked = nodes.select("node", "row_key").join(asked.distinct(), "node", "left_semi")
    bodies = stored(rows.select("row_key", "body").join(asked, "row_key").select("node", "body"), "dedup-bodies")
    edges = stored(_similar_pairs(candidates, bodies), "dedup-similar")

    labels = components(edges)
    placed = shared.join(labels, "node", "left").select("band", "key", "node", F.coalesce("label", "node").alias("label"))
    apart = placed.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    placed = stored(placed.join(apart.drop("high"), ["band", "key"]), "dedup-apart")
    if placed.isEmpty():
        return labels
    groups = components(placed.select(F.col("low").alias("left"), F.col("label").alias("right")))
    groups = groups.select(F.col("node").alias("label"), F.col("label").alias("group"))
    members = stored(placed.select("node", "label").distinct().join(groups, "label"), "dedup-members")
    more = stored(_similar_in_groups(members, bodies), "dedup-similar")
    return components(edges.union(more))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class of similar texts: the one with the smallest id, null last, then the first row.

    Texts are similar if the Jaccard similarity of their sets of STAGE_WORDS-word shingles is SIMILARITY or more.
    """

    def compute(bodies: list[bytes | None]) -> list[tuple]:
        found = []
        for body in bodies:
            shingles = shingle_set(body or b"")
            node = _signed(xxhash.xxh64_intdigest(shingles.tobytes(), HASH_SEED))
            found.append((_signed(fingerprint(body or b"", STAGE_WORDS)), node, bands(shingles)))
        return found

    prints = measured(docs, text, "print long, node long, bands array<long>", compute, docs.columns)
    rows = stored(prints.withColumn("row_key", F.monotonically_increasing_id()), "dedup-documents")
    body = F.coalesce(F.col("row").getField(text).cast("binary"), F.lit(b""))
    labels = similar_components(rows.select("row_key", "out.*", body.alias("body")))
    key = F.col("row").getField(doc_id)
    best = F.min(F.struct(key.isNull().alias("missing"), key.alias("id"), F.col("row_key").alias("row_key")))
    firsts = rows.groupBy(F.col("out.node").alias("node")).agg(best.alias("best")).join(labels, "node", "left")
    winners = firsts.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("best").alias("best"))
    chosen = winners.select(F.col("best.row_key").alias("row_key"))
    kept = rows.join(chosen, "row_key", "left_semi")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
