"""Classes of linked rows, and links between similar sets.

Links are never listed pair by pair: groups hand on edges that span what is linked, and contraction rounds
join them into classes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irquarry.session import new_work_path

#: Sets and bytes of elements in a part of a large group; sets and elements multiplied at once.
CELL_ROWS = 4096
CELL_ELEMENTS = 1 << 21
BLOCK = 512
COLUMNS = 8192
#: Cells are compared in so many calls at least, and in one more for so many elements.
BINS = 64
BIN_ELEMENTS = 1 << 18
#: Elements whose sets are looked through at once.
SLICE_ELEMENTS = 1 << 20
#: Counters that say how often elements occur; words of 64 parity bits of a set.
COUNTERS = 1 << 20
PARITY = 4
#: Sets that meet at one element are compared by their parities up to so many.
MEETING_ROWS = 2048
MIXER = np.uint64(0x9E3779B97F4A7C15)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (left, right), all long: the label is the smallest node that is reachable.

    A round joins every node to the neighbour, or itself, that comes first in an order drawn anew, so long chains shrink by a
    constant share; neighbours are aggregated, never gathered.  Every round is stored.
    """
    edges = _stored(edges, "edges")
    nodes = edges.select(F.explode(F.array("left", "right")).alias("node")).distinct()
    labels = _stored(nodes.withColumn("label", F.col("node")), "labels")
    edges = _stored(edges.where("left <> right").distinct(), "links")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        ends = edges.union(edges.select("right", "left"))
        first = F.min(F.struct(F.xxhash64(F.lit(turn), "right").alias("draw"), F.col("right").alias("node")))
        own = F.struct(F.xxhash64(F.lit(turn), "node").alias("draw"), F.col("node").alias("node"))
        heads = ends.groupBy(F.col("left").alias("node")).agg(first.alias("other"))
        heads = _stored(heads.select("node", F.least("other", own)["node"].alias("head")), "heads")
        moved = heads.withColumnRenamed("node", "label")
        labels = _stored(labels.join(moved, "label", "left").select("node", F.coalesce("head", "label").alias("label")), "labels")
        for side in ("left", "right"):
            edges = edges.join(heads.withColumnsRenamed({"node": side, "head": f"new_{side}"}), side)
        low, high = F.least("new_left", "new_right"), F.greatest("new_left", "new_right")
        edges = edges.where("new_left <> new_right").select(low.alias("left"), high.alias("right")).distinct()
        edges = _stored(edges, "links")
    smallest = labels.groupBy("label").agg(F.min("node").alias("smallest"))
    return labels.join(smallest, "label").select("node", F.col("smallest").alias("label"))


class Forest:
    """What is linked so far: every value points to a smaller one of its class, or to itself."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.parent = np.arange(len(self.values))

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        a, b = np.searchsorted(self.values, left), np.searchsorted(self.values, right)
        while (apart := self.parent[a] != self.parent[b]).any():
            a, b = a[apart], b[apart]
            roots = np.sort(np.stack([self.parent[a], self.parent[b]]), axis=0)
            np.minimum.at(self.parent, roots[1], roots[0])
            while not np.array_equal(shorter := self.parent[self.parent], self.parent):
                self.parent = shorter

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return self.values[moved], self.values[self.parent[moved]]


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each left set shares with each right set: products of blocks over the elements both sides have."""
    flats = [np.concatenate(side) for side in (left, right)]
    both = np.intersect1d(*flats)
    owners = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    places = [np.searchsorted(both, flat) for flat in flats]
    count = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(both), COLUMNS):
        stop = min(start + COLUMNS, len(both))
        dense = []
        for side, flat, owner, place in zip((left, right), flats, owners, places):
            here = np.flatnonzero((place >= start) & (place < stop))
            here = here[both[place[here]] == flat[here]]
            block = np.zeros((len(side), stop - start), np.float32)
            block[owner[here], place[here] - start] = 1
            dense.append(block)
        count += dense[0] @ dense[1].T
    return count


def similar_blocks(
    left: list[np.ndarray], right: list[np.ndarray], least: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of sets whose Jaccard similarity is ``least`` or more; blocks whose sizes are too far apart are passed over.

    Sets without elements are like nothing.
    """
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    orders = [np.argsort(n, kind="stable") for n in sizes]
    orders = [o[n[o] > 0] for o, n in zip(orders, sizes)]
    for i in range(0, len(orders[0]), BLOCK):
        rows = orders[0][i : i + BLOCK]
        for j in range(0, len(orders[1]), BLOCK):
            cols = orders[1][j : j + BLOCK]
            n, m = sizes[0][rows], sizes[1][cols]
            if n.max() < least * m.min() or m.max() < least * n.min():
                continue
            common = shared_counts([left[r] for r in rows], [right[c] for c in cols])
            r, c = np.nonzero(common >= least * (n[:, None] + m[None, :] - common) - 1e-6)
            if len(r):
                yield rows[r], cols[c]


def cells(members: DataFrame) -> DataFrame:
    """``members`` (group, node, elements) dealt into cells (group, row, col): a whole small group, a pair of parts of a large one.

    A member has a row for each part of its group; parts hold about CELL_ROWS sets or CELL_ELEMENTS elements.
    """
    parts = F.greatest(F.ceil(F.count("*") / CELL_ROWS), F.ceil(F.sum(F.size("elements").cast("long")) / CELL_ELEMENTS), F.lit(1))
    rows = members.join(members.groupBy("group").agg(parts.cast("int").alias("parts")), "group")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("group", F.least("part", "other").alias("row"), F.greatest("part", "other").alias("col"), "part", "node", "elements")


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all lists in one array, and where each list begins and the last one ends."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = whole.offsets.to_numpy().astype(np.int64)
    return whole.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with about SLICE_ELEMENTS elements at a time."""
    for batch in batches:
        offsets = _lists(batch.column("elements"))[1]
        cuts = np.searchsorted(offsets, np.arange(0, offsets[-1], SLICE_ELEMENTS)[1:])
        for start, stop in itertools.pairwise(np.unique([0, *cuts, batch.num_rows])):
            yield batch.slice(start, stop - start)


def similar_edges(members: DataFrame, least: float) -> DataFrame:
    """Edges (left, right) that span the similar sets of each group; a call compares a bin of cells."""

    def compare(cells: pa.Table) -> pa.Table:
        node, part = cells["node"].to_numpy(), cells["part"].to_numpy()
        flat, offsets = _lists(cells["elements"])
        key = [cells[name].to_numpy() for name in ("col", "row", "group")]
        order = np.lexsort(key)
        new = np.any([np.diff(k[order]) != 0 for k in key], axis=0)
        found = [(node[:0], node[:0])]
        for here in np.split(order, np.flatnonzero(new) + 1):
            if len(here) < 2:
                continue
            forest = Forest(node[here])
            sides = [here[part[here] == side[here[0]]] for side in key[1::-1]]
            sets = ([np.unique(flat[offsets[i] : offsets[i + 1]]) for i in side] for side in sides)
            for a, b in similar_blocks(*sets, least):
                forest.add(node[sides[0][a]], node[sides[1][b]])
            found.append(forest.edges())
        left, right = (np.concatenate(side) for side in zip(*found))
        return pa.table({"left": left, "right": right})

    total = members.agg(F.sum(F.size("elements").cast("long"))).head()[0] or 0
    bins = BINS + total // BIN_ELEMENTS
    dealt = cells(members).withColumn("bin", F.pmod(F.xxhash64("group", "row", "col"), F.lit(bins)))
    return dealt.groupBy("bin").applyInArrow(compare, "left long, right long")


def _counters(elements: np.ndarray) -> np.ndarray:
    return ((elements.view(np.uint64) * MIXER) >> np.uint64(44)).astype(np.int64) % COUNTERS


def often(nodes: DataFrame) -> np.ndarray:
    """How often elements occur in ``nodes``, in quarters of powers of two, by counter: COUNTERS numbers for a table of any size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(COUNTERS, np.int64)
        for batch in _slices(batches):
            found += np.bincount(_counters(_lists(batch.column("elements"))[0]), minlength=COUNTERS)
        counter = np.flatnonzero(found)
        yield pa.record_batch({"counter": counter, "n": found[counter]})

    counts = nodes.select("elements").mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    rows = counts.select("counter", F.floor(4 * F.log2(F.col("n") + 1)).alias("level")).toArrow()
    levels = np.zeros(COUNTERS, np.uint8)
    levels[rows["counter"].to_numpy()] = rows["level"].to_numpy()
    return levels


def rarest(nodes: DataFrame, levels: np.ndarray, least: float) -> DataFrame:
    """A row for each of the rarest elements of ``nodes`` (node, place, elements sorted): key, node, size and parity bits of the set.

    There are so many of them that two similar sets of a place share one, however well ``levels`` tell the rare elements: it is
    enough that all sets order theirs alike.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            flat, offsets = _lists(batch.column("elements"))
            size = np.diff(offsets)
            owner = np.repeat(np.arange(len(size)), size)
            mixed = flat.view(np.uint64) * MIXER
            bit = np.uint64(1) << ((mixed >> np.uint64(56)) & np.uint64(63))
            word = (mixed >> np.uint64(48)) % np.uint64(PARITY)
            order = np.argsort(owner << 8 | levels[_counters(flat)], kind="stable")
            first = size - np.ceil(least * size - 1e-9).astype(np.int64) + 1
            taken = np.arange(len(flat)) - offsets[owner] < first[owner]
            row = owner[taken]
            place = batch.column("place").to_numpy().view(np.uint64)
            out = {
                "key": (mixed[order[taken]] + place[row]).view(np.int64),
                "node": batch.column("node").to_numpy()[row],
                "size": size[row],
            }
            for i in range(PARITY):
                parity = np.bitwise_xor.reduceat(np.where(word == i, bit, np.uint64(0)), offsets[:-1])
                out[f"parity_{i}"] = parity.view(np.int64)[row]
            yield pa.record_batch(out)

    nodes = nodes.where(F.size("elements") > 0).select("node", "place", "elements")
    return nodes.mapInArrow(rows, ", ".join(["key long, node long, size long", *(f"parity_{i} long" for i in range(PARITY))]))


def meeting_edges(met: DataFrame, least: float) -> DataFrame:
    """Edges (left, right) that span the rows of each key that may be similar, for all that sizes and parities tell.

    Two sets differ in as many elements as parity bits at least.  More than MEETING_ROWS rows of a key are linked as they are.
    """

    def spanned(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
        left, right = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (left, right))
        forest = Forest(np.concatenate([left, right]))
        forest.add(left, right)
        return pa.record_batch(dict(zip(("left", "right"), forest.edges())))

    def compared(rows: np.ndarray) -> pa.RecordBatch:
        key, node, size, parity = rows[0], rows[1], rows[2], rows[3:].view(np.uint64)
        starts = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        lengths = np.diff(starts, append=len(key))
        crowded = np.repeat(lengths > MEETING_ROWS, lengths)
        left, right = [np.repeat(node[starts], lengths)[crowded]], [node[crowded]]
        here, step = np.flatnonzero(~crowded), 1
        while len(here):
            here = here[here + step < len(key)]
            here = here[key[here] == key[here + step]]
            a, b = here, here + step
            apart = sum(np.bitwise_count(p[a] ^ p[b]).astype(np.int64) for p in parity)
            near = apart <= (1 - least) / (1 + least) * (size[a] + size[b]) + 1e-3
            near &= np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - 1e-3
            left.append(node[a[near]])
            right.append(node[b[near]])
            step += 1
        return spanned(left, right)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowd = np.zeros((3 + PARITY, 0), np.int64), None
        for batch in batches:
            rows = np.stack([column.to_numpy() for column in batch.columns])
            if crowd is not None:  # the key of the last batch had too many rows to hold
                inside = rows[0] == crowd[0]
                yield spanned([np.full(inside.sum(), crowd[1])], [rows[1][inside]])
                rows = rows[:, ~inside]
            rows = np.concatenate([held, rows], axis=1)
            if not rows.shape[1]:
                continue
            crowd, last = None, np.searchsorted(rows[0], rows[0, -1])
            held, rows = rows[:, last:], rows[:, :last]
            yield compared(rows)
            if held.shape[1] > MEETING_ROWS:
                crowd = held[:2, 0]
                yield compared(held)
                held = held[:, :0]
        yield compared(held)

    return met.repartition("key").sortWithinPartitions("key").mapInArrow(edges, "left long, right long")


def similar_classes(sets: DataFrame, least: float) -> DataFrame:
    """(idx, first) of ``sets`` (idx, block, elements array<long>): the smallest idx linked to it within the block.

    Sets are linked if the Jaccard similarity of their distinct elements is ``least`` or more.  Equal sets, told by 128 bits of hash,
    are one row.  Two similar sets share one of their rarest elements, so many of them that the rest cannot reach ``least``:
    rows that meet there and whose sizes and parities allow it make groups, which are compared in bounded cells.
    Empty sets are linked to nothing but each other.
    """
    known = _stored(sets.select("idx", "block", F.sort_array(F.array_distinct("elements")).alias("elements")), "sets")
    key = ["block", "low", "high"]
    known = known.where(F.col("block").isNotNull() & F.col("elements").isNotNull())
    known = known.withColumns({name: F.xxhash64(F.lit(i), F.col("elements")) for i, name in enumerate(key[1:])})
    copies = known.groupBy(*key).agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = _stored(copies.drop("copies"), "copies")
    known = known.join(copies, key, "left").withColumn("node", F.coalesce("first", "idx"))
    nodes = known.where("node = idx").select("node", F.xxhash64("block").alias("place"), "elements")
    groups = connected(meeting_edges(rarest(nodes, often(nodes), least), least))
    # a key is a sum of hashes: rows of two blocks that meet by chance are parted again
    members = nodes.join(groups, "node").withColumn("group", F.xxhash64("label", "place"))
    members = _stored(members.select("group", "node", "elements"), "members")
    linked = connected(similar_edges(members, least))
    return known.select("idx", "node").join(linked, "node", "left").select("idx", F.coalesce("label", "node").alias("first"))
