"""Ranked lexical search as dense blocked multiplication: item vocabulary tiles times document impact tiles.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lowered.  A document's impact for a term and an item's
weights are whole numbers, so a score is a matrix product over the item tile's vocabulary.  A vocabulary tile is cut where an item's weights
times the largest impact could reach 2 ** 53: each product of doubles is then exact, and tiles are added as 64-bit integers.

How it runs: items go in rounds of a bounded number of bytes, documents once a round.  A scan turns documents into tiles, a stored
table of (document, term, count) for the round's vocabulary; document frequencies and lengths are summed from it in Spark; a second
pass multiplies each tile and keeps per task the best of each item, ties settled by id, so no pair of item and
document is ever a row.  All documents count, with every term they hold.

Null text has no term.  A document's whole text is read in slices cut between terms.  A null id is ranked after all
others of its score.  Repeated document rows are ranked each; repeated item rows give their results each.  An item or a corpus without
terms gives no rows, as does an empty table.  Other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from irquarry.llm.common import named, sliced, stored, texts, total_bytes

TOP = 10
#: Bytes of item text a round takes to every task.
ITEM_BYTES = 4 << 20
#: Items of a tile and its weights, widest vocabulary tile, documents and entries of a document tile.
ITEM_TILE = 256
ITEM_WEIGHTS = 1 << 22
VOCABULARY_TILE = 2048
TILE_DOCS = 1024
TILE_ENTRIES = 1 << 19
#: Bytes of a text split into terms at a time.
SPLIT_BYTES = 4 << 20
#: No impact reaches this, and no partial sum this.
MOST_IMPACT = 10**6
EXACT = 1 << 53

_SEPARATOR = bytes(b for b in range(0x80) if not chr(b).isalnum())
_LOWERED = bytes.maketrans(
    bytes(range(0x41, 0x5B)) + _SEPARATOR, bytes(range(0x61, 0x7B)) + b" " * len(_SEPARATOR)
)
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def term_lists(body: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, a list per slice; no term is cut."""
    at = 0
    while at < len(body):
        stop = at + SPLIT_BYTES
        if stop < len(body):
            gap = _GAP.search(body, stop)
            stop = gap.start() if gap else len(body)
        yield body[at:stop].translate(_LOWERED).split()
        at = stop


def counted(body: bytes) -> Counter:
    total: Counter = Counter()
    for part in term_lists(body):
        total.update(part)
    return total


_TILE = "docs long, occurrences long, ids array<long>, sizes array<long>, doc array<int>, term array<int>, times array<long>"


def _tiles(docs: DataFrame, doc_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """Documents as tiles: ``docs`` with a term and their ``occurrences``, and the entries of those with a listed term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        sizes: list[int] = []
        doc: list[int] = []
        term: list[int] = []
        times: list[int] = []
        docs_seen = occurrences = 0

        def tile() -> pa.RecordBatch:
            columns = [[docs_seen], [occurrences], [ids], [sizes], [doc], [term], [times]]
            long, short = pa.list_(pa.int64()), pa.list_(pa.int32())
            kinds = [pa.int64(), pa.int64(), long, long, short, short, long]
            names = ["docs", "occurrences", "ids", "sizes", "doc", "term", "times"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for piece in sliced(batch, 1):
                for key, body in zip(piece.column(0).to_pylist(), texts(piece.column(1))):
                    counts = counted(body or b"")
                    if not counts:
                        continue
                    n = counts.total()
                    docs_seen, occurrences = docs_seen + 1, occurrences + n
                    listed = counts.keys() & vocabulary.keys()
                    if listed:
                        doc.extend([len(ids)] * len(listed))
                        term.extend([vocabulary[t] for t in listed])
                        times.extend([counts[t] for t in listed])
                        ids.append(key)
                        sizes.append(n)
                    if len(ids) >= TILE_DOCS or len(doc) >= TILE_ENTRIES:
                        yield tile()
                        ids, sizes, doc, term, times = [], [], [], [], []
                        docs_seen = occurrences = 0
        if docs_seen:
            yield tile()

    return docs.select(named(doc_id).cast("long").alias("id"), named(text).alias("body")).mapInArrow(run, _TILE)


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def impacts(times: np.ndarray, sizes: np.ndarray, doc: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    """The impact of each entry, from its count and its document's size."""
    spread = np.array([25 + 75 * int(n) * documents // occurrences for n in sizes], dtype=np.int64)
    return (1_000_000_000 * times) // (1000 * times + 8 * spread[doc])


class ItemTile:
    """Some items' weights over their own vocabulary, cut into tiles whose products are exact."""

    def __init__(self, first: int, weights: list[dict[int, int]], terms: int):
        self.first, self.items = first, len(weights)
        self.local = np.full(terms, -1, np.int32)
        used = sorted({t for w in weights for t in w})
        self.local[used] = np.arange(len(used))
        matrix = np.zeros((len(used), len(weights)), np.int64)
        for j, w in enumerate(weights):
            for t, value in w.items():
                matrix[self.local[t], j] = value
        self.tiles = list(_exact_tiles(matrix))

    def scores(self, docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """int64 scores, documents by items."""
        total = np.zeros((docs, self.items), np.int64)
        place = self.local[term]
        order = np.argsort(place, kind="stable")
        place, doc, impact = place[order], doc[order], impact[order].astype(np.float64)
        for start, part in self.tiles:
            a, b = np.searchsorted(place, (start, start + len(part)))
            dense = np.zeros((docs, len(part)))
            dense[doc[a:b], place[a:b] - start] = impact[a:b]
            total += (dense @ part).astype(np.int64)
        return total


def _exact_tiles(matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows as doubles): each item's weights of a tile times MOST_IMPACT stay below EXACT."""
    most = (EXACT - 1) // MOST_IMPACT
    while (matrix > 0).any():
        now = np.minimum(matrix, most)  # a larger weight is spread over several rounds
        start, held = 0, np.zeros(matrix.shape[1], np.int64)
        for row in range(len(now)):
            if row > start and (row - start >= VOCABULARY_TILE or (held + now[row] > most).any()):
                yield start, now[start:row].astype(np.float64)
                start, held = row, np.zeros_like(held)
            held = held + now[row]
        yield start, now[start:].astype(np.float64)
        matrix = matrix - now


def _item_tiles(weights: list[dict[int, int]]) -> Iterator[tuple[int, int]]:
    """Bounds of the items that make a tile, by their number and the size of their matrix."""
    start, terms = 0, set()
    for i, found in enumerate(weights):
        wider = terms | found.keys()
        if i > start and (i - start >= ITEM_TILE or len(wider) * (i + 1 - start) > ITEM_WEIGHTS):
            yield start, i
            start, wider = i, set(found)
        terms = wider
    if weights:
        yield start, len(weights)


class _Best:
    """The best documents of each item so far: scores descending, then ids ascending, null last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.rows = [(np.array([], np.int64), np.array([], bool), np.array([], np.int64)) for _ in range(items)]

    def add(self, item: int, score: np.ndarray, none: np.ndarray, key: np.ndarray) -> None:
        old_score, old_none, old_key = self.rows[item]
        least = old_score[-1] if len(old_score) == self.top else 1
        near = np.flatnonzero(score >= least)  # equal scores too: their ids decide
        if not len(near):
            return
        score, none, key = (np.concatenate(c) for c in ((old_score, score[near]), (old_none, none[near]), (old_key, key[near])))
        order = np.lexsort((key, none, -score))[: self.top]
        self.rows[item] = score[order], none[order], key[order]


def _ranked(tiles: DataFrame, item_ids: list, id_kind: DataType, item_tiles: list[ItemTile], totals: tuple[int, int], top: int) -> DataFrame:
    """item (its number), item_id, doc_id and score: the best of every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(item_ids), top)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, doc, term, times = (batch.column(c)[row].values for c in range(5))
                none = np.asarray(ids.is_null())
                key = ids.fill_null(0).to_numpy(zero_copy_only=False)
                doc, term = doc.to_numpy(), term.to_numpy()
                worth = impacts(times.to_numpy(), sizes.to_numpy(), doc, *totals)
                for tile in item_tiles:
                    mine = tile.local[term] >= 0
                    scores = tile.scores(len(key), doc[mine], term[mine], worth[mine])
                    for j in range(tile.items):
                        best.add(tile.first + j, scores[:, j], none, key)
        for item, (score, none, key) in enumerate(best.rows):
            if len(score):
                columns = [
                    pa.array(np.full(len(score), item, np.int32)),
                    pa.array([item_ids[item]] * len(score)).cast(kind),
                    pa.array(key, mask=none),
                    pa.array(score),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "doc_id", "score"])

    kind = to_arrow_type(id_kind)
    columns = tiles.select("ids", "sizes", "doc", "term", "times")
    return columns.mapInArrow(run, f"item int, item_id {id_kind.simpleString()}, doc_id long, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's ``top`` best documents with a score above 0.

    Ids of documents are whole numbers.  Runs jobs: the tiles of each round are stored.
    """
    asked = items.select(named(item_id).alias("item_id"), named(item_text).cast("binary").alias("body")).where("body is not null")
    id_kind = asked.schema["item_id"].dataType
    rounds = total_bytes(asked, "body") // item_bytes + 1
    number = F.pmod(F.xxhash64("item_id", "body"), F.lit(rounds))
    found = None
    for turn in range(rounds):
        rows = [(r[0], counted(bytes(r[1]))) for r in asked.where(number == turn).collect()]
        rows = [r for r in rows if r[1]]
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, counts in rows for t in counts}))}
        tiles = stored(_tiles(docs, doc_id, text, vocabulary), "lexical-tiles")
        documents, occurrences = (int(x or 0) for x in tiles.agg(F.sum("docs"), F.sum("occurrences")).head())
        held = tiles.select(F.explode("term").alias("term")).groupBy("term").count().collect()
        frequency = {r["term"]: r["count"] for r in held}
        worth = {i: weight(documents, n) for i, n in frequency.items()}
        weights = [
            {i: times * worth[i] for t, times in counts.items() if (i := vocabulary[t]) in worth} for _, counts in rows
        ]
        item_tiles = [ItemTile(a, weights[a:b], len(vocabulary)) for a, b in _item_tiles(weights)]
        best = _ranked(tiles, [r[0] for r in rows], id_kind, item_tiles, (documents, occurrences), top)
        best = best.withColumn("round", F.lit(turn))
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("round", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
