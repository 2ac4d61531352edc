"""Repeated passages by De Bruijn compaction: k-word windows are edges, repeated nonbranching paths compact, coordinates verify.

A node is a sequence of ``window - 1`` words, an edge (a window of ``window`` words) leads from the node of its first words to that of its
last, and is known by this pair of 64-bit digests.  Edges between two cut points that their own digests set compact into a segment, and
segments into a path unless a node between them has several repeated segments in or out.  What is repeated lies in documents of different
ids; its source coordinate is the smallest (doc_id, place) where it starts.  A repeated span of a document is a run of
its windows along one path, place by place, and names the source's place where the same words stand.

How it runs:

1. Documents are dealt into chunks of about ``chunk_bytes`` by a hash of id and text; the one shuffle of texts, which all later steps reuse.
2. A chunk sends the distinct truncated digests of its windows, sorted, as Rice codes of their differences (about 2 bytes each), cut by
   key range; a range answers with those that another chunk, or another document of that chunk, has too.
   Digests get as many bits as the corpus needs for few chance hits, and every chunk has one entry for a passage, however many copies.
3. Windows are cut into segments where their own digest says so (every SEGMENT windows or so).  A segment whose windows are all marked
   travels as one row; where a smaller id has the same segment, all its windows are settled at once, so copies send few rows.
4. Segments that are their own source meet at their nodes; a node that one repeated segment enters and one leaves joins them into a path,
   and paths, numbered per source document, are joined to the same segments of other documents.
5. What is left (the first document of each segment, and segments that are marked in part) is sent window by window as edges; a
   window function over equal edges finds the source and drops chance hits.
6. Places of segments and windows go back to the chunks, where they become spans.

A range and a chunk exchange a row only if they share a digest, so rows never outnumber windows.  A chunk with one very long
text holds that text.  Null text has no words.  A row without id gives and loses nothing.  Rows of equal id lose nothing to each other;
those that repeat id and text meet in one chunk.  Documents below ``window`` words have no window.  Extra columns are kept if asked
for, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, from_arrow_type
from pyspark.sql.types import StructField, StructType

from irquarry.llm.common import named, sliced, texts, total_bytes

WINDOW_WORDS = 13
CHUNK_BYTES = 8 << 20
#: Bits of a digest beyond those that count the corpus' bytes; a text has a window in several bytes, so a chance hit is rarer than 1 in 64.
EXTRA_BITS = 4
#: A segment begins at one window in so many (a power of two).
SEGMENT = 8
#: Bytes from which a word is digested on its own.
LONG_WORD = 256

_RANDOM = np.random.default_rng(11)
_FACTORS = _RANDOM.integers(0, 1 << 63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _word_digests(bodies: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A digest of every word of the texts, one text after another, and the number of words of each text."""
    whole = b"\n".join(b or b"" for b in bodies) + b"\n" * 8
    flat = np.frombuffer(whole, np.uint8)
    space = _SPACE[flat]
    edge = np.r_[True, space[:-1]]
    starts, stops = np.flatnonzero(~space & edge), np.flatnonzero(space & ~edge)
    first = np.cumsum([0, *(len(b or b"") + 1 for b in bodies)])
    lengths = np.diff(np.searchsorted(starts, first))
    number = stops - starts
    digests = number.astype(np.uint64) * _FACTORS[0]
    windows = np.lib.stride_tricks.sliding_window_view(flat, 8)
    live, at = np.flatnonzero(number <= LONG_WORD), 0
    while len(live):  # eight bytes of every word at a time
        left = np.minimum(number[live] - at, 8).astype(np.uint64)
        piece = windows[starts[live] + at].view("<u8").ravel() & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * left))
        digests[live] = _mixed((digests[live] ^ piece) * _FACTORS[1])
        at += 8
        live = live[number[live] > at]
    for i in np.flatnonzero(number > LONG_WORD).tolist():
        digests[i] = xxhash.xxh64_intdigest(whole[starts[i] : stops[i]], 11)
    return digests, lengths


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def _sequences(digests: np.ndarray, length: int) -> np.ndarray:
    """A digest of every ``length`` consecutive values, from those of half the length."""
    if length == 1:
        return _mixed(digests)
    half = _sequences(digests, length // 2)
    both = half[: len(half) - length // 2] * _FACTORS[0] + half[length // 2 :]
    if length % 2:
        both = both[: len(both) - 1] * _FACTORS[1] + digests[length - 1 :]
    return _mixed(both)


class _Windows:
    """All windows of some documents, in order: ``source`` and ``target`` nodes, ``key``, ``owner`` and ``place``."""

    def __init__(self, bodies: list[bytes | None], ids: pa.Array, window: int):
        flat, lengths = _word_digests(bodies)
        real = np.asarray(ids.is_valid())
        number = np.where(real, np.maximum(lengths - window + 1, 0), 0)
        self.owner = np.repeat(np.arange(len(bodies)), number)
        self.begins = np.cumsum(number) - number
        self.place = np.arange(len(self.owner)) - np.repeat(self.begins, number)
        start = np.repeat(np.cumsum(lengths) - lengths, number) + self.place
        nodes = _sequences(flat, window - 1) if len(self.owner) else flat
        self.source, self.target = nodes[start], nodes[start + 1]
        self.key = _mixed(self.source * np.uint64(3) + self.target)
        self.ids = ids.fill_null(0).to_numpy()
        self.tags = _tags(bodies, ids)

    def distinct(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct truncated digests, sorted, and which of them lie in documents of two ids here."""
        key = self.key >> np.uint64(64 - bits)
        ranks = np.unique(self.ids, return_inverse=True)[1].astype(np.uint64)
        wide = int(len(self.ids)).bit_length()
        if bits + wide <= 64:
            both = np.sort(key << np.uint64(wide) | ranks[self.owner])
            key, rank = both >> np.uint64(wide), both & np.uint64((1 << wide) - 1)
        else:
            order = np.lexsort((ranks[self.owner], key))
            key, rank = key[order], ranks[self.owner][order]
        if not len(key):
            return key, np.zeros(0, bool)
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        last = np.r_[heads[1:], len(key)] - 1
        return key[heads], rank[heads] != rank[last]

    def marked(self, shared: np.ndarray, bits: int) -> np.ndarray:
        """Which windows have one of the (sorted) truncated digests."""
        key = self.key >> np.uint64(64 - bits)
        short = np.uint64(max(bits - 24, 0))
        likely = np.zeros(1 << min(bits, 24), bool)
        likely[shared >> short] = True
        found = likely[key >> short]  # few others get past their leading bits
        near = np.flatnonzero(found)
        at = np.minimum(np.searchsorted(shared, key[near]), max(len(shared) - 1, 0))
        found[near] = shared[at] == key[near] if len(shared) else False
        return found

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and a digest of every segment."""
        if not len(self.key):
            return np.array([], np.int64), np.array([], np.int64), np.array([], np.uint64)
        heads = np.flatnonzero((self.place == 0) | (self.key & np.uint64(SEGMENT - 1) == 0))
        number = np.diff(np.r_[heads, len(self.key)])
        power = np.cumprod(np.full(int(number.max()), _FACTORS[2]), dtype=np.uint64)
        offset = np.arange(len(self.key)) - np.repeat(heads, number)
        return heads, number, np.add.reduceat(_mixed(self.target) * power[offset], heads)


def _tags(bodies: list[bytes | None], ids: pa.Array) -> np.ndarray:
    """0, or for several texts of one id in a chunk the place of the text among them."""
    tags, keys = np.zeros(len(ids), np.int32), ids.to_pylist()
    if len(set(keys)) < len(keys):
        often = {key for key, n in Counter(keys).items() if n > 1}
        found = {i: bodies[i] or b"" for i, key in enumerate(keys) if key in often}
        for key in often:
            mine = [i for i in found if keys[i] == key]
            order = {body: n for n, body in enumerate(sorted({found[i] for i in mine}))}
            for i in mine:
                tags[i] = order[found[i]]
    return tags


def _packed(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Sorted keys as the first one, their number, the low bits of a difference, and the Rice-coded differences."""
    steps = np.diff(keys)
    low = max(int(steps.mean()).bit_length() - 1, 0) if len(steps) else 0
    stops = np.cumsum((steps >> np.uint64(low)) + np.uint64(1)).astype(np.int64) - 1
    unary = np.zeros(stops[-1] + 1 if len(stops) else 0, np.uint8)
    unary[stops] = 1
    rest = (steps[:, None] >> np.arange(low, dtype=np.uint64)).astype(np.uint8) & 1
    return int(keys[0].view(np.int64)), len(keys), low, np.packbits(np.r_[rest.ravel(), unary]).tobytes()


def _unpacked(first: int, number: int, low: int, body: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(body, np.uint8))
    n = number - 1
    stops = np.flatnonzero(bits[n * low :])[:n].astype(np.uint64)
    steps = (np.diff(stops, prepend=np.uint64(0)) - (np.arange(n) > 0)) << np.uint64(low)
    for i in range(low):
        steps |= bits[i : n * low : low].astype(np.uint64) << np.uint64(i)
    return np.cumsum(np.r_[np.array([first], np.int64).view(np.uint64), steps], dtype=np.uint64)


def _range_of(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    return ((keys << np.uint64(64 - bits)) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)


def _fields(**kinds: pa.DataType) -> pa.Schema:
    """No field is null: joins then add no filter that would tell one use of a shuffle from another."""
    return pa.schema([pa.field(name, kind, nullable=False) for name, kind in kinds.items()])


_INT, _LONG, _BYTES = pa.int32(), pa.int64(), pa.binary()
_KEYS = dict(first=_LONG, n=_INT, low=_INT, keys=_BYTES)
_ASKED = _fields(chunk=_LONG, key_range=_INT, **_KEYS, many=_BYTES)
_ANSWER = _fields(chunk=_LONG, key_range=_INT, **_KEYS)
_SPOTS = pa.list_(pa.struct([("doc", _LONG), ("tag", _INT), ("place", _INT)]))
#: Where a chunk has a segment or an edge first, and all its places there if it has several; one column, so that every use of the rows needs
#: all of it.
_HERE = pa.struct([("doc", _LONG), ("place", _INT), ("tag", _INT), ("chunk", _LONG), ("spots", _SPOTS)])
_SEGMENT = _fields(source=_LONG, target=_LONG, digest=_LONG, number=_INT, last=_LONG, here=_HERE)
_EDGE = _fields(source=_LONG, target=_LONG, here=_HERE)
_SPANS = pa.list_(pa.struct([("start", _INT), ("words", _INT), ("first_doc", _LONG), ("first_start", _INT)]))


def _table(columns: list, schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _asked(dealt: DataFrame, windows, bits: int, ranges: int) -> DataFrame:
    """Per chunk and range the distinct digests, and which of them lie in two documents of the chunk."""

    def run(group: pa.Table) -> pa.Table:
        distinct, many = windows(group).distinct(bits)
        bounds = np.searchsorted(_range_of(distinct, bits, ranges), np.arange(ranges + 1))
        chunk, rows = group["chunk"][0].as_py(), []
        for r in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[r], bounds[r + 1]
            rows.append((chunk, int(r), *_packed(distinct[a:b]), np.packbits(many[a:b]).tobytes()))
        return _table(list(zip(*rows)) or [[]] * len(_ASKED), _ASKED)

    return dealt.groupBy("chunk").applyInArrow(run, from_arrow_schema(_ASKED))


def _key_lists(rows: pa.Table) -> list[np.ndarray]:
    return [_unpacked(*row) for row in zip(*(rows[c].to_pylist() for c in _KEYS))]


def _answered(asked: DataFrame) -> DataFrame:
    """Per chunk and range those of its digests that documents of different ids have, as far as digests tell."""

    def run(group: pa.Table) -> pa.Table:
        lists = _key_lists(group)
        marked = [k[np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)) == 1] for k, m in zip(lists, group["many"].to_pylist())]
        every = np.sort(np.concatenate(lists))
        shared = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *marked]))
        rows = []
        for chunk, key_range, keys in zip(group["chunk"].to_pylist(), group["key_range"].to_pylist(), lists):
            at = np.minimum(np.searchsorted(shared, keys), max(len(shared) - 1, 0))
            mine = keys[shared[at] == keys] if len(shared) else keys[:0]
            if len(mine):
                rows.append((chunk, key_range, *_packed(mine)))
        return _table(list(zip(*rows)) or [[]] * len(_ANSWER), _ANSWER)

    return asked.groupBy("key_range").applyInArrow(run, from_arrow_schema(_ANSWER))


def _shared(replies: pa.Table) -> np.ndarray:
    lists = _key_lists(replies.sort_by("key_range"))
    return np.concatenate(lists) if lists else np.array([], np.uint64)


def _first_rows(found: _Windows, at: np.ndarray, keys: list[np.ndarray], chunk: int) -> list:
    """Per distinct key of the windows ``at``: the keys, the last document, and where the chunk has it."""
    doc, tag, place = found.ids[found.owner[at]], found.tags[found.owner[at]], found.place[at]
    order = np.lexsort((place, tag, doc, *reversed(keys)))
    keys = [k[order] for k in keys]
    doc, tag, place = doc[order], tag[order], place[order]
    new = np.ones(len(doc), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    heads = np.flatnonzero(new)
    number = np.diff(np.r_[heads, len(doc)])
    many = np.repeat(number > 1, number)
    spots = pa.StructArray.from_arrays(
        [pa.array(c[many], f.type) for c, f in zip((doc, tag, place), _SPOTS.value_type)], fields=list(_SPOTS.value_type)
    )
    bounds = np.r_[0, np.cumsum(np.where(number > 1, number, 0))]
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32(), mask=np.r_[number <= 1, False]), spots)
    first = [doc[heads], place[heads], tag[heads], np.full(len(heads), chunk)]
    here = pa.StructArray.from_arrays([*(pa.array(c, f.type) for c, f in zip(first, _HERE)), lists], fields=list(_HERE))
    return [*(k[heads].view(np.int64) for k in keys), doc[heads + number - 1], here]


def _names(found: _Windows) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """First window and number of windows of every segment, and what it is known by: end nodes, digest and length."""
    heads, number, digest = found.segments()
    return heads, number, [found.source[heads], found.target[heads + number - 1], digest, number.astype(np.uint64)]


def _segments(dealt: DataFrame, answers: DataFrame, windows, bits: int) -> DataFrame:
    """The segments of each chunk whose windows are all marked, one row per distinct segment."""

    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows or not replies.num_rows:
            return _table([[]] * len(_SEGMENT), _SEGMENT)
        found = windows(group)
        heads, _, names = _names(found)
        whole = np.logical_and.reduceat(found.marked(_shared(replies), bits), heads) if len(heads) else np.zeros(0, bool)
        columns = _first_rows(found, heads[whole], [n[whole] for n in names], group["chunk"][0].as_py())
        columns[3] = columns[3].astype(np.int32)
        return _table(columns, _SEGMENT)

    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, from_arrow_schema(_SEGMENT))


def _edges(dealt: DataFrame, answers: DataFrame, own: DataFrame, windows, bits: int) -> DataFrame:
    """The marked windows of each chunk that no segment settles, one row per distinct window.

    These lie in segments marked in part, and in ``own``: segments that no smaller id has, in the chunk's first documents.
    """
    right = answers.unionByName(own, allowMissingColumns=True)

    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows or not replies.num_rows:
            return _table([[]] * len(_EDGE), _EDGE)
        found = windows(group)
        heads, number, keys = _names(found)
        if not len(heads):
            return _table([[]] * len(_EDGE), _EDGE)
        kept = replies.filter(replies["key_range"].is_valid())
        firsts = replies.filter(replies["key_range"].is_null())
        marked = found.marked(_shared(kept), bits)
        whole = np.flatnonzero(np.logical_and.reduceat(marked, heads))
        # the chunk's whole segments by number, with the smallest id that has each
        ids = found.ids[found.owner[heads[whole]]]
        mine = [k[whole] for k in keys]
        order = np.lexsort((ids, *mine))
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in mine], axis=0)
        names = np.empty(len(order), np.int64)
        names[order] = np.cumsum(new) - 1
        least = ids[order][new]
        open_ = np.zeros(len(least), bool)
        if firsts.num_rows:
            owners = dict(zip(zip(found.ids.tolist(), found.tags.tolist()), range(len(found.ids))))
            owner = [owners[key] for key in zip(firsts["doc"].to_pylist(), firsts["tag"].to_pylist())]
            at = np.searchsorted(heads[whole], found.begins[owner] + firsts["place"].to_numpy())
            open_[names[at]] = True
        sent = np.ones(len(heads), bool)
        sent[whole] = open_[names] & (ids == least[names])
        at = np.flatnonzero(marked & np.repeat(sent, number))
        source, target, _, here = _first_rows(found, at, [found.source[at], found.target[at]], group["chunk"][0].as_py())
        return _table([source, target, here], _EDGE)

    return dealt.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(run, from_arrow_schema(_EDGE))


def with_source(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``first``, the smallest ``here`` of their keys."""
    return rows.withColumn("first", F.min("here").over(Window.partitionBy(*keys)))


def _lost(rows: DataFrame, *columns: str) -> DataFrame:
    """A row per place whose document has a larger id than the source."""
    rows = rows.where("here.spots is not null or here.doc > first.doc")
    only = F.array(F.struct(*[F.col("here")[f.name].alias(f.name) for f in _SPOTS.value_type]))
    spots = rows.select("here.chunk", *columns, "first", F.explode(F.coalesce("here.spots", only)).alias("spot"))
    spots = spots.where("spot.doc > first.doc")
    return spots.select(
        "chunk", "spot.*", *columns, F.col("first.doc").alias("first_doc"), F.col("first.place").alias("first_place")
    )


def paths(segments: DataFrame) -> DataFrame:
    """first_doc, first_place and path_start of every repeated segment at its source: where the path that it lies on begins.

    A segment goes on the path of the one before it in its document if no other repeated segment enters or leaves the node between them.
    """
    whole = F.max("last").over(Window.partitionBy("source", "target", "digest", "number"))
    own = segments.withColumn("final", whole).where("first = here and first.doc < final")
    own = own.select("source", "target", "here.doc", "here.place", (F.col("here.place") + F.col("number")).alias("stop"))
    ends = [own.select(F.col(node).alias("node"), F.lit(way).alias("leaves"), "doc", "place", "stop") for node, way in (("source", True), ("target", False))]
    ends = ends[0].unionByName(ends[1])
    end = F.struct("doc", "place", "stop")
    nodes = ends.groupBy("node").agg(
        F.count_if("leaves").alias("out"),
        F.count(F.lit(1)).alias("ends"),
        F.max(F.when(F.col("leaves"), end)).alias("after"),
        F.max(F.when(~F.col("leaves"), end)).alias("before"),
    )
    single = nodes.where("out = 1 and ends = 2 and before.doc = after.doc and before.stop = after.place")
    joined = own.join(single.select("after.doc", "after.place", F.lit(True).alias("goes_on")), ["doc", "place"], "left")
    along = Window.partitionBy("doc").orderBy("place")
    start = F.max(F.when(F.col("goes_on").isNull(), F.col("place"))).over(along)
    return joined.select(F.col("doc").alias("first_doc"), F.col("place").alias("first_place"), start.alias("path_start"))


def repeated_spans(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    window: int = WINDOW_WORDS,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``row`` (the kept columns) and ``spans``: word ranges whose windows also start in a document with a smaller id.

    A span names the place of the same words in such a document; spans may overlap.  Ids are whole numbers.
    """
    kept = docs.columns if keep is None else keep
    total = total_bytes(docs, text)
    parts = total // chunk_bytes + 1
    bits = min(64, total.bit_length() + EXTRA_BITS)
    wide = kept if text in kept else [*kept, text]
    body = wide.index(text)
    chunk = F.pmod(F.xxhash64(named(doc_id), named(text)), F.lit(parts))
    row = F.struct(*[named(c).alias(c) for c in wide])
    # every use of the texts starts from this plan, so Spark shuffles them once
    dealt = docs.select(chunk.alias("chunk"), named(doc_id).cast("long").alias("id"), row.alias("row"))

    def bodies(group: pa.Table) -> list[bytes | None]:
        return texts(group["row"].combine_chunks().field(body))

    def windows(group: pa.Table) -> _Windows:
        return _Windows(bodies(group), group["id"].combine_chunks(), window)

    answers = _answered(_asked(dealt, windows, bits, parts))
    segments = with_source(_segments(dealt, answers, windows, bits), ["source", "target", "digest", "number"])
    own = segments.where("first.doc = here.doc and last >= here.doc").select("here.chunk", "here.doc", "here.tag", "here.place")
    edges = with_source(_edges(dealt, answers, own, windows, bits), ["source", "target"])
    lost = segments.where("last >= here.doc and (here.spots is not null or here.doc > first.doc)")
    lost = lost.withColumns({"first_doc": F.col("first.doc"), "first_place": F.col("first.place")})
    by_segment = _lost(lost.join(paths(segments), ["first_doc", "first_place"]), "number", "path_start")
    # windows of segments that are marked in part run along their source
    by_window = _lost(edges).withColumns({"number": F.lit(1), "path_start": F.lit(-1)})
    found = by_segment.unionByName(by_window)

    def spans(group: pa.Table, rows: pa.Table) -> pa.Table:
        lists: list[list] = [[] for _ in range(group.num_rows)]
        if rows.num_rows and group.num_rows:
            ids = group["id"].combine_chunks()
            owners: dict = {}
            for i, key in enumerate(zip(ids.to_pylist(), _tags(bodies(group), ids).tolist())):
                owners.setdefault(key, []).append(i)
            for doc, tag, *span in _runs(rows):
                for i in owners[doc, tag]:
                    lists[i].append((span[0], span[1] + window - 1, *span[2:]))
        names = ("start", "words", "first_doc", "first_start")
        named_lists = [[dict(zip(names, s)) for s in found] for found in lists]
        return pa.table([group["row"], pa.array(named_lists, _SPANS)], names=["row", "spans"])

    schema = StructType([dealt.schema["row"], StructField("spans", from_arrow_type(_SPANS))])
    rows = dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(spans, schema)
    if wide is kept:
        return rows
    slim = [F.col("row").getField(c).alias(c) for c in kept] or [F.lit(0).alias("none")]
    return rows.select(F.struct(*slim).alias("row"), "spans")


def _runs(rows: pa.Table) -> Iterator[tuple[int, ...]]:
    """doc, tag, place, windows, first_doc and first_place of the runs along a path; whole segments are runs already."""
    columns = ("doc", "tag", "first_doc", "path_start", "place", "number", "first_place")
    doc, tag, first_doc, path, place, number, first = (rows[c].to_numpy() for c in columns)
    order = np.lexsort((place, path, first_doc, tag, doc))
    doc, tag, first_doc, path, place, number, first = (c[order] for c in (doc, tag, first_doc, path, place, number, first))
    new = np.ones(len(doc), bool)
    same = np.all([c[1:] == c[:-1] for c in (doc, tag, first_doc, path)], axis=0)
    new[1:] = ~(same & (place[1:] == place[:-1] + number[:-1]) & (first[1:] == first[:-1] + number[:-1]))
    heads = np.flatnonzero(new)
    length = np.add.reduceat(number, heads)
    return zip(*(c[heads].tolist() for c in (doc, tag, place)), length.tolist(), *(c[heads].tolist() for c in (first_doc, first)))


def kept_words(words: list[bytes], spans: list[dict]) -> list[bytes]:
    """The words outside of the spans."""
    if not spans:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [s["start"] for s in spans], 1)
    np.add.at(edge, [s["start"] + s["words"] for s in spans], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """All rows and columns, the text of those with repeated spans replaced by the kept words, joined by one space."""
    found = repeated_spans(docs, doc_id, text, docs.columns, window)
    schema = docs.schema
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1):
                spans = part.column(2).to_pylist()
                bodies = texts(part.column(1))
                kept = [b if not s else b" ".join(kept_words(b.split(), s)) for b, s in zip(bodies, spans)]
                columns = part.column(0).flatten()
                columns[place] = pa.array(kept, pa.binary()).cast(columns[place].type)
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return found.select("row", F.col("row").getField(text).alias("body"), "spans").mapInArrow(run, schema)
