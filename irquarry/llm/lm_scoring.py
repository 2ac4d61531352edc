"""Deleted interpolation: n-gram estimates mixed by context frequency, weights from held-out counts.

A text is its words and one end token; ``order`` words of context less one are padded with a start.  An
n-gram's estimate is count(context, word) / count(context); the estimates of all orders and the uniform
one are mixed with weights that depend on how often the longest context was seen (a bucket per
power of two).  The training documents are dealt into a counting part and a held-out part; weights come
from expectation-maximisation on the held-out part's tokens under the counting part's
estimates, and scores use the counts of both parts.

How it runs: documents are packed into chunks (a stored table, one row of compressed texts each).  A chunk
asks for the counts of its distinct n-grams, as sorted 64-bit keys, and sends its own counts along; the
owner of a key range sums what all chunks sent and answers each chunk in the order asked.  So every distinct
n-gram of a chunk crosses the network once, as 8 bytes, the answers as counts, and no count table is
ever broadcast or collected.  The number of ranges follows the bytes of the corpus.

Null text counts as empty (one end token).  Repeated rows count and are scored each.  Without training
documents only the uniform estimate is left.  An empty table gives an empty result.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from irquarry.llm.common import named, sliced, stored, texts, total_bytes

ORDER = 2
#: Bytes of text per chunk and per range of keys.
CHUNK_BYTES = 8 << 20
#: Tokens of a chunk that are scored at a time.
SLICE_TOKENS = 1 << 18
BUCKETS = 24
EM_ROUNDS = 60
#: Ratios of estimates are rounded to this share of an octave before the weights are learned.
OCTAVE_STEPS = 4

# Parts of the corpus.
COUNTED, HELD, UNSEEN = 0, 1, 2

_START = np.uint64(0x5354415254)
_END = np.uint64(0x454E44)
_CHUNKS = "chunk long, part int, ids array<{id}>, sizes array<int>, body binary"


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit key of a pair of keys; wraps around."""
    key = left * np.uint64(0x9E3779B97F4A7C15) ^ ((right << np.uint64(31)) | (right >> np.uint64(33)))
    key = key * np.uint64(0xC2B2AE3D27D4EB4F)
    key ^= key >> np.uint64(29)
    key = key * np.uint64(0x165667B19E3779F9)
    return key ^ (key >> np.uint64(32))


def _chunked(docs: DataFrame, part: Column, doc_id: str, text: str, chunk_bytes: int) -> DataFrame:
    """Documents packed into rows of about ``chunk_bytes`` of text of one part of the corpus."""
    rows = docs.select(named(doc_id).alias("id"), part.alias("part"), named(text).alias("body"))
    schema = StructType.fromDDL(_CHUNKS.format(id=docs.schema[doc_id].dataType.simpleString()))
    id_kind = pa.list_(to_arrow_type(docs.schema[doc_id].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        open_chunks: dict[int, tuple[list, list[bytes]]] = {}
        weights: dict[int, int] = {}

        def closed(kind: int) -> pa.RecordBatch:
            nonlocal made
            ids, bodies = open_chunks.pop(kind)
            weights[kind] = 0
            made += 1
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(bodies))
            columns = [[first + made], [kind], [ids], [[len(b) for b in bodies]], [body]]
            kinds = [pa.int64(), pa.int32(), id_kind, pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.fieldNames()
            )

        for batch in batches:
            for piece in sliced(batch, 2):
                ids, kinds = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                for key, kind, body in zip(ids, kinds, texts(piece.column(2))):
                    chunk = open_chunks.setdefault(kind, ([], []))
                    chunk[0].append(key)
                    chunk[1].append(body or b"")
                    weights[kind] = weights.get(kind, 0) + len(body or b"") + 16
                    if weights[kind] >= chunk_bytes:
                        yield closed(kind)
        for kind in list(open_chunks):
            yield closed(kind)

    return rows.mapInArrow(run, schema)


def _ngram_keys(token: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Per order the key of the n-gram that ends at each place; what precedes a text is starts."""
    keys, beyond = [token], _START
    for _ in range(1, order):
        before = np.empty_like(token)
        before[1:] = keys[-1][:-1]
        before[first] = beyond
        keys.append(_mixed(before, token))
        beyond = _mixed(np.array([beyond]), np.array([_START]))[0]
    return keys


class _Grams:
    """The n-grams of one chunk, texts padded with ``order - 1`` starts.

    ``keys[k]``: the (k+1)-gram that ends at each place; ``real``: the places of tokens; ``bounds``: where
    each text's tokens begin among these; ``asked[k]``: the distinct keys, sorted.  The context of an n-gram
    is the shorter one that ends a place earlier, and is followed by something wherever it occurs.
    """

    def __init__(self, sizes: list[int], body: bytes, order: int):
        plain = zstandard.ZstdDecompressor().decompress(body) if sum(sizes) else b""
        known: dict[bytes, int] = {}
        flat: list[int] = []
        lengths = []
        at = 0
        for size in sizes:
            words = plain[at : at + size].lower().split()
            at += size
            flat.extend([-2] * (order - 1))
            flat.extend([known.setdefault(w, len(known)) for w in words])
            flat.append(-1)
            lengths.append(len(words) + 1)
        hashes = [xxhash.xxh64_intdigest(w) for w in known] + [int(_START), int(_END)]
        place = np.array(flat, dtype=np.int32)
        del flat, plain, known
        self.real = np.flatnonzero(place != -2)
        self.lengths = np.array(lengths, dtype=np.int64)
        self.bounds = np.cumsum(self.lengths) - self.lengths
        first = self.bounds + (order - 1) * np.arange(len(lengths))
        self.keys = _ngram_keys(np.array(hashes, dtype=np.uint64)[place], first, order)
        self.asked = [np.unique(k) for k in self.keys]

    def own(self, k: int) -> np.ndarray:
        """How often each asked key occurs here."""
        return np.bincount(np.searchsorted(self.asked[k], self.keys[k]), minlength=len(self.asked[k]))

    def slices(self) -> Iterator[_Grams]:
        """The same texts in parts of about SLICE_TOKENS tokens, each with the chunk's asked keys."""
        pads = len(self.keys) - 1
        starts = np.unique(np.searchsorted(self.bounds, np.arange(0, self.lengths.sum(), SLICE_TOKENS)))
        starts = starts[starts < len(self.bounds)]
        for i, j in zip(starts, [*starts[1:], len(self.lengths)]):
            part = copy.copy(self)
            part.lengths = self.lengths[i:j]
            part.bounds = self.bounds[i:j] - self.bounds[i]
            first = self.bounds[i] + pads * i
            last = first + part.lengths.sum() + pads * (j - i)
            part.keys = [k[first:last] for k in self.keys]
            lo, hi = np.searchsorted(self.real, (first, last))
            part.real = self.real[lo:hi] - first
            yield part

    def counts(self, answers: list[np.ndarray]) -> list[np.ndarray]:
        """Per order the corpus count at every place, from the counts of the asked keys."""
        return [c[np.searchsorted(a, k)] for a, k, c in zip(self.asked, self.keys, answers)]


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Range 0..ranges-1 of sorted keys, by their upper half: ranges are intervals of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _requests(chunks: DataFrame, order: int, ranges: int) -> DataFrame:
    """What each chunk asks for and adds: its distinct keys and own counts, cut by order and key range."""
    schema = StructType.fromDDL(
        "gram_order int, key_range int, chunk long, part int, keys array<long>, counted array<int>, held array<int>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, part, sizes, body = (batch.column(c)[row].as_py() for c in range(4))
                grams = _Grams(sizes, body, order)
                for k, keys in enumerate(grams.asked):
                    own, nothing = grams.own(k).astype(np.int32), np.zeros(len(keys), np.int32)
                    bounds = np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1)).astype(np.int32)
                    full = np.flatnonzero(np.diff(bounds))
                    values = (keys.view(np.int64), own if part == COUNTED else nothing, own if part == HELD else nothing)
                    lists = [pa.ListArray.from_arrays(bounds, v).take(pa.array(full)) for v in values]
                    same = [pa.array(np.full(len(full), v), t) for v, t in ((k, "int32"), (chunk, "int64"), (part, "int32"))]
                    yield pa.RecordBatch.from_arrays(
                        [same[0], pa.array(full, pa.int32()), same[1], same[2], *lists], names=schema.fieldNames()
                    )
                del grams  # before the next chunk's are made

    return chunks.select("chunk", "part", "sizes", "body").mapInArrow(run, schema)


_ANSWER = "gram_order int, key_range int, chunk long, part int, counted array<int>, held array<int>, sums array<long>"


def _answers(requests: DataFrame) -> DataFrame:
    """Per chunk and range the counts over all chunks, in the order asked.

    Each range also gives a row without chunk whose ``sums`` are the keys seen in training, and their counted and
    held occurrences, starts left out: for single words, the vocabulary and the number of tokens.
    """
    schema = StructType.fromDDL(_ANSWER)

    def flat(group: pa.Table, column: str) -> np.ndarray:
        return group[column].combine_chunks().flatten().to_numpy(zero_copy_only=False)

    def run(group: pa.Table) -> pa.Table:
        keys = flat(group, "keys").view(np.uint64)
        sizes = pc.list_value_length(group["keys"]).to_numpy()
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        distinct, place = np.unique(keys, return_inverse=True)
        sums = [
            np.bincount(place, weights=flat(group, c), minlength=len(distinct)).astype(np.int64)
            for c in ("counted", "held")
        ]
        word = distinct != _START
        totals = [int(((sums[0] + sums[1] > 0) & word).sum()), int(sums[0][word].sum()), int(sums[1][word].sum())]
        n = group.num_rows
        whole = {name: group[name].combine_chunks() for name in ("gram_order", "key_range", "chunk", "part")}
        replies = [pa.ListArray.from_arrays(bounds, s[place].astype(np.int32)) for s in sums]
        rows = pa.table(
            [*whole.values(), *replies, pa.nulls(n, pa.list_(pa.int64()))], names=schema.fieldNames()
        )
        none = pa.nulls(1, pa.list_(pa.int32()))
        total = pa.table(
            [
                whole["gram_order"][:1],
                whole["key_range"][:1],
                pa.nulls(1, pa.int64()),
                pa.nulls(1, pa.int32()),
                none,
                none,
                pa.array([totals], pa.list_(pa.int64())),
            ],
            names=schema.fieldNames(),
        )
        return pa.concat_tables([rows, total])

    return requests.groupBy("gram_order", "key_range").applyInArrow(run, schema)


def _answered(answers: pa.Table, order: int, column: str) -> list[np.ndarray]:
    """Per order the counts of a chunk's asked keys: the ranges' answers one after another."""
    found = []
    for k in range(order):
        mine = answers.filter(pc.equal(answers["gram_order"], k)).sort_by("key_range")
        found.append(mine[column].combine_chunks().flatten().to_numpy(zero_copy_only=False))
    return found


def _estimates(grams: _Grams, at: list[np.ndarray], tokens: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order the estimate at each token, and the bucket of its longest context."""
    estimates = [at[0][grams.real] / max(tokens, 1)]
    context = np.zeros(len(grams.real))
    for k in range(1, len(at)):
        context = at[k - 1][grams.real - 1].astype(np.float64)
        count = at[k][grams.real]
        estimates.append(np.divide(count, context, out=np.zeros(len(context)), where=context > 0))
    bucket = np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)
    return estimates, np.minimum(bucket, BUCKETS - 1)


def learned_weights(cells: list[tuple[int, list[int | None], int]], order: int) -> np.ndarray:
    """Mixture weights per bucket: the uniform estimate's first, then those of orders 1 and up.

    ``cells``: (bucket, rounded log2 ratio of each order's estimate to the uniform one or None for zero, tokens).
    Expectation-maximisation from equal weights; a bucket without tokens takes the weights of all tokens.
    """

    def fit(rows: list) -> np.ndarray:
        ratio = np.array([[1.0] + [0.0 if r is None else 2.0 ** (r / OCTAVE_STEPS) for r in x[1]] for x in rows])
        number = np.array([x[2] for x in rows], dtype=np.float64)
        mixture = np.full(order + 1, 1.0 / (order + 1))
        for _ in range(EM_ROUNDS):
            joint = ratio * mixture
            share = joint / joint.sum(axis=1, keepdims=True)
            mixture = (share * number[:, None]).sum(axis=0) / number.sum()
        mixture = np.maximum(mixture, 1e-6)  # any text keeps a probability
        return mixture / mixture.sum()

    table = np.tile(fit(cells) if cells else np.full(order + 1, 1.0 / (order + 1)), (BUCKETS, 1))
    for bucket in {c[0] for c in cells}:
        table[bucket] = fit([c for c in cells if c[0] == bucket])
    return table


def _cells(chunks: DataFrame, answers: DataFrame, order: int, tokens: int, types: int) -> list:
    """The held-out tokens as cells of bucket and rounded ratios; the rounding bounds their number."""
    schema = StructType.fromDDL("bucket int, ratios array<int>, tokens long")

    def run(held: pa.Table, replies: pa.Table) -> pa.Table:
        found = []
        counted = _answered(replies, order, "counted")
        for i in range(held.num_rows):
            for grams in _Grams(held["sizes"][i].as_py(), held["body"][i].as_py(), order).slices():
                estimates, bucket = _estimates(grams, grams.counts(counted), tokens)
                with np.errstate(divide="ignore"):
                    ratios = [np.rint(np.log2(e * (types + 1)) * OCTAVE_STEPS) for e in estimates]
                marks = np.stack([bucket, *[np.where(np.isfinite(r), r, 1 << 20) for r in ratios]], axis=1)
                cells, number = np.unique(marks.astype(np.int64), axis=0, return_counts=True)
                lists = [[None if r == 1 << 20 else r for r in c[1:]] for c in cells.tolist()]
                columns = [pa.array(cells[:, 0], pa.int32()), pa.array(lists, pa.list_(pa.int32())), pa.array(number)]
                found.append(pa.table(columns, names=schema.fieldNames()))
        return pa.concat_tables(found) if found else to_arrow_schema(schema).empty_table()

    held = chunks.where(F.col("part") == HELD).select("chunk", "sizes", "body")
    replies = answers.where(F.col("part") == HELD).select("chunk", "gram_order", "key_range", "counted")
    found = held.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)
    summed = found.groupBy("bucket", "ratios").agg(F.sum("tokens").alias("tokens"))
    return [(r["bucket"], r["ratios"], r["tokens"]) for r in summed.collect()]


def _scores(
    chunks: DataFrame, answers: DataFrame, order: int, tokens: int, types: int, weights: np.ndarray
) -> DataFrame:
    id_kind = chunks.schema["ids"].dataType.elementType.simpleString()
    schema = StructType.fromDDL(
        f"doc_id {id_kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )

    def run(texts_of: pa.Table, replies: pa.Table) -> pa.Table:
        made = []
        counts = [a.astype(np.int64) + b for a, b in zip(*(_answered(replies, order, c) for c in ("counted", "held")))]
        for i in range(texts_of.num_rows):
            grams = _Grams(texts_of["sizes"][i].as_py(), texts_of["body"][i].as_py(), order)
            columns = [scores_of(part, part.counts(counts)) for part in grams.slices()]
            ids = texts_of["ids"].slice(i, 1).combine_chunks().flatten()
            train = pa.array(np.full(len(ids), tokens))
            known, base, score = (pa.array(np.concatenate(c)) for c in zip(*columns))
            values = [ids, pa.array(grams.lengths), known, train, base, score]
            made.append(pa.table(values, names=schema.fieldNames()))
        return pa.concat_tables(made) if made else to_arrow_schema(schema).empty_table()

    def scores_of(grams: _Grams, at: list[np.ndarray]) -> list[np.ndarray]:
        """Per text the known tokens, the base score and the model's."""
        count = at[0][grams.real]
        base = np.log10((count + 0.5) / (tokens + 0.5 * (types + 1)))
        estimates, bucket = _estimates(grams, at, tokens)
        mixture = weights[bucket]
        chance = mixture[:, 0] / (types + 1)
        for k, estimate in enumerate(estimates):
            chance = chance + mixture[:, k + 1] * estimate
        values = ((count > 0).astype(np.int64), base, np.log10(chance))
        return [np.add.reduceat(v, grams.bounds) for v in values]

    replies = answers.select("chunk", "gram_order", "key_range", "counted", "held")
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


def score(
    docs: DataFrame,
    training_part: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document.

    ``training_part``: COUNTED, HELD (it teaches the weights, then counts too) or UNSEEN (scored only).
    ``base_score`` is an additive single-word score, ``score`` the interpolated model's: log10 of the
    probability of the text and its end.
    """
    chunks = stored(_chunked(docs, training_part, doc_id, text, chunk_bytes), "lm-chunks")
    ranges = int(total_bytes(docs, text) // chunk_bytes) + 1
    answers = stored(_answers(_requests(chunks, order, ranges)), "lm-counts")
    words = answers.where(F.col("chunk").isNull() & (F.col("gram_order") == 0))
    sums = words.agg(*[F.coalesce(F.sum(F.get("sums", F.lit(i))), F.lit(0)) for i in range(3)]).head()
    types, counted, held = (int(x) for x in sums)
    replies = answers.where(F.col("chunk").isNotNull())
    weights = learned_weights(_cells(chunks, replies, order, counted, types), order)
    return _scores(chunks, replies, order, counted + held, types, weights)
