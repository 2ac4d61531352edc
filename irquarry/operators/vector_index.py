"""Indexes over vectors: inverted lists for approximate search, blocks by direction for exact search that passes blocks over.

A vector of unit length lies in the list of its nearest centre and is kept there as one byte per piece of what is left
after the centre is taken off.  A query looks into the lists whose centres it scores best, adds up table entries
for the bytes, and has its best candidates scored exactly.  Centres and code books are learned in Spark from a
bounded sample; every vector is indexed.  How many lists and candidates a query needs is measured on a bounded
sample of the queries against exact search.

Lists and queries meet as pairs of bounded blocks, so a list of many copies is split, and a task hands on only the best candidates of
each query.  Vectors of zero length are in no list and match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irquarry.operators.retrieval import (
    BLOCK_ROWS,
    DIGITS,
    TILE_ROWS,
    _first_k,
    _matrix,
    best_of,
    by_span,
    paired_blocks,
    spans_of,
    topk,
    topk_lists,
)
from irquarry.session import new_work_path

#: Vectors that centres and code books are learned from, at most about so many, and rounds of learning.
TRAINING_ROWS = 1 << 18
ROUNDS = 8
#: Lists at most; values of a code and numbers a code stands for.
MOST_LISTS = 1 << 14
CODES = 256
PIECE = 4
#: Queries that probes and candidates are chosen on, share of their exact hits to reach with each, and candidates at most.
TUNING_QUERIES = 256
AIMED_SHARE = 0.97
MOST_CANDIDATES = 4096


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of those that have a length, and which these are."""
    rows = _matrix(column)
    real = ~np.isnan(rows).any(axis=1) if rows.size else np.zeros(len(column), bool)
    return rows[real] if rows.size else rows.reshape(0, 0), real


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    found = np.empty(len(rows), np.int64)
    half = (centres * centres).sum(axis=1) / 2
    step = max(1, (1 << 22) // max(len(centres), 1))
    for at in range(0, len(rows), step):
        found[at : at + step] = np.argmax(rows[at : at + step] @ centres.T - half, axis=1)
    return found


def _pieces(rows: np.ndarray, width: int) -> np.ndarray:
    """pieces x rows x width; the last piece is filled up with zeros."""
    pieces = -(-rows.shape[1] // width)
    wide = np.zeros((len(rows), pieces * width))
    wide[:, : rows.shape[1]] = rows
    return wide.reshape(len(rows), pieces, width).transpose(1, 0, 2)


@dataclass(frozen=True)
class VectorIndex:
    """``centres`` (lists x dimensions) and ``books`` (pieces x codes x width)."""

    centres: np.ndarray
    books: np.ndarray

    def encoded(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes (rows x pieces) of unit rows."""
        lists = _nearest(rows, self.centres)
        rest = _pieces(rows - self.centres[lists], self.books.shape[2])
        return lists, np.stack([_nearest(r, b) for r, b in zip(rest, self.books)], axis=1).astype(np.uint8)

    def estimates(self, rows: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Estimated cosines of unit rows with the vectors of one list."""
        tables = np.einsum("prw,pcw->prc", _pieces(rows, self.books.shape[2]), self.books)
        total = np.repeat((rows @ self.centres[at])[:, None], len(codes), axis=1)
        for table, code in zip(tables, codes.T):
            total += table[:, code]
        return total

    def entries(self, vectors: DataFrame) -> DataFrame:
        """point_id, list and codes of every vector."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, real = _unit(batch.column(1))
                if not len(rows):
                    continue
                lists, codes = self.encoded(rows)
                ids = batch.column(0).filter(pa.array(real))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())],
                    names=["point_id", "list", "codes"],
                )

        rows = _with_length(vectors).select(F.col("point_id").cast("long"), "embedding")
        return rows.mapInArrow(run, "point_id long, list int, codes binary")

    def asked(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id, embedding and the lists that each query looks into, a row per list."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, real = _unit(batch.column(1))
                if not len(rows):
                    continue
                best = np.argsort(-(rows @ self.centres.T), axis=1, kind="stable")[:, :probes]
                whole = batch.filter(pa.array(real))
                lists = pa.array(best.tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([whole.column(0), whole.column(1), lists], names=["query_id", "embedding", "lists"])

        rows = _with_length(queries).select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"))
        rows = rows.mapInArrow(run, "query_id long, embedding array<double>, lists array<int>")
        return rows.select("query_id", "embedding", F.explode("lists").alias("list"))

    def candidates(self, queries: DataFrame, entries: DataFrame, probes: int, count: int, skip_self: bool = False) -> DataFrame:
        """query_id, point_id and rank of the ``count`` best estimates of each query."""

        def run(key, q: pa.Table, v: pa.Table) -> pa.Table:
            found = [(np.array([], np.int64), np.array([], np.int64), np.array([], np.float64))]
            if q.num_rows and v.num_rows:
                codes = np.frombuffer(b"".join(v["codes"].to_pylist()), np.uint8).reshape(v.num_rows, -1)
                ids, rows, points = q["q_query_id"].to_numpy(), _matrix(q["q_embedding"]), v["point_id"].to_numpy()
                last = max(len(points) - count, 0)
                for at in range(0, len(rows), TILE_ROWS):
                    mine = ids[at : at + TILE_ROWS]
                    scores = np.round(self.estimates(rows[at : at + TILE_ROWS], key[0].as_py(), codes), DIGITS)
                    if skip_self:
                        scores[mine[:, None] == points[None, :]] = -np.inf
                    kth = np.partition(scores, last, axis=1)[:, last]
                    r, c = np.nonzero((scores >= kth[:, None]) & np.isfinite(scores))
                    found.append(_first_k(mine[r], points[c], scores[r, c], count))
            columns = [pa.array(np.concatenate(c)) for c in zip(*found)]
            return pa.table(columns, names=["query_id", "point_id", "score"])

        pairs = paired_blocks(self.asked(queries, probes), entries, ["list"], holds="codes", span_rows=BLOCK_ROWS)
        best = best_of(pairs.applyInArrow(run, "query_id long, point_id long, score double"), count, [])
        return best.select("query_id", "point_id", "rank")

    def search(
        self, queries: DataFrame, vectors: DataFrame, k: int, probes: int, count: int, skip_self: bool = False
    ) -> DataFrame:
        """query_id, point_id, score and rank of the best ``k`` of ``count`` candidates per query, scored exactly."""
        return rescored(self.candidates(queries, self.entries(vectors), probes, count, skip_self), queries, vectors, k)


def rescored(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The best ``k`` candidates of each query by exact cosine."""
    asked = queries.select("query_id", F.col("embedding").alias("q"))
    known = vectors.select("point_id", F.col("embedding").alias("v"))
    pairs = candidates.select("query_id", "point_id").join(asked, "query_id").join(known, "point_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = np.round((_matrix(batch.column(2)) * _matrix(batch.column(3))).sum(axis=1), DIGITS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(score)], names=["query_id", "point_id", "score"]
                )

    scored = pairs.select("query_id", "point_id", "q", "v").mapInArrow(run, "query_id long, point_id long, score double")
    return best_of(scored, k, [])


def _with_length(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.size("embedding") > 0)


def _improved(sample: DataFrame, books: np.ndarray, centres: np.ndarray | None) -> np.ndarray:
    """One round of k-means for every book: partial sums per task, means in Spark, at most one row per code to the driver."""
    number, codes, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros(books.shape), np.zeros((number, codes), np.int64)
        for batch in batches:
            rows, _ = _unit(batch.column(0))
            if not len(rows):
                continue
            if centres is not None:
                rows = rows - centres[_nearest(rows, centres)]
            for b, piece in enumerate(_pieces(rows, width)):
                code = _nearest(piece, books[b])
                count[b] += np.bincount(code, minlength=codes)
                for j in range(width):
                    sums[b, :, j] += np.bincount(code, weights=piece[:, j], minlength=codes)
        b, c = np.nonzero(count)
        if len(b):
            columns = [pa.array(b, pa.int32()), pa.array(c, pa.int32()), pa.array(count[b, c]), pa.array(sums[b, c].tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["book", "code", "n", "sums"])

    parts = sample.select("embedding").mapInArrow(run, "book int, code int, n long, sums array<double>")
    means = F.array(*[F.sum(F.get("sums", F.lit(i))) / F.sum("n") for i in range(width)])
    better = books.copy()
    for r in parts.groupBy("book", "code").agg(means.alias("mean")).collect():
        better[r["book"], r["code"]] = r["mean"]
    return better


def fit(vectors: DataFrame, lists: int | None = None, rounds: int = ROUNDS) -> VectorIndex | None:
    """Centres and code books from at most about TRAINING_ROWS vectors; None without vectors of some length.

    ``lists`` is the square root of the number of vectors unless given, and MOST_LISTS at most.
    """
    spark = vectors.sparkSession
    rows = _with_length(vectors).select("point_id", "embedding")
    share = rows.count() // TRAINING_ROWS + 1
    path = new_work_path(spark, "training")
    drawn = rows.where(F.pmod(F.xxhash64("point_id"), F.lit(share)) == 0)
    drawn.select(F.xxhash64(F.lit(1), "point_id").alias("draw"), "point_id", F.col("embedding").cast("array<float>")).write.parquet(path)
    sample = spark.read.parquet(path)
    n = sample.count()
    wanted = min(MOST_LISTS, lists or max(1, round((n * share) ** 0.5)))
    first = sample.orderBy("draw", "point_id").limit(max(wanted, CODES)).select("embedding").toArrow()
    start, _ = _unit(first["embedding"].combine_chunks()) if first.num_rows else (np.zeros((0, 0)), None)
    if not len(start):
        return None
    centres = start[:wanted][None]
    for _ in range(rounds):
        centres = _improved(sample, centres, None)
    centres = centres[0]
    left = start[:CODES] - centres[_nearest(start[:CODES], centres)]
    books = np.ascontiguousarray(_pieces(left, min(PIECE, left.shape[1])))
    for _ in range(rounds):
        books = _improved(sample, books, centres)
    return VectorIndex(centres, books)


def tuned(index: VectorIndex, queries: DataFrame, vectors: DataFrame, k: int, skip_self: bool = False) -> tuple[int, int]:
    """Lists to look into and candidates to score, so that each finds AIMED_SHARE of the exact hits of a sample of the queries."""
    sample = _with_length(queries).select("query_id", "embedding")
    sample = sample.orderBy(F.xxhash64("query_id"), "query_id").limit(TUNING_QUERIES)
    hits = topk(sample, vectors, k, skip_self=skip_self).select("query_id", "point_id")
    asked = sample.withColumnRenamed("embedding", "q")
    pairs = hits.join(asked, "query_id").join(vectors.select("point_id", F.col("embedding").alias("v")), "point_id")
    pairs = pairs.select("query_id", "point_id", "q", "v").toArrow()
    if not pairs.num_rows:
        return 1, k
    asked_rows, found_rows = (_matrix(pairs[c]) for c in ("q", "v"))
    scores = asked_rows @ index.centres.T
    own = scores[np.arange(len(scores)), _nearest(found_rows, index.centres)]
    probes = _reaching((scores > own[:, None] - 1e-12).sum(axis=1))
    ranks = index.candidates(sample, index.entries(vectors), probes, MOST_CANDIDATES, skip_self)
    known = {(r["query_id"], r["point_id"]): r["rank"] for r in ranks.join(hits, ["query_id", "point_id"]).collect()}
    found = [known.get(pair, MOST_CANDIDATES) for pair in zip(*(pairs[c].to_pylist() for c in ("query_id", "point_id")))]
    inside = np.array([r for r in found if r < MOST_CANDIDATES] or [MOST_CANDIDATES])
    return probes, max(k, _reaching(inside))


def _reaching(needed: np.ndarray) -> int:
    """The least number that AIMED_SHARE of the needs do not exceed."""
    return int(np.sort(needed)[int(np.ceil(AIMED_SHARE * len(needed))) - 1])


def nearest(queries: DataFrame, vectors: DataFrame, k: int, skip_self: bool = False, lists: int | None = None) -> DataFrame:
    """Approximate top k: an index is fitted and tuned, then all queries are searched.  Runs jobs."""
    index = fit(vectors, lists)
    if index is None:
        return topk(queries, vectors, k, skip_self=skip_self)
    probes, count = tuned(index, queries, vectors, k, skip_self)
    return index.search(queries, vectors, k, probes, count, skip_self)


@dataclass(frozen=True)
class Directions:
    """Blocks of vectors by direction: unit ``centres`` and the cosine of the widest angle in each; above 1 for an empty block."""

    centres: np.ndarray
    cosines: np.ndarray

    def bounds(self, rows: np.ndarray) -> np.ndarray:
        """The highest cosine that a unit row can have with a vector of each block."""
        near = np.clip(rows @ self.centres.T, -1, 1)
        # angle to the centre less the block's angle, by the law for the difference of two angles
        sine = np.sqrt(np.maximum(1 - near * near, 0)) * np.sqrt(np.maximum(1 - self.cosines * self.cosines, 0))
        return np.where(near >= self.cosines, 1.0, near * self.cosines + sine)


def directions(vectors: DataFrame, lists: int | None = None) -> tuple[Directions, DataFrame] | None:
    """Blocks by direction and the vectors (point_id, embedding, list) in them; None without vectors of some length.

    Centres are learned as for the index, every vector lies in the block of its nearest one, and a block's angle is that of its farthest vector.
    """
    index = fit(vectors, lists)
    if index is None:
        return None
    norms = np.linalg.norm(index.centres, axis=1, keepdims=True)
    centres = index.centres / np.where(norms > 0, norms, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, real = _unit(batch.column(1))
            if not len(rows):
                continue
            near = rows @ centres.T
            lists = np.argmax(near, axis=1)
            whole = batch.filter(pa.array(real))
            columns = [whole.column(0), whole.column(1), pa.array(lists, pa.int32()), pa.array(near[np.arange(len(lists)), lists])]
            yield pa.RecordBatch.from_arrays(columns, names=["point_id", "embedding", "list", "near"])

    rows = _with_length(vectors).select(F.col("point_id").cast("long"), F.col("embedding").cast("array<double>"))
    placed = rows.mapInArrow(run, "point_id long, embedding array<double>, list int, near double")
    path = new_work_path(vectors.sparkSession, "directions")
    placed.write.parquet(path)
    placed = vectors.sparkSession.read.schema(placed.schema).parquet(path)
    cosines = np.full(len(centres), np.inf)  # an empty block bounds nothing
    for r in placed.groupBy("list").agg(F.min("near").alias("near")).collect():
        cosines[r["list"]] = min(r["near"] - SLACK, 1.0)
    return Directions(centres, np.where(np.isinf(cosines), 2.0, np.maximum(cosines, -1.0))), placed.drop("near")


#: Room for rounding when a bound is compared with a score.
SLACK = 1e-8
#: Blocks that the first round of a pruned search looks into.
FIRST_BLOCKS = 2


def _looking(queries: DataFrame, blocks: Directions, first: bool, spans: int) -> DataFrame:
    """query_id, embedding, span and the lists of it that are looked into: in the first round the blocks of the highest bounds, in the second
    those of the others that may hold a score as good as the query's k-th (``kth``)."""
    step = max(1, (1 << 22) // len(blocks.cosines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = blocks.cosines > 1
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            rows, real = _unit(batch.column(1))
            if not len(rows):
                continue
            whole = batch.filter(pa.array(real))
            bound = blocks.bounds(rows)
            bound[:, empty] = -np.inf
            order = np.argsort(-bound - rows @ blocks.centres.T / 4, axis=1, kind="stable")
            early = np.zeros(bound.shape, bool)
            np.put_along_axis(early, order[:, :FIRST_BLOCKS], True, axis=1)
            early[:, empty] = False
            if first:
                chosen = [np.flatnonzero(e) for e in early]
            else:
                kth = whole.column(2).to_numpy(zero_copy_only=False)
                chosen = [np.flatnonzero(~e & ~empty & (b >= (-2 if np.isnan(t) else t) - SLACK)) for e, b, t in zip(early, bound, kth)]
            yield by_span(whole, chosen, spans)

    rows = _with_length(queries).select(
        F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"), *([] if first else [F.col("kth")])
    )
    return rows.mapInArrow(run, "query_id long, embedding array<double>, span int, lists array<int>")


def pruned_topk(
    queries: DataFrame, vectors: DataFrame, k: int = 3, skip_self: bool = False, lists: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows of exact ``topk``, and n_looked and n_skipped: pairs of a query and a block that were compared or passed over.

    Vectors lie in blocks by direction.  A first round searches the blocks a query can score best in; its k-th score there
    rules out every block whose bound lies below it, and a second round searches the rest.
    """
    made = directions(vectors, lists)
    spark = queries.sparkSession
    if made is None:
        none = spark.createDataFrame([], "n_looked long, n_skipped long")
        return topk(queries, vectors, k, skip_self=skip_self), none
    blocks, placed = made
    spans = spans_of(placed)

    def searched(looking: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        paths = [new_work_path(spark, f"{name}-{part}") for part in ("looking", "hits")]
        looking.write.parquet(paths[0])
        looking = spark.read.schema(looking.schema).parquet(paths[0])
        hits = topk_lists(looking, placed, k, spans, skip_self).select("query_id", "point_id", "score")
        hits.write.parquet(paths[1])
        return looking, spark.read.schema(hits.schema).parquet(paths[1])

    first, near = searched(_looking(queries, blocks, True, spans), "first")
    best = best_of(near, k, [])
    kth = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    second, rest = searched(_looking(queries.join(kth, "query_id", "left"), blocks, False, spans), "second")
    looked = first.select("lists").unionByName(second.select("lists")).agg(F.coalesce(F.sum(F.size("lists")), F.lit(0)).alias("n_looked"))
    pairs = _with_length(queries).agg(F.count(F.lit(1))).scalar() * int((blocks.cosines <= 1).sum())
    counts = looked.select("n_looked", (pairs - F.col("n_looked")).alias("n_skipped"))
    return best_of(near.unionByName(rest), k, []), counts
