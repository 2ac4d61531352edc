"""Truth-table survival words: what every subset and every order of a set of filters keeps.

A document's word has a bit per subset S of the filters (bit number S, filters as binary digits), set if no filter of S
rejects it.  Words of one part and label are added bit by bit with carry-save adders: three words become a sum word and
a carry word of twice the weight, until each weight has one word left, a plane.  Planes of all tasks are summed in
Spark, so a part of any size sends a few dozen planes per batch.  Survivors per subset then give every order of the filters.

Filters: A under 200 words, B distinct words under half of the words, C more than 2 % of the code points in A-Z,
D any of ``#$%&*|``, E text identical to that of a smaller id, whatever was removed.

Null text counts as empty, null part as the empty string.  A null id is neither smaller nor greater than any: its row fails no E,
makes no other fail it, and has no label.  Repeated rows count each; rows that share id and text do not fail E by each other.
Labels of one id are joined by "any".  Texts of any length are read whole, one at a time.  Other columns are ignored
whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irquarry.llm.common import WORD, named

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 2
#: Salts of rows without id in the join with the labels.
NULL_SALTS = 64


def survival_word(failed: int) -> int:
    """Bit S is set if none of the ``failed`` filters (a mask) is in S."""
    return sum(1 << subset for subset in range(SUBSETS) if not subset & failed)


def _failed(docs: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """id, digest, part, mask of the failed filters but the last, and n, the number of such rows."""
    rows = docs.select(
        named(doc_id).alias("id"),
        F.coalesce(named(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(named(text).cast("string"), F.lit("")).alias("body"),
    )
    rows = rows.withColumn("words", F.regexp_extract_all("body", F.lit(WORD), F.lit(0)))
    n = F.size("words")
    fails = (
        n < MIN_WORDS,
        100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * n,
        100 * F.regexp_count("body", F.lit("[A-Z]")) > UPPER_PERCENT * F.length("body"),
        F.col("body").rlike(r"[#$%&*|]"),
    )
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    digest = F.unhex(F.sha2("body", 256))
    rows = rows.select("id", digest.alias("digest"), "part", mask.alias("mask"))
    return rows.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))


def words(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, good, toxic, word and n, the number of documents, of distinct documents in no order.

    No join meets a hot key: rows of one id are counted first, and a text's first id is joined by text and id.
    """
    rows = _failed(docs, doc_id, text, part)
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id")).where("id is not null").withColumn("first", F.lit(True))
    rows = rows.join(firsts, ["digest", "id"], "left")
    copy = (F.col("id").isNotNull() & F.col("first").isNull()).cast("int")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id"))
    known = known.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NULL_SALTS))).otherwise(0)
    rows = rows.withColumn("salt", salt).join(known.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
    table = F.array(*[F.lit(survival_word(m)) for m in range(SUBSETS)])
    word = F.get(table, F.col("mask") + copy * (1 << (len(FILTERS) - 1)))
    flags = [F.coalesce(c, F.lit(False)).alias(name) for c, name in ((F.col("good"), "good"), (F.col("bad"), "toxic"))]
    return rows.select("part", *flags, word.alias("word"), "n")


def planes(group: np.ndarray, word: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, groups, planes) of sorted groups: a bit of a plane counts 2 ** level, and a group has one plane a level."""
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for level in range(int(times.max(initial=0)).bit_length()):
        has = (times >> level) & 1 == 1
        waiting[level] = [(group[has], word[has])]
    while waiting:
        level = min(waiting)
        pieces = waiting.pop(level)
        g, w = (np.concatenate(c) for c in zip(*pieces))
        order = np.argsort(g, kind="stable")
        g, w = g[order], w[order]
        while True:
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.array([], np.int64)
            if len(first) == len(g):
                break
            rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
            heads = np.flatnonzero(rank % 3 == 0)
            triple = np.zeros((3, len(heads)), w.dtype)
            triple[rank % 3, np.cumsum(rank % 3 == 0) - 1] = w
            a, b, c = triple
            carry = (a & b) | (c & (a ^ b))
            up = carry != 0
            if up.any():
                waiting.setdefault(level + 1, []).append((g[heads][up], carry[up]))
            g, w = g[heads], a ^ b ^ c
        yield level, g, w


def survivors(found: DataFrame) -> DataFrame:
    """part and ``alive``, ``good``, ``toxic``: per subset the survivors, those of quality 1, and the toxic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "good", "toxic", "level", "plane"]
        for batch in batches:
            part = batch.column(0).dictionary_encode()
            good, toxic = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            group = part.indices.to_numpy().astype(np.int64) * 4 + good * 2 + toxic
            word, times = (batch.column(i).to_numpy() for i in (3, 4))
            for level, groups, plane in planes(group, word.astype(np.uint32), times):
                yield pa.RecordBatch.from_arrays(
                    [
                        part.dictionary.take(pa.array(groups // 4)),
                        pa.array(groups // 2 % 2 == 1),
                        pa.array(groups % 2 == 1),
                        pa.array(np.full(len(groups), level, np.int32)),
                        pa.array(plane.astype(np.int64)),
                    ],
                    names=names,
                )

    found = found.select("part", "good", "toxic", "word", "n")
    kept = found.mapInArrow(run, "part string, good boolean, toxic boolean, level int, plane long")
    bits = kept.select("*", F.explode(F.sequence(F.lit(0), F.lit(SUBSETS - 1))).alias("subset"))
    count = F.expr("shiftleft(shiftright(plane, subset) & 1L, level)")
    sums = bits.groupBy("part", "subset").agg(
        F.sum(count).alias("alive"),
        F.sum(F.when(F.col("good"), count).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), count).otherwise(0)).alias("toxic"),
    )
    rows = F.sort_array(F.collect_list(F.struct("subset", "alive", "good", "toxic")))
    return sums.groupBy("part").agg(rows.alias("rows")).select("part", "rows.alive", "rows.good", "rows.toxic")


def _shapley(alive: Column, i: int) -> Column:
    """What filter i removes, summed over all orders of the filters: the orders with S before it number |S|! (4 - |S|)!."""
    total = F.lit(0).cast("long")
    for subset in range(SUBSETS):
        if not subset >> i & 1:
            before = subset.bit_count()
            orders = math.factorial(before) * math.factorial(len(FILTERS) - 1 - before)
            total = total + orders * (F.get(alive, F.lit(subset)) - F.get(alive, F.lit(subset | 1 << i)))
    return total


def audit(found: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from ``survivors``."""
    sums = survivors(found)
    shares = F.array(*[_shapley(F.col("alive"), i) for i in range(len(FILTERS))])
    rows = sums.withColumn("shares", shares).withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = f"instr('{FILTERS}', substr(filter_order, {{}}, 1)) - 1"
    before = f"aggregate(filter(sequence(1, {len(FILTERS)}), i -> i < step), 0, (s, i) -> s + shiftleft(1, {place.format('i')}))"
    rows = rows.withColumns({"at": F.expr(place.format("step")), "before": F.expr(before)})
    rows = rows.withColumn("after", F.expr("before + shiftleft(1, at)"))
    whole = SUBSETS - 1
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.expr("alive[after]").alias("kept"),
        F.expr("alive[before] - alive[after]").alias("removed"),
        F.expr("alive[0] - alive[shiftleft(1, at)] - (alive[before] - alive[after])").alias("redundant"),
        F.expr(f"alive[{whole} - shiftleft(1, at)] - alive[{whole}]").alias("unique_fails"),
        F.expr("good[before] - good[after]").alias("good_lost"),
        F.expr("toxic[before] - toxic[after]").alias("toxic_lost"),
        F.expr("shares[at]").alias("shapley"),
    )
