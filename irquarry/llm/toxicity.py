"""Character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

Features are character n-grams inside words (edges marked, A-Z lowered), present or absent in a text.  The number of
labelled texts of either class that hold an n-gram is counted in Spark; the n-grams whose counts tell most are
kept, each scaled by its smoothed log-count ratio; a logistic regression with an L2 penalty gives the
weights.  A text's score is the probability of label 1.

The fit takes at most ``sample`` labelled texts, chosen by a hash of the id; everything else is over whole texts.  Null and
empty texts score by the intercept alone.  Ids with several labels count once, with the largest.  Without labelled
texts of both classes the score is the share of label 1 (0.5 if there are no labels).  An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irquarry.llm.common import measured, named, one_text, sliced, stored, texts

#: Labelled texts the model is fitted on, at most.
SAMPLE = 12000
ORDERS = (3, 4, 5)
LONGEST_WORD = 64
MIN_TEXTS = 4
FEATURES = 1000
SMOOTHING = 1.0
PENALTY = 2.0
STEPS = 250
#: Words a task remembers; beyond it starts afresh.
REMEMBERED = 200_000


@lru_cache(maxsize=20_000)
def grams(word: bytes) -> frozenset[bytes]:
    """Character n-grams of a word between its marked edges; a word longer than LONGEST_WORD is cut into such parts."""
    found = set()
    for at in range(0, len(word), LONGEST_WORD):
        marked = b" " + word[at : at + LONGEST_WORD + 4] + b" "
        for n in ORDERS:
            found.update([marked[i : i + n] for i in range(len(marked) - n + 1)])
    return frozenset(found)


@dataclass
class Model:
    """Contribution of each n-gram, and the intercept."""

    weights: dict[bytes, float]
    intercept: float
    memory: dict[bytes, tuple] = field(default_factory=dict, compare=False, repr=False)

    def hits(self, body: bytes) -> set[bytes]:
        """The model's n-grams that the text holds."""
        found: set[bytes] = set()
        memory, weights = self.memory, self.weights
        for word in set(body.lower().split()):
            mine = memory.get(word)
            if mine is None:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                mine = memory[word] = tuple(g for g in grams(word) if g in weights)
            if mine:
                found.update(mine)
        return found

    def probability(self, body: bytes | None) -> float:
        total = self.intercept + math.fsum(self.weights[g] for g in self.hits(body or b""))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, total))))


def _gram_counts(sample: DataFrame) -> DataFrame:
    """(gram, zeros, ones): how many labelled texts of either class hold each n-gram; summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 0):
                tally: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
                for body, label in zip(texts(part.column(0)), part.column(1).to_pylist()):
                    held: set[bytes] = set()
                    for word in set((body or b"").lower().split()):
                        held |= grams(word)
                    mine = tally[label]
                    for gram in held:
                        mine[gram] = mine.get(gram, 0) + 1
                every = list(tally[0].keys() | tally[1].keys())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(every, pa.binary()),
                        pa.array([tally[0].get(g, 0) for g in every], pa.int64()),
                        pa.array([tally[1].get(g, 0) for g in every], pa.int64()),
                    ],
                    names=["gram", "zeros", "ones"],
                )

    counted = sample.select("body", "label").mapInArrow(run, "gram binary, zeros long, ones long")
    return counted.groupBy("gram").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))


def _regression(places: list[list[int]], labels: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights over the scaled features and the intercept, by accelerated gradient steps on the penalised loss."""
    rows = np.repeat(np.arange(len(places)), [len(p) for p in places])
    columns = np.fromiter((c for p in places for c in p), np.int64, len(rows))
    values = ratios[columns]
    n = len(labels)
    size = np.bincount(rows, values**2, minlength=n).max(initial=1.0) + 1.0
    step = 1.0 / (0.25 * size + PENALTY / n)
    weight, ahead = np.zeros(len(ratios)), np.zeros(len(ratios))
    bias = bias_ahead = math.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5))
    for turn in range(STEPS):
        margin = np.bincount(rows, values * ahead[columns], minlength=n) + bias_ahead
        error = 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40))) - labels
        slope = np.bincount(columns, values * error[rows], minlength=len(ratios)) / n + PENALTY / n * ahead
        new, new_bias = ahead - step * 20 * slope, bias_ahead - 2.0 * error.mean()
        push = turn / (turn + 3)
        ahead, bias_ahead = new + push * (new - weight), new_bias + push * (new_bias - bias)
        weight, bias = new, new_bias
    return weight, bias


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """The model from labelled texts; ``labels`` has doc_id and label (0 or 1, others left out)."""
    marked = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = marked.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded: may be broadcast
    rows = docs.select(named(doc_id).alias("doc_id"), named(text).alias("body"))
    drawn = one_text(rows.join(F.broadcast(chosen), "doc_id"))  # a repeated id counts once
    drawn = stored(drawn.select("body", "label"), "toxicity-sample")
    sizes = {r["label"]: r["count"] for r in drawn.groupBy("label").count().collect()}
    zeros, ones = sizes.get(0, 0), sizes.get(1, 0)
    if not zeros or not ones:
        share = 0.5 if not zeros + ones else min(max(ones / (zeros + ones), 1e-6), 1 - 1e-6)
        return Model({}, math.log(share / (1 - share)))
    a, b = F.col("ones"), F.col("zeros")
    ratio = F.log(((a + SMOOTHING) / (ones + 2 * SMOOTHING)) / ((b + SMOOTHING) / (zeros + 2 * SMOOTHING)))
    counts = _gram_counts(drawn).where(a + b >= MIN_TEXTS).withColumn("ratio", ratio)
    # how far an n-gram's count of label 1 lies from its expectation, in standard deviations
    expected = (a + b) * (ones / (zeros + ones))
    tells = F.abs(a - expected) / F.sqrt(expected + 1.0)
    kept = counts.orderBy(tells.desc(), "gram").limit(FEATURES).select("gram", "ratio").collect()
    if not kept:
        return Model({}, math.log(ones / zeros))
    place = {bytes(r["gram"]): i for i, r in enumerate(kept)}
    ratios = np.array([r["ratio"] for r in kept])
    probe = Model(dict.fromkeys(place, 0.0), 0.0)

    def held(bodies: list[bytes | None]) -> list[tuple]:
        return [([place[g] for g in probe.hits(b or b"")],) for b in bodies]

    found = measured(drawn, "body", "places array<int>", held, ["label"]).collect()
    target = np.array([r["row"]["label"] for r in found], dtype=np.float64)
    weight, bias = _regression([r["out"]["places"] for r in found], target, ratios)
    return Model({g: float(weight[i] * ratios[i]) for g, i in place.items()}, float(bias))


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``row`` (the kept columns) and ``out.score`` of every document; a scan."""
    return measured(docs, text, "score double", lambda bodies: [(model.probability(b),) for b in bodies], keep)
