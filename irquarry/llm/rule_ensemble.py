"""Sparse rule ensemble: tree paths as conjunctive rules over text statistics, weighted by a lasso, compiled to columns.

Statistics of each text are measured in one pass.  A forest of shallow trees is grown on labelled texts; every path
from a root to a node is a rule.  A logistic regression with an L1 penalty gives each rule a weight, most of
them zero; what is left is compiled into one Spark column expression.

The fit takes at most ``sample`` labelled texts, chosen by a hash of the id.  Null text counts as empty; its statistics are
zero.  Ids with several labels count once, with the largest.  Without labelled texts of both classes the score is the share of
label 1 (0.5 if there are no labels).  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irquarry.llm.common import measured, named, one_text, stored

#: Labelled texts the model is fitted on, at most.
SAMPLE = 20000
TREES = 24
DEPTH = 3
PENALTY = 0.002
SEED = 11
#: Partitions of the bounded sample while it is fitted.
FIT_PARTITIONS = 4

STATISTICS = (
    "log_words", "mean_word", "symbol_words", "upper", "digits", "punctuation", "bangs", "pipes", "distinct_words",
    "top_word", "repeat_lines", "long_words", "letter_words", "marks_at_end", "spaces", "repeat_pairs",
)
FIELDS = ", ".join(f"{s} double" for s in STATISTICS)

_ODD = b"#*$%&|<>{}\\^~=@_"
_MARKS = string.punctuation.encode()
_DIGITS = string.digits.encode()
_UPPER = string.ascii_uppercase.encode()
_NO_LETTERS = string.whitespace.encode() + _DIGITS + _MARKS


def _number_of(body: bytes, chars: bytes) -> int:
    return len(body) - len(body.translate(None, chars))


def statistics(body: bytes) -> tuple[float, ...]:
    """The values of STATISTICS; shares lie in 0..1 but for marks, which may exceed one a word."""
    words = body.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    size = len(body)
    counts = Counter(words)
    letters = max(size - _number_of(body, _NO_LETTERS), 1)
    lines = [line for line in body.split(b"\n") if line.strip()]
    pairs = Counter(zip(words, words[1:]))
    return (
        math.log1p(n),
        sum(map(len, words)) / n,
        _number_of(body, _ODD) / n,
        _number_of(body, _UPPER) / letters,
        _number_of(body, _DIGITS) / size,
        _number_of(body, _MARKS) / n,
        body.count(b"!") / n,
        body.count(b"|") / n,
        len(counts) / n,
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        sum(len(w) > 20 for w in words) / n,
        sum(w.isalpha() or not w.isascii() for w in words) / n,
        sum(w[-1:] in b"!#$%&*|~" for w in words) / n,
        (size - sum(map(len, words))) / size,
        1 - len(pairs) / max(n - 1, 1) if n > 1 else 0.0,
    )


def with_statistics(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``row`` (the kept columns) and ``out`` (FIELDS) of every document."""
    return measured(docs, text, FIELDS, lambda bodies: [statistics(b or b"") for b in bodies], keep)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is at most, threshold), and its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self, statistic) -> Column:
        met = F.lit(True)
        for name, at_most, threshold in self.terms:
            met = met & (statistic(name) <= threshold if at_most else statistic(name) > threshold)
        return met


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self, statistic) -> Column:
        """The probability of label 1 as a column expression; ``statistic`` gives the column of a name."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + F.when(rule.holds(statistic), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def _paths(tree) -> list[tuple[tuple[str, bool, float], ...]]:
    """The conjunctions from the root of a tree to each of its nodes."""
    found: list[tuple[tuple[str, bool, float], ...]] = []
    stack = [(tree._call_java("rootNode"), ())]
    while stack:
        node, terms = stack.pop()
        if terms:
            found.append(_tightest(terms))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            name, threshold = STATISTICS[split.featureIndex()], split.threshold()
            stack.append((node.leftChild(), (*terms, (name, True, threshold))))
            stack.append((node.rightChild(), (*terms, (name, False, threshold))))
    return found


def _tightest(terms: tuple[tuple[str, bool, float], ...]) -> tuple[tuple[str, bool, float], ...]:
    """One term per statistic and side."""
    kept: dict[tuple[str, bool], float] = {}
    for name, at_most, threshold in terms:
        key = (name, at_most)
        pick = min if at_most else max
        kept[key] = threshold if key not in kept else pick(kept[key], threshold)
    return tuple(sorted((name, at_most, threshold) for (name, at_most), threshold in kept.items()))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Ensemble:
    """The ensemble from labelled texts; ``labels`` has doc_id and label (0 or 1, others left out).

    Only the chosen texts are measured here.
    """
    marked = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = marked.groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded: may be broadcast
    rows = docs.select(named(doc_id).alias("doc_id"), named(text).alias("body"))
    drawn = one_text(rows.join(F.broadcast(chosen), "doc_id"))  # a repeated id counts once
    drawn = drawn.select("label", F.col("body").alias("text"))
    known = stored(with_statistics(drawn, ["label"]).select("row.label", "out.*"), "rules-sample")
    known = known.coalesce(FIT_PARTITIONS)  # bounded as well
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    zeros, ones = sizes.get(0.0, 0), sizes.get(1.0, 0)
    if not zeros or not ones:
        share = 0.5 if not zeros + ones else min(max(ones / (zeros + ones), 1e-6), 1 - 1e-6)
        return Ensemble((), math.log(share / (1 - share)))
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(known)
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=5, featureSubsetStrategy="0.5", seed=SEED
    ).fit(vectors)
    paths = list(dict.fromkeys(p for tree in forest.trees for p in _paths(tree)))
    rules = [Rule(p) for p in paths]
    if not rules:
        return Ensemble((), math.log(ones / zeros))
    names = [f"rule_{i}" for i in range(len(rules))]
    held = known.select("label", *[r.holds(F.col).cast("double").alias(n) for r, n in zip(rules, names)])
    table = VectorAssembler(inputCols=names, outputCol="features").transform(held).select("label", "features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False).fit(table)
    weights = lasso.coefficients.toArray()
    kept = tuple(Rule(r.terms, float(w)) for r, w in zip(rules, weights) if w)
    return Ensemble(kept, float(lasso.intercept))
