"""Compression bands: texts that compress too well are repetitive, those that do not compress carry no language.

The ratio (compressed / plain bytes, zstandard) of the whole text and of each fixed chunk must lie within limits that
depend on the text's length.  ``fitted`` takes the limits from texts known to be good; without them, or at lengths of
which too few are known, wide limits hold that only extremes exceed.  Word, symbol and repetition counts come along, as columns and as a base rule.

Null text counts as empty: all counts 0, rejected by the base rule.  A last chunk shorter than half a chunk is left to
the whole ratio.  Equal texts get equal verdicts.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irquarry.llm.common import measured, named, one_text

LEVEL = 3
CHUNK_BYTES = 1024
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

#: Length in bytes up to which a band holds, least and largest whole ratio.  Short texts compress less; the limits
#: lie well outside of what prose reaches.
WHOLE_BANDS = (
    (512, 0.45, 0.85),
    (1024, 0.42, 0.76),
    (2048, 0.38, 0.70),
    (4096, 0.35, 0.66),
    (16384, 0.32, 0.64),
    (float("inf"), 0.28, 0.62),
)
#: Least and largest ratio of a chunk, and the percentage of chunks that may lie outside.
CHUNK_BAND = (0.30, 0.76)
MAX_ODD_CHUNKS_PERCENT = 10
#: The share of good texts left outside on either side, of texts and of chunks, and texts or chunks that a class of lengths needs.
WHOLE_TAIL = 0.005
CHUNK_TAIL = 0.002
MIN_KNOWN = 8

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "whole_ratio double, odd_chunks long, n_chunks long, kept boolean"
)


def whole_class(n_bytes: int) -> int:
    """Half octaves of the length."""
    return math.floor(2 * math.log2(n_bytes))


def chunk_class(n_bytes: int) -> int:
    """Eighths of a chunk."""
    return 8 * n_bytes // CHUNK_BYTES


@dataclass(frozen=True)
class Bands:
    """Least and largest ratio per class of lengths; classes not listed keep the wide limits."""

    wholes: dict[int, tuple[float, float]] = field(default_factory=dict)
    chunks: dict[int, tuple[float, float]] = field(default_factory=dict)

    def whole(self, n_bytes: int) -> tuple[float, float]:
        found = self.wholes.get(whole_class(n_bytes))
        return found or next((low, high) for limit, low, high in WHOLE_BANDS if n_bytes <= limit)

    def chunk(self, n_bytes: int) -> tuple[float, float]:
        return self.chunks.get(chunk_class(n_bytes), CHUNK_BAND)


WIDE = Bands()


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL)


def ratio(body: bytes) -> float:
    return len(_compressor().compress(body)) / len(body)


def chunk_ratios(body: bytes, size: int = CHUNK_BYTES) -> list[tuple[int, float]]:
    """Length and ratio of consecutive chunks; a rest below half a chunk is left out."""
    chunks = [body[i : i + size] for i in range(0, len(body), size)]
    return [(len(c), ratio(c)) for c in chunks if len(c) >= size // 2]


def repeat_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows that occur twice or more; each word counts once."""
    if len(words) <= window:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    if len(known) == len(words):
        return 0
    key = ids[: len(ids) - window + 1]
    for k in range(1, window):
        pair = key * len(known) + ids[k : len(ids) - window + 1 + k]
        # renumbered, so that the next product stays below 64 bits
        key = np.unique(pair, return_inverse=True)[1]
    again = np.bincount(key)[key] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(window):
        covered[k : len(ids) - window + 1 + k] |= again
    return int(covered.sum())


def duplicate_lines(body: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in body.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def verdict(body: bytes, bands: Bands = WIDE) -> tuple:
    """The values of FIELDS for one text."""
    words = body.split()
    chars = sum(len(w) for w in words) if body.isascii() else sum(len(w.decode("utf-8", "replace")) for w in words)
    repeats = repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    whole, odd, chunks, kept = None, 0, 0, False
    if body:
        whole = ratio(body)
        ratios = chunk_ratios(body) if len(body) > CHUNK_BYTES else [(len(body), whole)]
        limits = [(bands.chunk(n) if len(body) > CHUNK_BYTES else CHUNK_BAND, r) for n, r in ratios]
        odd = sum(not low <= r <= high for (low, high), r in limits)
        chunks = len(ratios)
        low, high = bands.whole(len(body))
        kept = not failed and low <= whole <= high and 100 * odd <= MAX_ODD_CHUNKS_PERCENT * chunks
    symbols = sum(body.count(bytes([s])) for s in SYMBOLS)
    return len(words), chars, symbols, duplicate_lines(body), repeats, failed, whole, odd, chunks, kept


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Bands:
    """Limits from all texts that ``labels`` (doc_id, label) calls good (1) and the base rule passes.

    Per class of lengths the outer quantiles of the ratio, moved away from the median by a share that shrinks with the
    number of texts known.
    """
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("label").alias("least"))
    rows = docs.select(named(doc_id).alias("doc_id"), named(text).alias("body"))
    good = one_text(rows.join(chosen.where("least = 1").select("doc_id"), "doc_id"))

    def compute(bodies: list[bytes | None]) -> list[tuple]:
        found = []
        for body in bodies:
            words = (body or b"").split()
            cells = []
            if len(words) >= MIN_WORDS and 100 * repeat_words(words) <= MAX_REPEAT_PERCENT * len(words):
                cells.append((True, whole_class(len(body)), ratio(body)))
                if len(body) > CHUNK_BYTES:
                    cells += [(False, chunk_class(n), r) for n, r in chunk_ratios(body)]
            found.append(([dict(zip(("whole", "class", "ratio"), c)) for c in cells],))
        return found

    cells = measured(good, "body", "cells array<struct<whole: boolean, class: int, ratio: double>>", compute, [])
    cells = cells.select(F.inline("out.cells"))
    quantiles = {
        "whole_low": WHOLE_TAIL,
        "chunk_low": CHUNK_TAIL,
        "middle": 0.5,
        "chunk_high": 1 - CHUNK_TAIL,
        "whole_high": 1 - WHOLE_TAIL,
    }
    marks = [F.percentile_approx("ratio", q, 10000).alias(name) for name, q in quantiles.items()]
    bands = Bands()
    for r in cells.groupBy("whole", "class").agg(F.count("*").alias("n"), *marks).where(F.col("n") >= MIN_KNOWN).collect():
        side = "whole" if r["whole"] else "chunk"
        more = 0.1 + 2 / math.sqrt(r["n"])
        low, middle, high = r[f"{side}_low"], r["middle"], r[f"{side}_high"]
        target = bands.wholes if r["whole"] else bands.chunks
        target[r["class"]] = (low - more * (middle - low), high + more * (high - middle))
    return bands


def judged(docs: DataFrame, keep: list[str] | None = None, text: str = "text", bands: Bands = WIDE) -> DataFrame:
    """``row`` (the kept columns) and ``out`` (FIELDS) of every document."""
    return measured(docs, text, FIELDS, lambda bodies: [verdict(b or b"", bands) for b in bodies], keep)
