"""Operators that work text by text: quality rules, TIFF, toxicity, the rule ensemble."""

import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from irquarry.llm import common, quality_rules, queries, rule_ensemble, tiff, toxicity
from irquarry.llm.common import measured


@pytest.mark.parametrize("codec", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
def test_tiff_round_trip(codec, predictor, tile):
    rng = np.random.default_rng(codec + predictor + tile)
    pages = [rng.integers(0, 256, (37, 20)).astype(np.uint8), np.full((5, 200), 7, np.uint8)]
    rows = tiff.page_rows(tiff.encode(pages, codec, predictor, rows=10, tile=tile))
    assert [r[7] for r in rows] == [p.tobytes() for p in pages]
    assert [r[0] for r in rows] == [0, 1]


def test_tiff_known_streams():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.packbits_decode(packed, len(plain)) == plain
    long = bytes(np.random.default_rng(1).integers(0, 7, 30000).astype(np.uint8))
    assert tiff.lzw_decode(tiff.lzw_encode(long), len(long)) == long


def test_tiff_broken_files(spark, table):
    good = tiff.encode([np.zeros((2, 3), np.uint8)])
    files = table([(1, good), (2, b"junk"), (3, None), (4, good[:20])], "page int, media binary")
    rows = {r["row"]["page"]: r["page"] for r in tiff.pages(files).collect()}
    assert rows[1]["pixels"] == bytes(6) and rows[1]["error"] is None
    assert all(rows[i]["page"] == -1 and rows[i]["error"] for i in (2, 3, 4))
    assert tiff.pages(files.limit(0)).count() == 0


def test_fitted_bands_tell_held_out_labels_apart(spark):
    folder = "/root/testdata/sf0.1"
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    labels = common.table(spark, folder, "labels").select("doc_id", "quality")
    bands = quality_rules.fitted(docs, queries.learnable(common.table(spark, folder, "labels"), "quality"))
    rows = quality_rules.judged(docs, ["doc_id"], bands=bands).select("row.doc_id", "out.kept", "out.base_failed")
    held = rows.join(labels, "doc_id").where(common.crc_remainder(rows["doc_id"], 4) == 2).where("not base_failed")
    shares = {r["quality"]: (r["kept"], r["n"]) for r in held.groupBy("quality").agg(
        F.count_if("kept").alias("kept"), F.count("*").alias("n")).collect()}
    assert shares[1][0] >= 0.98 * shares[1][1]
    assert shares[0][0] <= 0.25 * shares[0][1]


def test_junk_in_a_fifth_of_a_text(table):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnoprstu"), rng.integers(2, 9))) for _ in range(400)]
    prose = [" ".join(rng.choice(words, 1600)) for _ in range(60)]
    junk = " ".join(rng.permutation(words[:12]).tolist() * 40)[:1800]
    spoilt = prose[0][: 4 * len(prose[0]) // 5] + " " + junk
    docs = table([*enumerate(prose), (99, spoilt)], "doc_id long, text string")
    labels = table([(i, 1) for i in range(1, 60)], "doc_id long, label int")
    bands = quality_rules.fitted(docs, labels)
    rows = {r["row"]["doc_id"]: r["out"] for r in quality_rules.judged(docs, ["doc_id"], bands=bands).collect()}
    assert rows[0]["kept"] and not rows[99]["kept"] and not rows[99]["base_failed"]
    assert quality_rules.fitted(docs, labels.limit(0)) == quality_rules.WIDE
    assert quality_rules.fitted(docs.limit(0), labels) == quality_rules.WIDE


def test_bands_are_fitted_on_every_good_text(spark, table):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghijklmnoprstu"), 5)) for _ in range(120)]
    prose = [" ".join(rng.permutation(words).tolist()) for _ in range(8)]
    known = {quality_rules.whole_class(len(p.encode())) for p in prose}
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    rows = rows.unionByName(table([(-1 - i, p) for i, p in enumerate(prose)], "doc_id long, text string"))
    labels = rows.select("doc_id", F.lit(1).alias("label"))
    bands = quality_rules.fitted(rows, labels)
    assert len(known) == 1 and set(bands.wholes) == known


def test_compression_bands(table):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnoprstu"), rng.integers(2, 9))) for _ in range(300)]
    noise = "".join(chr(c) for c in rng.integers(33, 127, 4000))
    noisy = " ".join(noise[i : i + 9] for i in range(0, 4000, 9))
    stamp = "\n".join(" ".join(rng.permutation(words[:8])) for _ in range(60))
    texts = {"prose": " ".join(words), "loop": "one two three " * 100, "noise": noisy, "stamp": stamp, "none": None, "empty": ""}
    docs = table([(k, v, 1) for k, v in texts.items()], "n_words string, text string, kept int")
    rows = {r["row"]["n_words"]: r["out"] for r in quality_rules.judged(docs).collect()}
    assert rows["prose"]["kept"] and not rows["prose"]["base_failed"]
    assert rows["loop"]["base_failed"] and not rows["loop"]["kept"]
    assert not rows["noise"]["kept"] and not rows["noise"]["base_failed"]
    assert not rows["stamp"]["kept"]
    assert rows["none"]["n_words"] == rows["empty"]["n_words"] == 0 and not rows["none"]["kept"]
    assert quality_rules.judged(docs.limit(0)).count() == 0


def test_base_counts():
    text = "a b c a b c\nx # é\n\nx # é\n \t\n".encode()
    n_words, chars, symbols, lines, repeats, failed = quality_rules.verdict(text)[:6]
    assert (n_words, chars, symbols, lines, failed) == (12, 12, 2, 1, True)
    assert repeats == 12


def _labelled(table, good, bad, n=120):
    rng = np.random.default_rng(5)
    stem = ["".join(rng.choice(list("aeinrst"), 5)) for _ in range(200)]
    rows, marks = [], []
    for i in range(n):
        words = list(rng.choice(stem, 40))
        label = i % 3 == 0
        rows.append((i, (good if label else bad)(words), i))
        marks.append((i, int(label)))
    rows += [(1000, None, 0), (1001, "", 0), (None, "x", 0), (1000, None, 0)]
    marks += [(0, 0), (None, 1), (5000, 1), (3, None)]
    return table(rows, "doc_id long, text string, score int"), table(marks, "doc_id long, label int")


def test_toxicity_learns_its_words(spark, table):
    docs, labels = _labelled(table, lambda w: " ".join([*w, "zquix", "Blorg"]), " ".join)
    model = toxicity.fit(docs, labels)
    assert model.probability(b"some zquix and blorg here") > 0.7 > 0.3 > model.probability(b"some and here")
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["out"]["score"] <= 1 for r in rows)
    one = toxicity.fit(docs, labels.where("label = 1"))
    assert toxicity.scored(docs.limit(0), one).count() == 0
    assert toxicity.fit(docs.limit(0), labels).probability(b"x") == pytest.approx(0.5)


def test_rules_compile_to_columns(spark, table):
    docs, labels = _labelled(table, " ".join, lambda w: " ".join(x + "%%%" for x in w))
    model = rule_ensemble.fit(docs, labels)
    assert model.rules
    rows = rule_ensemble.with_statistics(docs)
    scored = rows.select("row", model.score(lambda n: rows["out"][n]).alias("p")).collect()
    for r in scored:
        if r["row"]["doc_id"] is not None and 0 < r["row"]["doc_id"] < 1000:
            assert (r["p"] > 0.7) == (r["row"]["doc_id"] % 3 == 0)
    empty = rule_ensemble.fit(docs.limit(0), labels)
    assert empty.rules == () and empty.intercept == 0.0


def test_a_repeated_id_weighs_as_one_text(table):
    docs, labels = _labelled(table, lambda w: " ".join([*w, "zquix"]), lambda w: " ".join(x + "%%%" for x in w))
    once = docs.where("doc_id < 1000")
    often = once.union(once.where("doc_id = 4").crossJoin(once.sparkSession.range(300)).drop("id"))
    one, many = toxicity.fit(once, labels), toxicity.fit(often, labels)
    assert one.intercept == pytest.approx(many.intercept) and one.weights == pytest.approx(many.weights)
    one, many = rule_ensemble.fit(once, labels), rule_ensemble.fit(often, labels)
    assert one.intercept == pytest.approx(many.intercept, abs=0.2) and one.rules and many.rules


def test_very_long_text_is_read_whole(table):
    text = "word " * 400_000 + "end"
    docs = table([(1, text)], "doc_id long, text string")
    crc = measured(docs, "text", "crc long", lambda b: [(zlib.crc32(x),) for x in b]).head()["out"]["crc"]
    assert crc == zlib.crc32(text.encode())
