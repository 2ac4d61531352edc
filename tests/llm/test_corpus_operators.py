"""Operators that shuffle: packing, language-model scores, near duplicates, shards, mixing, archive."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from irquarry.llm import curriculum, lm_scoring, near_dedup, packing, queries, sharding, warc
from irquarry.session import new_work_path

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "word", "It's  a\ttest\n\n", "é中 <|endoftext|> x" * 3, "a" * 5000, "long text " * 3000, "same", "same"]


@pytest.fixture(scope="module")
def odd(table):
    rows = [(i if i != 3 else None, t, "s" if i % 2 else None, i) for i, t in enumerate(ODD)]
    return table(rows, "doc_id long, text string, source string, size int")


def test_packing_places_every_id_once(odd):
    tokenizer = Tokenizer.from_file(packing.byte_bpe()["tokenizer"])
    tokenizer.encode_special_tokens = True
    rows = packing.pack(odd, length=64, group_pieces=50).collect()
    for i, text in enumerate(ODD):
        key = i if i != 3 else None
        mine = sorted((r for r in rows if r["doc_id"] == key), key=lambda r: r["start"])
        assert sum((r["ids"] for r in mine), []) == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert [r["start"] for r in mine] == list(np.cumsum([0] + [r["length"] for r in mine])[:-1])
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(odd.limit(0)).count() == 0


def test_first_fit_takes_the_first_bin_with_room():
    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True)
    room: list[int] = []
    want = []
    for size in sizes:
        place = next((i for i, r in enumerate(room) if r >= size), len(room))
        if place == len(room):
            room.append(100)
        room[place] -= size
        want.append(place)
    assert packing.first_fit(sizes, 100) == want


def _brute_lm(rows, order):
    """Counts by dictionary, the same weights procedure on exact cells, scores one by one."""
    words = {k: [w for w in (t or "").encode().lower().split()] + ["</s>"] for k, (t, _) in rows.items()}
    counts = [[Counter() for _ in range(order)] for _ in range(2)]
    for k, (_, part) in rows.items():
        if part < 2:
            padded = ["<s>"] * (order - 1) + words[k]
            for i in range(len(padded)):
                for n in range(order):
                    gram = tuple(padded[max(0, i - n) : i + 1])
                    gram = ("<s>",) * (n + 1 - len(gram)) + gram
                    counts[part][n][gram] += 1
    def estimates(k, table, tokens):
        padded = ["<s>"] * (order - 1) + words[k]
        for i in range(order - 1, len(padded)):
            found = [table[0][(padded[i],)] / max(tokens, 1)]
            context = 0
            for n in range(1, order):
                context = table[n - 1][tuple(padded[i - n : i])]
                found.append(table[n][tuple(padded[i - n : i + 1])] / context if context else 0.0)
            yield found, min(int(math.log2(context)) + 1, lm_scoring.BUCKETS - 1) if context else 0
    both = [a + b for a, b in zip(*counts)]
    real = lambda c: {g: n for g, n in c.items() if g != ("<s>",)}
    types, counted = len(real(both[0])), sum(real(counts[0][0]).values())
    cells = Counter()
    for k, (_, part) in rows.items():
        if part == 1:
            for found, bucket in estimates(k, counts[0], counted):
                ratio = tuple(
                    round(math.log2(e * (types + 1)) * lm_scoring.OCTAVE_STEPS) if e else None for e in found
                )
                cells[bucket, ratio] += 1
    weights = lm_scoring.learned_weights([(b, list(r), n) for (b, r), n in cells.items()], order)
    tokens = sum(real(both[0]).values())
    scores = {}
    for k in rows:
        total = 0.0
        for found, bucket in estimates(k, both, tokens):
            mixture = weights[bucket]
            total += math.log10(mixture[0] / (types + 1) + sum(m * e for m, e in zip(mixture[1:], found)))
        scores[k] = total
    return tokens, scores


@pytest.mark.parametrize("order", [1, 2, 3])
def test_interpolation_against_brute_force(table, order):
    rng = random.Random(4)
    rows = {i: (" ".join(rng.choice("abcdeFGH") for _ in range(rng.randint(0, 40))), i % 3) for i in range(60)}
    rows[60], rows[61] = (None, 0), ("", 2)
    docs = table([(k, t, p, 0) for k, (t, p) in rows.items()], "doc_id long, text string, part int, score int")
    tokens, want = _brute_lm(rows, order)
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, F.col("part"), order=order, chunk_bytes=300).collect()}
    assert len(got) == len(rows)
    for k, score in want.items():
        assert got[k]["train_tokens"] == tokens
        assert got[k]["score"] == pytest.approx(score, rel=1e-6)


def test_interpolation_without_training(table):
    docs = table([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = lm_scoring.score(docs, F.lit(2)).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {1: 3, 2: 1} and all(r["score"] <= 0 for r in rows)
    assert lm_scoring.score(docs.limit(0), F.lit(0)).count() == 0


def _classes(prints, radius=4):
    values = sorted(set(prints))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[root(b)] = root(a)
    return {v: root(v) for v in values}


def test_links_against_all_pairs(spark):
    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:100]:
        for _ in range(4):
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            prints.add(p)
    frame = spark.createDataFrame([(near_dedup._signed(p),) for p in prints], "print long")
    want = _classes(prints)
    for homes in (16, 100_000):
        found = near_dedup.components(near_dedup.links(frame, shard_homes=homes)).collect()
        label = {r["node"] % (1 << 64): r["label"] for r in found}
        sizes = Counter(want.values())
        assert set(label) == {p for p in prints if sizes[want[p]] > 1}
        groups = defaultdict(set)
        for p, name in label.items():
            groups[name].add(want[p])
        assert all(len(g) == 1 for g in groups.values())
        assert len(groups) == sum(n > 1 for n in sizes.values())


def test_fingerprint_and_classes(odd):
    def brute(text):
        words = (text or "").encode().lower().split()
        if not words:
            return 0
        parts = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = near_dedup.near_duplicates(odd).collect()
    assert Counter(r["fingerprint"] for r in rows) == Counter(f"{brute(t):016x}" for t in ODD)
    assert {r["component_id"] for r in rows if r["doc_id"] in (0, 1, 2)} == {0}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert len({r["component_id"] for r in rows}) == kept.count()
    assert near_dedup.near_duplicates(odd.limit(0)).count() == near_dedup.keep_one(odd.limit(0)).count() == 0


def test_keep_one_against_brute_force(table):
    rng = random.Random(8)
    texts = {}
    for family in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([8, 60, 150, 300]))]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(words)
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in texts.items() for w in [t.split()]}
    label = dict.fromkeys(sets)
    for k in sets:
        if label[k] is None:
            open_, label[k] = [k], k
            while open_:
                a = open_.pop()
                for b in sets:
                    if label[b] is None and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                        label[b] = k
                        open_.append(b)
    docs = table(list(texts.items()), "doc_id long, text string")
    kept = [r["doc_id"] for r in near_dedup.keep_one(docs).collect()]
    assert sorted(kept) == sorted(set(label.values()))
    prints = {k: near_dedup.fingerprint(t.encode()) for k, t in texts.items()}
    assert any(label[a] == label[b] and (prints[a] ^ prints[b]).bit_count() > 4 for a in texts for b in texts)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "left long, right long")
    assert near_dedup.components(edges).select("label").distinct().count() == 1


def test_growth_takes_rows_only_into_the_new_shard(odd, spark):
    tree = sharding.topology(24)
    rows = sharding.shard_documents(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), tree)
    rows = rows.collect()
    assert all(r["grown_shard"] in (r["shard"], 24) for r in rows) and any(r["grown_shard"] == 24 for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(slots) == 24 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    odd_rows = sharding.shard_documents(odd, tree).collect()
    assert sorted(r["size"] for r in odd_rows) == sorted(len((t or "").encode()) + 8 for t in ODD)
    assert sharding.shard_documents(odd.limit(0), tree).count() == 0


def test_weights_steer_shards(spark):
    tree = [sharding.Shard(0, 0, 0, 3.0), sharding.Shard(1, 0, 1, 1.0)]
    share = spark.range(4000).select(sharding.assigned(F.col("id"), tree).alias("s")).where("s = 0").count() / 4000
    assert 0.71 < share < 0.79


def test_mix_meets_its_targets(odd, table):
    rows = curriculum.assigned(odd, []).collect()
    total = sum(r["size"] for r in rows)
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(total)
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and len(r["positions"]) == r["whole"] + (r["part_words"] > 0)
        assert all(0 <= p <= 1 for p in r["positions"])
    assert all(abs(taken[r["source"]] - r["target"]) <= 1 for r in rows)
    assert curriculum.mixed(odd).columns == odd.columns
    assert curriculum.mixed(odd.limit(0)).count() == curriculum.assigned(odd.limit(0), []).count() == 0


def test_targets_share_out_the_excess(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 100), ("c", 400), (None, 90)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in curriculum.targets(sources).collect()}
    sizes, weights = {"a": 10, "b": 100, "c": 400, None: 90}, {"a": 5, "b": 2, "c": 1, None: 5}
    want, free = {}, dict(weights)
    while True:
        rest = 600 - sum(want.values())
        over = [s for s in free if rest * free[s] / sum(free.values()) > 3 * sizes[s]]
        if not over:
            want |= {s: rest * w / sum(free.values()) for s, w in free.items()}
            break
        for s in over:
            want[s] = 3 * sizes[s]
            free.pop(s)
    assert got == pytest.approx(want)


def test_demand_is_inverted(spark):
    schedule = (1.5, 1.0, 0.5)
    times = np.linspace(0, 1, 21)
    demand = [1.5 * t - 0.5 * t * t for t in times]
    frame = spark.createDataFrame([(float(d),) for d in demand], "d double")
    got = [r[0] for r in frame.select(curriculum.inverted(F.col("d"), schedule)).collect()]
    assert got == pytest.approx(list(times), abs=1e-9)


def test_archive_round_trip(spark, table):
    big, small = "x" * 150, "tiny"
    pages = [(3, "http://a", big), (1, "http://b\r\nX: y", big), (2, None, small), (4, "u", small), (5, "u", None),
             (None, "u", big), (6, "u", ""), (1, "again", big)]
    frame = table(pages, "page_id long, url string, html string")
    folder = new_work_path(spark, "archive-test")
    warc.write(frame, folder)
    rows = warc.restored(spark, folder).collect()
    assert len(rows) == len(pages)
    kinds = Counter((r["page"], r["record_type"], r["refers_to"]) for r in rows)
    assert kinds[("1", "response", None)] == 2 and kinds[("3", "revisit", "1")] == 1 and kinds[(None, "revisit", "1")] == 1
    assert kinds[("2", "response", None)] == kinds[("4", "response", None)] == kinds[("5", "response", None)] == 1
    assert spark.read.parquet(f"{folder}/payloads").count() == 3
    for r in rows:
        body = bytes(r["record"]).split(b"\r\n\r\n", 1)[1]
        assert body == (b"" if r["record_type"] == "revisit" else bytes(r["payload"])) + b"\r\n\r\n"
    spoiled = new_work_path(spark, "archive-spoiled")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{spoiled}/headers")
    wrong = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.lit(b"other"))
    wrong.write.parquet(f"{spoiled}/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read(spark, spoiled).select("payload_digest").collect()


def test_queries_give_a_row_per_document(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("op4_sharding", "op5_quality_rules", "op6_tiff", "op8_curriculum"):
        assert queries.queries()[name](spark, SMALL).count() == n, name


def test_payload_is_read_back(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op6_tiff(spark, SMALL).collect():
        payload = docs[r["doc_id"]].ljust(r["payload_bytes"], b"\xff")
        assert r["payload_bytes"] % 576 == 0 and r["tail_crc32"] == zlib.crc32(payload[-32:])


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SMALL)
    assert kept.columns == docs.columns
    got = {r["doc_id"] for r in kept.collect()}
    want = {r["doc_id"] for r in queries.op10_rule_ensemble(spark, SMALL).where("predicted = 1").collect()}
    assert got == want
    assert corpus_pipeline.run(spark, SMALL).count() > 0
