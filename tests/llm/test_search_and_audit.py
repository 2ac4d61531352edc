"""Repeated passages, ranked search, filter audit: brute force and odd rows."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from irquarry.llm import debruijn, filter_audit, lexical

ODD = [None, "", " ", "word", "It's  a\ttest\n\n", "é中 <|endoftext|> x" * 3, "a" * 5000, "long text " * 3000, "same", "same"]


@pytest.fixture(scope="module")
def odd(table):
    rows = [(i if i != 3 else None, t, "s" if i % 2 else None, i) for i, t in enumerate(ODD)]
    return table(rows, "doc_id long, text string, source string, size int")


def _passages(seed, docs=60):
    """Texts over few words, so that windows repeat, with long passages, copies and parts of copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    shared = [[rng.choice(words) for _ in range(rng.randint(5, 60))] for _ in range(6)]
    rows = []
    for i in range(docs):
        parts = [rng.choice(shared) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(0, 5))]
        rows.append((i * 7 % docs, rng.choice([" ", "\n", "  "]).join(w for p in parts for w in p)))
    rows += [(docs + k, rows[k][1]) for k in range(5)] + [rows[0], rows[1]]
    return rows


def _brute_repeats(rows, k):
    first = {}
    for key, text in rows:
        w = (text or "").split()
        for i in range(len(w) - k + 1) if key is not None else ():
            s = tuple(w[i : i + k])
            first[s] = min(first.get(s, key), key)
    out = []
    for key, text in rows:
        w = (text or "").split()
        gone = set()
        for i in range(len(w) - k + 1) if key is not None else ():
            if first[tuple(w[i : i + k])] < key:
                gone |= set(range(i, i + k))
        out.append((key, " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize(("k", "chunk_bytes"), [(13, 1 << 20), (4, 300), (2, 1000)])
def test_spans_cover_what_smaller_ids_have(table, k, chunk_bytes):
    rows = _passages(k)
    docs = table(rows, "doc_id long, text string")
    found = debruijn.repeated_spans(docs, window=k, chunk_bytes=chunk_bytes).collect()
    texts = {key: (t or "").split() for key, t in rows}
    got = []
    for r in found:
        words = (r["row"]["text"] or "").split()
        got.append((r["row"]["doc_id"], " ".join(debruijn.kept_words(words, r["spans"]))))
        for s in r["spans"]:  # the coordinates name the same words in a smaller id
            assert s["first_doc"] < r["row"]["doc_id"] and s["words"] >= k
            assert texts[s["first_doc"]][s["first_start"] : s["first_start"] + s["words"]] == words[s["start"] : s["start"] + s["words"]]
    assert sorted(got) == sorted(_brute_repeats(rows, k))


def test_a_shared_passage_keeps_its_coordinates(table):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(50)]
    rows = [(i, " ".join([*(f"x{rng.random()}" for _ in range(20)), *passage, *(f"y{rng.random()}" for _ in range(20))])) for i in range(30)]
    found = debruijn.repeated_spans(table(rows, "doc_id long, text string"), chunk_bytes=2000).collect()
    spans = {r["row"]["doc_id"]: [tuple(s) for s in r["spans"]] for r in found}
    assert spans.pop(0) == []
    for found in spans.values():  # pieces of one passage, along its source
        assert {i for s in found for i in range(s[0], s[0] + s[1])} == set(range(20, 70))
        assert all(s[2] < 30 and s[0] == s[3] for s in found)


def test_paths_break_at_branching_nodes(table):
    # segments of two windows: 0 and 1 share nodes 1-2-3, 2 and 3 share 4-2-5; node 2 is entered and left twice, 6-7-8 is one path
    rows = []
    for doc, nodes in ((0, (1, 2, 3)), (1, (1, 2, 3)), (2, (4, 2, 5)), (3, (4, 2, 5)), (4, (6, 7, 8, 9)), (5, (6, 7, 8))):
        rows += [(a, b, a * 10 + b, 2, doc, doc, 2 * i) for i, (a, b) in enumerate(zip(nodes, nodes[1:]))]
    made = table(rows, "source long, target long, digest long, number int, last long, doc long, place int")
    made = made.selectExpr("source", "target", "digest", "number", "last", "struct(doc, place) as here")
    segments = debruijn.with_source(made, ["source", "target", "digest", "number"])
    found = {tuple(r) for r in debruijn.paths(segments).collect()}
    assert found == {(0, 0, 0), (0, 2, 2), (2, 0, 0), (2, 2, 2), (4, 0, 0), (4, 2, 0)}


def test_words_are_those_of_bytes():
    rng = random.Random(6)
    bodies = [b"", b" a  b\tc ", None, b"x", "\x1c\x85\u2003 y\x0bz\x0c".encode(), b"a\nb c", b"w" * 255 + b" " + b"w" * 256 + b" " + b"w" * 3000]
    bodies += [bytes(rng.choice(b"ab\x00 \n\x0d") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    digests, lengths = debruijn._word_digests(bodies)
    words = [w for b in bodies for w in (b or b"").split()]
    assert lengths.tolist() == [len((b or b"").split()) for b in bodies]
    assert len(set(zip(words, digests.tolist()))) == len(set(words)) == len(set(digests.tolist()))
    assert debruijn._word_digests([])[0].tolist() == []


def test_repeats_of_odd_rows(odd, spark):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = debruijn.without_repeats(odd)
    assert found.columns == odd.columns
    want = dict(_brute_repeats(rows, 13))
    for r in found.collect():
        assert (r["text"] or "").split() == want[r["doc_id"]].split()
    assert debruijn.repeated_spans(odd.limit(0)).count() == 0
    clash = odd.selectExpr("*", "1 AS spans", "2 AS chunk", "3 AS row", "4 AS id")
    assert debruijn.without_repeats(clash).select("spans", "chunk", "row", "id").distinct().collect() == [(1, 2, 3, 4)]


def test_packed_keys_come_back():
    rng = np.random.default_rng(5)
    for n, bits in ((1, 64), (2, 64), (1000, 20), (5000, 38), (300, 64)):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) >> np.uint64(64 - bits) if bits < 64 else rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert np.array_equal(debruijn._unpacked(*debruijn._packed(keys)), keys)


_TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in _TERMS.findall(text or "")]


def _brute_search(docs, items, top):
    bags = [(key, Counter(_terms(t))) for key, t in docs]
    bags = [(key, b) for key, b in bags if b]
    n_docs, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for key, b in bags:
            m = 25 + 75 * b.total() * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m))
                for t in _terms(text)
                if t in b
            )
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out += [(item, rank + 1, None if none else key, -s) for rank, (s, none, key) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("item_bytes", [1 << 20, 40])
def test_search_matches_brute_force(table, monkeypatch, item_bytes):
    monkeypatch.setattr(lexical, "TILE_DOCS", 7)
    monkeypatch.setattr(lexical, "ITEM_TILE", 3)
    monkeypatch.setattr(lexical, "SPLIT_BYTES", 16)
    rng = random.Random(1)
    words = ["Alpha", "beta", "Ünï", "x9", "q", "中文", "zz"] + [f"t{i}" for i in range(30)]
    docs = [(i if i != 4 else None, rng.choice([" ", "-", ";"]).join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(60)]
    docs += [(100, docs[0][1]), docs[1], docs[1], (200, None), (201, ""), (202, "...")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(12)] + [(50, None), (51, ""), (52, "unknown"), (None, "alpha"), (7, "beta x9")]
    got = lexical.search(table(docs, "doc_id long, text string"), table(items, "item_id int, text string"), top=5, item_bytes=item_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute_search(docs, items, 5)


def test_search_of_nothing(odd, table):
    items = table([(1, "word text")], "item_id long, text string")
    assert lexical.search(odd.limit(0), items).count() == 0
    assert lexical.search(odd, items.limit(0)).count() == 0
    assert lexical.search(odd, items).count() == 2


def test_partial_products_stay_exact():
    most = (lexical.EXACT - 1) // lexical.MOST_IMPACT
    rng = np.random.default_rng(1)
    weights = [{i: int(w) for i, w in enumerate(rng.integers(1, most, 40))}, {3: 5 * most + 1, 7: 2}]
    tile = lexical.ItemTile(0, weights, 40)
    assert all((part.sum(axis=0) <= most).all() for _, part in tile.tiles)
    impact = np.full(40, lexical.MOST_IMPACT - 1, np.int64)
    small = [{i: w // 64 for i, w in weights[0].items()}, {3: 5, 7: 2}]
    for some in (small, weights[1:]):
        tile = lexical.ItemTile(0, some, 40)
        got = tile.scores(1, np.zeros(40, np.int64), np.arange(40), impact)
        assert got.tolist() == [[sum(w * (lexical.MOST_IMPACT - 1) for w in x.values()) for x in some]]


def test_planes_count_bits():
    rng = np.random.default_rng(2)
    group, word = np.sort(rng.integers(0, 4, 1000)), rng.integers(0, 1 << 32, 1000, dtype=np.uint32)
    times = rng.integers(0, 9, 1000)
    got = np.zeros((4, 32), np.int64)
    for level, groups, plane in filter_audit.planes(group, word, times):
        assert len(set(groups.tolist())) == len(groups)
        for g, p in zip(groups.tolist(), plane.tolist()):
            got[g] += [(p >> b & 1) << level for b in range(32)]
    want = np.zeros((4, 32), np.int64)
    for g, w, n in zip(group.tolist(), word.tolist(), times.tolist()):
        want[g] += [(w >> b & 1) * n for b in range(32)]
    assert np.array_equal(got, want)
    assert list(filter_audit.planes(np.array([], np.int64), np.array([], np.uint32), np.array([], np.int64))) == []


def _brute_audit(rows, labels):
    good = {k for k, q, _ in labels if q == 1}
    toxic = {k for k, _, t in labels if t == 1}
    smallest = {}
    for key, text, _ in rows:
        if key is not None:
            smallest[text or ""] = min(smallest.get(text or "", key), key)
    fails = []
    for key, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": key is not None and key > smallest[t],
        }
        fails.append((part or "", {x for x in f if f[x]}, key in good and key is not None, key in toxic and key is not None))
    out, shapley = [], Counter()
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order):
                before = set(order[:step])
                here = [f for f in mine if not f[1] & before]
                lost = [f for f in here if x in f[1]]
                row = (len(here) - len(lost), len(lost), sum(x in f[1] for f in mine) - len(lost), sum(f[1] == {x} for f in mine))
                out.append((part, "".join(order), step + 1, *row, sum(f[2] for f in lost), sum(f[3] for f in lost), x))
                shapley[part, x] += len(lost)
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


def test_audit_matches_brute_force(table):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        n = rng.choice([0, 5, 199, 200, 260])
        words = [rng.choice(["a", "b", "Up", "é"]) if rng.random() < 0.5 else f"{rng.choice(['w', 'W'])}{rng.random()}" for _ in range(n)]
        text = " ".join(words) + rng.choice(["", "", " #", "|"])
        rows.append((i, rng.choice([text, None, ""]) if rng.random() < 0.1 else text, rng.choice(["s", "t", None, ""])))
    rows += [(200 + i, rows[i][1], "s") for i in range(20)] + [(None, rows[0][1], "t"), (None, rows[0][1], None), rows[3], rows[3]]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 180, 2)] + [(4, 1, 1), (None, 1, 1), (5, None, None)]
    found = filter_audit.words(table(rows, "doc_id long, text string, source string"), table(labels, "doc_id long, quality int, toxic int"))
    got = filter_audit.audit(found)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == _brute_audit(rows, labels)


def test_audit_of_odd_rows(odd, table):
    labels = table([(7, 1, 0)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.words(odd.limit(0), labels)).count() == 0
    clash = odd.selectExpr("*", "1 AS id", "2 AS part", "3 AS body", "4 AS n", "5 AS words")
    rows = filter_audit.audit(filter_audit.words(clash, labels.limit(0))).collect()
    assert len(rows) == 2 * 600
    want = _brute_audit([(r["doc_id"], r["text"], r["source"]) for r in odd.collect()], [])
    assert sorted(tuple(r) for r in rows) == want


def test_kept_words_takes_overlapping_spans():
    words = [str(i).encode() for i in range(10)]
    spans = [dict(start=1, words=4), dict(start=3, words=4), dict(start=9, words=1)]
    assert debruijn.kept_words(words, spans) == [b"0", b"7", b"8"]
    assert hashlib.sha256(b" ".join(debruijn.kept_words(words, []))).hexdigest() == hashlib.sha256(b" ".join(words)).hexdigest()
