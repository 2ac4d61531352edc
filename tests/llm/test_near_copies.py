"""Near copies of the pipeline's stage: classes of brute force, rows in proportion to the group."""

import random

import pytest

from irquarry.llm import near_dedup


def _group(n, seed, words=60, changed=2):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for at in rng.sample(range(words), changed):
            text[at] = f"x{rng.randint(0, 5)}"
        rows.append((i, " ".join(text)))
    return rows


def _classes(rows):
    sets = [near_dedup.shingle_set((t or "").encode()) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.similar(sets[i], sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(rows))]


@pytest.mark.parametrize(("changed", "cell"), [(1, 4096), (2, 4096), (2, 40)])
def test_large_groups_of_near_copies_keep_the_classes_of_brute_force(table, monkeypatch, changed, cell):
    monkeypatch.setattr(near_dedup, "CELL_ROWS", cell)
    monkeypatch.setattr(near_dedup, "PAIR_ROWS", 50)
    rows = _group(150, 1, changed=changed) + [(1000, None), (1001, ""), (1002, None), (1003, "one two"), (1004, "one two")]
    kept = sorted(r["doc_id"] for r in near_dedup.keep_one(table(rows, "doc_id long, text string")).collect())
    assert kept == [rows[i][0] for i, label in enumerate(_classes(rows)) if label == i]


def test_cells_grow_with_the_group(table, spark):
    found = {}
    for n in (200, 400):
        rows = [(i, 0, 0, t) for i, t in _group(n, 2)]
        made = table(rows, "node long, label long, group long, body string")
        members, bodies = made.select("node", "label", "group"), made.selectExpr("node", "cast(body as binary) as body")
        found[n] = near_dedup.cells(members, bodies).count()
    assert found == {200: 200, 400: 400}


def test_stage_of_odd_rows(table, spark):
    rows = [(i, t, 1) for i, t in enumerate([None, "", " ", "a b", "a b", "é中", "w " * 30000])] + [(None, "a b", 2), (None, "new text", 3)]
    docs = table(rows, "doc_id long, text string, print int").selectExpr("*", "4 AS node", "5 AS bands", "6 AS row_key", "7 AS `out`")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None) == [(0, None), (3, "a b"), (5, "é中"), (6, "w " * 30000)]
    assert [r["text"] for r in kept.where("doc_id is null").collect()] == ["new text"]
    assert near_dedup.keep_one(docs.limit(0)).count() == 0
