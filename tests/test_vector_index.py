"""Vector indexes against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from irquarry.operators import retrieval, vector_index


def _table(table, mat):
    vectors = table([(i, m.tolist()) for i, m in enumerate(mat)], "point_id long, embedding array<float>")
    return vectors, vectors.withColumnRenamed("point_id", "query_id")


def _clustered(n=600, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((30, dim))
    mat = np.repeat(base, n // 30, axis=0) + rng.standard_normal((n, dim)) * 0.1
    mat[100:150] = mat[100]  # copies, and rows without a direction
    mat[7] = 0
    return mat


@pytest.mark.parametrize("kind", ["clustered", "far apart"])
def test_index_finds_nine_tenths(table, kind):
    mat = _clustered() if kind == "clustered" else np.random.default_rng(3).standard_normal((600, 16))
    vectors, queries = _table(table, mat)
    queries = queries.where("query_id % 20 = 0")
    exact = retrieval.topk(queries, vectors, 3, skip_self=True)
    index = vector_index.fit(vectors, rounds=4)
    probes, count = vector_index.tuned(index, queries, vectors, 3, skip_self=True)
    found = index.search(queries, vectors, 3, probes, count, skip_self=True)
    row = retrieval.recall(exact, found).head()
    assert row["n_exact"] == 90 and row["n_found"] >= 81
    assert count <= 60
    best = {(r["query_id"], r["point_id"]): r["score"] for r in exact.collect()}
    assert all(abs(best[r["query_id"], r["point_id"]] - r["score"]) < 1e-6 for r in found.collect() if (r["query_id"], r["point_id"]) in best)


def test_codes_stand_for_their_vectors(table):
    mat = _clustered()
    vectors, _ = _table(table, mat)
    index = vector_index.fit(vectors, rounds=4)
    unit = mat.astype(np.float32).astype(np.float64)
    unit = np.delete(unit, 7, axis=0)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    entries = {r["point_id"]: (r["list"], bytes(r["codes"])) for r in index.entries(vectors).collect()}
    assert sorted(entries) == [i for i in range(600) if i != 7]
    lists, codes = index.encoded(unit)
    at = 3
    mine = np.flatnonzero(lists == lists[at])
    estimate = index.estimates(unit[at : at + 1], int(lists[at]), codes[mine])[0]
    assert np.abs(estimate - unit[mine] @ unit[at]).max() < 0.2


@pytest.mark.parametrize("kind", ["clustered", "far apart", "few"])
def test_pruned_search_gives_the_rows_of_exact_search(table, kind):
    mat = {
        "clustered": _clustered(),
        "far apart": np.random.default_rng(3).standard_normal((300, 16)),
        "few": np.array([[1.0, 0], [0, 1], [0, 0], [1, 1]]),
    }[kind]
    vectors, queries = _table(table, mat)
    for skip_self in (True, False):
        hits, counts = vector_index.pruned_topk(queries, vectors, 3, skip_self)
        want = retrieval.topk(queries, vectors, 3, skip_self=skip_self)
        rows = lambda df: sorted((r["query_id"], r["rank"], r["point_id"], round(r["score"], 7)) for r in df.collect())
        assert rows(hits) == rows(want)
        row = counts.head()
        assert row["n_looked"] > 0
        if kind == "clustered":
            assert row["n_skipped"] > 2 * row["n_looked"]


def test_nothing_to_index(table):
    vectors, queries = _table(table, _clustered())
    assert vector_index.nearest(queries, vectors.limit(0), 3).count() == 0
    assert vector_index.pruned_topk(queries, vectors.limit(0), 3)[0].count() == 0
    assert vector_index.fit(vectors.where("point_id = 7")) is None
    one = vector_index.nearest(queries.where("query_id = 0"), vectors.where("point_id < 2"), 3, skip_self=True)
    assert [r["point_id"] for r in one.collect()] == [1]
    assert vectors.select(F.count("*")).head()[0] == 600
