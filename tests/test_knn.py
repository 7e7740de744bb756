"""Exact nearest neighbours by rings against all pairs."""

import numpy as np
import pytest

from tidemark.operators import knn


def want(queries, vectors, k):
    out = []
    for i, q, part in queries:
        if i is None or q is None or part is None:
            continue
        far = sorted((float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), j) for j, v, p in vectors if j is not None and v is not None and p == part and j != i)
        out += [(i, r + 1, j, round(d, 9)) for r, (d, j) in enumerate(far[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, x array<double>, part string")


@pytest.mark.parametrize("kind", ["clusters", "line", "spread", "copies"])
def test_as_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(knn, "SHARE", 70)
    monkeypatch.setattr(knn, "GROUP", 40)
    rng = np.random.default_rng(len(kind))
    n, dim = 400, 5
    x = {"clusters": rng.normal(size=(12, dim))[rng.integers(0, 12, n)] * 8 + rng.normal(size=(n, dim)) * 0.2, "line": np.outer(rng.random(n) * 100, np.ones(dim)), "spread": rng.normal(size=(n, dim)), "copies": np.repeat(rng.normal(size=(8, dim)), n // 8, axis=0)}[kind]
    vectors = [(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)] + [(None, [0.0] * dim, "a"), (901, None, "a"), (902, [0.0] * dim, None)]
    queries = vectors[::3] + [(5000, x[7].tolist(), "a"), (5001, x[7].tolist(), "nowhere")]
    got = knn.knn_join(frame(spark, queries), frame(spark, vectors), 4, "part", points=10).collect()
    assert sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in got) == want(queries, vectors, 4)
    looked = {r["query_id"]: r["looked"] for r in got}
    share = np.mean(list(looked.values())) / (n / 2)
    assert share <= 1.01
    if kind in ("clusters", "line"):
        assert share < 0.5  # most pairs are never looked at


def test_few_and_none(spark):
    one = [(1, [0.0, 1.0], "a"), (2, [0.0, 2.0], "a")]
    got = knn.knn_join(frame(spark, one), frame(spark, one), 5, "part").collect()
    assert sorted(tuple(r)[:4] for r in got) == [(1, 1, 2, 1.0), (2, 1, 1, 1.0)]
    assert knn.knn_join(frame(spark, one), frame(spark, []), 5).count() == 0
    assert knn.knn_join(frame(spark, []), frame(spark, one), 5).count() == 0
