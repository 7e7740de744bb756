"""Near-duplicate vectors and components against brute force."""

import numpy as np
import pytest

from tests.llm import brute
from tidemark.llm import graph, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x int"


def want(rows, threshold):
    good = []
    for i, e, label, *_ in rows:
        v = None if e is None or any(x is None for x in e) else np.array(e, np.float32).astype(float)
        if i is not None and label is not None and v is not None and len(v) and np.isfinite(v).all() and v.any():
            good.append((i, label, v / np.linalg.norm(v)))
    n = {i: 0 for i, *_ in rows}
    links = []
    for p, (i, li, a) in enumerate(good):
        for j, lj, b in good[p + 1 :]:
            if li == lj and len(a) == len(b) and a @ b >= threshold:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    comp = brute.components({i for i, *_ in rows if i is not None}, links)
    return sorted((i, n[i], comp[i], comp[i] == i) for i, *_ in rows if i is not None)


def vectors(seed, n=300, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(20, dim))
    rows = []
    for i in range(n):
        v = base[rng.integers(20)] + rng.normal(size=dim) * rng.choice([0.0, 0.08, 0.12, 1.0])
        rows.append((i + 10, [float(np.float32(x)) for x in v], int(rng.integers(3)), "s", 0))
    odd = [(1, None, 1), (2, [0.0] * dim, 1), (3, [float("nan")] * dim, 1), (4, [None] + [1.0] * (dim - 1), 1), (5, [float("inf")] + [1.0] * (dim - 1), 1), (6, rows[0][1], None), (7, [], 1), (8, [1.0, 2.0], 1), (9, [2.0, 4.0], 1)]
    return rows + [(*o, "s", 0) for o in odd] + [(900, [x * 3 for x in rows[0][1]], rows[0][2], "s", 0)]


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.98), (2, 0.98), (3, 0.9)])
def test_same_as_all_pairs(spark, seed, threshold):
    rows = vectors(seed)
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), threshold).select("vec_id", "n_links", "component_id", "kept")
    assert sorted(tuple(r) for r in got.collect()) == want(rows, threshold)


def test_dense_cells_are_dealt_into_shares(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "SHARE", 9)
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    rows = [(i, [float(np.float32(x)) for x in base + rng.normal(size=8) * 0.1], 1, "s", 0) for i in range(80)]
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("vec_id", "n_links", "component_id", "kept")
    assert sorted(tuple(r) for r in got.collect()) == want(rows, 0.98)


def test_rows_without_id_and_empty_table(spark):
    got = near_vectors.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], 1, "s", 0), (5, [1.0, 0.0], 1, "s", 0)], SCHEMA)).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == [(5, 0, 5, True), (None, 0, None, False)]
    assert near_vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)]
    ids = {i for ab in links for i in ab if ab[0] != ab[1]}
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame([*links, (None, 3), (7, 7)], "a long, b long")).collect()}
    assert got == {i: c for i, c in brute.components(ids, [x for x in links if x[0] != x[1]]).items()}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_at_the_threshold_under_any_axes():
    rng = np.random.default_rng(7)
    one, two = np.array([[1.0, 0, 0, 0]]), np.array([[49.0, 9, 3, 3]]) / 50
    for _ in range(200):
        turn = np.linalg.qr(rng.normal(size=(4, 4)))[0]
        i, _, close = near_vectors.linked_pairs(*((v @ turn).astype(np.float32).astype(float) for v in (one, two)), 0.98)
        assert len(i) == 1 and close.all()


@pytest.mark.parametrize("seed", range(3))
def test_links_at_the_threshold(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(1, [1.0, 0.0, 0.0, 0.0], 1), (2, [49.0, 9.0, 3.0, 3.0], 1), (3, [2.0**500, 0.0, 0.0, 0.0], 2), (4, [49 * 2.0**490, 9 * 2.0**490, 3 * 2.0**490, 3 * 2.0**490], 2), (5, [48.9999, 9.0, 3.0, 3.0], 3), (6, [1.0, 0.0, 0.0, 0.0], 3)]
    rows += [(100 + i, rng.normal(size=4).tolist(), 9) for i in range(50)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[i] for i in range(1, 7)] == [(1, 1), (1, 1), (1, 3), (1, 3), (0, 5), (0, 6)]


def test_rows_of_one_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (2, [1.0, 0.01, 0.0], 1), (3, [0.01, 1.0, 0.0], 1), (3, [0.01, 1.0, 0.0], 1)]
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False)]


def test_a_tree_of_cells(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "SHARE", 20)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 6)) * [3, 2, 1, 0.3, 0.2, 0.1]
    rows = [(i, [float(np.float32(c)) for c in base[rng.integers(40)] + rng.normal(size=6) * 0.08], 1, "s", 0) for i in range(500)]
    y = near_vectors.unit(np.array([r[1] for r in rows]))
    radius = float(np.sqrt(0.04)) + 1e-5
    nodes = near_vectors.grow(y, 1.0, radius)
    row, cell, home = near_vectors.cells(y, nodes, radius)
    assert len(nodes) > 5 and home.sum() == len(y) and len(row) < 3 * len(y)
    near = {(i, j) for i in range(500) for j in range(i) if np.linalg.norm(y[i] - y[j]) <= radius}
    met = [(max(p, q), min(p, q)) for c in set(cell.tolist()) for p, hp in zip(row[cell == c].tolist(), home[cell == c], strict=True) for q, hq in zip(row[cell == c].tolist(), home[cell == c], strict=True) if p > q and (hp or hq)]
    assert len(met) == len(set(met)) and near <= set(met)
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("vec_id", "n_links", "component_id", "kept")
    assert sorted(tuple(r) for r in got.collect()) == want(rows, 0.98)
