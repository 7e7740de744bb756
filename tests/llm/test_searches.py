"""Hard negatives and nearest neighbours against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import adaptive_scan, hard_negatives, queries, vector_blocks

SCHEMA = "vec_id long, embedding array<float>, label int, id string, block int, x int, n long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, None, 2) for r in rows], SCHEMA)


def random_rows(seed, n=400, dim=16, kinds=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    rows = [(i, [float(np.float32(v)) for v in base[rng.integers(12)] * rng.choice([0.1, 1]) + rng.normal(size=dim) * rng.choice([0.0, 0.3, 1.0])], int(rng.integers(kinds))) for i in range(10, n)]
    odd = [(1, None, 1), (2, [0.0] * dim, 1), (3, [float("nan")] * dim, 1), (4, [None] + [1.0] * (dim - 1), 1), (5, [float("inf")] + [1.0] * (dim - 1), 1), (100, rows[3][1], None), (7, [], 1), (0, [1.0, 2.0], 1), (200, [2.0, 4.0], 1), (8, [2.0, 4.0], 2), (None, rows[0][1], 1)]
    return rows + odd + [(300, rows[290][1], rows[290][2]), (900, rows[0][1], rows[0][2]), (901, rows[0][1], 1), (902, rows[0][1], 2)]


def good(rows, labelled):
    for i, e, label in rows:
        if i is not None and e and None not in e and np.isfinite(e).all() and (label is not None if labelled else any(e)):
            yield i, np.array(e, np.float64), label


def hard(rows, every=100):
    rows = [(i, np.floor(256 * e).astype(int), label) for i, e, label in good(rows, True)]
    out = []
    for a, (ai, av, al) in enumerate(rows):
        if ai % every:
            continue
        scored = sorted((-int(av @ v), i, label == al) for k, (i, v, label) in enumerate(rows) if k != a and len(v) == len(av))
        for p, pi, _ in [s for s in scored if s[2]][:5]:
            fits = [s for s in scored if not s[2] and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(ai, pi, k + 1, i, -p, -n) for k, (n, i, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "dim"), [(1, 16), (2, 3), (3, 70)])
def test_hard_negatives(spark, monkeypatch, seed, dim):
    monkeypatch.setattr(vector_blocks, "SHARE", 100)
    monkeypatch.setattr(vector_blocks, "GROUP", 2)
    rows = random_rows(seed, dim=dim)
    got = hard_negatives.mine(table(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = hard(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_the_query_on_its_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op11_hard_negatives(spark, sf).collect())) == hard(rows)


def test_few_rows_and_none(spark):
    one = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (3, [-1.0, 0.0], 1)]
    assert sorted(map(tuple, hard_negatives.mine(table(spark, one)).collect())) == [(0, 1, 1, 2, 65536, 58880)]
    assert hard_negatives.mine(table(spark, one[1:])).count() == 0  # no anchor
    assert hard_negatives.mine(table(spark, [])).count() == 0
    assert adaptive_scan.neighbours(table(spark, [])).count() == 0
    assert [tuple(r) for r in adaptive_scan.neighbours(table(spark, one[:2])).collect()] == [(0, 1, 1, 0.0)]
    assert adaptive_scan.neighbours(table(spark, one[:1])).count() == 0


def test_scores_that_fit_no_long(spark):
    rows = [(0, [2.0**30] * 4, 1), (1, [2.0**30] * 4, 1)]
    with pytest.raises(Exception, match="do not fit in a long"):
        hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()


def test_intervals_hold_and_narrow():
    rng = np.random.default_rng(3)
    q = np.floor(256 * rng.normal(size=(3000, 64)) / 8).astype(np.int64)
    planes, codes = hard_negatives.Planes(q[:20]), hard_negatives.Codes(q)
    exact, estimate, every = q[:20] @ q.T, 0.0, (slice(None), None)
    widths = []
    for level in range(hard_negatives.LEVELS):
        estimate = estimate + codes.alignment[level][None, :] * hard_negatives._tile(planes, codes.code[level])
        half = hard_negatives.interval(planes, codes, level, every, (None, slice(None)))
        assert (np.abs(exact - estimate) <= half).all()
        widths.append(float(np.median(half)))
        i, j = rng.integers(0, 20, 50), rng.integers(0, 3000, 50)
        assert np.allclose(planes.products(codes.code[level], i, j), hard_negatives._tile(planes, codes.code[level])[i, j])
    assert all(b < 0.75 * a for a, b in zip(widths[:-1], widths[1:], strict=True))
    counts: list[int] = []
    best = np.sort(exact, axis=1)[:, -5].astype(float)
    i, j = hard_negatives.survivors(planes, codes, np.ones((20, 3000), bool), best, np.full(20, np.inf), counts)
    assert {(a, b) for a, b in zip(*np.nonzero(exact >= best[:, None]), strict=True)} <= set(zip(i, j, strict=True))
    assert counts[-1] < 0.1 * counts[0]


def nearest(rows, every=100, k=10):
    rows = list(good(rows, False))
    out = {}
    for a, (ai, av, _) in enumerate(rows):
        if ai % every == 0:
            out.setdefault(ai, []).append(sorted((float(np.sqrt(((av - v) ** 2).sum())), i) for b, (i, v, _) in enumerate(rows) if b != a and len(v) == len(av))[:k])
    return out


@pytest.mark.parametrize(("seed", "dim", "lists"), [(1, 16, 10_000), (2, 3, 40), (3, 64, 40)])
def test_nearest_neighbours(spark, monkeypatch, seed, dim, lists):
    monkeypatch.setattr(vector_blocks, "SHARE", 60)
    monkeypatch.setattr(adaptive_scan, "LIST_ROWS", lists)
    rows = random_rows(seed, dim=dim)
    got = {}
    for r in adaptive_scan.neighbours(table(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"], r["rank"]))
    want = nearest(rows)
    assert got.keys() == want.keys()
    vectors = {i: e for i, e, _ in good(rows, False)}
    found = 0
    for i, mine in got.items():
        if len(want[i]) == 1:
            assert [r for *_, r in mine] == list(range(1, 1 + len(mine))) and [m[:2] for m in mine] == sorted(m[:2] for m in mine)
            assert all(np.isclose(s, np.linalg.norm(vectors[v] - vectors[i]), rtol=1e-12) for s, v, _ in mine)
            found += len({v for _, v, _ in mine} & {v for _, v in want[i][0]}) / len(want[i][0])
    assert found >= 0.9 * sum(len(w) == 1 for w in want.values())
    if lists == 10_000:  # one list and no test fails: all as by brute force
        assert found == sum(len(w) == 1 for w in want.values())


def test_recall_on_the_given_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = nearest(rows)
    got = queries.op13_adaptive_scan(spark, sf).groupBy("query_id").agg(F.collect_set("vec_id").alias("found")).collect()
    hits = sum(len(set(r["found"]) & {v for _, v in want[r["query_id"]][0]}) for r in got)
    assert hits >= 0.9 * 10 * len(want)


def test_scan_abandons_early():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(2000, 64))
    q = v[:20] + rng.normal(size=(20, 64)) * 0.2
    far = ((q[:, None] - v[None]) ** 2).sum(axis=2)
    bound = np.sort(far, axis=1)[:, 9]
    counts: list[int] = []
    i, j = adaptive_scan.scan(adaptive_scan.column_blocks(q), adaptive_scan.column_blocks(v), np.ones(far.shape, bool), bound, counts)
    true = {(a, b) for a, b in zip(*np.nonzero(far <= bound[:, None]), strict=True)}
    assert len(true & set(zip(i, j, strict=True))) >= 0.97 * len(true) and set(zip(i, j, strict=True)) <= {(a, b) for a, b in zip(*np.nonzero(far <= bound[:, None] * (1 + 1e-6)), strict=True)}
    assert counts == sorted(counts, reverse=True) and counts[3] < 0.5 * counts[0] and counts[-1] <= len(true)


def test_probes_follow_the_data():
    rng = np.random.default_rng(1)
    spread = rng.normal(size=(3000, 32))
    tight = np.repeat(rng.normal(size=(30, 32)) * 5, 100, axis=0) + rng.normal(size=(3000, 32)) * 0.1
    probes = []
    for x in (spread, rng.permutation(tight)):
        index = adaptive_scan.Index(adaptive_scan.means(x, 30), 1)
        probes.append(adaptive_scan.probes_for(index, x, 10, 0.98))
    assert probes[0] > 10 and probes[1] < 5


def test_shares_are_bounded_in_bytes(spark, monkeypatch):
    assert [vector_blocks.at_most(8192, n, vector_blocks.MOST_BYTES) for n in (64, 4096, 1 << 30)] == [8192, 1024, 16]
    monkeypatch.setattr(vector_blocks, "MOST_BYTES", 8 * 16 * 20)
    rows = random_rows(5)
    assert sorted(map(tuple, hard_negatives.mine(table(spark, rows)).collect())) == hard(rows)
    wide = spark.createDataFrame([(i, 0, [float(i)] * 16) for i in range(100)], "id long, label long, x array<double>").coalesce(1)
    packed = vector_blocks.blocks(wide, lambda x: x.tobytes())
    assert max(r["n"] for r in packed.collect()) == 20 and packed.agg({"n": "sum"}).first()[0] == 100
