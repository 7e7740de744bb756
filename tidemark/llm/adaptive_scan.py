"""Approximate nearest neighbours by an adaptive dimension scan over probed lists.

A bounded sample gives centroids; every vector goes to the list of its nearest one, and a query probes
the nearest lists.  How many is measured: on the sample, whose neighbours are known, as
many as reach the wanted recall.  Within a list vectors and queries are turned by a random
orthogonal matrix, so that any first components are a fair sample of all, and are kept in blocks
of columns.  Distances grow block by block.  After each block a test asks, for each pair still open, whether the
whole distance can be below the query's tenth best: the squared distance of d of D turned components,
times D/d, is near the whole one, and a pair whose share is so large that chance hardly explains
it is abandoned.  Pairs that stay to the end are measured on the original vectors.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hard_negatives import empty, first_of, rotation
from tidemark.llm.kernels import as_array
from tidemark.llm.vector_blocks import blocks, by_size, finite, first_ranks, grid, queries

#: Vectors that lists and probes are fitted on at most, vectors of a list, and lists at most.
FIT_ROWS, LIST_ROWS, MOST_LISTS = 20_000, 1024, 625
#: Queries of the sample that the number of probes is measured on, and the recall that it is to reach there.
FIT_QUERIES, WANTED = 400, 0.98
#: Columns of a block; and how surprising a partial distance must be (ADSampling's epsilon).
COLUMNS, SURPRISE = 16, 2.1
_TILE, _WIDE, _FEW = 256, 1024, 0.2


class Index:
    """Centroids of one dimension, and how many lists a query probes."""

    def __init__(self, centroids: np.ndarray, probes: int):
        self.centroids, self.probes = centroids, probes

    def nearest(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The nearest lists of each vector, nearest first."""
        out = np.empty((len(x), n), np.int32)
        for s in range(0, len(x), 4096):
            part = x[s : s + 4096]
            far = ((self.centroids**2).sum(axis=1) - 2 * part @ self.centroids.T) if len(self.centroids) > 1 else np.zeros((len(part), 1))
            out[s : s + 4096] = np.argsort(far, axis=1, kind="stable")[:, :n]
        return out


def means(x: np.ndarray, k: int, turns: int = 8) -> np.ndarray:
    """Centroids by Lloyd's iteration from evenly spaced rows; an empty one stays where it was."""
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(turns):
        of = Index(centre, 1).nearest(x)[:, 0]
        order = np.argsort(of, kind="stable")
        first, count = np.searchsorted(of[order], np.arange(k)), np.bincount(of, minlength=k)
        some = count > 0
        centre[some] = np.add.reduceat(x[order], first[some], axis=0) / count[some][:, None]
    return centre


def probes_for(index: Index, x: np.ndarray, k: int, wanted: float) -> int:
    """The fewest lists to probe that hold the wanted share of the true neighbours of some of the sample's vectors."""
    asked = x[: min(FIT_QUERIES, len(x))]
    length = (x**2).sum(axis=1)
    far = length[None, :] - 2 * asked @ x.T
    far[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    k = min(k, len(x) - 1)
    if not k:
        return len(index.centroids)
    true = np.argpartition(far, k - 1, axis=1)[:, :k]
    home = index.nearest(x)[:, 0]
    place = np.argsort(index.nearest(asked, len(index.centroids)), axis=1, kind="stable")  # place of each list in a query's order
    needed = np.take_along_axis(place, home[true], axis=1).ravel()
    return min(len(index.centroids), int(np.sort(needed)[int(np.ceil(wanted * len(needed))) - 1]) + 1)


def fit(rows: DataFrame, k: int, wanted: float = WANTED) -> dict[int, Index]:
    """By dimension an index, from a sample of bounded size chosen by hash, and the counts of vectors."""
    totals = {r["size"]: r["count"] for r in rows.groupBy(F.size("x").alias("size")).count().collect()}  # a row for each dimension
    sample = rows.select("x").orderBy(F.xxhash64("x"), "x").limit(FIT_ROWS).toArrow()
    found = {}
    for batch in sample.combine_chunks().to_batches():
        for _, x in by_size(batch):
            lists = max(1, min(MOST_LISTS, -(-totals[x.shape[1]] // LIST_ROWS), len(x) // 16))
            index = Index(means(x, lists), 1)
            index.probes = probes_for(index, x, k, wanted)
            found[x.shape[1]] = index
    return found


def column_blocks(x: np.ndarray) -> list[np.ndarray]:
    """Turned vectors, a contiguous array for each block of columns."""
    y = x @ rotation(x.shape[1])
    return [np.ascontiguousarray(y[:, c : c + COLUMNS]) for c in range(0, y.shape[1], COLUMNS)]


def scan(q: list[np.ndarray], v: list[np.ndarray], open_: np.ndarray, bound: np.ndarray, counts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that no test abandons; bound is the squared distance that each query has to beat.

    counts, if given, gets how many pairs were open before each block, and after the last.
    """
    counts = [] if counts is None else counts
    size = sum(b.shape[1] for b in v)
    so_far, done, dense = np.zeros(open_.shape), 0, True
    i = j = np.zeros(0, np.int64)
    for a, b in zip(q, v, strict=True):
        counts.append(int(open_.sum()) if dense else len(i))
        done += b.shape[1]
        # The whole squared distance is beyond the bound, so the test says, if the part is beyond this share of it:
        # of a turned vector, the length of a part varies as that of done of size equal components does.
        share = min(1.0, (1 + SURPRISE * np.sqrt((1 - done / size) / done)) ** 2 * done / size) + (1e-9 if done == size else 0)
        if dense:
            so_far += np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0)
            open_ = open_ & (so_far <= (bound * share)[:, None] + (1e-9 * _lengths(q) if done == size else 0))
            if open_.mean() <= _FEW or done == size:
                i, j = np.nonzero(open_)
                so_far, dense = so_far[i, j], False
        else:
            for s in range(0, len(i), 1 << 15):
                t = slice(s, s + (1 << 15))
                so_far[t] += ((a[i[t]] - b[j[t]]) ** 2).sum(axis=1)
            keep = so_far <= bound[i] * share + (1e-9 * _lengths(q)[i, 0] if done == size else 0)
            i, j, so_far = i[keep], j[keep], so_far[keep]
    counts.append(len(i))
    return i, j


def _lengths(q: list[np.ndarray]) -> np.ndarray:
    """Squared lengths of the queries, a column: rounding of distances is in proportion."""
    return sum((a**2).sum(axis=1) for a in q)[:, None]


def distances(q: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of the pairs in double precision, on the vectors as they are."""
    out = np.empty(len(i))
    for s in range(0, len(i), 1 << 14):
        t = slice(s, s + (1 << 14))
        out[t] = np.sqrt(((q[i[t]] - v[j[t]]) ** 2).sum(axis=1))
    return out


_FOUND = "block long, place int, query_id long, vec_id long, score double"


def best_in_cell(left: pa.Table, right: pa.Table, most: int) -> pa.Table:
    """The nearest vectors of a share for each query of a group."""
    if not left.num_rows or not right.num_rows:
        return empty(_FOUND.replace(", score double", "")).append_column("score", pa.array([], pa.float64()))
    rows = right.to_pylist()
    size = rows[0]["size"]
    v = np.concatenate([vectors_of(r) for r in rows])
    v_ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
    v_block = np.repeat([r["block"] for r in rows], [r["n"] for r in rows])
    v_place = np.concatenate([np.arange(r["n"]) for r in rows])
    turned = column_blocks(v)
    q = np.stack([np.frombuffer(x, np.float64, size) for x in left.column("q").to_pylist()])
    block, place, ids = (as_array(left.column(c)).to_numpy(zero_copy_only=False) for c in ("block", "place", "id"))
    found = []
    for s in range(0, len(q), _TILE):
        at = slice(s, s + _TILE)
        asked, bound = column_blocks(q[at]), np.full(len(ids[at]), np.inf)
        top = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for w in range(0, len(v), _WIDE):
            part = slice(w, w + _WIDE)
            other = (block[at][:, None] != v_block[part][None, :]) | (place[at][:, None] != v_place[part][None, :])
            i, j = scan(asked, [b[part] for b in turned], other, bound)
            top = tuple(np.concatenate(c) for c in zip(top, (i, j + w, distances(q[at], v[part], i, j)), strict=True))
            keep = first_ranks(top[0], top[2], v_ids[top[1]], most=most)
            top = tuple(c[keep] for c in top)
            full = np.bincount(top[0], minlength=len(bound)) == most
            last = np.zeros(len(bound))
            np.maximum.at(last, top[0], top[2])
            bound = np.where(full, last**2, np.inf)
        found.append((top[0] + s, *top[1:]))
    i, j, score = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.table({"block": block[i], "place": pa.array(place[i], pa.int32()), "query_id": ids[i], "vec_id": v_ids[j], "score": score})


def write(x: np.ndarray, single: bool) -> bytes:
    return x.astype(np.float32 if single else np.float64).tobytes()


def vectors_of(row: dict) -> np.ndarray:
    """A block's vectors; the width of a number follows from its bytes."""
    return np.frombuffer(row["x"], np.float32 if len(row["x"]) == 4 * row["n"] * row["size"] else np.float64).reshape(row["n"], row["size"]).astype(np.float64)


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10, wanted: float = WANTED) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for vectors (vec_id, embedding): the k nearest found of each query.

    Queries are the rows whose vec_id is divisible by every, candidates all rows but the query's own, of
    the same dimension.  score is the Euclidean distance of the original vectors in double
    precision, rank counts from 1, ties by smaller vec_id; fewer than k where there are fewer candidates in the
    lists probed.  Results are approximate in which rows are found, never in their score: wanted
    is the recall that the number of probes reaches on a bounded sample, the tests along the
    way lose a little more.

    Rows with a null vec_id or vector, with no component, with a null, NaN or infinite one, and
    zero vectors take no part.  Repeated rows are rows of their own: each is a query
    and a candidate.  An empty table gives none.  Other columns, labels included, are ignored.
    """
    x = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & F.coalesce(finite(x) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.where(usable).select(F.col("vec_id").cast("long").alias("id"), F.lit(0).cast("long").alias("label"), x.alias("x"))
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast(fit(rows, k, wanted))  # MOST_LISTS centroids for each dimension of the sample at most

    def index(size: int) -> Index:
        return shared.value.get(size) or Index(np.zeros((1, size)), 1)  # a dimension that the sample has not: one list

    packed = blocks(rows, partial(write, single=single), lambda x: index(x.shape[1]).nearest(x)[:, 0])

    def probe(batches):
        for batch in batches:
            sizes = as_array(batch.column("size")).to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                one = index(size)
                lists = one.nearest(np.stack([np.frombuffer(x, np.float64) for x in part.column("q").to_pylist()]), one.probes)
                again = part.take(pa.array(np.repeat(np.arange(len(lists)), lists.shape[1])))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(lists.ravel(), pa.int32())], [*part.schema.names, "list"])

    asked = queries(packed, every, vectors_of).mapInArrow(probe, "block long, place int, size int, id long, label long, q binary, list int")
    found = grid(asked, packed, lambda a, b: best_in_cell(a, b, k), _FOUND)
    return first_of(found.withColumn("nearness", -F.col("score")), ["block", "place"], "nearness", "vec_id", k, "rank").select("query_id", "rank", "vec_id", "score")
