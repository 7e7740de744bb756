"""Exact nearest neighbours of many queries, with reference points instead of a join of all pairs.

A few reference points, far apart, are taken from a bounded sample.  Every vector belongs to the cell of
its nearest point and knows its distance to it; of a cell the least and the greatest such distance, its ring, is
known.  A query is first answered in its own cell.  Its k-th distance there then tells which other
cells it has to see: by the triangle inequality those whose ring comes as near, and by the plane between
two points those that reach over it.  Within a cell only vectors of a slice of the ring are looked at.
Nothing is approximate; on vectors without any structure most cells are seen, and the result says how many vectors were looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.shared import checkpointed

#: Reference points, vectors they are chosen from, and vectors and queries that one task compares.
POINTS, SAMPLE, SHARE, GROUP = 48, 4096, 8192, 4096
#: Queries that are compared at once.
BLOCK = 64
_SLACK = 1e-9


def reference_points(vectors: DataFrame, x: str, n: int = POINTS, sample: int = SAMPLE) -> np.ndarray:
    """Points of a sample chosen by hash, each as far as possible from those before it; the first is the one farthest from the mean."""
    rows = vectors.select(F.col(x).cast("array<double>").alias("x")).orderBy(F.xxhash64("x"), "x").limit(sample).collect()
    x_ = np.array([r["x"] for r in rows], float)
    if not len(x_):
        return x_
    chosen, far = [], ((x_ - x_.mean(axis=0)) ** 2).sum(axis=1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        own = ((x_ - x_[chosen[-1]]) ** 2).sum(axis=1)
        far = own if len(chosen) == 1 else np.minimum(far, own)
    return x_[chosen or [0]]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _search(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """Up to k nearest vectors of one share for each query of one group, none beyond the query's bound, and how many were looked at."""
    asked, bound, to_point = (_column(left, c) for c in ("query_id", "bound", "to_point"))
    q, v = _matrix(left.column("q")), _matrix(right.column("x"))
    names, ring = _column(right, "id"), _column(right, "ring")
    order = np.argsort(ring, kind="stable")
    v, names, ring = v[order], names[order], ring[order]
    lengths = (v * v).sum(axis=1)
    found, looked = [], np.zeros(len(q), np.int64)
    queue = np.argsort(to_point, kind="stable")
    for block in (queue[i : i + BLOCK] for i in range(0, len(q), BLOCK)):
        # Only the slice of the ring that the bounds of the block reach; there products first, and distances of what these leave.
        reach = bound[block] * (1 + _SLACK) + _SLACK
        lo, hi = int(np.searchsorted(ring, (to_point[block] - reach).min())), int(np.searchsorted(ring, (to_point[block] + reach).max(), "right"))
        if lo >= hi:
            continue
        own = names[None, lo:hi] == asked[block][:, None]
        looked[block] += hi - lo - own.sum(axis=1)
        size = (q[block] ** 2).sum(axis=1)
        with np.errstate(all="ignore"):
            near = size[:, None] + lengths[None, lo:hi] - 2 * (q[block] @ v[lo:hi].T)
            near[own | np.isnan(near)] = np.inf
            error = 1e-15 * (q.shape[1] + 8) * (size + lengths[lo:hi].max())
            few = min(k, hi - lo) - 1
            limit = np.minimum(np.partition(near, few, axis=1)[:, few], reach**2) + 2 * error
            rows, columns = np.nonzero(~((near > limit[:, None]) | own))
            exact = [np.sqrt(((v[lo + columns[i : i + SHARE]] - q[block[rows[i : i + SHARE]]]) ** 2).sum(axis=1)) for i in range(0, len(rows), SHARE)]
        if not len(rows):
            continue
        far, who = np.concatenate(exact), names[lo + columns]
        order = np.lexsort((who, far, rows))
        rows, far, who = rows[order], far[order], who[order]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        found.append((block[rows[first]], who[first], far[first]))
    at, who, far = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    # A row without an id says how many were looked at.
    return pa.table({"query_id": np.concatenate([asked[at], asked]), "id": pa.array([*who.tolist(), *[None] * len(q)], pa.int64()), "distance": pa.array([*far.tolist(), *[None] * len(q)], pa.float64()), "looked": np.concatenate([np.zeros(len(at), np.int64), looked])})


_OUT = "query_id long, id long, distance double, looked long"


def _meet(queries: DataFrame, vectors: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """Queries (part, cell, query_id, q, to_point, bound) against the vectors (part, cell, id, x, ring) of their cell, in groups and shares of bounded size."""
    key = ["part", "cell"]
    n = counts.join(queries.groupBy(*key).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups")), key)
    left = queries.join(n.drop("n"), key).withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    right = vectors.join(n.drop("n"), key).withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    key += ["share", "group"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return _search(a, b, k) if a.num_rows and b.num_rows else pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64()), "looked": pa.array([], pa.int64())})

    left, right = (df.drop("shares", "groups") for df in (left, right))
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))  # both come from one table: columns of their own
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, _OUT)


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, part: str | None = None, points: int = POINTS) -> DataFrame:
    """Rows (query_id, rank, id, distance, looked): the k nearest vectors of each query, ties by id, and how many vectors were looked at for it.

    queries and vectors: id (long), x (array of numbers, one length); with part only those of
    equal part, which is not null, are neighbours.  Distances are Euclidean, in double precision.  A row is no neighbour of its own id.
    Rows without an id or a vector take no part; a query without any neighbour gives no row.
    """
    def given(df: DataFrame) -> DataFrame:
        df = df.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), (F.col(part).cast("string") if part else F.lit("")).alias("part"))
        return df.where("id is not null and x is not null and part is not null")

    vectors, queries = given(vectors), given(queries)
    at = reference_points(vectors, "x", points)

    def place(batches):
        for batch in batches:
            x = _matrix(batch.column("x"))
            far = np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in at], axis=1) if len(x) and len(at) else np.zeros((len(x), 0))
            cell = far.argmin(axis=1) if far.size else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), batch.column("x"), pa.array(cell, pa.int32()), pa.array(list(far), pa.list_(pa.float64()))], ["id", "part", "x", "cell", "far"])

    placed = "id long, part string, x array<double>, cell int, far array<double>"
    own = F.try_element_at("far", F.col("cell") + 1)
    known = checkpointed(vectors.mapInArrow(place, placed).select("part", "cell", "id", "x", own.alias("ring")))
    rings = checkpointed(known.groupBy("part", "cell").agg(F.min("ring").alias("low"), F.max("ring").alias("high"), F.count("*").alias("n"), F.ceil(F.count("*") / SHARE).cast("int").alias("shares")))
    asked = checkpointed(queries.mapInArrow(place, placed).select("part", "cell", F.col("id").alias("query_id"), F.col("x").alias("q"), "far"))
    home = _meet(asked.withColumns({"to_point": own, "bound": F.lit(float("inf"))}).drop("far"), known, rings.select("part", "cell", "n", "shares"), k)
    home = checkpointed(_first(home, k))
    # The k-th distance at home bounds what other cells can add.
    bound = home.groupBy("query_id").agg(F.max(F.when(F.col("place") == k, F.col("distance"))).alias("bound"))
    rest = asked.join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))).withColumnRenamed("cell", "home")
    there = F.element_at("far", F.col("cell") + 1)
    slack = F.col("bound") + _SLACK * (1 + F.col("bound"))
    rest = rest.join(rings, "part").where(F.col("cell") != F.col("home")).withColumn("to_point", there)
    rest = rest.where((F.col("to_point") - F.col("high") <= slack) & (F.col("low") - F.col("to_point") <= slack) & (F.col("to_point") - F.element_at("far", F.col("home") + 1) <= 2 * slack))
    others = _meet(rest.select("part", "cell", "query_id", "q", "to_point", "bound"), known, rings.select("part", "cell", "n", "shares"), k)
    every = home.select("query_id", "id", "distance", "looked").unionAll(others)
    total = every.groupBy("query_id").agg(F.sum("looked").alias("looked"))
    best = _first(every.drop("looked").withColumn("looked", F.lit(0)), k).where("id is not null")
    return best.drop("looked").join(total, "query_id").select("query_id", F.col("place").alias("rank"), "id", "distance", "looked")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each query with their place, and its rows without an id summed up to one, of place 0."""
    looked = found.where("id is null").groupBy("query_id").agg(F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("distance"), F.sum("looked").alias("looked"), F.lit(0).alias("place"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    best = found.where("id is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return best.select("query_id", "id", "distance", "looked", "place").unionAll(looked)


def _products(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """For each query of a group the vectors of a share that may be among the k of greatest product once products are rounded to nine places; of equal products the first k ids."""
    asked, names, q, v = _column(left, "query_id"), _column(right, "id"), _matrix(left.column("q")), _matrix(right.column("x"))
    order = np.argsort(names, kind="stable")
    names, v = names[order], v[order]
    size, who, other, product = np.sqrt((v * v).sum(axis=1).max()), [], [], []
    for i in range(0, len(q), BLOCK):
        near = q[i : i + BLOCK] @ v.T
        own = names[None, :] == asked[i : i + BLOCK, None]
        near[own] = -np.inf
        few = min(k, len(v))
        slack = 2.1e-9 + 1e-15 * (q.shape[1] + 8) * size * np.sqrt((q[i : i + BLOCK] ** 2).sum(axis=1))
        limit = np.partition(near, len(v) - few, axis=1)[:, len(v) - few] - 2 * slack
        rows, columns = np.nonzero((near >= limit[:, None]) & ~own)
        # Summed from left to right, as Spark does.
        sums = [np.cumsum(q[i + rows[j : j + SHARE]] * v[columns[j : j + SHARE]], axis=1)[:, -1] for j in range(0, len(rows), SHARE)]
        if not len(rows):
            continue
        sums = np.concatenate(sums)
        order = np.lexsort((columns, sums, rows))  # ids are in order
        rows, columns, sums = rows[order], columns[order], sums[order]
        starts = np.r_[True, (rows[1:] != rows[:-1]) | (sums[1:] != sums[:-1])]
        at = np.arange(len(rows))
        first = at - np.maximum.accumulate(np.where(starts, at, 0)) < k
        who.append(asked[i + rows[first]])
        other.append(names[columns[first]])
        product.append(sums[first])
    return pa.table({"query_id": np.concatenate([np.zeros(0, np.int64), *who]), "id": np.concatenate([np.zeros(0, np.int64), *other]), "product": np.concatenate([np.zeros(0), *product])})


def greatest_products(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, id, product) among which are, for each query, the k vectors of its part of greatest inner product, rounded to nine places, ties by id.

    queries and vectors: id (long), part, x (finite numbers, one length).  Shares and groups of a part are dealt by id; all pairs are compared, by matrix products.
    """
    vectors, queries = (df.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), F.col("part").cast("string").alias("part")).where("part is not null") for df in (vectors, queries))
    sizes = vectors.groupBy("part").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")).join(queries.groupBy("part").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups")), "part")
    left = queries.join(sizes, "part").select("part", F.col("id").alias("query_id"), F.col("x").alias("q"), F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("group"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    right = vectors.join(sizes, "part").select("part", "id", "x", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return _products(a, b, k) if a.num_rows and b.num_rows else pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "product": pa.array([], pa.float64())})

    key = ["part", "share", "group"]
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "query_id long, id long, product double")
