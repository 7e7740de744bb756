"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors of one label are turned into principal axes, leading axes first.  Two unit
vectors of cosine c lie sqrt(2 - 2c) apart at most.  A tree of cuts across leading axes, grown
on a sample, deals vectors into cells where that keeps few vectors near both sides of a cut;
vectors that are spread alike in all directions stay in one cell.  Within a cell, tiles of
vectors are compared a few axes at a time: what the axes still to come can add is bounded by
the product of the suffix norms, and a tile stops as soon as no pair in it can reach the
threshold.  Rotated vectors travel in single precision; a pair so near to the threshold
that this could matter is decided on the original vectors in double precision.  Equal vectors
are compared once, with their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import checkpointed, components
from tidemark.llm.kernels import as_array

#: Vectors that the axes and the tree are fitted on at most; any axes and any tree give the same result.
FIT_ROWS = 20_000
#: Leading axes that cells are cut across, and the share of a cell's vectors that a cut may put on both sides.
CUT_AXES, MOST_GUESTS = 16, 0.25
STEP, TILE = 8, 512
#: Vectors of a cell that one task compares; larger cells are dealt into pairs of shares of this size.
SHARE = 8192
#: Cosines of vectors in single precision are this exact at least.
_SLACK = 1e-6


def fit(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension the principal axes as columns, leading first, and the vectors of the sample turned to them; from a bounded sample chosen by hash."""
    rows = vectors.select("x").orderBy(F.xxhash64("x"), "x").limit(FIT_ROWS).collect()
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r["x"]), []).append(r["x"])
    found = {}
    for size, xs in by_size.items():
        x = unit(np.array(xs, np.float64))
        turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        found[size] = turn, x @ turn
    return found


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def grow(y: np.ndarray, each: float, radius: float) -> list[tuple[int, float, int, int]]:
    """Nodes (axis, cut, lower child, upper child) of a tree over the sample y, each row of which stands for so many vectors; axis -1 is a cell."""
    nodes: list[tuple[int, float, int, int]] = [(-1, 0.0, 0, 0)]
    open_ = [(0, y)]
    while open_:
        node, rows = open_.pop()
        if len(rows) * each <= SHARE or len(rows) < 32:
            continue
        cuts = np.median(rows[:, :CUT_AXES], axis=0)
        guests = ((rows[:, :CUT_AXES] > cuts) & (rows[:, :CUT_AXES] <= cuts + radius)).mean(axis=0)
        lower = (rows[:, :CUT_AXES] <= cuts).mean(axis=0)
        guests[(lower < 0.2) | (lower > 0.8)] = 1.0
        axis = int(np.argmin(guests))
        if guests[axis] > MOST_GUESTS:
            continue
        cut, low = float(cuts[axis]), rows[:, axis] <= cuts[axis]
        nodes[node] = axis, cut, len(nodes), len(nodes) + 1
        open_ += [(len(nodes), rows[low]), (len(nodes) + 1, rows[~low])]
        nodes += [(-1, 0.0, 0, 0)] * 2
    return nodes


def is_usable() -> Column:
    """True for vectors that can link, else false: id and label not null, all components finite, not all zero."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (id, label, x, k1, k2) of the vectors that can link.  k1 and k2 name label and vector."""
    rows = vectors.where(is_usable()).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    return rows.withColumns({"k1": F.xxhash64("label", "x"), "k2": F.xxhash64("x", "label", F.lit(1))})


def cells(y: np.ndarray, nodes: list[tuple[int, float, int, int]], radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) of every vector in its own cell, and as a guest in cells that it is near to.

    Of two vectors on either side of a cut, the upper one is a guest below; so two vectors
    within the radius meet in one cell only where one of them is at home.
    """
    found, open_ = [], [(0, np.arange(len(y)), np.ones(len(y), bool))]
    while open_:
        node, rows, home = open_.pop()
        axis, cut, low, high = nodes[node]
        if axis < 0:
            found.append((rows, np.full(len(rows), node), home))
            continue
        v = y[rows, axis]
        below, near_above, near_below = v <= cut, (v > cut) & (v <= cut + radius), (v <= cut) & (v > cut - radius) & ~home
        down, up = below | near_above, ~below | near_below
        open_ += [(low, rows[down], (home & below)[down]), (high, rows[up], (home & ~below)[up])]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) of two tiles of unit vectors in PCA order whose product is at or over the threshold, or within _SLACK of it, and whether it is so near."""

    def rest(v: np.ndarray, k: int) -> np.ndarray:
        return np.sqrt((v[:, k:] ** 2).sum(axis=1))

    none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    size = a.shape[1]
    so_far = np.zeros((len(a), len(b)))
    k = 0
    while k < size:
        to = min(size, k + STEP)
        so_far += a[:, k:to] @ b[:, k:to].T
        k = to
        open_ = so_far + np.outer(rest(a, k), rest(b, k)) >= threshold - _SLACK
        n = int(open_.sum())
        if not n:
            return none
        if n * 20 < open_.size:
            break
    i, j = np.nonzero(open_)
    exact = np.empty(len(i))
    for s in range(0, len(i), 1 << 16):
        exact[s : s + (1 << 16)] = np.einsum("ij,ij->i", a[i[s : s + (1 << 16)]], b[j[s : s + (1 << 16)]])
    over = exact >= threshold - _SLACK
    return i[over], j[over], exact[over] < threshold + _SLACK


def compare(y: np.ndarray, weight: np.ndarray, home: np.ndarray, share: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector the number of vectors linked with it in this group, and the first row of its group of linked ones; and the pairs of rows too near to the threshold to tell.

    Pairs of two guests are left to the cell that is one's home.  With share, only pairs of different shares count.
    """
    order = np.argsort(y[:, 0], kind="stable")
    y, w, h = y[order], weight[order], home[order]
    s = None if share is None else share[order]
    n = np.zeros(len(y), np.int64)
    root = np.arange(len(y))
    unsure = [np.zeros((2, 0), np.int64)]

    def top(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = int(root[v])
        return v

    reach = np.sqrt(2 - 2 * threshold) + 1e-6
    for p in range(0, len(y), TILE):
        for q in range(p, len(y), TILE):
            if y[q, 0] - y[min(p + TILE, len(y)) - 1, 0] > reach:
                break
            i, j, close = linked_pairs(y[p : p + TILE], y[q : q + TILE], threshold)
            i, j = i + p, j + q
            keep = (h[i] | h[j]) & (i < j)
            if s is not None:
                keep &= s[i] != s[j]
            unsure.append(order[np.stack([i[keep & close], j[keep & close]])])
            keep &= ~close
            i, j = i[keep], j[keep]
            np.add.at(n, i, w[j])
            np.add.at(n, j, w[i])
            # One link for each pair of groups that meet here is enough.
            while len(i):
                tops = np.array([top(v) for v in range(len(root))]) if len(i) > len(root) else None
                ti, tj = (tops[i], tops[j]) if tops is not None else (np.array([top(v) for v in i.tolist()]), np.array([top(v) for v in j.tolist()]))
                apart = ti != tj
                i, j, ti, tj = i[apart], j[apart], ti[apart], tj[apart]
                if len(i):
                    _, first = np.unique(ti, return_index=True)
                    for f in first.tolist():
                        a, b = top(int(ti[f])), top(int(tj[f]))
                        if a != b:
                            root[max(a, b)] = min(a, b)
    tops = np.array([top(v) for v in range(len(root))], np.int64)
    count, first = np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
    count[order], first[order] = n, order[tops]
    return count, first, np.concatenate(unsure, axis=1)


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two arrays in double precision.  Powers of two, which change no digit, keep very large and small numbers in range."""

    def scaled(v: Column) -> Column:
        top = F.floor(F.log2(F.array_max(F.transform(v, F.abs))))
        half = F.floor(top / 2)  # the whole power may be out of range itself
        return F.when(F.abs(top) > 400, F.transform(v, lambda c: c * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - top))).otherwise(v)

    def dot(v: Column, w: Column) -> Column:
        return F.aggregate(F.zip_with(v, w, lambda a, b: a * b), F.lit(0.0), lambda s, c: s + c)

    x, y = scaled(x), scaled(y)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Two vectors link if their labels are equal and not null, they have as many components, and
    their cosine in double precision is at or over the threshold (above 0).  Vectors that are
    null, empty, zero, or hold a null, NaN or infinity link with nothing and are kept.
    component_id is the smallest vec_id reachable by links, itself included; kept says
    that it is its own.  Equal vectors link with each other.  Rows of one vec_id are vectors
    of their own: each has its own links and component.  A row without vec_id takes no
    part: no links, a null component, not kept.  Other columns are ignored.
    """
    good = usable(vectors)
    classes = good.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("x").alias("x"))
    classes = checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))  # numbers that stay, once written
    radius = float(np.sqrt(2 - 2 * threshold)) + 1e-5
    totals = {r["size"]: r["count"] for r in classes.groupBy(F.size("x").alias("size")).count().collect()}  # a row for each dimension
    turns = {size: (turn, grow(y, totals[size] / len(y), radius)) for size, (turn, y) in fit(classes).items()}
    shared = classes.sparkSession.sparkContext.broadcast(turns)

    def deal(batches):
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column(3).to_pylist()])
            for size in np.unique(sizes).tolist():
                pick = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(pick))
                x = as_array(part.column(3)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                turn, nodes = shared.value.get(size, (np.eye(size), [(-1, 0.0, 0, 0)]))
                y = unit(x) @ turn
                row, cell, home = cells(y, nodes, radius)
                y = y.astype(np.float32)
                taken = part.select([0, 1, 2]).take(pa.array(row))
                for s in range(0, len(row), 10_000):
                    t = slice(s, s + 10_000)
                    yield pa.RecordBatch.from_arrays([*taken.slice(s, 10_000).columns, pa.array(np.full(len(row[t]), size), pa.int32()), pa.array(cell[t], pa.int32()), pa.array(home[t]), pa.array([v.tobytes() for v in y[row[t]]], pa.binary())], ["node", "copies", "label", "size", "cell", "home", "y"])

    dealt = classes.select("node", "copies", "label", "x").mapInArrow(deal, "node long, copies long, label string, size int, cell int, home boolean, y binary")
    key = ["label", "size", "cell"]
    many = dealt.groupBy(*key).agg(F.count("*").alias("members"), F.max(F.col("home").cast("int")).alias("homes")).where("members > 1 and homes > 0").select(*key, F.ceil(F.col("members") / SHARE).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")
    rows = dealt.join(many, key).withColumns({"share": share, "other": F.explode(F.sequence(F.lit(0), F.col("shares") - 1))}).withColumns({"p": F.least("share", "other"), "q": F.greatest("share", "other")})

    def run(table: pa.Table) -> pa.Table:
        ids, weight, home, share = (as_array(table.column(c)).to_numpy(zero_copy_only=False) for c in ("node", "copies", "home", "share"))
        y = np.frombuffer(b"".join(table.column("y").to_pylist()), np.float32).reshape(len(ids), -1).astype(np.float64)
        two = table.column("p")[0].as_py() != table.column("q")[0].as_py()
        count, first, unsure = compare(y, weight, home.astype(bool), share if two else None, threshold)
        found = count > 0
        cols = np.concatenate([ids[found], ids[unsure[0]]]), np.concatenate([count[found], np.zeros(unsure.shape[1], np.int64)]), np.concatenate([ids[first][found], ids[unsure[1]]])
        return pa.table({"node": cols[0], "n": cols[1], "other": cols[2]})

    found = checkpointed(rows.groupBy(*key, "p", "q").applyInArrow(run, "node long, n long, other long"))  # n is 0 for a pair that is left to decide
    side = lambda c: classes.select(F.col("node").alias(c), F.col("copies").alias(f"copies_{c}"), F.col("x").alias(f"x_{c}"))
    unsure = found.where("n = 0").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")
    decided = checkpointed(unsure.where(cosine(F.col("x_a"), F.col("x_b")) >= threshold).select("a", "b", "copies_a", "copies_b"))
    counts = found.where("n > 0").select("node", "n").unionAll(decided.select("a", "copies_b")).unionAll(decided.select("b", "copies_a")).groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(found.where("n > 0").select(F.col("node").alias("a"), F.col("other").alias("b")).unionAll(decided.select("a", "b"))).toDF("node", "component")
    named = classes.select("node", "id").join(joined, "node").groupBy("component").agg(F.min("id").alias("component_id"))
    result = classes.select("k1", "k2", "node", "id", "copies").join(counts, "node", "left").join(joined, "node", "left").join(named, "component", "left")
    result = result.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    members = good.select("id", "k1", "k2").join(result, ["k1", "k2"]).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    alone = vectors.where(~is_usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return members.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
