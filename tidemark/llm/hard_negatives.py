"""Hard negatives by rotated one-bit codes with stored alignments and exact integer scores.

Vectors become integers and are turned by a random orthogonal matrix, which changes no product.
A code keeps one bit, the sign, of each turned component; the product of code and vector,
their *alignment*, is stored beside it.  What code times alignment leaves of the vector is coded
again, some levels deep.  An anchor keeps some bit planes of its turned components, so that its
product with a code is a few popcounts.  What is left after a level is bounded by
Cauchy-Schwarz: the product lies within estimate ± (rest of the vector x length of the anchor +
rounding of the anchor x length of the code's vector).  This interval is certain, not
likely: a vector goes only if its whole interval lies outside what is asked for.  The product of
the integers themselves is taken for the vectors whose interval survives.

Two rounds over the same blocks: anchors with vectors of their label give the positives; with
their scores known, anchors with all others give the negatives of each positive.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import checkpointed
from tidemark.llm.kernels import as_array
from tidemark.llm.vector_blocks import blocks, finite, first_ranks, grid, queries

#: Levels of codes, bit planes of an anchor.
LEVELS, PLANES = 4, 6
#: Anchors compared at a time, vectors compared at a time, and the share of pairs from which on pairs are listed one by one.
_TILE, _WIDE, _FEW = 128, 4096, 0.2
#: Rounding of sums in double precision, as a part of the product of lengths.
_SLACK = 1e-9


@lru_cache(maxsize=4)
def rotation(size: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    return np.linalg.qr(np.random.default_rng(size).normal(size=(size, size)))[0]


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as integers of the least width that holds them."""
    q = np.floor(256 * x)
    most = np.abs(q).max(initial=0)
    if most >= 2.0**62:
        raise ValueError("a component times 256 does not fit in a long")
    return q.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def bits(positive: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    packed = np.packbits(positive, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


class Codes:
    """Codes, alignments and lengths of the rests of integer vectors, level by level."""

    def __init__(self, q: np.ndarray, levels: int = LEVELS):
        rest = q.astype(np.float64) @ rotation(q.shape[1]) if len(q) else np.zeros((0, q.shape[1]))
        self.length = np.linalg.norm(rest, axis=1)
        self.code, self.alignment, self.rest = [], [], []
        for _ in range(levels):
            sign = np.where(rest > 0, 1.0, -1.0) / np.sqrt(q.shape[1])
            along = (rest * sign).sum(axis=1)
            rest = rest - along[:, None] * sign
            self.code.append(bits(sign > 0))
            self.alignment.append(along)
            self.rest.append(np.linalg.norm(rest, axis=1))

    def __getitem__(self, at) -> Codes:
        part = object.__new__(Codes)
        part.length = self.length[at]
        part.code, part.alignment, part.rest = ([v[at] for v in values] for values in (self.code, self.alignment, self.rest))
        return part

    def to_bytes(self) -> bytes:
        return b"".join([self.length.tobytes(), *(v.tobytes() for level in zip(self.code, self.alignment, self.rest, strict=True) for v in level)])

    @classmethod
    def from_bytes(cls, data: bytes, n: int, size: int) -> Codes:
        part, words, at = object.__new__(cls), -(-size // 64), 0

        def take(count: int, dtype) -> np.ndarray:
            nonlocal at
            at += 8 * count
            return np.frombuffer(data, dtype, count, at - 8 * count)

        part.length = take(n, np.float64)
        part.code, part.alignment, part.rest = [], [], []
        while at < len(data):
            part.code.append(take(n * words, np.uint64).reshape(n, words))
            part.alignment.append(take(n, np.float64))
            part.rest.append(take(n, np.float64))
        return part

    @classmethod
    def join(cls, parts: list[Codes]) -> Codes:
        one = object.__new__(cls)
        one.length = np.concatenate([p.length for p in parts])
        one.code, one.alignment, one.rest = ([np.concatenate(v) for v in zip(*(getattr(p, name) for p in parts), strict=True)] for name in ("code", "alignment", "rest"))
        return one


class Planes:
    """Bit planes of turned anchors, and what rounding to them leaves."""

    def __init__(self, q: np.ndarray):
        y = q.astype(np.float64) @ rotation(q.shape[1])
        self.length = np.linalg.norm(y, axis=1)
        self.middle = (1 << PLANES) / 2 - 0.5
        self.step = np.maximum(np.abs(y).max(axis=1, initial=0) / self.middle, 1e-300)
        u = np.clip(np.rint(y / self.step[:, None] + self.middle), 0, (1 << PLANES) - 1).astype(np.int64)
        self.off = np.linalg.norm(y - (u - self.middle) * self.step[:, None], axis=1)
        self.plane = [bits((u >> b & 1).astype(bool)) for b in range(PLANES)]
        self.total, self.size = u.sum(axis=1), q.shape[1]

    def products(self, code: np.ndarray, i, j) -> np.ndarray:
        """Products of rounded anchors i with codes j, by popcounts; i and j index either a whole tile or one pair after another."""
        count = 0
        for b, plane in enumerate(self.plane):
            count = count + (np.bitwise_count(plane[i] & code[j]).sum(axis=-1, dtype=np.int32) << b)
        ones = np.bitwise_count(code[j]).sum(axis=-1, dtype=np.int32)
        return (2 * count - self.total[i] - self.middle * (2 * ones - self.size)) * (self.step[i] / np.sqrt(self.size))


def interval(a: Planes, v: Codes, level: int, i, j) -> np.ndarray:
    """Half the width of the interval of the pairs after a level."""
    return v.rest[level][j] * a.length[i] + a.off[i] * (v.length[j] + v.rest[level][j]) + _SLACK * v.length[j] * a.length[i]


def scores(a: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of the pairs."""
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), 1 << 15):
        t = slice(s, s + (1 << 15))
        out[t] = np.einsum("ij,ij->i", a[i[t]], v[j[t]])
    return out


def survivors(a: Planes, v: Codes, open_: np.ndarray, least, most: np.ndarray, counts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) among the open ones whose interval meets [least, most] of the anchor after every level.

    least is an array, or a function that gives one from the estimates of the first level.
    counts, if given, gets how many pairs were open before each level, and after the last.
    """
    counts = [] if counts is None else counts
    i, j, estimate, every, each = slice(None), slice(None), 0.0, (slice(None), None), (None, slice(None))
    level, dense = 0, True
    while level < len(v.code):
        counts.append(int(open_.sum()) if dense else len(i))
        if dense:
            estimate = estimate + v.alignment[level][None, :] * _tile(a, v.code[level])
            half = interval(a, v, level, *(every, each))
            if callable(least):
                least = least(np.where(open_, estimate, -np.inf))
            open_ = open_ & (estimate + half >= least[:, None]) & (estimate - half <= most[:, None])
            level += 1
            if open_.mean() <= _FEW or level == len(v.code):
                i, j = np.nonzero(open_)
                estimate, dense = estimate[i, j], False
        else:
            estimate = estimate + v.alignment[level][j] * a.products(v.code[level], i, j)
            half = interval(a, v, level, i, j)
            keep = (estimate + half >= least[i]) & (estimate - half <= most[i])
            i, j, estimate = i[keep], j[keep], estimate[keep]
            level += 1
    counts.append(len(i))
    return i, j


def _tile(a: Planes, code: np.ndarray) -> np.ndarray:
    """Products of all rounded anchors with all codes."""
    count = np.zeros((len(a.total), len(code)), np.int32)
    for b, plane in enumerate(a.plane):
        for w in range(code.shape[1]):
            count += np.bitwise_count(plane[:, None, w] & code[None, :, w]).astype(np.int32) << b
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.int32)
    return (2 * count - a.total[:, None] - (a.middle * (2 * ones - a.size))[None, :]) * (a.step / np.sqrt(a.size))[:, None]


class Share:
    """A share's vectors in the order of their labels."""

    def __init__(self, table: pa.Table, size: int):
        rows = table.to_pylist()
        q, codes = zip(*(read(r) for r in rows), strict=True)
        labels = np.concatenate([np.frombuffer(r["labels"], np.int64) for r in rows])
        order = np.argsort(labels, kind="stable")
        self.labels = labels[order]
        self.ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])[order]
        self.block = np.repeat([r["block"] for r in rows], [r["n"] for r in rows])[order]
        self.place = np.concatenate([np.arange(r["n"]) for r in rows])[order]
        self.q = np.concatenate([x.astype(np.int64) for x in q])[order]
        self.codes = Codes.join(list(codes))[order]

    def fits(self, anchors: np.ndarray) -> None:
        if int(np.abs(anchors).max(initial=0)) * int(np.abs(self.q).max(initial=0)) * self.q.shape[1] >= 1 << 63:
            raise ValueError("scores do not fit in a long")


def write(x: np.ndarray) -> bytes:
    q = whole(x)
    return bytes([q.itemsize]) + q.tobytes() + Codes(q).to_bytes()


def read(row: dict) -> tuple[np.ndarray, Codes]:
    width, n, size = row["x"][0], row["n"], row["size"]
    end = 1 + width * n * size
    return np.frombuffer(row["x"][1:end], f"<i{width}").reshape(n, size), Codes.from_bytes(row["x"][end:], n, size)


def anchors_of(table: pa.Table) -> tuple[np.ndarray, ...]:
    return (np.stack([np.frombuffer(v, np.int64) for v in table.column("q").to_pylist()]), *(as_array(table.column(c)).to_numpy(zero_copy_only=False) for c in ("block", "place", "id", "label")))


_POSITIVE = "block long, place int, anchor_id long, positive_id long, positive_score long"
_NEGATIVE = "block long, place int, anchor_id long, nth int, positive_id long, positive_score long, negative_id long, negative_score long"


def empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))})


def best_positives(left: pa.Table, right: pa.Table, most: int) -> pa.Table:
    """The first rows of each anchor's own label in a share, by score, then id."""
    if not left.num_rows or not right.num_rows:
        return empty(_POSITIVE)
    q, block, place, ids, label = anchors_of(left)
    v = Share(right, q.shape[1])
    v.fits(q)
    found = [(np.zeros(0, np.int64),) * 3]
    for one in np.unique(label).tolist():
        lo, hi = np.searchsorted(v.labels, [one, one + 1]).tolist()
        mine = np.flatnonzero(label == one)
        for s in range(0, len(mine) if hi > lo else 0, _TILE):
            at = mine[s : s + _TILE]
            top = [np.zeros(0, np.int64)] * 3
            bound = np.full(len(at), -np.inf)
            for w in range(lo, hi, _WIDE):  # what was found so far bounds what is still to come
                part = slice(w, min(w + _WIDE, hi))
                own = (block[at][:, None] == v.block[part][None, :]) & (place[at][:, None] == v.place[part][None, :])

                def least(estimate: np.ndarray) -> np.ndarray:
                    if estimate.shape[1] <= most:
                        return bound
                    j = np.argpartition(-estimate, most - 1, axis=1)[:, :most]
                    i = np.repeat(np.arange(len(at)), most)
                    exact = scores(q[at], v.q[part], i, j.ravel()).astype(float)
                    exact[np.isneginf(estimate[i, j.ravel()])] = -np.inf
                    return np.maximum(bound, exact.reshape(-1, most).min(axis=1))

                i, j = survivors(Planes(q[at]), v.codes[part], ~own, least, np.full(len(at), np.inf))
                top = [np.concatenate(c) for c in zip(top, (i, j + w, scores(q[at], v.q[part], i, j)), strict=True)]
                keep = first_ranks(top[0], -top[2], v.ids[top[1]], most=most)
                top = [c[keep] for c in top]
                full = np.bincount(top[0], minlength=len(at)) == most
                last = np.full(len(at), np.iinfo(np.int64).max)
                np.minimum.at(last, top[0], top[2])
                bound = np.where(full, last.astype(float), -np.inf)
            found.append((at[top[0]], top[1], top[2]))
    i, j, score = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.table({"block": block[i], "place": pa.array(place[i], pa.int32()), "anchor_id": ids[i], "positive_id": v.ids[j], "positive_score": score})


def best_negatives(left: pa.Table, right: pa.Table, most: int, percent: int) -> pa.Table:
    """For each anchor and positive the first rows of other labels in a share whose score is percent to 100 hundredths of the positive's."""
    if not left.num_rows or not right.num_rows:
        return empty(_NEGATIVE)
    q, block, place, ids, label = anchors_of(left)
    v = Share(right, q.shape[1])
    v.fits(q)
    lists = left.column("positives").to_pylist()
    count = max(len(p) for p in lists)
    wanted = np.full((len(q), count), -1, np.int64)
    names = np.zeros((len(q), count), np.int64)
    for k, positives in enumerate(lists):
        for p in positives:
            wanted[k, p["nth"] - 1], names[k, p["nth"] - 1] = p["positive_score"], p["positive_id"]
    # A product of percent and score may pass a long's end: bounds are worked out once, in Python's integers.  Below zero no score is in the range.
    low = np.array([[-(-percent * int(p) // 100) for p in row] for row in wanted], np.int64)
    able = wanted >= 0
    least = np.where(able, low, np.iinfo(np.int64).max).min(axis=1)
    greatest = wanted.max(axis=1)
    found = [(np.zeros(0, np.int64),) * 4]
    tries = np.flatnonzero(able.any(axis=1))
    for s in range(0, len(tries), _TILE):
        at = tries[s : s + _TILE]
        planes, top = Planes(q[at]), [np.zeros(0, np.int64)] * 4
        for w in range(0, len(v.ids), _WIDE):
            part = slice(w, w + _WIDE)
            i, j = survivors(planes, v.codes[part], label[at][:, None] != v.labels[part][None, :], least[at].astype(float), greatest[at].astype(float))
            score, j = scores(q[at], v.q[part], i, j), j + w
            for nth in range(count):
                fits = able[at[i], nth] & (score >= low[at[i], nth]) & (score <= wanted[at[i], nth])
                new = (i[fits], np.full(int(fits.sum()), nth), j[fits], score[fits])
                top = [np.concatenate(c) for c in zip(top, new, strict=True)]
            keep = first_ranks(top[0] * count + top[1], -top[3], v.ids[top[2]], most=most)
            top = [c[keep] for c in top]
        found.append((at[top[0]], *top[1:]))
    i, nth, j, score = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.table({"block": block[i], "place": pa.array(place[i], pa.int32()), "anchor_id": ids[i], "nth": pa.array(nth + 1, pa.int32()), "positive_id": names[i, nth], "positive_score": wanted[i, nth], "negative_id": v.ids[j], "negative_score": score})


def first_of(rows: DataFrame, key: list[str], score: str, id_: str, most: int, rank: str) -> DataFrame:
    """The first rows of each key by score, then id.  Spark cuts each task's rows down before it shuffles them."""
    order = Window.partitionBy(*key).orderBy(F.desc(score), id_)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= most)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for vectors (vec_id, label, embedding).

    A component x becomes floor(256 x).  Anchors are the rows whose vec_id is divisible by every;
    scores are integer products with the anchor, higher ones first, ties by smaller vec_id.  An
    anchor's positives are the first other rows of its label; a positive's negatives, by rank from 1, are the first
    rows of other labels with percent * positive_score <= 100 * negative_score <= 100 * positive_score.
    Where there are fewer, all of them; none where the positive's score is below zero.

    Rows with a null vec_id, label or vector, with no component, or with a null, NaN or infinite one take no
    part.  A zero vector does.  Rows of other dimensions than the anchor's have no score with it.
    Repeated rows are rows of their own: each is an anchor and a candidate.  Labels are compared as
    longs.  A score that does not fit in a long is an error.  An empty table gives none.  Other columns
    are ignored.
    """
    x = F.col("embedding").cast("array<double>")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite(x), F.lit(False)))
    packed = blocks(rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), x.alias("x")), write)
    asked = queries(packed, every, lambda row: read(row)[0].astype(np.int64)).withColumn("list", F.lit(0))
    found = grid(asked, packed, lambda a, b: best_positives(a, b, positives), _POSITIVE)
    best = first_of(found, ["block", "place"], "positive_score", "positive_id", positives, "nth")
    best = best.groupBy("block", "place").agg(F.collect_list(F.struct("nth", "positive_id", "positive_score")).alias("positives"))
    known = checkpointed(asked.join(best, ["block", "place"]))
    found = grid(known, packed, lambda a, b: best_negatives(a, b, negatives, percent), _NEGATIVE)
    return first_of(found, ["block", "place", "nth"], "negative_score", "negative_id", negatives, "rank").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
