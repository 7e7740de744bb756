"""Vectors packed into blocks, a row for each, and grids in which every query meets every block once.

A row of its own for each vector would spend more on rows than on numbers.  A block is what
one Arrow batch holds of one dimension, and of one list where vectors are dealt into lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import checkpointed
from tidemark.llm.kernels import as_array

#: Vectors of a share and queries of a group at most: what one task compares.  A vector travels once for each group, a query once for each share.
SHARE, GROUP = 8192, 8192
#: Bytes of a share's or a group's vectors in double precision: vectors of many dimensions come in smaller ones.
MOST_BYTES = 32 << 20


def at_most(rows: int, size: int, most: int) -> int:
    """How many vectors of a dimension one share or group of so many rows and bytes holds."""
    return max(16, min(rows, most // (8 * max(size, 1))))


def finite(x: Column) -> Column:
    """True where all of an array's components are numbers, and finite; null for a null array."""
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size(x) > 0)


def by_size(batch: pa.RecordBatch, x: str = "x") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each dimension, and their vectors in double precision."""
    column = as_array(batch.column(x))
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[starts[rows][:, None] + np.arange(size)]


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return as_array(batch.column(name)).to_numpy(zero_copy_only=False).astype(np.int64)


BLOCK_SCHEMA = "size int, list int, n int, ids binary, labels binary, x binary"
_BLOCK = [("size", pa.int32()), ("list", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("x", pa.binary())]


def blocks(rows: DataFrame, write: Callable[[np.ndarray], bytes], lists: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """BLOCK_SCHEMA rows with a number (block), written to the shared folder, from rows (id, label, x).

    write gives the bytes of a block's vectors, lists the list of each vector (none: all in
    list 0).  Block and place in it name a vector, whatever its id; they stay, once written.
    """

    share, most = SHARE, MOST_BYTES

    def pack(batches):
        for batch in batches:
            ids, labels = longs(batch, "id"), longs(batch, "label")
            for at, x in by_size(batch):
                of = np.zeros(len(at), np.int32) if lists is None else lists(x)
                found = []
                for k in np.unique(of).tolist():
                    all_ = np.flatnonzero(of == k)
                    step = at_most(share, x.shape[1], most)
                    for mine in (all_[s : s + step] for s in range(0, len(all_), step)):
                        found.append((x.shape[1], k, len(mine), ids[at[mine]].tobytes(), labels[at[mine]].tobytes(), write(x[mine])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*found, strict=True), _BLOCK, strict=True)], [name for name, _ in _BLOCK])

    packed = rows.select("id", "label", "x").mapInArrow(pack, BLOCK_SCHEMA)
    return checkpointed(packed.withColumn("block", F.monotonically_increasing_id()))


QUERY_SCHEMA = "block long, place int, size int, id long, label long, q binary"


def queries(packed: DataFrame, every: int, width: Callable[[dict], Callable[[bytes], np.ndarray]]) -> DataFrame:
    """QUERY_SCHEMA rows of the blocks' vectors whose id is divisible by every; width reads a block's vectors."""

    def pick(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    x, labels = width(row)[at], np.frombuffer(row["labels"], np.int64)[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), row["block"])), pa.array(at, pa.int32()), pa.array(np.full(len(at), row["size"]), pa.int32()), pa.array(ids[at]), pa.array(labels), pa.array([v.tobytes() for v in x], pa.binary())],
                        ["block", "place", "size", "id", "label", "q"],
                    )

    return packed.mapInArrow(pick, QUERY_SCHEMA)


def grid(asked: DataFrame, packed: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(queries, blocks) for every pair of a group of queries and a share of blocks of one list and dimension; asked has the columns size and list.

    Groups and shares are dealt by hash, their number follows from counts, one row for each list.
    """
    key = ["size", "list"]
    per = lambda rows: F.greatest(F.lit(16), F.least(F.lit(rows), F.floor(MOST_BYTES / (8 * F.first("size")))))  # noqa: E731  as at_most
    n = packed.groupBy(*key).agg(F.ceil(F.sum("n") / per(SHARE)).cast("int").alias("shares")).join(asked.groupBy(*key).agg(F.ceil(F.count("*") / per(GROUP)).cast("int").alias("groups")), key)
    n = F.broadcast(n)  # lists are few by construction
    left = asked.join(n, key).withColumn("group", F.pmod(F.xxhash64("block", "place"), F.col("groups")).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    right = packed.join(n, key).withColumn("share", F.pmod(F.xxhash64("block"), F.col("shares")).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    key += ["share", "group"]
    return left.drop("shares", "groups").groupBy(*key).cogroup(right.drop("shares", "groups").groupBy(*key)).applyInArrow(run, schema)


def first_ranks(group: np.ndarray, *keys: np.ndarray, most: int) -> np.ndarray:
    """Places of the first so many of each group in the order of keys, the main one first; groups in order."""
    order = np.lexsort((*keys[::-1], group))
    if not len(order):
        return order
    g = group[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[rank < most]
