"""Exact Jaccard join of documents on word shingles, by size-banded tiles and bitmap signatures.

1. Equal texts are one unit from the start.
2. Shingles that no other text has cannot be shared.  A unit too few of whose shingles are
   shared to reach the threshold with anything is done; this ends most of them.
3. Units that agree in the smallest of their shared shingles under either of two hash orders
   meet in a bucket; what is linked there gets one component.
4. Every pair over the threshold shares one of the rarest shingles of both (prefix filter).
   Shingles whose units are not of one component yet are buckets again.  So groups of near
   copies, which step 3 has joined, are not compared once more for each shared shingle.

Within a bucket units are sorted by size and cut into tiles.  A pair of tiles is skipped if
their sizes are too far apart; for the others the Hamming distance of parity bitmaps bounds
each overlap from above, and only pairs that could pass, and are not joined yet, have their
sorted arrays intersected.  Large buckets are dealt into shares, twice anew, which joins what
is alike in them at a cost that grows with the bucket, not its square.  Only of buckets that
still have several components do pairs of shares meet, with bitmaps alone; the sorted
arrays are fetched for the pairs that could pass.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import checkpointed, components
from tidemark.llm.kernels import U64, as_array, buffers, ids_of, lower_ascii, mix, runs, shingle_sets, slices
from tidemark.llm.parts import KEY_SCHEMA, exchange, key_rows, load, number_of_parts, part_of, seen, squeeze, table_of

WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Units of a bucket that one task compares; larger buckets are dealt into shares of this size.
SHARE = 2000
TILE = 256
#: Bits of a bitmap for each shingle of a set, at least; and of any bitmap.
BITS_EACH, LEAST_BITS = 4, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def needed(n, num: int = NUMERATOR, den: int = DENOMINATOR):
    """Shared shingles that a set of n needs with any partner: at least num/den of its own."""
    return -(-n * num // den)


def text_parts(docs: DataFrame, n: int) -> DataFrame:
    """Lower-cased texts dealt into parts by their hash, equal texts of a batch once with their smallest id.  Rows without an id are left out."""

    def pack(batches):
        for batch in batches:
            all_ids, texts = ids_of(batch.column(0)), batch.column(1)
            for i, j in slices(buffers(texts)[1], 8 << 20):
                data, offs = buffers(texts.slice(i, j - i))
                raw = lower_ascii(data).tobytes()
                keys = np.frombuffer(b"".join(hashlib.sha256(raw[a:b]).digest()[:16] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)), U64).reshape(-1, 2)
                order = np.lexsort((all_ids[i:j], keys[:, 1], keys[:, 0]))
                order = order[np.append(True, (keys[order][1:] != keys[order][:-1]).any(axis=1))]
                part = (keys[order, 0] % U64(n)).astype(np.int32)
                order = order[np.argsort(part, kind="stable")]
                part = np.sort(part, kind="stable")
                rows = []
                at, count = runs(part)
                for a, c in zip(at.tolist(), count.tolist(), strict=True):
                    mine = order[a : a + c]
                    pieces = [raw[offs[k] : offs[k + 1]] for k in mine.tolist()]
                    rows.append((int(part[a]), all_ids[i:j][mine].tobytes(), np.array([len(p) for p in pieces], np.int64).tobytes(), squeeze(b"".join(pieces))))
                yield from table_of([("part", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary())], rows).to_batches()

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return rows.mapInArrow(pack, "part int, ids binary, sizes binary, text binary")


class Part:
    """Distinct texts of one part, the smallest id of each, and their shingle sets."""

    def __init__(self, table: pa.Table, k: int):
        ids, data, offs = load(table)
        raw = data.tobytes()
        unit: dict[bytes, int] = {}
        for i, a, b in zip(ids.tolist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            unit.setdefault(raw[a : b - 1], i)  # in the order of ids
        self.ids = np.array(list(unit.values()), np.int64)
        self.names = [hashlib.sha256(t).hexdigest()[:32] for t in unit]
        texts = list(unit)
        offs = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=offs[1:])
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        keys, sizes = [], []
        for i, j in slices(offs):
            got, at = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
            keys.append(got)
            sizes.append(np.diff(at))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, U64)
        self.size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.offs = np.concatenate([[0], np.cumsum(self.size)])
        self.distinct, self.which, self.count = np.unique(self.keys, return_inverse=True, return_counts=True)


_UNIT_SCHEMA = "name string, id long, n long, keys binary, prefix array<long>, low array<long>"


def units(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """_UNIT_SCHEMA rows for all distinct texts; keys (shared shingles, sorted), prefix (the rarest) and low (the smallest under two orders) only where a partner is possible."""
    n = number_of_parts(docs)
    parts = text_parts(docs, n)

    def count(table: pa.Table) -> pa.Table:
        part = Part(table, k)
        return key_rows(part_of(table), part.distinct, n, np.minimum(part.count, 65535), carry=b"")

    def describe(left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left, k)
        level = seen(right, part.distinct, n)[0][part.which]
        shared = np.add.reduceat(np.append(level > 0, 0), part.offs[:-1]) * (part.size > 0) if len(part.ids) else np.zeros(0, np.int64)
        rows = []
        for i, (name, unit, size, alive) in enumerate(zip(part.names, part.ids.tolist(), part.size.tolist(), (shared >= needed(part.size, num, den)) & (part.size > 0), strict=True)):
            if not alive:
                rows.append((name, unit, size, None, None, None))
                continue
            mine = slice(part.offs[i], part.offs[i + 1])
            keys, rare = part.keys[mine], level[mine]
            keys, rare = keys[rare > 0], rare[rare > 0]
            first = np.lexsort((keys, rare))[: len(keys) - needed(size, num, den) + 1]
            low = [int(mix(keys ^ U64(s)).min().view(np.int64)) for s in (0x51ED27, 0xA5F0C3)]
            rows.append((name, unit, size, keys.tobytes(), keys[first].view(np.int64), low))
        return table_of([("name", pa.string()), ("id", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("prefix", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))], rows)

    rows = exchange(parts.groupBy("part").applyInArrow(count, KEY_SCHEMA), n)
    return parts.groupBy("part").cogroup(rows.groupBy("part")).applyInArrow(describe, _UNIT_SCHEMA)


def bitmap(keys: np.ndarray) -> np.ndarray:
    """Parities of how many keys fall on each bit; every key that only one of two sets has changes one bit at most.

    The number of bits is a power of two that follows the set's size, so that sets of any size tell apart.
    """
    bits = max(LEAST_BITS, 1 << (BITS_EACH * len(keys) - 1).bit_length())
    return np.packbits((np.bincount((keys & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").view(U64)


def folded(maps: list[np.ndarray], words: int) -> np.ndarray:
    """The bitmaps at a common width: halves laid on each other give the bitmap of half as many bits."""
    out = np.empty((len(maps), words), U64)
    for i, m in enumerate(maps):
        while len(m) > words:
            m = m[: len(m) // 2] ^ m[len(m) // 2 :]
        out[i] = m
    return out


def bands(size: np.ndarray) -> list[tuple[int, int]]:
    """Tiles of units sorted by size: TILE of them at most, none twice as large as the first."""
    out, a = [], 0
    while a < len(size):
        b = min(a + TILE, int(np.searchsorted(size, 2 * size[a], "left")))
        out.append((a, max(b, a + 1)))
        a = out[-1][1]
    return out


def could_pass(size: np.ndarray, own: np.ndarray, maps: list[np.ndarray], label: np.ndarray, num: int, den: int, side: np.ndarray | None = None):
    """Pairs of tiles of units sorted by size: (first of one, first of the other, matrix of the pairs that could reach the threshold)."""
    tiles = bands(size)
    for t, (a, to) in enumerate(tiles):
        sa = slice(a, to)
        for b, end in tiles[t:]:
            sb = slice(b, end)
            if size[b] * num > size[to - 1] * den:
                break  # all further tiles have sets too large for any of this one
            if side is not None and len(np.unique(np.concatenate([side[sa], side[sb]]))) == 1:
                continue
            words = min(len(m) for m in maps[a:to] + maps[b:end])
            one, two = folded(maps[a:to], words), folded(maps[b:end], words)
            far = np.zeros((to - a, end - b), np.int32)
            for w in range(words):
                far += np.bitwise_count(one[:, None, w] ^ two[None, :, w])
            most = (own[sa, None] + own[None, sb] - far) // 2  # the overlap is no larger
            could = (num + den) * most >= num * (size[sa, None] + size[None, sb])
            could &= np.minimum(own[sa, None], own[None, sb]) * (num + den) >= num * (size[sa, None] + size[None, sb])
            could &= label[sa, None] != label[None, sb]
            if side is not None:
                could &= side[sa, None] != side[None, sb]
            yield a, b, np.triu(could, 1) if a == b else could


def compare(size: np.ndarray, keys: list[np.ndarray], label: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links (i, j) that join labels not joined before."""
    order = np.argsort(size, kind="stable")
    size, label = size[order], np.unique(label[order], return_inverse=True)[1]
    keys = [keys[i] for i in order]
    own = np.array([len(k) for k in keys])
    links = []
    for a, b, could in could_pass(size, own, [bitmap(k) for k in keys], label, num, den):
        for i in np.flatnonzero(could.any(axis=1)).tolist():
            for j in np.flatnonzero(could[i]).tolist():
                x, y = a + i, b + j
                if label[x] != label[y] and overlap_reaches(size[x], size[y], keys[x], keys[y], num, den):
                    links.append((int(order[x]), int(order[y])))
                    label[label == label[y]] = label[x]
    return links


def overlap_reaches(n: int, m: int, one: np.ndarray, two: np.ndarray, num: int, den: int) -> bool:
    return (num + den) * len(np.intersect1d(one, two, assume_unique=True)) >= num * (n + m)


def within_shares(rows: DataFrame, sets: DataFrame, salt: int, num: int, den: int) -> DataFrame:
    """Links (a, b) of the units (bucket, id, component, shares) that one dealing brings into one share."""
    share = F.pmod(F.xxhash64("id", F.lit(salt)), F.col("shares")).cast("int")
    rows = rows.withColumn("share", share).join(sets.select("id", "n", "keys"), "id").select("bucket", "share", "id", "component", "n", "keys")

    def run(table: pa.Table) -> pa.Table:
        ids, label, size = (as_array(table.column(c)).to_numpy() for c in ("id", "component", "n"))
        found = compare(size, [np.frombuffer(k, U64) for k in table.column("keys").to_pylist()], label, num, den)
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in found], pa.int64()), "b": pa.array([int(ids[j]) for _, j in found], pa.int64())})

    return rows.groupBy("bucket", "share").applyInArrow(run, "a long, b long")


def across_shares(rows: DataFrame, sets: DataFrame, salt: int, num: int, den: int) -> DataFrame:
    """Links (a, b) of the units (bucket, id, component, shares) of different shares: bitmaps meet first, sorted arrays only for pairs that could pass."""

    def sketch(batches):
        for batch in batches:
            keys = [np.frombuffer(k, U64) for k in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(k) for k in keys], pa.int64()), pa.array([bitmap(k).tobytes() for k in keys], pa.binary())], ["id", "n", "own", "map"])

    share = F.pmod(F.xxhash64("id", F.lit(salt)), F.col("shares")).cast("int")
    rows = rows.withColumns({"share": share, "other": F.explode(F.sequence(F.lit(0), F.col("shares") - 1))}).where("share <> other").withColumns({"x": F.least("share", "other"), "y": F.greatest("share", "other")})
    rows = rows.join(sets.select("id", "n", "keys").mapInArrow(sketch, "id long, n long, own long, map binary"), "id")

    def meet(table: pa.Table) -> pa.Table:
        ids, label, share, size, own = (as_array(table.column(c)).to_numpy() for c in ("id", "component", "share", "n", "own"))
        maps = [np.frombuffer(m, U64) for m in table.column("map").to_pylist()]
        order = np.argsort(size, kind="stable")
        ids, found = ids[order], [np.zeros((2, 0), np.int64)]
        for a, b, could in could_pass(size[order], own[order], [maps[i] for i in order.tolist()], label[order], num, den, share[order]):
            i, j = np.nonzero(could)
            found.append(np.stack([ids[a + i], ids[b + j]]))
        found = np.concatenate(found, axis=1)
        return pa.table({"a": found.min(axis=0), "b": found.max(axis=0)})

    pairs = rows.groupBy("bucket", "x", "y").applyInArrow(meet, "a long, b long").distinct()
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("keys").alias(f"keys_{c}"))

    def verify(batches):
        for batch in batches:
            a, b, n, m, one, two = (batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "keys_a", "keys_b"))
            keep = [overlap_reaches(p, q, np.frombuffer(x, U64), np.frombuffer(y, U64), num, den) for p, q, x, y in zip(n, m, one, two, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(verify, "a long, b long")


def links_in(buckets: DataFrame, sets: DataFrame, num: int, den: int, all_: bool = True) -> DataFrame:
    """Links (a, b) found in buckets (token, id, component), enough to join whatever is linked in them; a bucket of one component is left out.

    Without all_ large buckets are only dealt into shares, twice: what no share brings together there is left to a later call.
    """
    # Tokens whose units come from the same components make one bucket: near copies share hundreds.
    met = buckets.select("token", "component").distinct().groupBy("token").agg(F.bit_xor(F.xxhash64("component")).alias("who"), F.count("*").alias("parties")).where("parties > 1")
    rows = buckets.join(met, "token").select(F.xxhash64("who", "parties").alias("bucket"), "id", "component").distinct()
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    rows = checkpointed(rows.join(sizes, "bucket"))
    found, large = checkpointed(within_shares(rows, sets, 0, num, den)), rows.where("shares > 1")
    for meeting in (within_shares, across_shares)[: 2 if all_ else 1]:
        if large.isEmpty():
            return found
        joined = components(found.unionAll(large.select("id", "component")))
        large = large.withColumnRenamed("component", "before").join(joined, "id", "left").select("bucket", "id", F.coalesce("component", "before").alias("component"), "shares")
        several = large.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("greatest")).where("least <> greatest").select("bucket")
        large = checkpointed(large.join(several, "bucket"))
        found = checkpointed(found.unionAll(meeting(large, sets, 1, num, den)))  # pairs of shares follow the second dealing
    return found


def nameless(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) for the documents without an id: the size of each one's set, and nothing else."""

    def count(batches):
        for batch in batches:
            _, offs = buffers(batch.column(0))
            for i, j in slices(offs, 8 << 20):
                data, at = buffers(batch.column(0).slice(i, j - i), " ")
                sizes = np.diff(shingle_sets(lower_ascii(data), at, k)[1])
                none = pa.nulls(j - i, pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(sizes, pa.int64()), none], ["doc_id", "n_shingles", "component_id"])

    return docs.where("doc_id is null").select(F.col("text").cast("string")).mapInArrow(count, "doc_id long, n_shingles long, component_id long")


def jaccard_components(docs: DataFrame, k: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) for every document.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set has its distinct
    shingles of k words, or its whole sequence if it has fewer words.  Documents link where
    the shared shingles are at least num/den of those of either.  component_id is the smallest
    doc_id reachable by links, itself included.  Null, empty and blank texts have no set and
    link with nothing, not with each other.  Rows without doc_id link with nothing either: their
    component is null.  Repeated rows each give a row.  Other columns are ignored.  Shingles
    are compared by 64-bit hashes, texts by 128 bits of SHA-256.
    """
    spark_units = checkpointed(units(docs, k, num, den))
    alive = spark_units.where("keys is not null")
    first = alive.select("id", F.explode("low").alias("token")).select("token", "id", F.col("id").alias("component")).distinct()
    near = links_in(first, alive, num, den, all_=False)  # the next step finds every link that is left
    joined = components(near)
    of = alive.join(joined, "id", "left").select("id", "prefix", F.coalesce("component", "id").alias("component"))
    rest = links_in(of.select("id", "component", F.explode("prefix").alias("token")), alive, num, den)
    of = components(near.unionAll(rest))
    done = spark_units.select("name", "id", "n").join(of, "id", "left").select("name", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))
    members = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("doc_id").isNotNull(), F.substring(F.sha2(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER).cast("binary"), 256), 1, 32)).alias("name"))
    result = members.where("doc_id is not null").join(done, "name", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return result.unionAll(nameless(docs, k))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that are the smallest of their component, all columns as they were; of repeated doc_ids every row stays.  Rows without an id stay."""
    first = jaccard_components(docs, **options).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    same = docs.join(first, F.col("doc_id").cast("long") == F.col("kept_id"), "left_semi")
    return same.unionAll(docs.where("doc_id is null"))
