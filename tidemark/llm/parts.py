"""Documents dealt into parts by a hash of id and text, and key exchanges between parts.

A *part* holds a bounded share of the documents: texts are measured first, and the
number of parts follows from their bytes, so that every part fits in a task whatever
the settings.  Texts travel compressed.  Keys (hashes of windows or shingles) are
dealt by their leading bits into as many parts; one sorted array for each pair of
parts travels instead of a row for each key.  Equal keys of one part travel once,
so a very frequent key costs a part one entry, not one for each occurrence.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kernels import U64, as_array, buffers, ids_of, mix, runs, slices

#: Bytes of text in a part, about; a longer text has a part to itself.
PART_BYTES = 8 << 20


def number_of_parts(docs: DataFrame) -> int:
    """From the bytes of all texts; one aggregate over the text column."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"]
    return max(1, math.ceil((total or 0) / PART_BYTES))


def need_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; what else there is, clashing names included, is left behind."""
    return docs.select(*[F.col(n).cast("string" if n == "text" else "long").alias(n) for n in names])


def squeeze(data) -> bytes:
    return pa.Codec("zstd", compression_level=5).compress(pa.py_buffer(data), asbytes=True)


def unsqueeze(data: bytes, size: int, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), dtype) if size else np.zeros(0, dtype)


def doc_parts(docs: DataFrame, n: int) -> DataFrame:
    """Rows (part, ids, sizes, text): for each batch of documents one row for each part that it has documents of."""

    def pack(batches):
        for batch in batches:
            all_ids = ids_of(batch.column(0))
            texts = batch.column(1)
            _, offs = buffers(texts)
            for i, j in slices(offs, 16 << 20):
                ids = all_ids[i:j]
                data, at = buffers(texts.slice(i, j - i))
                # By text, too: any number of rows may have one id or none.
                look = np.array([zlib.crc32(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], U64)
                part = (mix(mix(ids.view(U64)) ^ look) % U64(n)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                data, at = buffers(texts.slice(i, j - i).take(pa.array(order)))
                ids, part = ids[order], part[order]
                rows = []
                for a, b in blocks(part):
                    rows.append((int(part[a]), ids[a:b].tobytes(), np.diff(at[a : b + 1]).tobytes(), squeeze(data[at[a] : at[b]])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "ids", "sizes", "text"])

    return need_columns(docs, "doc_id", "text").mapInArrow(pack, "part int, ids binary, sizes binary, text binary")


def load(table: pa.Table, pad: bytes = b" ") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bytes and n+1 offsets of a part's documents in the order of id, then text, each followed by pad."""
    found = []
    for ids, sizes, text in zip(*(table.column(c).to_pylist() for c in ("ids", "sizes", "text")), strict=True):
        sizes = np.frombuffer(sizes, np.int64)
        ends = np.cumsum(sizes)
        raw = pa.decompress(text, int(ends[-1]), codec="zstd", asbytes=True) if ends[-1] else b""
        found += zip(np.frombuffer(ids, np.int64).tolist(), (raw[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)), strict=True)
    found.sort()
    offs = np.zeros(len(found) + 1, np.int64)
    np.cumsum([len(t) + len(pad) for _, t in found], out=offs[1:])
    data = np.frombuffer(pad.join([*(t for _, t in found), b""]), np.uint8)
    return np.array([i for i, _ in found], np.int64), data, offs


def key_part(keys: np.ndarray, n: int) -> np.ndarray:
    """Part of each key, by its leading 32 bits: sorted keys have sorted parts."""
    return ((keys >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def blocks(part: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal parts."""
    at, size = runs(part)
    return list(zip(at.tolist(), (at + size).tolist(), strict=True))


def planes(keys: np.ndarray, n_bytes: int = 8) -> bytes:
    """The leading bytes of sorted keys, most significant bytes first, which compress well."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].T).tobytes()


def from_planes(data: bytes, n_bytes: int = 8) -> np.ndarray:
    out = np.zeros((len(data) // n_bytes, 8), np.uint8)
    out[:, :n_bytes] = np.frombuffer(data, np.uint8).reshape(n_bytes, -1).T
    return out.view(">u8").ravel().astype(U64)


def table_of(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(schema)})


KEY_SCHEMA = "part int, source int, keys binary, counts binary, carry binary"
KEY_ARROW = [("part", pa.int32()), ("source", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("carry", pa.binary())]
#: Keys of a part at most, about: a word has two bytes with its space.
PART_KEYS = PART_BYTES // 2


def key_bytes(n: int) -> int:
    """Bytes of a key that travel where a false repeat only costs a later look: with so many parts, one key in a thousand is taken for a repeat by chance."""
    return min(8, math.ceil((math.log2(n * PART_KEYS) + 10) / 8))


def key_rows(source: int, keys: np.ndarray, n: int, counts: np.ndarray | None = None, carry: bytes | None = None) -> pa.Table:
    """Rows for KEY_SCHEMA from sorted distinct keys.  carry returns to the source unread."""
    part = key_part(keys, n)
    rows = []
    for a, b in blocks(part):
        rows.append((int(part[a]), source, planes(keys[a:b], key_bytes(n)), None if counts is None else counts[a:b].astype(np.uint16).tobytes(), None))
    if carry is not None:
        rows.append((source % n, source, None, None, carry))
    return table_of(KEY_ARROW, rows)


SEEN_SCHEMA = "part int, block int, seen binary, carry binary"
SEEN_ARROW = [("part", pa.int32()), ("block", pa.int32()), ("seen", pa.binary()), ("carry", pa.binary())]


def how_often(table: pa.Table, width: int) -> pa.Table:
    """For the keys of one key part, of so many bytes each: to each source, in its order, the log2 class of each key's count over all sources: 0 once, 1 twice or three times, ..."""
    rows = table.to_pylist()
    out = [(r["source"], -1, None, r["carry"]) for r in rows if r["keys"] is None]
    rows = [r for r in rows if r["keys"] is not None]
    if rows:
        each = [from_planes(r["keys"], width) for r in rows]
        keys = np.concatenate(each)
        count = np.concatenate([np.ones(len(k), np.int64) if r["counts"] is None else np.frombuffer(r["counts"], np.uint16).astype(np.int64) for k, r in zip(each, rows, strict=True)])
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        total = np.add.reduceat(count[order], first)
        level = np.empty(len(keys), np.uint8)
        level[order] = np.repeat(np.minimum(np.log2(total), 63).astype(np.uint8), np.diff(np.append(first, len(keys))))
        at = 0
        for k, r in zip(each, rows, strict=True):
            out.append((r["source"], r["part"], squeeze(level[at : at + len(k)].tobytes()), None))
            at += len(k)
    return table_of(SEEN_ARROW, out)


def exchange(keys: DataFrame, n: int) -> DataFrame:
    """From KEY_SCHEMA rows of so many parts, SEEN_SCHEMA rows for the parts that the keys came from."""
    width = key_bytes(n)
    return keys.groupBy("part").applyInArrow(lambda table: how_often(table, width), SEEN_SCHEMA)


def seen(table: pa.Table, keys: np.ndarray, n: int) -> tuple[np.ndarray, bytes | None]:
    """The classes of a part's sorted distinct keys, as they came back, and what was carried."""
    rows = table.to_pylist()
    carry = next((r["carry"] for r in rows if r["seen"] is None), None)
    sizes = np.bincount(key_part(keys, n), minlength=n)
    rows = sorted((r for r in rows if r["seen"] is not None), key=lambda r: r["block"])
    out = [unsqueeze(r["seen"], int(sizes[r["block"]]), np.uint8) for r in rows]
    got = np.concatenate(out) if out else np.zeros(0, np.uint8)
    if len(got) != len(keys):
        raise ValueError(f"{len(keys)} keys went out, {len(got)} came back")
    return got, carry


def part_of(table: pa.Table) -> int:
    return as_array(table.column("part"))[0].as_py()
