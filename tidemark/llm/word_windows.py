"""Substring deduplication over word windows by level-wise doubling.

Every window of the wanted length has a *landmark*: of the short windows in it the
leftmost of least hash.  Equal windows have equal landmarks, so the first level counts only
short windows that are landmarks, about one in eight.  A window whose landmark occurs
more than once is a candidate; each further level counts the windows of twice the length at
both ends of the candidates and keeps those for which both occur more than once, until
nothing is left or the wanted length is reached.  There a window that also starts
earlier marks its words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.kernels import U64, ids_back, leftmost_least, prefix_sums, runs, slices, windows, windows_at, word_hashes, words
from tidemark.llm.parts import KEY_SCHEMA, blocks, doc_parts, exchange, from_planes, key_part, key_rows, load, number_of_parts, part_of, planes, seen, squeeze, table_of, unsqueeze

_FIRST_SCHEMA = "part int, source int, keys binary, more binary, docs binary, starts binary, carry binary"
_FIRST_ARROW = [("part", pa.int32()), ("source", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary()), ("carry", pa.binary())]
_LATE_SCHEMA = "part int, block int, late binary, carry binary"
_LATE_ARROW = [("part", pa.int32()), ("block", pa.int32()), ("late", pa.binary()), ("carry", pa.binary())]


def lengths(length: int, shortest: int) -> list[int]:
    """Window lengths by level: halves of length, rounded up, while they have at least so many words."""
    out = [length]
    while out[0] > 1 and (out[0] + 1) // 2 >= shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Part:
    """The words of one part's documents."""

    def __init__(self, table: pa.Table):
        self.ids, self.data, self.offs = load(table)
        starts, ends = [], []
        for i, j in slices(self.offs):
            base = self.offs[i]
            a, b, _ = words(self.data[base : self.offs[j]], self.offs[i : j + 1] - base)
            starts.append(a + base)
            ends.append(b + base)
        self.starts, self.ends = np.concatenate(starts), np.concatenate(ends)
        self.word_offs = np.searchsorted(self.starts, self.offs)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.word_offs))
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def words(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words and their prefix sums."""
        if seed not in self.kept:
            out = [np.zeros(0, U64)]
            for i, j in slices(self.offs):  # arrays of eight bytes for each byte of text stay small
                mine, base = slice(self.word_offs[i], self.word_offs[j]), self.offs[i]
                out.append(word_hashes(self.data[base : self.offs[j]], self.starts[mine] - base, self.ends[mine] - base, seed))
            self.kept[seed] = (hashes := np.concatenate(out)), prefix_sums(hashes)
        return self.kept[seed]

    def hashes(self, at: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
        """Hashes of the windows of so many words that begin at the words at; independent ones for other seeds."""
        return windows_at(*self.words(seed), at, length) if len(at) else np.zeros(0, U64)

    def landmarks(self, length: int, short: int) -> np.ndarray:
        """First word of the landmark of the window that begins at each word, whether it stays within a text or not."""
        return leftmost_least(self.hashes(np.arange(len(self.starts) - short + 1), short), length - short + 1) if len(self.starts) >= length else np.zeros(0, np.int64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, which of them each key is, and how often each occurs."""
    order = np.argsort(keys, kind="stable")
    first, count = runs(keys[order])
    which = np.empty(len(keys), np.int64)
    which[order] = np.repeat(np.arange(len(first)), count)
    return keys[order][first], which, count


def looked_at(part: Part, at: np.ndarray, level: int, steps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First words of the two windows of a level that each candidate (first words at) is judged by: its landmark at the first level, then both ends."""
    length = steps[-1]
    if level == 0:
        mark = part.landmarks(length, steps[0])[at]
        return mark, mark
    return at, at + length - steps[level]


def survivors(part: Part, n: int, table: pa.Table, level: int, steps: list[int]) -> np.ndarray:
    """First words of the candidates whose windows of the level that table answers occur more than once."""
    carry = next((r for r in table.column("carry").to_pylist() if r is not None), None)
    at = candidates(part, unsqueeze(carry, (len(part.starts) + 7) // 8, np.uint8))
    one, two = looked_at(part, at, level, steps)
    places = np.unique(np.concatenate([one, two]))
    keys, which, count = distinct(part.hashes(places, steps[level]))
    found, _ = seen(table, keys, n)
    again = np.zeros(len(part.starts), bool)
    again[places] = (found > 0)[which] | (count > 1)[which]
    return at[again[one] & again[two]]


def candidates(part: Part, bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits, count=len(part.starts)))


def mask_bits(size: int, at: np.ndarray) -> bytes:
    mask = np.zeros(size, bool)
    mask[at] = True
    return squeeze(np.packbits(mask).tobytes())


def first_rows(source: int, part: Part, at: np.ndarray, length: int, n: int, carry: bytes) -> pa.Table:
    """For each distinct window of a part its earliest start, by document, then word."""
    keys, more, doc, start, _ = earliest(part, at, length)
    to = key_part(keys, n)
    rows = [(source % n, source, None, None, None, None, carry)]
    for a, b in blocks(to):
        rows.append((int(to[a]), source, planes(keys[a:b]), more[a:b].tobytes(), doc[a:b].tobytes(), start[a:b].astype(np.uint32).tobytes(), None))
    return table_of(_FIRST_ARROW, rows)


def earliest(part: Part, at: np.ndarray, length: int):
    """Distinct windows (two independent hashes each) in order, their earliest document and start, and which of them each of at is."""
    keys, more = part.hashes(at, length), part.hashes(at, length, 1)
    doc = part.ids[part.doc[at]]
    start = at - part.word_offs[part.doc[at]]
    order = np.lexsort((start, doc, more, keys))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
    first = order[new]
    which = np.empty(len(at), np.int64)
    which[order] = np.cumsum(new) - 1
    return keys[first], more[first], doc[first], start[first], which


def later(table: pa.Table) -> pa.Table:
    """For each source's windows whether the same window also starts earlier in another one."""
    rows = table.to_pylist()
    out = [(r["source"], -1, None, r["carry"]) for r in rows if r["keys"] is None]
    rows = [r for r in rows if r["keys"] is not None]
    if rows:
        keys = [from_planes(r["keys"]) for r in rows]
        sizes = [len(k) for k in keys]
        keys = np.concatenate(keys)
        more, doc, start = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("more", U64), ("docs", np.int64), ("starts", np.uint32)))
        order = np.lexsort((start, doc, more, keys))
        new = np.ones(len(order), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
        best = order[new][np.cumsum(new) - 1]
        late = np.empty(len(order), bool)
        late[order] = (doc[order] != doc[best]) | (start[order] != start[best])
        at = 0
        for r, k in zip(rows, sizes, strict=True):
            out.append((r["source"], r["part"], squeeze(np.packbits(late[at : at + k]).tobytes()), None))
            at += k
    return table_of(_LATE_ARROW, out)


def covered(part: Part, n: int, table: pa.Table, length: int) -> np.ndarray:
    """Whether each word lies in a window that also starts earlier."""
    rows = table.to_pylist()
    carry = next(r["carry"] for r in rows if r["carry"] is not None)
    size = len(part.starts)
    at = candidates(part, unsqueeze(carry, (size + 7) // 8, np.uint8))
    keys, _, doc, start, which = earliest(part, at, length)
    counts = np.bincount(key_part(keys, n), minlength=n)
    rows = sorted((r for r in rows if r["late"] is not None), key=lambda r: r["block"])
    late = [np.unpackbits(unsqueeze(r["late"], (counts[r["block"]] + 7) // 8, np.uint8), count=int(counts[r["block"]])).astype(bool) for r in rows]
    late = np.concatenate(late) if late else np.zeros(0, bool)
    # Late is what starts later than the earliest of its own part, and all of a window that another part has earlier.
    mine = (part.ids[part.doc[at]] != doc[which]) | (at - part.word_offs[part.doc[at]] != start[which])
    hit = at[mine | late[which]]
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + length, -1)
    return np.cumsum(step)[:-1] > 0


def kept_texts(part: Part, keep: np.ndarray):
    """For each document the bytes of its kept words, joined by one space."""
    mark = np.zeros(len(part.data) + 1, np.int8)
    mark[part.starts[keep]] += 1
    mark[part.ends[keep] + 1] -= 1  # the byte behind a word is white space, the padding at least
    bytes_kept = np.cumsum(mark[:-1], dtype=np.int8) > 0
    data = part.data.copy()
    data[part.ends[keep]] = 32
    out = data[bytes_kept].tobytes()
    size = np.zeros(len(part.starts) + 1, np.int64)
    np.cumsum((part.ends - part.starts + 1) * keep, out=size[1:])
    bounds = size[part.word_offs]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield out[a : max(a, b - 1)]


def remove_repeats(docs: DataFrame, length: int = 20, shortest: int = 5, texts: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256), and with texts also kept (string).

    Words are runs without ASCII white space, unchanged.  A word goes if a window of length
    words that covers it also starts earlier: in a document of smaller id, or earlier in the
    same one.  Windows are judged on the input.  A null text has no words; empty and short
    texts are kept whole.  A null doc_id counts as smaller than all others and stays null.
    Rows of equal doc_id are told apart by nothing, so neither is earlier than the other at
    the same start.  Other columns are ignored.

    shortest bounds the first level's windows from below.  Each level shuffles hashes, not texts;
    the texts are shuffled once, compressed.  Windows of the wanted length are told apart by
    128 bits of two independent hashes.
    """
    n = number_of_parts(docs)
    parts = doc_parts(docs, n)
    steps = lengths(length, shortest)

    def open_level(table: pa.Table) -> pa.Table:
        part, source = Part(table), part_of(table)
        at = windows(len(part.starts), part.word_offs, length)
        return rows_for(0, source, part, at)

    def rows_for(k: int, source: int, part: Part, at: np.ndarray) -> pa.Table:
        carry = mask_bits(len(part.starts), at)
        if k == len(steps) - 1:
            return first_rows(source, part, at, steps[k], n, carry)
        keys, _, _ = distinct(part.hashes(np.unique(np.concatenate(looked_at(part, at, k, steps))), steps[k]))
        return key_rows(source, keys, n, carry=carry)

    def next_level(k: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            part, source = Part(left), part_of(left)
            return rows_for(k, source, part, survivors(part, n, right, k - 1, steps))

        return run

    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left)
        gone = covered(part, n, right, length)
        removed = np.concatenate([[0], np.cumsum(gone)])[part.word_offs]
        kept = list(kept_texts(part, ~gone))
        cols = {"doc_id": ids_back(part.ids), "n_words": pa.array(np.diff(part.word_offs)), "n_removed": pa.array(np.diff(removed)), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())}
        if texts:
            cols["kept"] = pa.array([t.decode() for t in kept], pa.string())
        return pa.table(cols)

    last = len(steps) - 1
    rows = parts.groupBy("part").applyInArrow(open_level, _FIRST_SCHEMA if last == 0 else KEY_SCHEMA)
    for k in range(1, len(steps)):
        rows = parts.groupBy("part").cogroup(exchange(rows, n).groupBy("part")).applyInArrow(next_level(k), _FIRST_SCHEMA if k == last else KEY_SCHEMA)
    late = rows.groupBy("part").applyInArrow(later, _LATE_SCHEMA)
    return parts.groupBy("part").cogroup(late.groupBy("part")).applyInArrow(close, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
