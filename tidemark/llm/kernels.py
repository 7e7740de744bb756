"""Numpy helpers that run inside tasks on Arrow text: words, hashes, windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
NULL_ID = np.iinfo(np.int64).min

_GOLD = U64(0x9E3779B97F4A7C15)
_BASE = U64(0xD6E8FEB86659FD93)
_SEP = np.zeros(256, bool)
_SEP[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves about half of the output bits."""
    x = np.asarray(x, U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


with np.errstate(over="ignore"):
    # A random number for each byte; low bytes differ, so that no difference is a multiple of a large power of two.
    _BYTE = mix(np.arange(1, 257, dtype=U64) * _GOLD) >> U64(8) << U64(8) | np.arange(256, dtype=U64)
_PLACES: dict[int, np.ndarray] = {}
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base, and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for i, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[i] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums that give the polynomial hash of any range by ``range_hash``."""
    out = np.zeros(len(values) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges; equal ranges hash alike wherever they stand."""
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(U64) * _GOLD)


def as_array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def ids_of(column) -> np.ndarray:
    """Ids as int64; a null id becomes NULL_ID."""
    return pc.fill_null(as_array(column).cast(pa.int64()), int(NULL_ID)).to_numpy(zero_copy_only=False)


def ids_back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def buffers(texts: pa.Array, pad: str = "") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts one after another and the n+1 offsets.  Each text is followed by pad; null counts as empty."""
    texts = pc.fill_null(as_array(texts).cast(pa.large_string()), "")
    if pad:
        texts = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(pad, pa.large_string()))
    texts = as_array(texts)
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = 1 << 19):
    """Ranges of texts with at most so many bytes in all, one text at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs without ASCII white space), and the n+1 word offsets of the texts.  Texts must be padded by a space."""
    sep = _SEP[data]
    edge = np.flatnonzero(np.diff(sep, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    return starts, ends, np.searchsorted(starts, offs)


def places(n: int, seed: int) -> np.ndarray:
    """A random odd number for each place in a word, by seed."""
    if len(_PLACES.get(seed, ())) < n:
        with np.errstate(over="ignore"):
            _PLACES[seed] = mix(np.arange(1, max(n, 1 << 12) + 1, dtype=U64) * _GOLD + mix(U64(seed + 1))) | U64(1)
    return _PLACES[seed]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each word: bytes times random numbers for their places, summed.  Words must not overlap.

    Unlike a polynomial's, the factors follow no rule, so no family of words collides; seeds give independent hashes.
    """
    if not len(starts):
        return np.zeros(0, U64)
    size = ends - starts
    first = np.cumsum(size) - size
    shift = np.repeat(starts - first, size)
    index = np.arange(len(shift))
    index += shift  # the bytes of words
    place = index - np.repeat(starts, size)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(_BYTE[data[index]] * places(int(size.max()), seed)[place], first) + size.astype(U64) * _GOLD)


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of so many words, from the hashes of windows half as long."""
    out, done, block, size = None, 0, hashes, 1
    with np.errstate(over="ignore"):
        n = max(0, len(hashes) - length + 1)
        while size <= length:
            if length & size:
                tail = block[done : done + n]
                out = tail if out is None else mix(mix(out ^ _BASE) + tail)
                done += size
            if size * 2 <= length:
                block = mix(mix(block[: len(block) - size] ^ _BASE) + block[size:])
            size *= 2
        return mix(out + U64(length) * _GOLD)


#: Runs of fewer words than this can't be told apart wrongly by a polynomial of their hashes but by chance.
SHORT = 512


def windows_at(hashes: np.ndarray, sums: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows of so many words that begin at the words at; sums are the prefix sums of hashes."""
    return range_hash(sums, at, at + length) if length < SHORT else window_hashes(hashes, length)[at]


def leftmost_least(keys: np.ndarray, span: int, chunk: int = 1 << 19) -> np.ndarray:
    """Place of the least of each run of span keys, the leftmost of several.  Keys are compared by their leading 44 bits, everywhere alike."""
    n = max(0, len(keys) - span + 1)
    out = np.empty(n, np.int64)
    if not chunk + span <= 1 << 20:
        raise ValueError("span too long")
    for a in range(0, n, chunk):
        part = keys[a : min(a + chunk, n) + span - 1]
        low, reach = part >> U64(20) << U64(20) | np.arange(len(part), dtype=U64), 1
        while reach * 2 <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if span > reach:
            low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
        out[a : a + chunk] = (low & U64((1 << 20) - 1)).astype(np.int64) + a
    return out


def windows(n_words: int, word_offs: np.ndarray, length: int) -> np.ndarray:
    """First words of all windows of so many words that stay within one text."""
    if n_words < length:
        return np.zeros(0, np.int64)
    left = np.repeat(word_offs[1:], np.diff(word_offs)) - np.arange(n_words)
    return np.flatnonzero(left >= length)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each padded text, and their n+1 offsets.  A text with fewer than k words gives its whole sequence."""
    starts, ends, wo = words(data, offs)
    hashes = word_hashes(data, starts, ends)
    sums = prefix_sums(hashes)
    at = windows(len(starts), wo, k)
    keys, first = [windows_at(hashes, sums, at, k)] if len(at) else [np.zeros(0, U64)], [at]
    count = np.diff(wo)
    for size in range(1, k):
        short = wo[:-1][count == size]
        if len(short):
            keys.append(windows_at(hashes, sums, short, size))
            first.append(short)
    keys, first = np.concatenate(keys), np.concatenate(first)
    doc = np.searchsorted(wo, first, "right") - 1
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys, doc = keys[new], doc[new]
    return keys, np.searchsorted(doc, np.arange(len(offs)))


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return at, np.diff(np.append(at, len(sorted_values)))
