"""Benchmark decontamination by greedy string tiling.

Documents that share a seed (a run of words) with a benchmark item are tiled against it:
the longest common runs of words not yet marked are marked first, whatever their order,
found by running Karp-Rabin hashes of a length that falls from round to round.  A document
is contaminated by an item whose words are covered to the threshold or more, so that a
passage whose sentences have been moved about is still found.
"""

from __future__ import annotations

import math
import unicodedata
from functools import cache, reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kernels import U64, as_array, buffers, prefix_sums, range_hash, slices, windows, word_hashes

SEED_WORDS, THRESHOLD = 5, 0.8
#: Benchmark text that one pass holds in memory; more text is more passes.
PASS_BYTES = 16 << 20
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


#: Scripts written without spaces between words, by the first words of their characters' names.
_UNSPACED = ("CJK ", "HIRAGANA ", "KATAKANA ", "HALFWIDTH KATAKANA ", "BOPOMOFO ", "THAI ", "LAO ", "KHMER ", "MYANMAR ", "TIBETAN ", "NUSHU ", "TANGUT ", "YI ")


@cache
def _classes() -> np.ndarray:
    """Class of each code point: 0 part of a word, 1 between words (spaces and punctuation), 2 a word of its own (unspaced scripts and symbols)."""
    out = np.zeros(0x110000, np.uint8)
    for c in [*range(128, 0x32400), *range(0xE0000, 0xE0200)]:
        kind = unicodedata.category(chr(c))
        if kind[0] in "PZ" or kind in ("Cc", "Sk") or c == 0x200B:
            out[c] = 1
        elif kind[0] == "S" or unicodedata.name(chr(c), "").startswith(_UNSPACED):
            out[c] = 2
    return out


def word_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and the n+1 offsets of the texts.

    Words are runs of letters, digits and other non-ASCII characters that are no space or
    punctuation; each character of a script without spaces, and each non-ASCII symbol, is one.
    """
    data, offs = buffers(pc.utf8_lower(as_array(texts).cast(pa.large_string())), " ")
    word = ~_BREAK[data]
    cut = np.zeros(len(data) + 1, bool)
    lead = np.flatnonzero(data >= 0xC0)
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    code = data[lead].astype(np.int64) & (0xFF >> (size + 1))
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << 6 | data[lead[more] + k] & 0x3F
    kind = _classes()[code]
    for k in range(4):
        gap = (kind == 1) & (size > k)
        word[lead[gap] + k] = False
    own = kind == 2
    cut[lead[own]] = cut[lead[own] + size[own]] = True
    before = np.concatenate([[False], word])
    after = np.append(word, False)
    starts, ends = np.flatnonzero(after & (~before | cut)), np.flatnonzero(before & (~after | cut))
    return word_hashes(data, starts, ends), np.searchsorted(starts, offs)


def tile(item: np.ndarray, text: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length), none overlapping, longest first.

    item and text are arrays of word hashes; 0 matches nothing.  In each round running
    hashes of length s over unmarked words pair up equal stretches, which are extended as far
    as both stay equal and unmarked.  A match over twice s raises s; else the matches are
    marked by falling length, what is left of a match that a longer one overlaps among them,
    and s is halved down to least.
    """
    free_item, free_text = item != 0, text != 0
    tiles: list[tuple[int, int, int]] = []
    s = max(least, 32)
    while True:
        if s > len(item) or s > len(text):
            if s == least:
                break
            s = max(least, s // 2)
            continue
        found = matches(item, text, free_item, free_text, s)
        longest = max((m[0] for m in found), default=0)
        if longest > 2 * s:
            s = longest
            continue
        queue = [(-length, a, b) for length, a, b in found]
        heapify(queue)
        while queue:
            length, a, b = heappop(queue)
            free = free_item[a : a - length] & free_text[b : b - length]
            if free.all():
                free_item[a : a - length] = free_text[b : b - length] = False
                tiles.append((a, b, -length))
                continue
            # What longer tiles have taken is cut out; each stretch left waits for its turn by its own length.
            edge = np.flatnonzero(np.diff(free, prepend=False, append=False)).tolist()
            for i, j in zip(edge[0::2], edge[1::2], strict=True):
                if j - i >= s:
                    heappush(queue, (i - j, a + i, b + i))
        if s == least:
            break
        s = max(least, s // 2)
    return sorted(tiles, key=lambda t: (-t[2], t[0]))


def matches(item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, s: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, start in item, start in text) of at least s unmarked words."""

    def hashed(words: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        taken = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(taken[s:] == taken[:-s])
        return at, range_hash(prefix_sums(words), at, at + s)

    at_item, keys = hashed(item, free_item)
    at_text, probes = hashed(text, free_text)
    order = np.argsort(keys, kind="stable")
    keys, at_item = keys[order], at_item[order]
    lo, hi = np.searchsorted(keys, probes, "left"), np.searchsorted(keys, probes, "right")
    found, done = [], set()
    for b, i, j in zip(at_text[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
        for a in at_item[i:j].tolist():
            if (a - 1, b - 1) in done:  # inside the match that began before
                done.add((a, b))
                continue
            n = min(len(item) - a, len(text) - b)
            same = (item[a : a + n] == text[b : b + n]) & free_item[a : a + n] & free_text[b : b + n]
            length = n if same.all() else int(np.argmin(same))
            if length >= s:
                found.append((length, a, b))
                done.add((a, b))
    return found


class Index:
    """Seeds of the benchmark items of one pass."""

    def __init__(self, rows: list[tuple[int, str]], seed_words: int, short_items: bool = False):
        self.k = seed_words
        words, offs = word_arrays(pa.array([t for _, t in rows], pa.string()))
        self.items = [(i, words[a:b]) for (i, _), a, b in zip(rows, offs[:-1], offs[1:], strict=True)]
        at = windows(len(words), offs, seed_words)
        size = np.full(len(at), seed_words)
        if short_items:  # the whole of an item is its seed
            short = np.flatnonzero((np.diff(offs) > 0) & (np.diff(offs) < seed_words))
            at, size = np.concatenate([at, offs[:-1][short]]), np.concatenate([size, np.diff(offs)[short]])
        self.sizes = np.unique(size).tolist()
        seeds = range_hash(prefix_sums(words), at, at + size)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.at, self.owner = seeds[order], at[order], (np.searchsorted(offs, at, "right") - 1)[order]
        self.length = np.diff(offs)
        self.bits = max(16, int(len(seeds) * 16).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.seeds >> U64(64 - self.bits)] = True

    def reachable(self, lo: np.ndarray, hi: np.ndarray, threshold: float) -> list[int]:
        """Items that could reach the threshold with the seeds of these ranges: tiles cover no word of an item that none of its shared seeds has."""
        lo, first = np.unique(lo, return_index=True)
        size = hi[first] - lo
        seeds = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
        at = np.sort(self.at[seeds])
        owner = self.owner[seeds][np.argsort(self.at[seeds], kind="stable")]  # items lie one behind the other
        gap = np.append(at[1:] - at[:-1], self.k)
        last = np.append(owner[1:] != owner[:-1], True)
        gain = np.minimum(np.where(last, self.k, gap), np.minimum(self.k, self.length[owner]))
        begin = np.flatnonzero(np.append(True, last[:-1]))
        which = owner[begin]
        return which[np.add.reduceat(gain, begin) >= threshold * self.length[which] - 1e-9].tolist()

    def contaminated(self, texts: pa.Array, threshold: float):
        """(text, item id, words covered, words of the item, tiles) for each pair of a text and an item that it covers to the threshold."""
        words, offs = word_arrays(texts)
        sums, hits = prefix_sums(words), [np.zeros((4, 0), np.int64)]
        for k in self.sizes:
            at = windows(len(words), offs, k)
            keys = range_hash(sums, at, at + k)
            maybe = np.flatnonzero(self.table[keys >> U64(64 - self.bits)])
            lo, hi = np.searchsorted(self.seeds, keys[maybe], "left"), np.searchsorted(self.seeds, keys[maybe], "right")
            hit = lo < hi
            hits.append(np.stack([at[maybe[hit]], lo[hit], hi[hit], np.full(hit.sum(), k)]))
        at, lo, hi, size = (h := np.concatenate(hits, axis=1))[:, np.argsort(h[0], kind="stable")]
        doc = np.searchsorted(offs, at, "right") - 1
        for d in np.unique(doc).tolist():
            mine = slice(*np.searchsorted(doc, [d, d + 1]))
            owners = self.reachable(lo[mine], hi[mine], threshold)
            if not owners:
                continue
            # Only words under a seed can be in a tile; others, and what lies between stretches, become a break.
            covered = np.zeros(int(offs[d + 1] - offs[d]) + 1, np.int64)
            np.add.at(covered, at[mine] - offs[d], 1)
            np.add.at(covered, at[mine] - offs[d] + size[mine], -1)
            covered = np.cumsum(covered)[:-1] > 0
            keep = covered | np.concatenate([[False], covered[:-1]])
            text = np.where(covered, words[offs[d] : offs[d + 1]], U64(0))[keep]
            place = np.flatnonzero(keep)
            for o in owners:
                item_id, item = self.items[o]
                tiles = tile(item, text, min(self.k, len(item)))
                n = sum(t[2] for t in tiles)
                if n >= threshold * len(item):
                    yield d, item_id, n, len(item), [(a, int(place[b]), m) for a, b, m in tiles]


def passes(benchmark: DataFrame, seed_words: int, short_items: bool = False) -> list:
    """Broadcast indexes, each over at most about PASS_BYTES of benchmark text (an item longer than that has a pass of its own).

    The driver makes them one by one, and keeps each in a file, not in memory.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, math.ceil(total / PASS_BYTES))
    out = []
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").collect()
        out.append(benchmark.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in rows], seed_words, short_items)))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, seed_words: int = SEED_WORDS, threshold: float = THRESHOLD, short_items: bool = False) -> DataFrame:
    """Rows (doc_id, item_id, n_covered, n_item, coverage, tiles) for each contaminated pair.

    tiles is an array of (item_start, doc_start, n_words) in words.  Whole texts are read.
    Null or empty texts match nothing, nor do items of fewer words than a seed has unless
    short_items is set, which finds these wherever all their words follow one another; items
    without an id are left out.  Repeated rows each give their pairs; a null doc_id stays null.
    The documents are not shuffled: each pass looks them up in a broadcast index of at most
    PASS_BYTES of benchmark text.
    """
    out = None
    for shared in passes(benchmark, seed_words, short_items):

        def run(batches, shared=shared):
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                for i, j in slices(buffers(texts)[1]):
                    rows = [(ids[i + d].as_py(), *rest) for d, *rest in shared.value.contaminated(texts.slice(i, j - i), threshold)]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
                    cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                    spans = pa.array([[{"item_start": a, "doc_start": b, "n_words": n} for a, b, n in r[4]] for r in rows], pa.list_(pa.struct([("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())])))
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([r[2] / r[3] for r in rows], pa.float64()), spans], ["doc_id", "item_id", "n_covered", "n_item", "coverage", "tiles"])

        rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, item_id long, n_covered long, n_item long, coverage double, tiles array<struct<item_start:long,doc_start:long,n_words:long>>")
        out = rows if out is None else out.unionAll(rows)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, seed_words: int = SEED_WORDS, threshold: float = THRESHOLD, short_items: bool = False) -> DataFrame:
    """The documents that no item contaminates, all columns as they were.

    With one pass documents are filtered where they are read.  With more, each pass finds the
    texts that it contaminates, so that a task holds one index at a time, and documents
    with these texts go by an anti-join on 128 bits of their SHA-256.
    """
    at = docs.columns.index("text")
    indexes = passes(benchmark, seed_words, short_items)

    def filtering(shared, keep_them: bool):
        def run(batches):
            for batch in batches:
                text = batch.column(at if keep_them else 0)
                for i, j in slices(buffers(text)[1]):
                    clean = np.ones(j - i, bool)
                    clean[[d for d, *_ in shared.value.contaminated(text.slice(i, j - i), threshold)]] = False
                    yield batch.slice(i, j - i).filter(pa.array(clean if keep_them else ~clean))

        return run

    if len(indexes) == 1:
        return docs.mapInArrow(filtering(indexes[0], True), docs.schema)
    name = F.substring(F.sha2(F.col("text").cast("string").cast("binary"), 256), 1, 32)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    found = reduce(DataFrame.unionAll, [texts.mapInArrow(filtering(shared, False), "text string") for shared in indexes]).select(name.alias("name")).distinct()
    rows = docs.select(F.struct("*").alias("row"), name.alias("name"))
    return rows.join(found, "name", "left_anti").select("row.*")
