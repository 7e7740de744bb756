"""Runs of repeated words, by descending common prefixes of suffixes.

A run is a stretch of consecutive words with smallest period q that is at least two periods long
and that no neighbouring word extends.  Its first suffix and the one a period later share
exactly length - q words, q at least.  So suffixes of one document are sorted, and united
as in Kruskal's algorithm, neighbours of the longest common prefix first.  Every class keeps the places of its
suffixes in order.  Where a union makes two places neighbours that are no farther apart than the
common prefix, their distance is a period: at that moment nothing of the class lies between them, so
it is the smallest one.  The pair whose words in front differ is the run's beginning.

Only documents in which a stretch of words as long as the shortest common prefix in question comes twice are sorted
at all, by doubling, many of them at once; only places whose prefix is that long are united.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.kernels import U64, as_array, buffers, ids_back, ids_of, mix, slices, window_hashes, word_hashes, words

#: Words of the shortest run.
SHORTEST = 12
#: Bytes of text that are sorted at a time; a longer text is sorted alone.
BYTES = 2 << 20


def with_planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents, chosen and parted by the checksum of their id, the last words are replaced by repeats of those in front of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.floor(h / 10).cast("long").alias("g"), F.coalesce((h % 10 == 0) & F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)).alias("chosen"))
    rows = rows.withColumn("w", F.when(F.col("chosen"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("chosen"), F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.when(F.col("chosen"), 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))))
    place = lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i)
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.element_at("w", (place(i) + 1).cast("int")))
    return rows.select("doc_id", F.when(F.col("chosen"), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def suffix_order(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose suffix shares at least so many symbols with another one, in the order of suffixes, and the common prefix of each with the one before (0 if less than least).

    No symbol may be in two documents, and each document must end in a symbol of its own.
    """
    n = len(ids)
    levels = [ids.astype(np.int32)]  # ranks of the first 1, 2, 4, ... symbols
    while True:
        rank, step = levels[-1], 1 << (len(levels) - 1)
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank.astype(np.int64) * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int32)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new) - 1
        levels.append(rank)
        if new.all():
            break
    common = np.zeros(n, np.int64)
    i, j = order[1:], order[:-1]
    at = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(i + at, n - 1), np.minimum(j + at, n - 1)
        at += np.where((levels[k][x] == levels[k][y]) & (i + at < n) & (j + at < n), 1 << k, 0)
    common[1:] = np.where(at >= least, at, 0)
    near = common > 0
    near[:-1] |= common[1:] > 0
    return order[near], common[near]


def runs_of(ids: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of length max(shortest, 2 * period) or more in the symbols of some documents, by start, then period.

    No symbol may be in two documents, and each document must end in a symbol of its own.
    """
    order, common = suffix_order(ids, -(-shortest // 2))
    place = order.tolist()
    group: list[list[int]] = [[p] for p in place]  # the ordered places of each class, at its root
    root = list(range(len(place)))

    def top(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    found: list[tuple[int, int, int]] = []
    word = ids.tolist()
    pairs = np.flatnonzero(common > 0)
    pairs = pairs[np.argsort(-common[pairs], kind="stable")]
    for at, prefix in zip(pairs.tolist(), common[pairs].tolist(), strict=True):
        one, two = top(at - 1), top(at)
        if len(group[one]) < len(group[two]):
            one, two = two, one
        large, small = group[one], group[two]
        root[two], group[two] = one, []
        last = -1
        for p, following in zip(small, [*small[1:], len(word)], strict=True):
            k = bisect_left(large, p)
            # Neighbours that came with p have met it before.
            before = large[k - 1] if k and large[k - 1] != last else p
            after = large[k] if k < len(large) and large[k] < following else p
            for i, j in ((before, p), (p, after)):
                q = j - i
                if 0 < q <= prefix and q + prefix >= shortest and (i == 0 or word[i - 1] != word[j - 1]):
                    found.append((i, q + prefix, q))
            large.insert(k, p)
            last = p
    found.sort(key=lambda r: (r[0], r[2]))
    return found


def repeating(hashes: np.ndarray, offs: np.ndarray, least: int) -> np.ndarray:
    """The documents in which a stretch of so many words comes twice."""
    n = len(offs) - 1
    if len(hashes) < least:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n), np.diff(offs))
    key = window_hashes(hashes, least)
    start = np.flatnonzero(doc[: len(key)] == doc[least - 1 :])
    with np.errstate(over="ignore"):
        key = np.sort(mix(key[start] ^ mix(doc[start].astype(U64) + U64(1))) >> U64(24) << U64(24) | doc[start].astype(U64))
    return np.unique((key[1:][key[1:] == key[:-1]] & U64((1 << 24) - 1)).astype(np.int64))


def all_runs(data: np.ndarray, offs: np.ndarray, shortest: int = SHORTEST) -> tuple[list[list[tuple[int, int, int]]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of each padded text, places counted in its words; and starts, ends and offsets of words."""
    starts, ends, at = words(data, offs)
    hashes = word_hashes(data, starts, ends)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offs) - 1)]
    docs = repeating(hashes, at, -(-shortest // 2))
    if len(docs):
        sizes = np.diff(at)[docs]
        index = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - at[docs], sizes)
        owner = np.repeat(np.arange(len(docs)), sizes)
        ends_at = np.cumsum(sizes)
        # Symbols: words told apart by document, and an end for each document.
        order = np.lexsort((hashes[index], owner))
        new = np.ones(len(index), np.int64)
        new[1:] = (hashes[index][order][1:] != hashes[index][order][:-1]) | (owner[order][1:] != owner[order][:-1])
        symbol = np.empty(len(index), np.int64)
        symbol[order] = np.cumsum(new) - 1
        symbols = np.insert(symbol, ends_at, int(new.sum()) + np.arange(len(docs)))
        first = ends_at - sizes + np.arange(len(docs))
        for start, length, period in runs_of(symbols, shortest):
            k = int(np.searchsorted(first, start, "right")) - 1
            out[int(docs[k])].append((start - int(first[k]), length, period))
    return out, (starts, ends, at)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words are in no run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Rows (doc_id, runs, collapsed): every document's runs (start, length, period) by start, then period, and its words without repeats.

    Words are runs without ASCII white space, numbered from 0.  A run is a stretch of
    words with smallest period q of length max(shortest, 2 * q) or more that no neighbouring word
    extends keeping q.  collapsed drops each word that a run holds behind its first q words, and joins the others by one
    space.  Null, empty and blank texts have no run and an empty collapsed text.  A null doc_id stays
    null; repeated rows each give a row; an empty table gives none.  Other columns are ignored.
    Words are compared by 64-bit hashes.
    """
    if shortest < 2:
        raise ValueError("a run has two words at least")

    def run(batches):
        for batch in batches:
            ids, texts = ids_of(batch.column(0)), as_array(batch.column(1))
            _, offs = buffers(texts)
            for a, b in slices(offs, BYTES):
                data, at = buffers(texts.slice(a, b - a), " ")
                found, (starts, ends, word_at) = all_runs(data, at, shortest)
                raw, collapsed = data.tobytes(), []
                for k, runs in enumerate(found):
                    lo, hi = int(word_at[k]), int(word_at[k + 1])
                    keep = kept_words(hi - lo, runs) if runs else slice(None)
                    collapsed.append(b" ".join([raw[s:e] for s, e in zip(starts[lo:hi][keep].tolist(), ends[lo:hi][keep].tolist(), strict=True)]).decode())
                rows = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found], pa.list_(_RUN))
                yield pa.RecordBatch.from_arrays([ids_back(ids[a:b]), rows, pa.array(collapsed, pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def digests(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Rows (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the longest run (ties: smallest start, then period; null if none) and digests of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = find(docs, shortest).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", (-F.col("best.length")).alias("length"), "best.period", F.floor(-1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
