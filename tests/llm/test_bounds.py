"""That bounds bound: bitmaps of any size, widths of keys, seeds that many items share."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tidemark.llm import decontaminate, ngram_join, parts
from tidemark.llm.kernels import U64


def sets(rng, count, size, common=0):
    base = rng.integers(0, 1 << 63, common, dtype=np.int64).astype(U64)
    return [np.unique(np.concatenate([base, rng.integers(0, 1 << 63, size - common, dtype=np.int64).astype(U64)])) for _ in range(count)]


def candidates(keys):
    size = np.array([len(k) for k in keys])
    order = np.argsort(size, kind="stable")
    keys, size = [keys[i] for i in order], size[order]
    found = set()
    for a, b, could in ngram_join.could_pass(size, size, [ngram_join.bitmap(k) for k in keys], np.arange(len(keys)), 80, 100):
        found |= {(a + i, b + j) for i, j in zip(*np.nonzero(could), strict=True)}
    return keys, found


@pytest.mark.parametrize("size", [10, 100, 600, 1500, 5000, 20_000])
def test_disjoint_sets_leave_no_candidate(size):
    rng = np.random.default_rng(size)
    assert not candidates(sets(rng, 40, size))[1]
    if size > 10:
        assert not candidates(sets(rng, 20, size, size // 4))[1]


def test_no_pair_over_the_threshold_is_lost():
    rng = np.random.default_rng(1)
    keys = []
    for size in (3, 7, 30, 90, 200, 1000, 3000):
        base = rng.integers(0, 1 << 63, size, dtype=np.int64).astype(U64)
        for _ in range(12):
            kept = base[rng.random(size) > 0.1]
            keys.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, max(1, size // 20), dtype=np.int64).astype(U64)])))
    keys, found = candidates(keys)
    true = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if 100 * len(np.intersect1d(keys[i], keys[j])) >= 80 * len(np.union1d(keys[i], keys[j]))}
    assert true and true <= found


def test_tiles_hold_sizes_of_one_band():
    size = np.sort(np.random.default_rng(2).integers(1, 5000, 3000))
    tiles = ngram_join.bands(size)
    assert [a for a, _ in tiles[1:]] == [b for _, b in tiles[:-1]] and tiles[0][0] == 0 and tiles[-1][1] == len(size)
    assert all(b - a <= ngram_join.TILE and size[b - 1] < 2 * max(size[a], 1) for a, b in tiles)


def test_rows_without_an_id_have_a_size(spark):
    rows = [(None, "a b c d e f"), (None, None), (None, "x"), (1, "a b c d e f"), (2, "q")]
    got = sorted((tuple(r) for r in ngram_join.jaccard_components(brute.docs(spark, rows, extra=True)).collect()), key=repr)
    assert got == sorted([(None, 2, None), (None, 0, None), (None, 1, None), (1, 2, 1), (2, 1, 2)], key=repr)


@pytest.mark.parametrize("n", [1, 7, 4000])
def test_false_repeats_are_rare_at_any_width(n):
    """Of as many keys as the width is made for, few agree by chance in it; with a byte less, many do."""
    width = parts.key_bytes(n)
    assert width == 8 or n * parts.PART_KEYS / 2 ** (8 * width) <= 2**-10 < 1
    # The same at a size that fits here: 4,000 keys at the width that they call for.
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.int64).astype(U64) << U64(1))
    bits = int(np.ceil(np.log2(len(keys)) + 10))
    cut = keys >> U64(64 - bits)
    assert 1 - len(np.unique(cut)) / len(keys) < 0.01
    assert 1 - len(np.unique(keys >> U64(64 - bits + 12))) / len(keys) > 0.5


def test_widths_grow_with_the_corpus():
    widths = [parts.key_bytes(n) for n in (1, 100, 10**4, 10**6, 10**7, 10**9)]
    assert widths == sorted(widths) and widths[0] == 4 and widths[-2] == 8 - 1 and widths[-1] == 8


def test_a_stem_that_thousands_of_items_share():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    stem = "which of the following is"
    items = [(i, f"{stem} " + " ".join(word() for _ in range(15))) for i in range(2000)]
    index = decontaminate.Index(items, 5)
    texts = [" ".join(word() for _ in range(40)) + f" {stem} " + " ".join(word() for _ in range(40)) for _ in range(20)]
    began = time.time()
    assert list(index.contaminated(pa.array(texts), 0.8)) == []
    assert time.time() - began < 0.5
    texts[3] += " " + items[77][1]
    found = list(index.contaminated(pa.array(texts), 0.8))
    assert [(d, i, n) for d, i, n, *_ in found] == [(3, 77, 20)]


def test_the_bound_loses_no_item():
    """The same pairs as tiling every item that shares a seed."""
    rng = random.Random(5)
    alphabet = [chr(97 + i) * 2 for i in range(6)]
    for _ in range(300):
        items = [(i, " ".join(rng.choice(alphabet) for _ in range(rng.randrange(3, 25)))) for i in range(8)]
        text = " ".join(rng.choice([rng.choice(items)[1], " ".join(rng.choice(alphabet) for _ in range(6))]) for _ in range(3))
        index = decontaminate.Index(items, 5, True)
        got = [(i, n) for _, i, n, *_ in index.contaminated(pa.array([text]), 0.8)]
        words, want = decontaminate.word_arrays(pa.array([text]))[0], []
        for i, item in index.items:
            covered = sum(t[2] for t in decontaminate.tile(item, words, min(5, len(item)))) if len(item) else 0
            if covered >= 0.8 * len(item) and len(item):
                want.append((i, covered))
        assert sorted(got) == sorted(want)
