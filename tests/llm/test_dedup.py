"""Word windows, suffixes and the Jaccard join against brute force, and their odd inputs."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tidemark.llm import decontaminate, kernels, ngram_join, parts, suffixes, word_windows


@pytest.fixture(autouse=True)
def several_parts(monkeypatch):
    monkeypatch.setattr(parts, "PART_BYTES", 4000)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4))) for _ in range(30)]
    pieces = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 40))) for _ in range(12)]
    rows = []
    for i in range(n):
        text = rng.choice([" ", "\n", "  "]).join(rng.choice(pieces) if rng.random() < 0.6 else " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 4)))
        rows.append((i * 3, text))
    rows += [(1, rows[0][1]), (2, rows[5][1].upper()), (4, ""), (5, None), (7, " \n\t "), (8, "one"), (11, "x " * 400), (13, "abc" * 300), (None, rows[3][1]), (14, rows[9][1] + "\x00 end\u2003x")]
    return rows + [rows[7], (16, "ab " * 5000)]


def same(df, want):
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("length", "shortest"), [(20, 10), (8, 2), (5, 5)])
def test_word_windows(spark, seed, length, shortest):
    rows = corpus(seed)
    same(word_windows.remove_repeats(brute.docs(spark, rows, extra=True), length, shortest), brute.word_dedup(rows, length))


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize(("length", "gram"), [(100, 32), (24, 8)])
def test_suffixes(spark, seed, length, gram):
    rows = corpus(seed)
    same(suffixes.remove_repeats(brute.docs(spark, rows, extra=True), length, gram), brute.byte_dedup(rows, length))


def test_kept_texts(spark):
    rows = [(1, "a b c d e f"), (2, "x a b c d y")]
    got = {r["doc_id"]: r["kept"] for r in word_windows.remove_repeats(brute.docs(spark, rows), 4, 2, texts=True).collect()}
    assert got == {1: "a b c d e f", 2: "x y"}
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.remove_repeats(brute.docs(spark, [(1, "0123456789"), (2, "ab0123456789cd")]), 8, 4, texts=True).collect()}
    assert got == {1: b"0123456789", 2: b"abcd"}


@pytest.mark.parametrize("seed", [5, 6])
def test_jaccard(spark, seed):
    rng = random.Random(seed)
    rows = corpus(seed, 30)
    for i in range(60):  # near copies
        ws = (rows[rng.randrange(30)][1] or "").split(" ")
        for _ in range(rng.randint(0, 3)):
            ws[rng.randrange(len(ws))] = rng.choice(["zz", "yy", "a"])
        rows.append((1000 + i, " ".join(ws)))
    got = [tuple(r) for r in ngram_join.jaccard_components(brute.docs(spark, rows, extra=True)).collect() if r["doc_id"] is not None]
    assert sorted(got) == sorted(brute.jaccard(rows))


def test_jaccard_exactly_at_the_threshold(spark):
    base = [f"w{i}" for i in range(13)]  # 9 shingles; one more word at the end shares 9 of 10
    rows = [(1, " ".join(base)), (2, " ".join([*base, "p", "q"])), (3, " ".join([*base, "p", "q", "r"])), (4, "a b c"), (5, "A b C"), (6, "a b")]
    assert sorted(tuple(r) for r in ngram_join.jaccard_components(brute.docs(spark, rows)).collect()) == sorted(brute.jaccard(rows))


@pytest.mark.parametrize(("seed", "changes"), [(9, 3), (10, 5)])
def test_large_buckets_are_dealt_into_shares(spark, monkeypatch, seed, changes):
    monkeypatch.setattr(ngram_join, "SHARE", 7)
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        ws = list(base)
        for k in range(rng.randint(0, changes)):
            ws[rng.randrange(60)] = f"v{i}_{k}" if rng.random() < 0.7 else f"u{rng.randrange(4)}"
        rows.append((i, " ".join(ws)))
    assert sorted(tuple(r) for r in ngram_join.jaccard_components(brute.docs(spark, rows)).collect()) == sorted(brute.jaccard(rows))


def test_pairs_of_shares_meet(spark, monkeypatch):
    rng = random.Random(11)
    sets = {i: sorted(rng.sample(range(40), 12)) for i in range(80)}
    for i in range(0, 80, 2):  # some pairs in reach
        sets[i + 1] = sorted({*sets[i][:-1], rng.randrange(100, 200)})
    table = spark.createDataFrame([(i, len(k), np.array(k, np.uint64).tobytes()) for i, k in sets.items()], "id long, n long, keys binary")
    rows = spark.createDataFrame([(1, i, i, 9) for i in sets], "bucket long, id long, component long, shares int")
    got = {(r["a"], r["b"]) for run, in ((ngram_join.within_shares,), (ngram_join.across_shares,)) for r in run(rows, table, 1, 80, 100).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}
    assert {(min(p), max(p)) for p in got} == want and len(want) >= 40


def test_one_of_each_keeps_columns(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (None, "a b c d e f g"), (4, "other words")]
    kept = ngram_join.one_of_each(brute.docs(spark, rows, extra=True))
    assert kept.columns == ["doc_id", "text", "part", "ids", "keys"]
    assert {r["doc_id"] for r in kept.collect()} == {1, 3, None, 4}


@pytest.mark.parametrize("run", [word_windows.remove_repeats, suffixes.remove_repeats, ngram_join.jaccard_components])
def test_empty_table(spark, run):
    assert run(brute.docs(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=24, max_size=24), min_size=1, max_size=40))
def test_deep_shallow_order(strings):
    rows = np.frombuffer("".join(strings).encode(), np.uint8).reshape(len(strings), 24)
    order, common = suffixes.deep_shallow(rows)
    got = [strings[i] for i in order]
    assert got == sorted(strings)
    for i in range(1, len(got)):
        n = next((k for k in range(24) if got[i][k] != got[i - 1][k]), 24)
        assert common[i] == n


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abc", min_size=12, max_size=12), min_size=1, max_size=30))
def test_blind_trie(strings):
    strings = [s.encode() for s in strings]
    assert [strings[i] for i in suffixes.blind_order(strings)] == sorted(strings)


def morse(bits):
    """A Thue-Morse word of 2**bits letters and its complement: the same to a polynomial hash modulo 2**64."""
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("bits", [10, 11, 12])
def test_words_that_collide_under_polynomials(spark, bits):
    one, two = morse(bits)
    ends = np.array([len(one), 2 * len(one) + 1])
    for seed in (0, 1):
        a, b = kernels.word_hashes(np.frombuffer(f"{one} {two} ".encode(), np.uint8), ends - len(one), ends, seed)
        assert a != b
    front = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{front} {one}"), (2, f"{front} {two}"), (3, f"{one} x y z v"), (4, f"{two} x y z v")]
    same(word_windows.remove_repeats(brute.docs(spark, rows)), brute.word_dedup(rows, 20))
    same(ngram_join.jaccard_components(brute.docs(spark, rows)), brute.jaccard(rows))
    bench = spark.createDataFrame([(1, f"{one} a b c d e f")], "item_id long, text string")
    found = decontaminate.contamination(brute.docs(spark, [(1, f"{one} a b c d"), (2, f"{two} a b c d"), (3, f"{one} a b c d e f")]), bench, threshold=0.5)
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 3]


def test_windows_hash_alike_wherever_they_stand():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 4, 400).astype(np.uint64)
    for length in (1, 2, 3, 5, 7, 10, 20):
        seen = {}
        for i, h in enumerate(kernels.window_hashes(words, length).tolist()):
            assert seen.setdefault(tuple(words[i : i + length].tolist()), h) == h
        assert len(set(seen.values())) == len(seen) and i == 400 - length
    keys = rng.integers(0, 9, 300).astype(np.uint64) << np.uint64(40)
    want = [i + int(np.argmin(keys[i : i + 7])) for i in range(294)]
    assert kernels.leftmost_least(keys, 7, chunk=50).tolist() == want


def test_a_gram_with_ever_different_neighbours_is_split(spark, monkeypatch):
    rng = random.Random(3)
    gram = "the same line of 32 bytes here, "
    noise = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows = [(i, noise(90) + gram + noise(90)) for i in range(60)] + [(100 + i, rows_text) for i, rows_text in enumerate([noise(90) + gram + noise(90)] * 3)]
    data, offs = np.frombuffer("".join(t for _, t in rows[:60]).encode(), np.uint8), np.cumsum([0] + [len(t) for _, t in rows[:60]])
    _, near, far, keys, looks = suffixes.anchors(data, offs, 100, 32)
    assert suffixes.key_counts(keys, near, far, looks)[1].max() < 4  # no key for all of them
    same(suffixes.remove_repeats(brute.docs(spark, rows)), brute.byte_dedup(rows, 100))
    long = noise(80)
    rows += [(200 + i, noise(90) + long + noise(90)) for i in range(40)] + [(300 + i, rows[70 % len(rows)][1]) for i in range(4)]
    monkeypatch.setattr(suffixes, "SPLIT", 4)
    monkeypatch.setattr(parts, "PART_BYTES", 1 << 20)
    same(suffixes.remove_repeats(brute.docs(spark, rows)), brute.byte_dedup(rows, 100))


def test_rows_without_id_are_dealt_by_text(spark):
    rows = [(None, f"text {i} " * 20) for i in range(100)]
    dealt = parts.doc_parts(brute.docs(spark, rows), 8).groupBy("part").count().collect()
    assert len(dealt) == 8
