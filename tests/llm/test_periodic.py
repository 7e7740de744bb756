"""Runs of repeated words against plain Python."""

import hashlib
import zlib

import numpy as np
import pytest

from tests.llm import brute
from tidemark.llm import periodic


def runs(w, shortest=12):
    """Every maximal stretch for every period, those with a smaller period left out."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(shortest, 2 * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def row(doc_id, w, shortest=12):
    found = runs(w, shortest)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    text = " ".join(x for i, x in enumerate(w) if i not in gone)
    digest = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{n},{q}\n" for s, n, q in found), text)]
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digest)


def texts(seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(60):
        w = []
        while len(w) < rng.integers(5, 120):
            piece = [chr(97 + c) for c in rng.integers(0, rng.choice([1, 2, 3, 20]), rng.integers(1, 12))]
            w += piece * int(rng.integers(1, 7))
        out.append(w)
    return out


@pytest.mark.parametrize("shortest", [2, 3, 7, 12])
def test_runs_of_random_words(shortest):
    for w in texts(shortest):
        symbols = np.unique(w, return_inverse=True)[1]
        assert periodic.runs_of(np.append(symbols, symbols.max() + 1), shortest) == runs(w, shortest)


def test_as_plain_python(spark):
    odd = [None, "", " \n\t", "a", "a " * 11, "a " * 12, "a " * 900, "a b " * 300 + "c " + "a b " * 300, "é x " * 30, "x\x00y " * 14, "  " * 13]
    rows = [(i * 7, " ".join(w)) for s in (1, 2) for i, w in enumerate(texts(s))] + [(1000 + i, t) for i, t in enumerate(odd)] + [(None, "q r " * 9), (7, "again " * 15)]
    docs = brute.docs(spark, rows, extra=True)
    for change in (lambda i, w: w, planted):
        got = periodic.digests(periodic.with_planted(docs) if change is planted else docs).collect()
        want = [row(i, change(i, brute.WORDS.findall(t or ""))) for i, t in rows]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert periodic.digests(brute.docs(spark, [])).count() == 0


def test_long_runs_and_their_seam(spark):
    text = "a b " * 30_000 + "c " + "a b " * 30_000
    got = sorted(periodic.find(brute.docs(spark, [(1, "a " * 200_000), (2, text)])).collect())
    assert [tuple(r) for r in got[0]["runs"]] == [(0, 200_000, 1)] and got[0]["collapsed"] == "a"
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 60_000, 2), (60_001, 60_000, 2)] and got[1]["collapsed"] == "a b c a b"


def test_documents_of_one_batch_do_not_meet(spark):
    rows = [(i, "one two three four five six seven") for i in range(50)]
    assert all(not r["runs"] for r in periodic.find(brute.docs(spark, rows)).collect())
