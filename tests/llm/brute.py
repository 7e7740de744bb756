"""Plain Python that says what the operators should return, for small tables."""

import hashlib
import re
from collections import defaultdict

WORDS = re.compile("[^\x20\x09-\x0d]+")


def docs(spark, rows, extra=False):
    """rows of (doc_id, text); with extra, columns of clashing names."""
    schema = "doc_id long, text string"
    if extra:
        rows = [(*r, i, "x", None) for i, r in enumerate(rows)]
        schema += ", part int, ids string, keys binary"
    return spark.createDataFrame(rows, schema)


def key(doc_id, start):
    return (doc_id is not None, doc_id or 0, start)


def covered(units, length):
    """units: list of (doc_id, sequence). Sets of removed places by row."""
    first = {}
    for doc_id, seq in units:
        for i in range(len(seq) - length + 1):
            k = tuple(seq[i : i + length]) if isinstance(seq, list) else seq[i : i + length]
            first[k] = min(first.get(k, key(doc_id, i)), key(doc_id, i))
    gone = []
    for doc_id, seq in units:
        mine = set()
        for i in range(len(seq) - length + 1):
            k = tuple(seq[i : i + length]) if isinstance(seq, list) else seq[i : i + length]
            if key(doc_id, i) > first[k]:
                mine |= set(range(i, i + length))
        gone.append(mine)
    return gone


def word_dedup(rows, length):
    units = [(d, WORDS.findall(t or "")) for d, t in rows]
    out = []
    for (d, ws), g in zip(units, covered(units, length), strict=True):
        kept = " ".join(w for i, w in enumerate(ws) if i not in g)
        out.append((d, len(ws), len(g), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def byte_dedup(rows, length):
    units = [(d, (t or "").encode()) for d, t in rows]
    out = []
    for (d, b), g in zip(units, covered(units, length), strict=True):
        kept = bytes(c for i, c in enumerate(b) if i not in g)
        spans = sum(i in g and i - 1 not in g for i in range(len(b)))
        out.append((d, len(b), len(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


def components(ids, links):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def lower(t):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), t)


def shingles(text, k=5):
    ws = WORDS.findall(lower(text or ""))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def jaccard(rows, num=80, den=100):
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if x and y and den * len(x & y) >= num * len(x | y)]
    comp = components({d for d, _ in sets}, links)
    return [(d, len(s), comp[d] if s else d) for d, s in sets]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def personal(text):
    found = defaultdict(list)
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 16 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15):
                found[kind].append((m.start(), m.end()))
    return found
