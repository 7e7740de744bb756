"""Suffix-array deduplication of byte strings, by deep-shallow sorting.

Every window of 100 bytes has an *anchor*: the leftmost of its 32-byte strings of least
hash.  Equal windows have equal anchors at the same place, so only suffixes that begin at
an anchor need sorting, one in about 35.  Windows that reach further to the right of their
anchor than to the left share the 66 bytes from it on, the others those up to its end; these
longer strings are what anchors are counted and dealt by, so an anchor that is everywhere with
ever different neighbours is dealt by its neighbours.  Anchors whose string occurs once are
done.  A string that is in very many different surroundings still is dealt window by window.

Each share is sorted twice, the text from the anchor on and the text before it read
backwards: multikey quicksort orders all suffixes by their first bytes, to a shallow
depth; groups that still agree there have long common prefixes and are ordered
through a blind trie each.  The common prefixes of neighbours then give classes of equal
windows for every distance between window and anchor, exactly and without more hashing.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.kernels import _BYTE, U64, ids_back, leftmost_least, mix, powers, prefix_sums, range_hash, runs
from tidemark.llm.parts import KEY_SCHEMA, doc_parts, exchange, key_part, key_rows, load, number_of_parts, part_of, seen, squeeze, table_of, unsqueeze

LENGTH, GRAM = 100, 32
SHALLOW = 16
#: A string in so many different surroundings, or in four for each part, is dealt window by window.
SPLIT = 1 << 14
_CHUNK = 1 << 19


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Place, least and greatest distance to a window's start, key and look of each anchor's two sides that have windows.

    The key is a hash of the bytes that all windows of the side share, the look one of all their bytes.
    """
    half = (length - gram) // 2
    found = []
    for a in range(0, len(data) - length + 1, _CHUNK):  # a long text is no single piece
        piece = data[a : a + _CHUNK + length - 1]
        sums, at = prefix_sums(_BYTE[piece]), np.arange(len(piece) - gram + 1)
        least = leftmost_least(range_hash(sums, at, at + gram), length - gram + 1)
        index = np.arange(len(least)) + a
        start = np.flatnonzero(offs[np.searchsorted(offs, index, "right")] - index >= length)
        place = least[start]
        first, count = runs(place)
        place, far, near = place[first], place[first] - start[first], place[first] - start[first + count - 1]
        right, left = near <= half, far > half
        place = np.concatenate([place[right], place[left]])
        near, far = np.concatenate([near[right], np.maximum(near[left], half + 1)]), np.concatenate([np.minimum(far[right], half), far[left]])
        side = np.repeat([0, 1], [right.sum(), left.sum()])
        keys = range_hash(sums, np.where(side, place - half - 1, place), np.where(side, place + gram, place + length - half))
        found.append((place + a, near, far, keys, range_hash(sums, place - far, place - near + length)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2


def key_counts(keys: np.ndarray, near: np.ndarray, far: np.ndarray, looks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and in how many different surroundings each is."""
    with np.errstate(over="ignore"):
        looks = mix(looks + near.astype(U64) * U64(65537) + far.astype(U64))
    order = np.lexsort((looks, keys))
    keys, looks = keys[order], looks[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (looks[1:] != looks[:-1])
    keys = keys[new]
    first, count = runs(keys)
    return keys[first], count


def by_window(data: np.ndarray, place: np.ndarray, near: np.ndarray, far: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which anchor, distance and key of each single window of the anchors; the key is a hash of the window."""
    size = far - near + 1
    which = np.repeat(np.arange(len(place)), size)
    distance = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + near[which]
    keys, factors = np.zeros(len(which), U64), powers(length)[0][:length]
    for i in range(0, len(which), 4096):
        j = slice(i, i + 4096)
        with np.errstate(over="ignore"):
            keys[j] = mix((_BYTE[data[(place[which[j]] - distance[j])[:, None] + np.arange(length)]] * factors).sum(axis=1, dtype=U64))
    return which, distance, keys


def blind_order(strings: list[bytes]) -> list[int]:
    """Order of distinct strings of equal length through a blind trie.

    Nodes hold only the depth at which strings part and the byte that each branch has there.
    A string goes down by those bytes alone to some leaf; one comparison with that leaf's
    string tells where the two really part, and there it is hung in.
    """
    root: list | int = 0  # a leaf is a number, a node is [depth, {byte: child}]
    for new in range(1, len(strings)):
        s, at = strings[new], root
        while not isinstance(at, int):
            at = at[1].get(s[at[0]]) if s[at[0]] in at[1] else next(iter(at[1].values()))
        other = strings[at]
        lo, hi = 0, len(s)
        while lo < hi:  # length of the common prefix
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if s[lo:mid] == other[lo:mid] else (lo, mid - 1)
        above, at = None, root
        while not isinstance(at, int) and at[0] < lo:
            above, at = at, at[1][s[at[0]]]
        if not isinstance(at, int) and at[0] == lo:
            at[1][s[lo]] = new
            continue
        node = [lo, {other[lo]: at, s[lo]: new}]
        if above is None:
            root = node
        else:
            above[1][s[above[0]]] = node
    out, stack = [], [root]
    while stack:
        at = stack.pop()
        if isinstance(at, int):
            out.append(at)
        else:
            stack += [at[1][b] for b in sorted(at[1], reverse=True)]
    return out


def multikey(rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by their first depth bytes; and starts and sizes, in that order, of the groups of several rows that agree in all of these.

    Multikey quicksort on all open groups at once: each group takes a byte of its own as pivot and falls
    into what is less, equal and greater at its place; the equal part goes on with the next byte.
    Equal rows keep their order.
    """
    order = np.arange(len(rows))
    start, size, place = (np.array([v] if len(rows) > 1 else [], np.int64) for v in (0, len(rows), 0))
    if not depth:
        return order, start, size
    done = [np.zeros((2, 0), np.int64)]
    while len(start):
        group = np.repeat(np.arange(len(start)), size)
        first = np.cumsum(size) - size
        at = np.arange(len(group)) + (start - first)[group]
        mine = order[at]
        byte = rows[mine, place[group]]
        low, middle, high = byte[first], byte[first + size // 2], byte[first + size - 1]
        pivot = np.maximum(np.minimum(low, middle), np.minimum(np.maximum(low, middle), high))[group]
        side = (byte >= pivot).astype(np.int64) + (byte > pivot)
        key = group * 3 + side
        count = np.bincount(key, minlength=3 * len(start))
        begin = np.cumsum(count) - count
        to = np.empty(len(group), np.int64)
        for k in range(3):
            here = np.flatnonzero(side == k)
            of = group[here]
            run = np.cumsum(np.bincount(of, minlength=len(start))) - np.bincount(of, minlength=len(start))
            to[here] = begin[key[here]] + np.arange(len(here)) - run[of]
        sorted_ = np.empty(len(group), np.int64)
        sorted_[to] = mine
        order[at] = sorted_
        start, place = np.repeat(start - first, 3) + begin, np.repeat(place, 3) + np.tile([0, 1, 0], len(start))
        several, deep = count > 1, place == depth
        done.append(np.stack([start[several & deep], count[several & deep]]))
        start, size, place = start[several & ~deep], count[several & ~deep], place[several & ~deep]
    return order, *np.concatenate(done, axis=1)


def deep_shallow(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (byte strings of equal length) and the common prefix of each with the one before; 0 for the first."""
    n, width = rows.shape
    depth = min(SHALLOW, width)
    order, first, count = multikey(rows, depth)
    new = np.zeros(n + 1, np.int64)
    if n > 1:
        new[2:] = np.cumsum((rows[order][1:] != rows[order][:-1]).any(axis=1))
    differ = new[first + count] > new[first + 1]
    for a, c in zip(first[differ].tolist(), count[differ].tolist(), strict=True):
        mine = order[a : a + c]
        strings: dict[bytes, list[int]] = {}
        for i in mine.tolist():
            strings.setdefault(rows[i, depth:].tobytes(), []).append(i)
        each = list(strings.values())
        order[a : a + c] = [i for k in blind_order(list(strings)) for i in each[k]]
    common = np.zeros(n, np.int64)
    if n > 1:
        same = rows[order][1:] == rows[order][:-1]
        common[1:] = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
    return order, common


def late_windows(doc: np.ndarray, at: np.ndarray, near: np.ndarray, far: np.ndarray, around: np.ndarray, length: int, before: int) -> np.ndarray:
    """For each anchor (row) and distance (column) whether the window that starts so far before the anchor also starts earlier.

    near and far are the least and greatest distance of an anchor's windows; around has the
    bytes from ``before`` before the anchor to ``length`` behind its start.
    """
    late = np.zeros((len(at), before + 1), bool)
    if not len(at):
        return late
    ranks, commons = [], []
    for rows in (around[:, before:], around[:, :before][:, ::-1]):
        order, common = deep_shallow(np.ascontiguousarray(rows))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ranks.append(rank)
        commons.append(common)
    by_time = np.lexsort((at, doc))
    for x in range(before + 1):
        rows = by_time[(near[by_time] <= x) & (x <= far[by_time])]
        if len(rows) < 2:
            continue
        right = np.cumsum(commons[0] < length - x)[ranks[0][rows]]
        left = np.cumsum(commons[1] < x)[ranks[1][rows]] if x else 0
        key = right * (len(at) + 1) + left
        order = np.argsort(key, kind="stable")
        first, count = runs(key[order])
        best = np.repeat(order[first], count)
        mine = order
        late[rows[mine], x] = (doc[rows[mine]] != doc[rows[best]]) | (at[rows[mine]] != at[rows[best]])
    return late


def surroundings(data: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, before: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes around each anchor that its windows have, zeros elsewhere, and a hash of each row."""
    around, looks = np.zeros((len(place), before + length), np.uint8), np.zeros(len(place), U64)
    factors = powers(before + length)[0][: before + length]
    for i in range(0, len(place), 4096):
        j = slice(i, i + 4096)
        index = place[j, None] + np.arange(-before, length)
        used = (index >= lo[j, None]) & (index < hi[j, None] + length)
        around[j] = np.where(used, data[np.clip(index, 0, len(data) - 1)], 0)
        with np.errstate(over="ignore"):
            looks[j] = mix((_BYTE[around[j]] * factors).sum(axis=1, dtype=U64))
    return around, looks


_ROW_SCHEMA = "part int, source int, docs binary, places binary, near binary, far binary, around binary, carry binary"
_ROW_ARROW = [("part", pa.int32()), ("source", pa.int32()), ("docs", pa.binary()), ("places", pa.binary()), ("near", pa.binary()), ("far", pa.binary()), ("around", pa.binary()), ("carry", pa.binary())]
_LATE_SCHEMA = "part int, block int, late binary, carry binary"
_LATE_ARROW = [("part", pa.int32()), ("block", pa.int32()), ("late", pa.binary()), ("carry", pa.binary())]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), and with texts also kept (binary).

    A byte goes if a string of length bytes that covers it also starts earlier: in a document
    of smaller id, or earlier in the same one.  Strings overlap, do not cross documents, and
    are judged on the input.  n_spans counts the maximal removed runs; kept is what remains,
    put together, which need not be valid UTF-8.  A null text counts as empty.  A null
    doc_id counts as smaller than all others and stays null; rows of equal doc_id are not told
    apart, so neither is earlier than the other at the same start.  Other columns are ignored.
    """
    n = number_of_parts(docs)
    parts = doc_parts(docs, n)
    before = length - gram
    split = max(1, math.ceil(math.log2(max(SPLIT, 4 * n))))

    def open_part(table: pa.Table) -> pa.Table:
        _, data, offs = load(table, b"")
        _, near, far, keys, looks = anchors(data, offs, length, gram)
        keys, count = key_counts(keys, near, far, looks)
        return key_rows(part_of(table), keys, n, np.minimum(count, 65535), carry=b"")

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, data, offs = load(left, b"")
        place, near, far, keys, _ = anchors(data, offs, length, gram)
        distinct, which, count = np.unique(keys, return_inverse=True, return_counts=True)
        level, _ = seen(right, distinct, n)
        again = ((level > 0) | (count > 1))[which]
        hot = level[which][again] >= split
        place, near, far, keys = place[again], near[again], far[again], keys[again]
        if hot.any():
            of, distance, single = by_window(data, place[hot], near[hot], far[hot], length)
            place = np.concatenate([place[~hot], place[hot][of]])
            near, far = (np.concatenate([v[~hot], distance]) for v in (near, far))
            keys = np.concatenate([keys[~hot], single])
        lo, hi = place - far, place - near
        owner = np.searchsorted(offs, place, "right") - 1
        doc, at = ids[owner], place - offs[owner]
        around, looks = surroundings(data, place, lo, hi, before, length)
        # Anchors of one part whose windows are all the same travel once, at their earliest place.
        alike = [looks, far, near]
        order = np.lexsort((at, doc, *alike, keys))
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.any([v[order][1:] != v[order][:-1] for v in (*alike, keys)], axis=0)
            new[1:] |= (around[order][1:] != around[order][:-1]).any(axis=1)
        sent = order[new]
        stands_for = np.empty(len(order), np.int64)
        stands_for[order] = np.cumsum(new) - 1
        tied = (doc == doc[sent][stands_for]) & (at == at[sent][stands_for])  # as early as the one sent: no earlier string here
        carry = b"".join((np.int64(len(place)).tobytes(), place.astype(np.int64).tobytes(), stands_for.tobytes(), near.astype(np.int64).tobytes(), far.astype(np.int64).tobytes(), tied.astype(np.int64).tobytes()))
        part = key_part(keys[sent], n)
        first, size = runs(part)
        source = part_of(left)
        rows = [(source % n, source, None, None, None, None, None, squeeze(carry))]
        for a, c in zip(first.tolist(), size.tolist(), strict=True):
            mine = sent[a : a + c]
            rows.append((int(part[a]), source, doc[mine].tobytes(), at[mine].astype(np.int64).tobytes(), near[mine].astype(np.uint16).tobytes(), far[mine].astype(np.uint16).tobytes(), squeeze(around[mine].tobytes()), None))
        return table_of(_ROW_ARROW, rows)

    def sort_share(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [(r["source"], -1, None, r["carry"]) for r in rows if r["docs"] is None]
        rows = [r for r in rows if r["docs"] is not None]
        if rows:
            doc, at, near, far = (np.concatenate([np.frombuffer(r[c], t) for r in rows]).astype(np.int64) for c, t in (("docs", np.int64), ("places", np.int64), ("near", np.uint16), ("far", np.uint16)))
            sizes = [len(r["docs"]) // 8 for r in rows]
            width = before + length
            around = np.concatenate([unsqueeze(r["around"], s * width, np.uint8).reshape(s, width) for r, s in zip(rows, sizes, strict=True)])
            late = np.packbits(late_windows(doc, at, near, far, around, length, before), axis=1)
            i = 0
            for r, s in zip(rows, sizes, strict=True):
                out.append((r["source"], r["part"], squeeze(late[i : i + s].tobytes()), None))
                i += s
        return table_of(_LATE_ARROW, out)

    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, data, offs = load(left, b"")
        rows = right.to_pylist()
        carry = pa.decompress(c := next(r["carry"] for r in rows if r["carry"] is not None), _raw_size(c), codec="zstd", asbytes=True)
        m = int(np.frombuffer(carry[:8], np.int64)[0])
        place, stands_for, near, far, tied = np.frombuffer(carry[8:], np.int64).reshape(5, m)
        step = -(-(before + 1) // 8)
        blocks = sorted((r for r in rows if r["late"] is not None), key=lambda r: r["block"])
        packed = b"".join(pa.decompress(r["late"], _raw_size(r["late"]), codec="zstd", asbytes=True) for r in blocks)
        late = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(-1, step), axis=1, count=before + 1).astype(bool)
        x = np.arange(before + 1)
        own = (x >= near[:, None]) & (x <= far[:, None])
        hit = own & ((tied == 0)[:, None] | late[stands_for]) if m else np.zeros((0, before + 1), bool)
        row, distance = np.nonzero(hit)
        start = place[row] - distance
        change = np.zeros(len(data) + 1, np.int32)
        np.add.at(change, start, 1)
        np.add.at(change, start + length, -1)
        gone = np.cumsum(change, dtype=np.int32)[:-1] > 0
        del row, distance, start, hit, change
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = offs[:-1][(offs[:-1] < len(data))]
        opens[inner] = gone[inner]  # a run ends with its document
        total, spans = (np.concatenate([[0], np.cumsum(v, dtype=np.int32)])[offs] for v in (gone, opens))
        left_over = data[~gone].tobytes()
        bounds = (offs - total).tolist()
        kept = [left_over[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        cols = {"doc_id": ids_back(ids), "n_bytes": pa.array(np.diff(offs)), "n_removed": pa.array(np.diff(total)), "n_spans": pa.array(np.diff(spans)), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())}
        if texts:
            cols["kept"] = pa.array(kept, pa.binary())
        return pa.table(cols)

    counted = exchange(parts.groupBy("part").applyInArrow(open_part, KEY_SCHEMA), n)
    sent = parts.groupBy("part").cogroup(counted.groupBy("part")).applyInArrow(send, _ROW_SCHEMA)
    late = sent.groupBy("part").applyInArrow(sort_share, _LATE_SCHEMA)
    return parts.groupBy("part").cogroup(late.groupBy("part")).applyInArrow(close, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)


def _raw_size(data: bytes) -> int:
    import zstandard

    return zstandard.frame_content_size(data)
