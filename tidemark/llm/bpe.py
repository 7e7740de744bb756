"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece the table keeps the one token that ends the encoding of
that prefix.  A token t may end a prefix if it and the token that ends the rest are
*compatible*: merging their joined bytes gives back exactly these two.  There is one
such token for each prefix, so the encoding of the whole is read off backwards, an
append only adds entries, and after an edit only entries from the edit on are made anew.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.kernels import buffers, ids_back, ids_of, slices
from tidemark.llm.parts import need_columns

#: Pieces whose ids are kept for reuse, in each of two generations in a worker, and their characters at most; longer ones are made anew each time.
KEPT_PIECES, KEPT_CHARS = 250_000, 64


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids by repeated merging of the pair of lowest rank, leftmost first; used on joined pairs of tokens."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Pieces(dict):
    """Ids of pieces as little-endian 32-bit integers; the last pieces, but for long ones, are kept, in two generations."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = struct.pack(f"<{len(ids := self.make(piece.encode()))}I", *ids)
        if len(piece) > KEPT_CHARS:
            return got
        if len(self) >= KEPT_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = got
        return got


class Vocabulary:
    """Ranks of a tiktoken file, and an automaton that gives all tokens that end at a byte, longest first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.compatible: dict[int, bool] = {}
        self.pieces = Pieces(self.encode_piece)
        # States are the prefixes of tokens.  A step goes to the longest state that ends the bytes read.
        self.step: dict[int, int] = {}
        ends: list[tuple[tuple[int, int], ...]] = [()]
        back = [0]
        for token in sorted(ranks, key=len):
            state = 0
            for byte in token:
                key = state << 8 | byte
                if key not in self.step:
                    self.step[key] = len(back)
                    back.append(0)
                    ends.append(())
                state = self.step[key]
            ends[state] = ((ranks[token], len(token)),)
        level = [(state, key) for key, state in self.step.items() if key < 256]
        below: dict[int, list[tuple[int, int]]] = {}
        for key, state in self.step.items():
            below.setdefault(key >> 8, []).append((state, key & 255))
        while level:
            for state, _ in level:
                ends[state] += ends[back[state]]
            after = [(child, state, byte) for state, _ in level for child, byte in below.get(state, ())]
            for child, state, byte in after:
                back[child] = self.go(back[state], byte, back)
            level = [(child, byte) for child, _, byte in after]
        self.ends, self.back = ends, back

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def go(self, state: int, byte: int, back: list[int]) -> int:
        while True:
            found = self.step.get(state << 8 | byte)
            if found is not None:
                return found
            if not state:
                return 0
            state = back[state]

    def fits(self, before: int, token: int) -> bool:
        """Whether the two tokens may stand side by side; before is -1 at the start of a piece."""
        if len(self.compatible) > 2_000_000:
            self.compatible.clear()
        joined = self.tokens[token] if before < 0 else self.tokens[before] + self.tokens[token]
        found = self.compatible[(before << 32) + token] = merged(joined, self.ranks) == ([token] if before < 0 else [before, token])
        return found

    def extend(self, piece: bytes, last: list[int], size: list[int], states: list[int]) -> None:
        """Fill the entries of all prefixes of piece that are not there yet; last[i] is the token that ends the first i bytes."""
        step, ends, get, fits = self.step, self.ends, self.compatible.get, self.fits
        state = states[-1]
        for i in range(len(last), len(piece) + 1):
            byte = piece[i - 1]
            found = step.get(state << 8 | byte)
            state = self.go(state, byte, self.back) if found is None else found
            states.append(state)
            for t, n in ends[state]:
                before = last[i - n]
                ok = get((before << 32) + t)
                if ok or ok is None and fits(before, t):
                    last.append(t)
                    size.append(n)
                    break
            else:
                raise ValueError(f"no token ends the first {i} bytes of {piece[:80]!r}")

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        last, size = [-1], [0]
        self.extend(piece, last, size, [0])
        return read_off(last, size)

    def encode(self, pieces: Iterable[str]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_off(last: list[int], size: list[int]) -> list[int]:
    out, i = [], len(last) - 1
    while i:
        out.append(last[i])
        i -= size[i]
    return out[::-1]


class PrefixTable:
    """The table of one piece, for exact appends and re-encoding near an edit."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last, self.size, self.states = vocabulary, b"", [-1], [0], [0]
        self.append(piece)

    def append(self, more: bytes) -> PrefixTable:
        self.piece += more
        self.vocabulary.extend(self.piece, self.last, self.size, self.states)
        return self

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace piece[start:end]; the number of entries made anew.  Behind the edit, old entries are kept as soon as as many in a row as the longest token has bytes come out as before."""
        old, shift = (self.last, self.size, self.states), len(new) - (end - start)
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last, self.size, self.states = (x[: start + 1] for x in old)
        made = same = 0
        while len(self.last) <= len(self.piece):
            i = len(self.last)
            self.vocabulary.extend(self.piece[:i], self.last, self.size, self.states)
            made += 1
            same = same + 1 if i > start + len(new) and old[0][i - shift] == self.last[i] else 0
            if same >= self.vocabulary.longest:
                self.last, self.size, self.states = (mine + x[i - shift + 1 :] for mine, x in zip((self.last, self.size, self.states), old, strict=True))
        return made

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.piece)
        return read_off(self.last, self.size) if whole is None else [whole]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each worker and file, so that kept pieces serve later tasks."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary.read(path)
    return _vocabularies[path]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, ids, decoded): packed little-endian 32-bit ids and the bytes they decode to.

    ids and decoded are binary.  path is a file of ranks that every executor has, pattern
    the regular expression whose matches are encoded one by one.  A null text counts as
    empty and gives no ids; a null doc_id stays null; repeated rows each give a row.  Texts
    are read whole.  The work has no shuffle: each batch of documents is encoded where it is read.
    """

    def run(batches):
        vocab, find = vocabulary(path), regex.compile(pattern).findall
        for batch in batches:
            ids, texts = ids_of(batch.column(0)), batch.column(1)
            for i, j in slices(buffers(texts)[1], 4 << 20):
                coded = [vocab.encode(find(t)) if t else b"" for t in texts.slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids_back(ids[i:j]), pa.array(coded, pa.binary()), pa.array(map(vocab.decode, coded), pa.binary())], ["doc_id", "ids", "decoded"])

    return need_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode_documents``, digested in the same task."""

    def run(batches):
        vocab, find = vocabulary(path), regex.compile(pattern).findall
        for batch in batches:
            ids, texts = ids_of(batch.column(0)), batch.column(1)
            for i, j in slices(buffers(texts)[1], 4 << 20):
                rows = []
                for t in texts.slice(i, j - i):
                    coded = vocab.encode(find(s)) if (s := t.as_py()) else b""
                    rows.append((len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256(vocab.decode(coded)).hexdigest()))
                n, a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([ids_back(ids[i:j]), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return need_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
