"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton holds a sample of its labelled text.  A text is
parsed from left to right into the longest phrases that occur in the sample.  A phrase of
a larger sample takes more bits to point at, so phrases count by the logarithm of
their sample's size (cross-entropy); the language of the least cost names the text.  A parse never goes
back, so with "end the phrase and start again" folded into the automaton's table it
is one table look-up for each byte, made for thousands of blocks of text at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.kernels import as_array, buffers, slices

#: Bounds of the training sample: so many stretches of so many characters for each language, so many languages.
STRETCHES, STRETCH_CHARS, LANGUAGES = 240, 120, 400
#: A parse starts afresh after so many symbols, so that very long texts are parsed in parallel.
BLOCK = 4096
#: Texts of so many symbols or more that need a phrase for nearly each of them are in no learned language; a stated language yields to a prediction of this score.
FEW, STRANGE, CLEAR = 20, 0.75, 0.2
_OTHER, _PAD = 0, 1


def held_out(doc_id: Column) -> Column:
    """True for a third of all documents, by id; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """Stretches of labelled text for each language, from documents chosen and places set by hashes.  Bounded by the constants above; more languages than fit are an error."""
    chance = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    stretch = F.substring(F.col("text"), (1 + F.pmod(F.shiftright(chance, 8), F.greatest(F.length("text") - STRETCH_CHARS, F.lit(1)))).cast("int"), F.lit(STRETCH_CHARS))
    rows = (
        docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("lang").cast("string").alias("lang"), chance.alias("chance"), stretch.alias("stretch"))
        .withColumn("place", F.row_number().over(Window.partitionBy("lang", F.pmod("chance", F.lit(16))).orderBy("chance", "stretch")))
        .where(F.col("place") <= STRETCHES)  # a common language is cut down in many tasks first
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("chance", "stretch")))
        .where(F.col("place") <= STRETCHES)
        .orderBy("lang", "place")
        .limit(STRETCHES * LANGUAGES + 1)
        .collect()
    )
    if len(rows) > STRETCHES * LANGUAGES:
        raise ValueError(f"more labelled languages than the {LANGUAGES} that a sample holds")
    found: dict[str, list[str]] = {}
    for r in rows:
        found.setdefault(r["lang"], []).append(r["stretch"])
    return found


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts the substrings of symbols; state 0 is the empty string."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def byte_classes(texts: list[str]) -> np.ndarray:
    """Class of each byte: letters and bytes of other scripts seen in training each have their own, what is no ASCII letter is _OTHER; unseen bytes share the last."""
    seen = sorted({b for t in texts for b in t.lower().encode()})
    classes = np.full(256, 2, np.uint8)
    classes[[b for b in range(128) if not chr(b).isalpha()]] = _OTHER
    for i, b in enumerate(b for b in seen if b >= 128 or chr(b).isalpha()):
        classes[b] = 3 + i
    return classes


def symbols_of(data: np.ndarray, offs: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the bytes, runs of _OTHER reduced to one, and the new offsets."""
    out = classes[data]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != _OTHER) | (out[:-1] != _OTHER)
    keep[offs[:-1][offs[:-1] < len(out)]] = True
    before = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return out[keep], before[offs]


class Parser:
    """Tables of all languages: entry state * width + class holds the next state, and in two low bits how many phrases ended."""

    def __init__(self, found: dict[str, list[str]]):
        self.languages = sorted(found)
        self.classes = byte_classes([t for ts in found.values() for t in ts])
        self.width = int(self.classes.max()) + 1
        self.start, tables, base = [], [], 0
        bits = []
        for lang in self.languages:
            symbols: list[int] = []
            for t in found[lang]:
                raw = np.frombuffer(t.lower().encode(), np.uint8)
                symbols += symbols_of(raw, np.array([0, len(raw)]), self.classes)[0].tolist()
                symbols.append(2)  # no text gives it a transition that counts: matches end here
            bits.append(np.log2(len(symbols) + 1))
            step = suffix_automaton(symbols)
            nxt = np.full((len(step), self.width), -1, np.int64)
            for s, row in enumerate(step):
                for c, t in row.items():
                    nxt[s, c] = t
            nxt[:, 2] = -1
            root = nxt[0]
            again = np.where(root >= 0, (base + root) << 2 | 1, base << 2 | 2)  # the phrase ends; so does that of the symbol itself if it is nowhere in the sample
            table = np.where(nxt >= 0, (base + nxt) << 2, again)
            table[0] = np.where(root >= 0, (base + root) << 2, base << 2 | 1)
            table[:, _PAD] = (base + np.arange(len(step))) << 2
            tables.append(table.astype(np.int32))
            self.start.append(base)
            base += len(step)
        self.bits = np.array(bits)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def phrases(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text by language (rows), and the symbols of each text."""
        symbols, at = symbols_of(data, offs, self.classes)
        size = np.diff(at)
        blocks = -(-size // BLOCK)
        doc = np.repeat(np.arange(len(size)), blocks)
        total = np.zeros((len(self.languages), len(size)), np.int64)
        if len(doc):
            first = at[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
            length = np.minimum(BLOCK, at[1:][doc] - first)
            order = np.argsort(-length, kind="stable")
            doc, first, length = doc[order], first[order], length[order]
            start = np.array(self.start, np.int32)[:, None]
            state = np.repeat(start, len(doc), axis=1)
            count = np.zeros(state.shape, np.int32)
            active = np.searchsorted(-length, -np.arange(BLOCK), "left")
            for j in range(int(length[0])):
                n = active[j]
                got = self.table[state[:, :n] * self.width + symbols[first[:n] + j]]
                count[:, :n] += got & 3
                state[:, :n] = got >> 2
            count += state != start
            for i in range(len(self.languages)):
                total[i] = np.bincount(doc, count[i], len(size)).astype(np.int64)
        return total, size

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of each text, 1 less the ratio of the least cost to the next one, and whether it is in no learned language."""
        lower = pc.utf8_lower(as_array(texts).cast(pa.large_string()))
        letter = pc.fill_null(pc.match_substring_regex(lower, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        data, offs = buffers(lower)
        names, scores, strange = np.full(len(lower), "und", object), np.zeros(len(lower)), ~letter
        if self.languages and len(lower):
            phrases, size = self.phrases(data, offs)
            cost = phrases * self.bits[:, None]
            best = np.argmin(cost, axis=0)  # the first in the order of names, if several
            low = cost[best, np.arange(len(lower))]
            if len(self.languages) > 1:
                second = np.partition(cost, 1, axis=0)[1]
                scores = np.where(letter & (second > 0), 1 - low / np.where(second > 0, second, 1), 0.0)
            else:
                scores = letter.astype(float)
            names = np.where(letter, np.array(self.languages, object)[best], "und")
            strange |= (size >= FEW) & (phrases.min(axis=0) >= STRANGE * size)
        return names.tolist(), scores, strange


def fit(docs: DataFrame) -> Parser:
    return Parser(sample(docs))


def identify(docs: DataFrame, parser: Parser) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score) for the whole text of every document.

    ``und`` with score 0 where text is null, empty or has no letter, or where there was no
    labelled text at all.  Equal costs go to the first language by name, with score 0.
    A null doc_id stays null and is not held out.  Repeated rows each give a row; other
    columns are ignored.  lang, source and doc_id play no part in a prediction.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches):
        for batch in batches:
            _, offs = buffers(batch.column(2))
            for i, j in slices(offs, 4 << 20):
                names, scores, _ = shared.value.predict(batch.column(2).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, parser: Parser) -> DataFrame:
    """The documents whose language is found, all columns but lang as they were.

    Documents named ``und`` go, and those of FEW symbols or more that no learned language
    fits.  A null lang gets the prediction, and so does one that a prediction of a score of
    CLEAR or more contradicts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    names = docs.columns

    def run(batches):
        for batch in batches:
            text = batch.column(names.index("text"))
            _, offs = buffers(text)
            for i, j in slices(offs, 4 << 20):
                part = batch.slice(i, j - i)
                found, score, strange = shared.value.predict(text.slice(i, j - i))
                found = pa.array(found, pa.string())
                if "lang" in names:
                    k = names.index("lang")
                    part = part.set_column(k, "lang", pc.coalesce(pc.if_else(pa.array(score >= CLEAR), found, part.column(k)), found))
                yield part.filter(pa.array(~strange))

    return docs.mapInArrow(run, docs.schema)
