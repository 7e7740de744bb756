"""What the words of a text say of it, in one pass in Arrow batches: vocabulary, tone, cues, fingerprint, and a vector of hashed words.

The same as the columns of ``functions.text`` make of it, for cues that are whole words: these look
through a text once for each pattern, and make a row or an array element of each word.
"""

from __future__ import annotations

import hashlib
import html
import re
import string
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import RETWEET, URL

_URL, _RETWEET = re.compile(URL, re.ASCII), re.compile(RETWEET, re.ASCII)


def _kept(signs: str, and_beyond: bool = False) -> bytes:
    """For bytes.translate: signs as they are, with and_beyond also the bytes of what is not ASCII; a space for any other byte."""
    return bytes(i if chr(i) in signs and i < 0x80 or and_beyond and i >= 0x80 else 0x20 for i in range(256))


_TOKEN, _PRINT = _kept(string.ascii_lowercase + "'"), _kept(string.ascii_lowercase + string.digits + "$")
_WHOLE = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode()).translate(_kept(string.ascii_lowercase + string.digits + "_", True))


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def clean(text: str | None) -> str:
    text = html.unescape(text or "")
    if "http" in text or "www." in text:
        text = _URL.sub(" ", text)
    return b" ".join(_bytes(_RETWEET.sub("", text)).split()).decode("utf-8", "surrogatepass")


def cleaned(text: Column) -> Column:
    """``functions.text.clean_text``, worked out once however many columns and filters come behind it: as columns it is written into each of them, and plans of it take long to make."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([clean(t) for t in texts], dtype=object)

    return run.asNondeterministic()(text)


def tokens(text: str | None) -> list[str]:
    """Runs of a-z and apostrophes in lower case."""
    return _bytes((text or "").lower()).translate(_TOKEN).decode().split()


@lru_cache(1)
def _odd() -> tuple[frozenset[str], re.Pattern]:
    """Signs on which \\b and Python's \\w differ (numbers that are no digits, marks on letters), and words where a text has any."""
    kinds = {"Mn": [], "No": [], "Nl": []}
    for i in range(0x80, sys.maxunicode + 1):
        if (kind := unicodedata.category(chr(i))) in kinds:
            kinds[kind].append(chr(i))
    marks, numbers = "".join(kinds["Mn"]), "".join(kinds["No"] + kinds["Nl"])
    return frozenset(marks + numbers), re.compile(rf"(?:_|[^\W_{numbers}][{marks}]*)+")


_WORD = re.compile(r"\w+")


def whole_words(text: str) -> set[str]:
    r"""All w, in lower case, for which \bw\b is found in text with case of a-z ignored."""
    words = set(_bytes(text).translate(_WHOLE).decode("utf-8", "surrogatepass").split())
    if text.isascii():
        return words
    mixed = [w for w in words if not w.isascii()]  # what is not ASCII may be part of a word or stand between two
    rest = " ".join(mixed)
    pattern = _WORD if _odd()[0].isdisjoint(rest) else _odd()[1]
    return words.difference(mixed).union(w for w in pattern.findall(rest) if w.isascii())


def tone(words: list[str], polarity: dict[str, int], negators: frozenset[str]) -> tuple[int, int]:
    """How many words are positive, and negative; one counts for the other side if a negator is among the three before it."""
    pos = neg = 0
    for i, w in enumerate(words):
        if w in polarity:
            turned = any(x in negators or x.endswith("n't") for x in words[max(0, i - 3) : i])
            if (polarity[w] > 0) != turned:
                pos += 1
            else:
                neg += 1
    return pos, neg


def _cues(text: str, wanted: list[frozenset[str]], n: int) -> tuple[list[bool], list[bool]]:
    """Which of the lists have a word that is in the text, n of them apart, and whether a whole number is."""
    words = whole_words(text)
    found = [not w.isdisjoint(words) for w in wanted]
    return found[:n], [*found[n:], any(map(str.isdigit, words))]


def fingerprint(text: str) -> str:
    """``functions.text.fingerprint`` of a cleaned text, which few texts have anything left to be cleaned of."""
    text = clean(text) if "&" in text or _RETWEET.match(text) else text
    return hashlib.md5(b" ".join(_bytes(text.lower()).translate(_PRINT).split())).hexdigest()


def told(text: Column, cues: list[list[str]], severe: list[list[str]], positive: list[str], negative: list[str], negators: list[str]) -> Column:
    """A struct of cues and severe, which of these lists have a word that is in the text, with whether a whole number is as the last of severe; of pos and neg, the hits of ``functions.text.lexicon_sentiment``, and of the fingerprint fp."""
    wanted, polarity, turning = [frozenset(c) for c in (*cues, *severe)], dict.fromkeys(negative, -1) | dict.fromkeys(positive, 1), frozenset(negators)

    @F.pandas_udf("cues array<boolean>, severe array<boolean>, pos int, neg int, fp string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(*_cues(t, wanted, len(cues)), *tone(tokens(t), polarity, turning), fingerprint(t)) for t in texts]
        return pd.DataFrame(rows, columns=["cues", "severe", "pos", "neg", "fp"])

    return run(text)


def _bucket(word: str, buckets: int) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:4]) % buckets


class _Buckets(dict):
    """The bucket of every word met; buckets itself for those that don't count."""

    def __init__(self, buckets: int, most: int = 1 << 18):
        self.buckets, self.most = buckets, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = _bucket(word, self.buckets) if len(word) > 2 else self.buckets
        return found


_buckets = lru_cache(4)(_Buckets)


def vector(text: str | None, buckets: int) -> np.ndarray | None:
    words = tokens(text)
    sums = np.bincount(np.fromiter(map(_buckets(buckets).__getitem__, words), np.int64, len(words)), minlength=buckets)[:buckets]
    return sums / np.sqrt((sums * sums).sum()) if sums.any() else None


def word_vectors(text: Column, buckets: int = 256) -> Column:
    """The unit vector of how often the words of each bucket occur; null for a text without a word of three letters."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([vector(t, buckets) for t in texts], dtype=object)

    return run(text)


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (w, n, g, b) from docs (text, g, b): how many texts have a word, and the sums of their g and b.  Words of a batch are counted before they are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            n, g, b = Counter(), Counter(), Counter()
            for text, good, bad in zip(rows["text"], rows["g"], rows["b"], strict=True):
                words = set(tokens(text))
                n.update(words)
                for sums, k in ((g, good), (b, bad)):
                    if k:
                        sums.update(words if k == 1 else dict.fromkeys(words, k))
            yield pd.DataFrame({"w": list(n), "n": list(n.values())} | {c: [sums.get(w, 0) for w in n] for c, sums in (("g", g), ("b", b))})

    counted = docs.select("text", "g", "b").mapInPandas(run, "w string, n long, g long, b long")
    return counted.groupBy("w").agg(*[F.sum(c).alias(c) for c in ("n", "g", "b")])
