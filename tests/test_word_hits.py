"""What is read from texts in one pass against the columns that say the same."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import word_hits as W

TEXTS = [
    "Not rising, RISING; it isn't rising. 12 pears", "RT @a: RT @b: R&amp;amp;D  http://x.y/z www.a", "été économie pears² pearsé pear's _pears pears_", "pearś İstanbul Kelvin falling 3.5 x7",
    "&lt;p&gt; &#x41; &#0; &#128; &notit; &amp;amp;lt;", "", None, " \t\n", "a'b ''' falling rising never falling", "pears² ½ pearsⅧ", "PEARS-rising falling", "ends in Σ Σ", "caf́ 8",
]
CUES, SEVERE = [["pears", "économie"], ["rising"], ["elvin", "stanbul"]], [["falling"], ["zzz"]]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").withColumn("c", W.cleaned(F.col("t"))).localCheckpoint()


def test_told(texts):
    cues = [[w for w in c if w.isascii()] for c in CUES]
    told = W.told(F.col("c"), cues, SEVERE, ["rising"], ["falling"], ["not", "never"])
    has = lambda words: F.col("c").rlike(r"(?i)\b(" + "|".join(words) + r")\b")
    rows = texts.select("i", "c", T.clean_text(F.col("t")).alias("clean"), told.alias("told"), T.fingerprint(F.col("c")).alias("fp"), F.array(*map(has, cues)).alias("cues"), F.array(*map(has, SEVERE), F.col("c").rlike(r"\b[0-9]+\b")).alias("severe"), T.lexicon_sentiment(F.col("c"), ["rising"], ["falling"], ["not", "never"]).alias("tone"), T.sentiment_of(told).alias("tone_told")).collect()
    for r in rows:
        assert (r["c"], r["told"]["fp"]) == (r["clean"], r["fp"]), r
        assert (r["told"]["cues"], r["told"]["severe"]) == (r["cues"], r["severe"]), r
        assert r["tone"] == r["tone_told"], r
    assert len({tuple(r["cues"]) for r in rows}) > 3


def test_vectors_and_counts(texts):
    words = F.expr("filter(regexp_extract_all(lower(c), \"[a-z']+\", 0), w -> length(w) > 2)")
    for r in texts.select(words.alias("w"), W.word_vectors(F.col("c"), 8).alias("v")).collect():
        counts = [sum(W._bucket(w, 8) == k for w in r["w"]) for k in range(8)]
        size = sum(n * n for n in counts) ** 0.5
        assert r["v"] == (pytest.approx([n / size for n in counts], abs=1e-15) if size else None)
    docs = texts.select(F.col("t").alias("text"), (F.col("i") % 2).cast("long").alias("g"), (F.col("i") % 3).cast("long").alias("b"))
    wanted = {}
    for i, t in enumerate(TEXTS):
        for w in set(re.findall("[a-z']+", (t or "").lower())):
            n, g, b = wanted.get(w, (0, 0, 0))
            wanted[w] = n + 1, g + i % 2, b + i % 3
    assert {r["w"]: (r["n"], r["g"], r["b"]) for r in W.word_counts(docs).collect()} == wanted
