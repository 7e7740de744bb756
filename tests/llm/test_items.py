"""Benchmark items of few words or in scripts without spaces."""

import pyarrow as pa

from tests.llm import brute
from tidemark.llm import decontaminate

ZH = "敏捷的棕色狐狸跳过了那只懒惰的狗。天气很好,我们去公园散步吧!"


def test_words_of_other_scripts():
    n = lambda *ts: decontaminate.word_arrays(pa.array(ts))[1].tolist()
    assert n("日本語", "a，b。c", "don\u2019t é ñandú", "ไทย x", "5€ 😀", "", None) == [0, 3, 6, 10, 14, 17, 17, 17]
    a, b = (decontaminate.word_arrays(pa.array([t]))[0].tolist() for t in ("狗，Été", "狗 été"))
    assert a == b


def test_short_and_unspaced_items(spark):
    bench = spark.createDataFrame([(1, "Alpha beta gamma"), (2, ZH), (3, "東京"), (4, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    moved = ZH[17:] + "另外" + ZH[:17]
    rows = [(1, "ALPHA, beta gamma"), (2, "x alpha gamma beta"), (3, ZH), (4, moved), (5, "我住在東京都"), (6, "京東"), (7, " ".join(f"w{i}" for i in range(20)) + " alpha beta gamma"), (8, None), (9, "")]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(brute.docs(spark, rows), bench, short_items=True).collect()}
    assert got == {(1, 1), (3, 2), (4, 2), (5, 3), (7, 1), (7, 4)}
    kept = decontaminate.keep_clean(brute.docs(spark, rows), bench, short_items=True)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 6, 8, 9]
