"""The bound of the sample of languages."""

import pytest

from tidemark.llm import langid


def test_more_languages_than_fit_are_an_error(spark, monkeypatch):
    rows = [(i, f"some words {i}", lang) for i, lang in enumerate(["aa", "bb", "cc"] * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "STRETCHES", 2)
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    assert langid.fit(docs).languages == ["aa", "bb", "cc"]
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        langid.fit(docs)
