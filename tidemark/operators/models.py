"""Text models behind one interface: probabilities and an embedding for each text.

``rules`` is made of columns alone.  ``batched`` wraps any model that takes a list of texts, such as
an ONNX session, loaded once in each Python worker.  Heads on embeddings are fitted with MLlib.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

OUTPUT = "embedding array<double>, sentiment array<double>, event array<double>"


def rules(docs: DataFrame, text: str, cues: dict[str, list[str]], positive: list[str], negative: list[str], negators: list[str], smoothing: float = 0.02) -> DataFrame:
    """docs with sentiment (negative, neutral, positive) and event probabilities from a lexicon and cues; OTHER counts one where no cue is."""
    names = [n for n in cues if n != "OTHER"] + ["OTHER"]
    rows = docs.withColumns({"_s": T.lexicon_sentiment(F.col(text), positive, negative, negators), "_c": T.cue_counts(F.col(text), {n: cues.get(n, []) for n in names})})
    return rows.withColumns({"sentiment": F.array("_s.neg", "_s.neu", "_s.pos"), "event": probabilities(F.col("_c"), names, smoothing)}).drop("_s", "_c")


def probabilities(counts: Column, names: list[str], smoothing: float = 0.02) -> Column:
    """Probabilities of names in order from a map of their cues; OTHER counts one where no cue is."""
    hits = F.aggregate(F.map_values(counts), F.lit(0), lambda a, x: a + x)
    raw = F.array(*[counts[n] + smoothing + (F.when(hits == 0, 1).otherwise(0) if n == "OTHER" else F.lit(0)) for n in names])
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def batched(load: Callable[[], Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> Callable[[Column], Column]:
    """A column function from a loader of a model that gives (embeddings, sentiment, event) for a list of texts.  Short texts are batched together."""

    @F.pandas_udf(OUTPUT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            order = texts.fillna("").str.len().argsort(kind="stable").to_numpy()
            back = np.argsort(order, kind="stable")
            parts = model([t or "" for t in texts.fillna("").iloc[order]])
            yield pd.DataFrame({n: [list(map(float, v)) for v in np.asarray(p)[back]] for n, p in zip(("embedding", "sentiment", "event"), parts, strict=True)})

    return run


def onnx_encoder(path: str, tokenizer_path: str, max_length: int = 128) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A loader for a sentence encoder in ONNX: tokens, mean of the last layer, unit length.  The files must be on every executor."""

    def load():
        import onnxruntime
        from tokenizers import Tokenizer

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.enable_truncation(max_length)
        tokenizer.enable_padding()
        wanted = {i.name for i in session.get_inputs()}

        def encode(texts: list[str]) -> np.ndarray:
            coded = tokenizer.encode_batch(texts)
            mask = np.array([c.attention_mask for c in coded], np.int64)
            given = {"input_ids": np.array([c.ids for c in coded], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
            hidden = session.run(None, {k: v for k, v in given.items() if k in wanted})[0]
            pooled = (hidden * mask[..., None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1)
            return pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12)

        return encode

    return load


def relevant(docs: DataFrame, other: int, threshold: float = 0.5) -> DataFrame:
    """docs with relevance, one less the probability of OTHER at a place, and whether it reaches the threshold."""
    return docs.withColumn("relevance", 1 - F.col("event")[other]).withColumn("relevant", F.col("relevance") >= threshold)


def fit_head(rows: DataFrame, label: str, embedding: str = "embedding"):
    """A logistic head on embeddings, rows weighted by the root of how rare their class is."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    most = counts.agg(F.max("_n")).first()[0]
    weighted = rows.join(counts, label).withColumns({"_w": F.sqrt(F.lit(float(most)) / F.col("_n")), "_x": array_to_vector(F.col(embedding).cast("array<double>"))})
    return Pipeline(stages=[LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", maxIter=40, regParam=0.01)]).fit(weighted)


def apply_head(model, rows: DataFrame, embedding: str = "embedding") -> DataFrame:
    """rows with probability (an array) and guess."""
    scored = model.transform(rows.withColumn("_x", array_to_vector(F.col(embedding).cast("array<double>"))))
    return scored.withColumn("probability", vector_to_array("probability")).withColumnRenamed("prediction", "guess").drop("_x", "rawPrediction")


def mlp(weights: list[np.ndarray], biases: list[np.ndarray], temperature: float = 1.0) -> Callable[[Column], Column]:
    """A column function for a head with hidden layers: each layer but the last is cut at 0, the last made probabilities at a temperature.  A null embedding gives null."""

    @F.pandas_udf("array<double>")
    def run(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
        known = vectors.dropna()
        if len(known):
            h = np.stack(known.to_list()).astype(float)
            for i, (w, b) in enumerate(zip(weights, biases, strict=True)):
                h = h @ w + b
                h = np.maximum(h, 0.0) if i < len(weights) - 1 else h / temperature
            h = np.exp(h - h.max(axis=1, keepdims=True))
            out.loc[known.index] = list(h / h.sum(axis=1, keepdims=True))
        return out

    return run


def first_available(loaders: list[Callable[[], Callable]], fallback: Callable) -> Callable:
    """The first model that loads; the fallback, which needs nothing, if none does."""
    import logging

    for load in loaders:
        try:
            return load()
        except Exception as e:  # whatever keeps a model from loading, the next one may do
            logging.getLogger(__name__).warning("model unavailable (%s: %s)", type(e).__name__, e)
    return fallback
