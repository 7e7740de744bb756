"""Decayed sentiment state, velocity and history of entities, over events in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import clip, decay

PRIOR, SPREAD = 2.0, 0.5


def decayed_state(observations: DataFrame, now: Column, half_life: dict[str, float], credibility: dict[str, float], digits: int = 6) -> DataFrame:
    """Rows (entity, evidence, sentiment, uncertainty, news_sentiment, social_sentiment, divergence).

    observations: entity, kind (a key of half_life, in hours), score, weight, at.  Each one's
    weight halves with its half life; sums of decayed weights are the closed form of an
    update one by one, so a single aggregation does, in any order.  The mean is shrunk
    to 0 by a prior of PRIOR observations.  Weights of 0 or less and unknown kinds count for nothing.
    """
    hl, cred = F.create_map(*[F.lit(x) for kv in half_life.items() for x in kv]), F.create_map(*[F.lit(x) for kv in credibility.items() for x in kv])
    hours = (F.unix_micros(now) - F.unix_micros("at")) / 3.6e9
    rows = observations.where((F.col("weight") > 0) & F.col("kind").isin(list(half_life))).select("entity", "kind", clip(F.col("score"), -1, 1).alias("score"), (F.col("weight") * decay(hours, hl[F.col("kind")])).alias("w"))
    kinds = rows.groupBy("entity", "kind").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("score")).alias("ws"))
    shown = F.when(F.col("w") > 0.05, F.col("ws") / (F.col("w") + 1))
    sums = kinds.groupBy("entity").agg(
        F.sum(cred[F.col("kind")] * F.col("w")).alias("W"), F.sum(cred[F.col("kind")] * F.col("ws")).alias("WS"),
        *[F.max(F.when(F.col("kind") == k, shown)).alias(f"{k}_sentiment") for k in half_life],
    )
    first, second = [f"{k}_sentiment" for k in half_life][:2]
    r = lambda c: F.round(c, digits)
    return sums.select("entity", r(F.col("W")).alias("evidence"), r(F.col("WS") / (F.col("W") + PRIOR)).alias("sentiment"), r(SPREAD / F.sqrt(F.col("W") + PRIOR)).alias("uncertainty"), r(F.col(first)).alias(first), r(F.col(second)).alias(second), r(F.col(second) - F.col(first)).alias("divergence"))


def trailing_count(rows: DataFrame, by: list[str], at: str, seconds: int, name: str) -> DataFrame:
    """How many rows of the same key lie in the seconds up to each row, both ends included."""
    return rows.withColumn(name, F.count("*").over(Window.partitionBy(*by).orderBy(F.unix_seconds(at)).rangeBetween(-seconds, 0)))


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as an upsert by key would leave it; one aggregation."""
    rest = [c for c in rows.columns if c not in by]
    found = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return found.select(*by, "_row.*")


def changes(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The rows that differ from the row before in one of the columns; the first of each key stays."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.lag(F.struct(*columns)).over(w)
    return rows.withColumn("_same", F.coalesce(before == F.struct(*columns), F.lit(False))).where(~F.col("_same")).drop("_same")


def first_n(rows: DataFrame, by: list[str], order: list, n: int, name: str = "place") -> DataFrame:
    """At most n rows of each key in the given order, with their place; Spark cuts before it shuffles."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
