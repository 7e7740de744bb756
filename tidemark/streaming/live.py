"""Streams of documents and signals.

Batch and stream share their column builders; what a batch does with windows a stream does with
watermarks and state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.text import fingerprint


def replay(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1, form: str = "json") -> DataFrame:
    """A stream over the files of a folder, so many at a time in the order they came."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(path)


def first_copies(docs: DataFrame, at: str, delay: str = "2 days") -> DataFrame:
    """The first document of each fingerprint; fingerprints are forgotten after the delay."""
    return docs.withColumn("fp", fingerprint(F.col("text"))).withWatermark(at, delay).dropDuplicatesWithinWatermark(["fp"])


def windowed(events: DataFrame, at: str, size: str, slide: str | None, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Counts and sums of value over tumbling or sliding windows; late rows are taken until the delay has passed."""
    return events.withWatermark(at, delay).groupBy(F.window(at, size, slide) if slide else F.window(at, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def decayed(observations: DataFrame, half_life_hours: float) -> DataFrame:
    """Per entity the running decayed sums after each batch: rows (entity, weight, weighted, at).

    A late observation counts in full at the time the state has reached: the state never runs backwards.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        w, ws, at = state.get if state.exists else (0.0, 0.0, float("-inf"))
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        for r in rows.itertuples():
            if r.at > at:
                f = 0.5 ** ((r.at - at) / 3600 / half_life_hours) if at > float("-inf") else 0.0
                w, ws, at = w * f, ws * f, r.at
            w, ws = w + r.weight, ws + r.weight * max(-1.0, min(1.0, r.score))
        state.update((w, ws, at))
        yield pd.DataFrame([(key[0], w, ws, at)], columns=["entity", "weight", "weighted", "at"])

    rows = observations.select(F.col("entity").cast("string"), "seq", (F.unix_micros("at") / 1e6).alias("at"), "score", "weight").where("weight > 0")
    return rows.groupBy("entity").applyInPandasWithState(run, "entity string, weight double, weighted double, at double", "w double, ws double, at double", "update", GroupStateTimeout.NoTimeout)


def to_sinks(stream: DataFrame, checkpoint: str, *sinks: Callable[[DataFrame, int], None], mode: str = "append"):
    """Every micro-batch to each sink in turn; a started query that ends when the input does."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for sink in sinks:
            sink(batch, number)
        batch.unpersist()

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def json_lines(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch in a folder of its own, so that one that is run again replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").json(f"{path}/batch={number}")


def upsert(path: str, by: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """The latest row of each key, in a folder for each version; the newest folder is the state."""
    from tidemark.operators.state import latest

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = f"{path}/v{number - 1:08d}"
        try:
            rows = spark.read.schema(batch.schema).parquet(old).unionByName(batch)
        except Exception as e:  # no version yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = batch
        latest(rows, by, order).write.mode("overwrite").parquet(f"{path}/v{number:08d}")

    return sink
