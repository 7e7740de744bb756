"""Feeds as streams and files: quarter-hour slots with a late newest one, RSS, and posts."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SLOT = timedelta(minutes=15)
_FORMAT = "%Y%m%d%H%M%S"


class SlotFeed(DataSource):
    """A stream over slot files in a folder, named by their time, one line a row.

    Options: path, start (yyyymmddHHMMSS) and give_up, how many slots old a missing file
    may be before it is passed over (4).  A missing slot holds back later ones until then, so that a
    late file is still read in its place.
    """

    @classmethod
    def name(cls) -> str:
        return "slot_feed"

    def schema(self) -> str:
        return "slot string, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SlotStream(self.options)

    def reader(self, schema) -> DataSourceReader:
        return SlotReader(self.options)


def lines(path: str, slot: str) -> Iterator[tuple[str, str]] | None:
    """The rows of a slot, or nothing if its file is not there (yet)."""
    import os

    name = os.path.join(path, slot + ".csv")
    return _rows(name, slot) if os.path.exists(name) else None


def _rows(name: str, slot: str) -> Iterator[tuple[str, str]]:
    with open(name, encoding="utf-8", errors="replace") as f:
        for line in f:
            yield slot, line.rstrip("\n")


def newest(path: str) -> str:
    import os

    return max((n[:14] for n in os.listdir(path) if n.endswith(".csv") and n[:14].isdigit()), default="")


class SlotStream(DataSourceStreamReader):
    """The driver only looks at file names; each slot is a partition that an executor reads.  The folder must be one that all share."""

    def __init__(self, options: dict):
        self.path, self.start, self.give_up = options["path"], options["start"], int(options.get("give_up", 4))
        self.at = self.start

    def initialOffset(self) -> dict:
        return {"slot": self.start}

    def latestOffset(self) -> dict:
        """The first slot that is not there and may still come, or the one after the newest."""
        import os

        last, at = newest(self.path), datetime.strptime(self.at, _FORMAT)
        while last and at <= datetime.strptime(last, _FORMAT):
            there = os.path.exists(os.path.join(self.path, at.strftime(_FORMAT) + ".csv"))
            if not there and datetime.strptime(last, _FORMAT) - at < self.give_up * SLOT:
                break
            at += SLOT
        self.at = at.strftime(_FORMAT)
        return {"slot": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        at, to = (datetime.strptime(o["slot"], _FORMAT) for o in (start, end))
        out = []
        while at < to:
            out.append(InputPartition(at.strftime(_FORMAT)))
            at += SLOT
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from lines(self.path, partition.value) or []

    def commit(self, end: dict) -> None:
        self.at = max(self.at, end["slot"])


class SlotReader(DataSourceReader):
    """All slots that are there, each a partition."""

    def __init__(self, options: dict):
        self.path, self.start = options["path"], options["start"]

    def partitions(self) -> list[InputPartition]:
        import os

        return [InputPartition(n[:14]) for n in sorted(os.listdir(self.path)) if n.endswith(".csv") and n[:14] >= self.start]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from lines(self.path, partition.value) or []


def rss_items(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Documents of RSS files: items with a title of 15 characters or more, once for each link; the first by time stays."""
    rows = spark.read.format("xml").schema("title string, link string, pubDate string").option("rowTag", "item").load(path)
    at = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]{3}, | GMT$", ""), F.lit("d MMM yyyy HH:mm:ss")), F.try_to_timestamp("pubDate"))
    rows = rows.select(F.lit(source).alias("source"), F.trim("title").alias("text"), F.col("link").alias("url"), at.alias("published_at")).where(F.length("text") >= 15)
    return rows.groupBy("url").agg(F.min_by(F.struct("source", "text", "published_at"), F.coalesce("published_at", F.current_timestamp())).alias("d")).select(make_id("d.source", "url"), "d.*", "url")


def make_id(source: str, key: str) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", F.col(source), F.col(key))), 1, 16).alias("doc_id")


def posts(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON lines of posts (id, body, created_at, symbol, label): bodies of ten characters or more; the author's label stays in meta."""
    rows = spark.read.schema("id string, body string, created_at timestamp, symbol string, label string").json(path).where(F.length("body") >= 10).dropDuplicates(["id"])
    return rows.select(F.lit("posts").alias("source"), F.lit("social").alias("kind"), F.col("id").alias("doc_id"), F.col("body").alias("text"), F.col("created_at").alias("published_at"), F.lit(True).alias("finance_feed"), F.map_filter(F.create_map(F.lit("symbol"), F.col("symbol"), F.lit("label"), F.col("label")), lambda k, v: v.isNotNull()).alias("meta"))
