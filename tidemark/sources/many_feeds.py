"""Many feeds as one stream: round robin over folders of files, a position for each feed in one offset.

A feed is a folder of JSON lines files, whose names sort by time; files are added and never changed.  Each micro-batch admits the
next few feeds in turn and of each a few files, so a feed that floods delays no other.  The offset holds
the turn, and for each feed the last file that was read; with it a restart loses and repeats nothing.  Spark asks
for a new offset without saying which was the last, so the reader writes down the last one that it gave, beside the query's checkpoint; what a batch
reads follows from the offsets that Spark has kept.  The driver only looks at names; files are read, and rows let through or not, where tasks run.  Items that a feed
repeats in later files are dropped by ``fresh``, in Spark's keyed state, not in the offset.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


@dataclass
class FeedFile(InputPartition):
    """One file of one feed."""

    feed: str
    file: str


class ManyFeeds(DataSource):
    """Options: path, a folder of feeds; log, a file for the last offset, of this query alone; feeds_per_batch (8) and files_per_feed (4); shortest, the least characters of a title (15); must, a pattern that
    a title has to match unless its feed is among finance, comma-separated (none: all pass)."""

    @classmethod
    def name(cls) -> str:
        return "many_feeds"

    def schema(self) -> str:
        return "feed string, key string, published_at timestamp, text string, url string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedStream(self.options)


class Gate:
    """Which items of a feed go on."""

    def __init__(self, options: dict):
        self.shortest, self.finance = int(options.get("shortest", 15)), {f for f in options.get("finance", "").split(",") if f}
        self.must = re.compile(options["must"], re.IGNORECASE) if options.get("must") else None

    def accepts(self, feed: str, title: str) -> bool:
        return len(title) >= self.shortest and (self.must is None or feed in self.finance or self.must.search(title) is not None)


class FeedStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.log, self.gate = options["path"], options["log"], Gate(options)
        self.feeds_per_batch, self.files_per_feed = int(options.get("feeds_per_batch", 8)), int(options.get("files_per_feed", 4))

    def initialOffset(self) -> dict:
        return {"turn": "", "read": {}}

    def last_given(self) -> dict:
        if not os.path.exists(self.log):
            return self.initialOffset()
        with open(self.log, encoding="utf-8") as f:
            return json.load(f)

    def give(self, at: dict) -> dict:
        """Written down before Spark has it: an offset that Spark never got is passed by the next one, and loses nothing."""
        with open(f"{self.log}.new", "w", encoding="utf-8") as f:
            json.dump(at, f)
        os.replace(f"{self.log}.new", self.log)
        return at

    def waiting(self, feed: str, after: str) -> list[str]:
        """Files of a feed that were not read yet, oldest first."""
        return sorted(n for n in os.listdir(os.path.join(self.path, feed)) if n.endswith(".json") and n > after)

    def latestOffset(self) -> dict:
        """The offset after the next few feeds in turn that have something; Spark asks once for each micro-batch."""
        at = self.last_given()
        names = sorted(n for n in os.listdir(self.path) if os.path.isdir(os.path.join(self.path, n)) and not n.startswith((".", "_")))
        names = [n for n in names if n > at["turn"]] + [n for n in names if n <= at["turn"]]
        read, turn, admitted = dict(at["read"]), at["turn"], 0
        for feed in names:
            if admitted == self.feeds_per_batch:
                break
            if files := self.waiting(feed, read.get(feed, "")):
                read[feed], turn = files[: self.files_per_feed][-1], feed
                admitted += 1
        return self.give({"turn": turn, "read": read})

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for feed, last in sorted(end["read"].items()):
            first = start["read"].get(feed, "")
            if last > first:
                out += [FeedFile(feed, n) for n in self.waiting(feed, first) if n <= last]
        return out

    def read(self, partition: FeedFile) -> Iterator[tuple]:
        from datetime import datetime, timezone

        with open(os.path.join(self.path, partition.feed, partition.file), encoding="utf-8") as f:
            for line in f:
                try:
                    item = json.loads(line)
                    title = str(item["title"]).strip()
                    when = datetime.fromisoformat(item["at"]) if item.get("at") else datetime.strptime(partition.file[:14], "%Y%m%d%H%M%S")
                except (ValueError, KeyError, TypeError):
                    continue  # a malformed line is no item
                if self.gate.accepts(partition.feed, title):
                    yield partition.feed, str(item.get("key") or item.get("url") or title), when.replace(tzinfo=when.tzinfo or timezone.utc), title, item.get("url")

    def commit(self, end: dict) -> None:
        pass


def fresh(items: DataFrame, delay: str = "7 days") -> DataFrame:
    """The first of the items of one feed and key; keys are forgotten once the watermark is the delay behind."""
    return items.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["feed", "key"])


def documents(items: DataFrame) -> DataFrame:
    """Items as documents."""
    return items.select(F.substring(F.sha1(F.concat_ws("|", "feed", "key")), 1, 16).alias("doc_id"), F.col("feed").alias("source"), F.lit("news").alias("kind"), "published_at", "text", "url")
