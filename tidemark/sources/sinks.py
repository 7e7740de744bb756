"""A sink in two phases, for streams and batches: rows become visible when the driver commits them, all at once, and once.

Tasks write files beside the table and report them; the commit moves a whole batch into place with one
rename.  A failed task's file is never named in a commit; a batch that is run again finds itself there
and is dropped.  The folder must be one that driver and executors share.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its file, and how many rows."""

    file: str
    rows: int


class CommittedLines(DataSource):
    """JSON lines under path, a folder for each batch, as a format to write to.

    Options: path; name, the batch's name where a batch of a stream gives none; columns, which are
    kept in this order, comma-separated (all).
    """

    @classmethod
    def name(cls) -> str:
        return "committed_lines"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return BatchSink(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return StreamSink(self.options)


class Sink:
    """Both phases; subclasses only name the batch."""

    def __init__(self, options: dict):
        self.path, self.columns = options["path"], [c for c in options.get("columns", "").split(",") if c]
        self.batch = options.get("name", "")
        self.pending = os.path.join(self.path, "_pending")

    def put(self, rows: Iterator) -> Written:
        """One task's rows, in a file that nobody reads yet."""
        os.makedirs(self.pending, exist_ok=True)
        name, n = os.path.join(self.pending, uuid.uuid4().hex), 0
        with open(name, "w", encoding="utf-8") as f:
            for row in rows:
                known = row.asDict(recursive=True)
                f.write(json.dumps({c: known[c] for c in self.columns or known}, default=str, ensure_ascii=False) + "\n")
                n += 1
            f.flush()
            os.fsync(f.fileno())
        return Written(name, n)

    def publish(self, messages: list[Written | None], batch: str) -> None:
        """Moves a batch's files into its folder, which appears with all of them or not at all; a batch that is there already stays as it is."""
        files = [m for m in messages if m is not None]
        final = os.path.join(self.path, f"batch={batch}")
        if not os.path.exists(final):
            ready = os.path.join(self.pending, f"ready-{uuid.uuid4().hex}")
            os.makedirs(ready)
            for i, m in enumerate(files):
                os.replace(m.file, os.path.join(ready, f"part-{i:05d}.json"))
            try:
                os.rename(ready, final)
                return
            except OSError:  # another commit of the same batch was faster
                for name in os.listdir(ready):
                    os.unlink(os.path.join(ready, name))
                os.rmdir(ready)
        self.drop(files)

    def drop(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.file):
                os.unlink(m.file)


class BatchSink(Sink, DataSourceWriter):
    def write(self, iterator: Iterator) -> Written:
        return self.put(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.publish(messages, self.batch or uuid.uuid4().hex)

    def abort(self, messages: list[Written | None]) -> None:
        self.drop(messages)


class StreamSink(Sink, DataSourceStreamWriter):
    def write(self, iterator: Iterator) -> Written:
        return self.put(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.publish(messages, f"{batchId:08d}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.drop(messages)


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that are committed."""
    if not any(name.startswith("batch=") for name in os.listdir(path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(os.path.join(path, "batch=*"))
