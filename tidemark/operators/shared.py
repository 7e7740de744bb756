"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_top(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a new one in local mode, as in tests, else an error: executors share no other."""
    top = spark.conf.get("spark.checkpoint.dir", "")
    if top:
        return top.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="shared-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to that folder, with its lineage cut."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_top(df.sparkSession))
    return df.checkpoint()
