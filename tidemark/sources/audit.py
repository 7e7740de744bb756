"""Counters and rejects from the one scan that a source is read with.

What a row is counted as is decided once, row by row: the first check that it fails names its reject.
Counters are an ``Observation`` of the plan that reads the rows; accepted and rejected rows are written by one
job and read back apart, so nothing is scanned, parsed or checked twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators.shared import shared_top


@dataclass(frozen=True)
class Audited:
    """Rows that passed, rows that did not with the reason, and the counters."""

    accepted: DataFrame
    rejects: DataFrame
    counters: dict[str, int]


def reason(checks: dict[str, Column]) -> Column:
    """The name of the first check that holds, null if none does; a check that is null holds not."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in checks.items()])


def audited(rows: DataFrame, checks: dict[str, Column], extra: dict[str, Column] | None = None, path: str | None = None) -> Audited:
    """rows split by checks (of what is wrong), with a counter for all rows, for those accepted, for each check, and for extra conditions on accepted rows.

    Both parts are written under path, or the shared folder, in one job.  An empty table has counters of 0.
    """
    import uuid

    names = ["rows", "accepted", *checks, *(extra or {})]
    if len(set(names)) < len(names):
        raise ValueError("counters need names of their own")
    spark, why = rows.sparkSession, F.col("reject")
    path = path or f"{shared_top(spark)}/audit-{uuid.uuid4().hex}"
    seen = Observation()
    marked = rows.withColumn("reject", reason(checks))
    each = [F.count_if(F.coalesce(why == name, F.lit(False))).alias(name) for name in checks]
    more = [F.count_if(why.isNull() & F.coalesce(c, F.lit(False))).alias(name) for name, c in (extra or {}).items()]
    marked = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(why.isNull()).alias("accepted"), *each, *more)
    marked.withColumn("kept", why.isNull()).write.partitionBy("kept").mode("overwrite").parquet(path)
    schema = rows.withColumn("reject", F.lit("").cast("string")).withColumn("kept", F.lit(True)).schema
    back = spark.read.schema(schema).parquet(path)
    return Audited(back.where("kept").drop("kept", "reject"), back.where("not kept").drop("kept"), {n: int(v or 0) for n, v in seen.get.items()})


def ordered(rows: DataFrame, name: str = "arrival") -> DataFrame:
    """rows of a file source with their place of arrival, a string that sorts by file, then by place in the file, however the files are cut into splits.

    Parquet knows a row's number.  Of line formats a split's start is known and the order of rows within it; rows
    must come straight from the reader, before any shuffle.
    """
    fields = set(rows.select("_metadata.*").columns)
    place = F.struct(F.lpad(F.col("_metadata.row_index").cast("string"), 20, "0")) if "row_index" in fields else F.struct(F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
    return rows.select("*", F.concat_ws("|", F.col("_metadata.file_path"), place["col1"], *([place["col2"]] if "row_index" not in fields else [])).alias(name))
