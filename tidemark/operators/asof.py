"""As-of and range joins without a nested loop: sort the union by time, carry the last value forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], strict: bool = False, tolerance: str | None = None) -> DataFrame:
    """left with the values of the last right row of the same key at or before (strict: before) its time.

    One shuffle by key; right rows of one key and time are reduced to one, the largest by its
    values.  Null values of right are kept as they are.  With a tolerance, an interval in
    SQL such as ``interval 5 days``, older rows count as none.  Null keys match nothing.
    """
    newest = right.groupBy(*by, time).agg(F.max(F.struct(*values)).alias("_value"))
    side = 1 if strict else 0  # what comes first at equal times
    rows = left.select(F.struct("*").alias("_left"), *by, time, F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(newest.schema["_value"].dataType).alias("_value"), F.lit(None).cast(right.schema[time].dataType).alias("_seen"))
    rows = rows.unionByName(newest.select(F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), *by, time, F.lit(side).alias("_side"), "_value", F.col(time).alias("_seen")))
    past = Window.partitionBy(*by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"_found": F.last("_value", ignorenulls=True).over(past), "_at": F.last("_seen", ignorenulls=True).over(past)}).where(F.col("_left").isNotNull())
    good = F.col("_at").isNotNull()
    for name in by:
        good &= F.col(name).isNotNull()
    if tolerance:
        good &= F.col("_at") >= F.col(time) - F.expr(tolerance)
    return rows.select("_left.*", *[F.when(good, F.col("_found")[v]).alias(v) for v in values])


def forward_fill(panel: DataFrame, by: list[str], time: str, column: str) -> DataFrame:
    past = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return panel.withColumn(column, F.last(column, ignorenulls=True).over(past))


def range_name(value: Column, ranges: list[tuple[int, int, str]], otherwise: str) -> Column:
    """The name of the first range (both ends inclusive) that has the value.  Ranges are code, a few dozen at most."""
    out = F.lit(otherwise)
    for low, high, name in reversed(ranges):
        out = F.when(value.between(low, high), F.lit(name)).otherwise(out)
    return out


def range_join(left: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: int) -> DataFrame:
    """Inner join of integer values with ranges of any number: ranges are repeated for each bucket of width they touch, and the join is on the bucket."""
    spans = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return left.withColumn("_bucket", F.floor(F.col(value) / width)).join(spans, "_bucket").where(F.col(value).between(F.col(low), F.col(high))).drop("_bucket")


def outside(left: DataFrame, windows: DataFrame, time: str, start: str, end: str, days: int = 1) -> DataFrame:
    """The rows of left whose time is in no window (half open), by day buckets and an anti-join; null times stay."""
    day = lambda c: F.floor(F.unix_timestamp(F.col(c)) / (86400 * days))
    spans = windows.withColumn("_day", F.explode(F.sequence(day(start), day(end)))).select("_day", F.col(start).alias("_start"), F.col(end).alias("_end"))
    rows = left.withColumn("_day", day(time))
    return rows.join(spans, (rows["_day"] == spans["_day"]) & (F.col(time) >= F.col("_start")) & (F.col(time) < F.col("_end")), "left_anti").drop("_day")
