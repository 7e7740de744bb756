"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.shared import checkpointed, shared_top


def components(links: DataFrame) -> DataFrame:
    """Rows (id, component) for every id in links (a, b): the smallest id that it is connected with.

    Alternates two steps until neither changes a link: every node tells its larger neighbours
    of the smallest node it knows, then its smaller ones.  Each step is one aggregation, which
    combines before it shuffles, and one join, which Spark splits where a node has very many
    links.  Null ends and loops link nothing; an empty table gives none.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = checkpointed(edges)
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = checkpointed(small.select("v", "m").where("v <> m").unionAll(low.select("u", "m")).toDF("u", "v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


__all__ = ["checkpointed", "components", "shared_top"]
