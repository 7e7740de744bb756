"""The watch list over time: every user of ``events`` is a name, held in the book where there is a customer of that number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import credit, watch_feed
from tidemark.plans.books import book
from tidemark.plans.common import Registry, table

R = Registry()

#: From which value on an error puts its user, and the users of the same nation, at the centre of a situation, and a purchase counts as a migration.
CENTRE, MIGRATION = 60.0, 60.0


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events as updates: all are opinions, errors and sign-ups are events too, and large values situations or migrations.  With them the situations of each nation, and whose they are."""
    nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("country"))
    rows = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", F.concat(F.lit("C"), "user_id").alias("entity"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("string").alias("id"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    value = F.col("value")
    tone = F.when(F.col("event_type") == "error", -F.least(F.lit(1.0), value / 40)).when(F.col("event_type") == "purchase", F.least(F.lit(1.0), value / 40)).when(F.col("k") % 2 == 0, 0.1).otherwise(-0.3)
    rows = rows.withColumn("said", tone)
    opinions = watch_feed.updates(rows, what=F.lit("opinion"), id=F.col("id"), kind=F.when(F.col("event_type") == "click", "social").otherwise("news"), tone=F.col("said"), weight=F.lit(1.0))
    news = rows.where(F.col("event_type").isin("error", "signup"))
    kind = F.when(F.col("event_type") == "error", "CREDIT_EVENT").otherwise("REGULATORY")
    news = watch_feed.updates(news, what=F.lit("event"), id=F.col("id"), event_type=kind, impact=F.least(F.lit(10.0), 5 + value / 10), focus=value >= 25, tone=F.col("said"))
    centres = rows.where((F.col("event_type") == "error") & (value >= CENTRE)).withColumn("impact", F.least(F.lit(10.0), 6 + value / 40))
    own = watch_feed.updates(centres, what=F.lit("situation"), id=F.col("id"), impact=F.col("impact"), focus=F.lit(True))
    moved = rows.where((F.col("event_type") == "purchase") & (value >= MIGRATION))
    moved = watch_feed.updates(moved, what=F.lit("migration"), id=F.col("id"), impact=F.col("k") % 5, focus=F.col("k") % 10 == 0)
    home = centres.join(nation, "user_id").select(F.col("country").alias("group"), "at", "impact", "id", F.col("entity").alias("hit"))
    members = rows.select("user_id", "entity").distinct().join(nation, "user_id").select("entity", F.col("country").alias("group"))
    return opinions.unionAll(news).unionAll(own).unionAll(moved), home, members


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of them as updates of each name, for a stream: a situation of a nation is one for each of its other names."""
    rows, home, members = parts(spark, sf_dir)
    others = home.join(members, "group").where("entity <> hit")
    return rows.unionAll(watch_feed.updates(others, what=F.lit("situation"), id=F.col("id"), impact=F.col("impact"), focus=F.lit(False)))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    until = table(spark, sf_dir, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    rows, home, members = parts(spark, sf_dir)
    return watch_feed.changes(rows, until or 0, shared=home, members=members)


@R.add()
def watch_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of status of every name up to the last event."""
    return feed(spark, sf_dir).withColumn("at", F.col("at").cast("timestamp_ntz"))


@R.add()
def watch_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names on the list after the last event, with what the book holds of them in millions, and when each was first flagged."""
    held = credit.exposures(book(spark, sf_dir)).select(F.col("obligor_id").alias("entity"), F.round(F.col("exposure") / 1e6, 1).alias("exposure"), F.round(F.col("protection") / 1e6, 1).alias("protection"), "rating")
    rows = watch_feed.listed(feed(spark, sf_dir)).join(held, "entity", "left").fillna(0.0, ["exposure", "protection"])
    naive = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("since", "first_monitor", "first_watch")]
    return rows.select("entity", "status", "score", *naive, "exposure", "protection", "rating").orderBy(F.desc(F.col("status") == "Watch Negative"), F.desc("score"), "entity")
