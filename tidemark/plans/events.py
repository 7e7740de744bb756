"""Queries over the event stream: state, velocity, history, windows and the impact scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import asof, signals, state
from tidemark.plans.common import Registry, table

R = Registry()

_SCORE = "greatest(-1.0, least(1.0, value / 50 - 1))"
_NOW = "TIMESTAMP '2024-02-15 00:00:00'"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: users are entities, clicks and views are social, the rest news."""
    kind = F.when(F.col("event_type").isin("click", "view"), "social").otherwise("news")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("entity"), kind.alias("kind"), (F.col("value") / 50 - 1).alias("score"), F.lit(1.0).alias("weight"), F.col("ts").cast("timestamp").alias("at"), "event_type", "value")


@R.add(f"""WITH o AS (SELECT user_id AS entity, CASE WHEN event_type IN ('click', 'view') THEN 'social' ELSE 'news' END AS kind, {_SCORE} AS s, pow(0.5, greatest(0, (epoch_us({_NOW}) - epoch_us(ts)) / 3.6e9) / CASE WHEN event_type IN ('click', 'view') THEN 12.0 ELSE 36.0 END) AS w FROM events),
k AS (SELECT entity, kind, sum(w) AS w, sum(w * s) AS ws FROM o GROUP BY ALL),
e AS (SELECT entity, sum(CASE kind WHEN 'news' THEN 1.0 ELSE 0.35 END * w) AS ww, sum(CASE kind WHEN 'news' THEN 1.0 ELSE 0.35 END * ws) AS wws, max(CASE WHEN kind = 'news' AND w > 0.05 THEN ws / (w + 1) END) AS n, max(CASE WHEN kind = 'social' AND w > 0.05 THEN ws / (w + 1) END) AS s FROM k GROUP BY entity)
SELECT entity, round(ww, 6) AS evidence, round(wws / (ww + 2), 6) AS sentiment, round(0.5 / sqrt(ww + 2), 6) AS uncertainty, round(n, 6) AS news_sentiment, round(s, 6) AS social_sentiment, round(s - n, 6) AS divergence FROM e""")
def decayed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.decayed_state(observations(spark, sf_dir), F.expr(_NOW), {"news": 36.0, "social": 12.0}, {"news": 1.0, "social": 0.35})


@R.add("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS last_hour FROM events")
def velocity_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select("event_id", "entity", "at")
    return state.trailing_count(rows, ["entity"], "at", 3600, "last_hour").select("event_id", "last_hour")


@R.add("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@R.add("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def change_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.changes(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


@R.add("SELECT user_id, max_by(event_id, (abs(value - 50), event_id)) AS event_id, round(max(abs(value - 50)), 6) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20 GROUP BY user_id".replace("max_by(event_id, (abs(value - 50), event_id))", "arg_max(event_id, struct_pack(a := abs(value - 50), b := event_id))"))
def top_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = state.first_n(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20)
    strength = F.abs(F.col("value") - 50)
    return recent.groupBy("user_id").agg(F.max_by("event_id", F.struct(strength.alias("s"), "event_id")).alias("event_id"), F.round(F.max(strength), 6).alias("strength"))


@R.add("SELECT time_bucket(INTERVAL '15 minutes', ts) AS slot, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.window("at", "15 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("slot"), "event_type", "n", "total")


@R.add("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return rows.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


@R.add("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (value < 10) AS noise FROM events GROUP BY event_type")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") < 10).alias("noise"))


@R.add("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM (VALUES (TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-08'), (TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-21 12:00:00')) w(a, b) WHERE e.ts >= a AND e.ts < b)")
def outside_blackouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-08'), (TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-21 12:00:00') AS w(start, end)")
    return asof.outside(table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at")), windows, "at", "start", "end").select("event_id")


@R.add("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS up, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS down FROM events) WHERE up <= 4 OR down <= 8")
def kept_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    rows = table(spark, sf_dir, "events").withColumns({"up": F.row_number().over(w.orderBy("ts", "event_id")), "down": F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id")))})
    return rows.where("up <= 4 or down <= 8").select("user_id", "event_id", "value")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one user as a cluster with the columns of the scorecard."""
    rows = table(spark, sf_dir, "events")
    n = lambda c: F.count_if(c)
    v = F.col("value")
    return rows.groupBy("user_id").agg(
        F.lit(4.0).alias("base"), (F.avg(v) / 100).alias("confidence"), (F.avg(v) / 50 - 1).alias("sentiment"), F.count("*").alias("n_scored"), F.count_distinct("event_type").alias("n_stories"),
        n(F.col("event_type") == "purchase").alias("n_news"), n(F.hour("ts") < 6).alias("stories_last_hour"), n(v > 95).alias("extreme_docs"), n(v > 80).alias("high_docs"), n(v < 5).alias("scale_docs"),
        F.count_distinct(F.day("ts") % 5).alias("n_sectors"), F.count_distinct(F.hour("ts") % 3).alias("n_regions"), n(F.col("event_type").isin("click", "signup")).alias("market_docs"),
    )


_CLUSTERS = """SELECT user_id, 4.0::DOUBLE AS base, avg(value) / 100 AS confidence, avg(value) / 50 - 1 AS sentiment, count(*) AS n_scored, count(DISTINCT event_type) AS n_stories, count(*) FILTER (event_type = 'purchase') AS n_news, count(*) FILTER (hour(ts) < 6) AS stories_last_hour,
 count(*) FILTER (value > 95) AS extreme_docs, count(*) FILTER (value > 80) AS high_docs, count(*) FILTER (value < 5) AS scale_docs, count(DISTINCT day(ts) % 5) AS n_sectors, count(DISTINCT hour(ts) % 3) AS n_regions, count(*) FILTER (event_type IN ('click', 'signup')) AS market_docs FROM events GROUP BY user_id"""


@R.add(f"""WITH c AS ({_CLUSTERS}),
p AS (SELECT *, least(1.5, (CASE WHEN extreme_docs > 0 THEN 1.0 * (CASE WHEN extreme_docs / n_scored >= 0.2 OR n_scored <= 3 THEN 1.0 ELSE 0.5 END) WHEN high_docs > 0 THEN 0.5 * (CASE WHEN high_docs / n_scored >= 0.2 OR n_scored <= 3 THEN 1.0 ELSE 0.5 END) ELSE 0 END)
   + 0.3 * (CASE WHEN scale_docs = 0 THEN 0 WHEN scale_docs / n_scored >= 0.2 OR n_scored <= 3 THEN 1.0 ELSE 0.5 END) + CASE WHEN abs(sentiment) >= 0.6 THEN 0.3 ELSE 0 END) AS intensity,
  CASE WHEN n_stories > 2 THEN least(2.0, 0.5 * log2(n_stories / 2)) ELSE 0 END AS corroboration, CASE WHEN stories_last_hour >= 40 THEN 1.0 WHEN stories_last_hour >= 15 THEN 0.5 WHEN stories_last_hour >= 5 THEN 0.25 ELSE 0 END AS velocity,
  least(0.75, CASE WHEN n_sectors >= 3 THEN 0.5 ELSE 0 END + CASE WHEN n_regions >= 2 THEN 0.25 ELSE 0 END) AS breadth,
  CASE WHEN market_docs / n_scored >= 0.25 OR market_docs >= 25 THEN 0.5 WHEN market_docs / n_scored < 0.1 AND market_docs < 5 THEN -1.0 ELSE 0 END AS market,
  CASE WHEN n_news = 0 OR n_stories = 1 THEN -1.0 WHEN n_stories = 2 THEN -0.5 ELSE 0 END AS cred, CASE WHEN confidence < 0.5 THEN -0.5 ELSE 0 END AS cert FROM c)
SELECT user_id, round(greatest(1.0, least(10.0, base + intensity + corroboration + velocity + breadth + market + cred + cert)), 6) AS impact,
 (1 + (intensity <> 0)::INT + (corroboration <> 0)::INT + (velocity <> 0)::INT + (breadth <> 0)::INT + (market <> 0)::INT + (cred <> 0)::INT + (cert <> 0)::INT)::INT AS n_factors FROM p""")
def impact_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clusters(spark, sf_dir).withColumn("i", signals.impact())
    return rows.select("user_id", F.round("i.score", 6).alias("impact"), F.size("i.factors").alias("n_factors"))


_DAILY = "SELECT user_id, date_trunc('day', ts)::DATE AS day, round(avg(value) / 25, 6) AS score FROM events GROUP BY ALL"


@R.add(f"""WITH RECURSIVE d AS ({_DAILY}), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM d),
f AS (SELECT user_id, i, day, score, CASE WHEN score >= 3 THEN 2 WHEN score >= 1.5 THEN 1 ELSE 0 END AS s FROM n WHERE i = 1
 UNION ALL SELECT n.user_id, n.i, n.day, n.score, CASE WHEN n.score >= 3 OR (f.s = 2 AND n.score >= 2.5) THEN 2 WHEN n.score >= 1.5 OR (f.s > 0 AND n.score >= 1.0) THEN 1 ELSE 0 END FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
SELECT user_id, day, score, CASE s WHEN 2 THEN 'Watch Negative' WHEN 1 THEN 'Monitor' END AS status FROM f""")
def watch_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.avg("value") / 25, 6).alias("score"))
    return signals.watch_status(daily, "user_id", "day", "score")


@R.add("""WITH RECURSIVE d AS (%s), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM d),
f AS (SELECT user_id, i, day, CASE WHEN score >= 3 THEN 2 WHEN score >= 1.5 THEN 1 ELSE 0 END AS s FROM n WHERE i = 1
 UNION ALL SELECT n.user_id, n.i, n.day, CASE WHEN n.score >= 3 OR (f.s = 2 AND n.score >= 2.5) THEN 2 WHEN n.score >= 1.5 OR (f.s > 0 AND n.score >= 1.0) THEN 1 ELSE 0 END FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
SELECT user_id, CASE s WHEN 2 THEN 'Watch Negative' ELSE 'Monitor' END AS status, min(day) AS first_day FROM f WHERE s > 0 GROUP BY ALL""" % _DAILY)
def first_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch_hysteresis(spark, sf_dir).where("status is not null").groupBy("user_id", "status").agg(F.min("day").alias("first_day"))


@R.add()
def stress_situations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.monitors import situations

    keys = F.when(F.col("value") < 95, F.array(F.concat(F.lit("K"), (F.col("user_id") % 7).cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "events").select("event_type", F.col("user_id").cast("string").alias("event_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("value") / 10).alias("impact"), F.col("value").cast("int").alias("reports"), keys.alias("keys"))
    return situations(rows)


@R.add()
def index_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.monitors import trades

    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("index_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("user_id").cast("string").alias("ticker"), (F.col("value") / 50 - 1).alias("sentiment"), F.lit(2.0).alias("evidence"), (F.col("value") / 10).alias("impact"), F.col("event_id").cast("string").alias("event_id"))
    return trades(rows)


@R.add("""WITH RECURSIVE d AS (%s), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM d),
f AS (SELECT user_id, i, day, CASE WHEN score >= 3 THEN 2 WHEN score >= 1.5 THEN 1 ELSE 0 END AS s FROM n WHERE i = 1
 UNION ALL SELECT n.user_id, n.i, n.day, CASE WHEN n.score >= 3 OR (f.s = 2 AND n.score >= 2.5) THEN 2 WHEN n.score >= 1.5 OR (f.s > 0 AND n.score >= 1.0) THEN 1 ELSE 0 END FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1),
first_ AS (SELECT user_id, min(day) AS flagged FROM f WHERE s = 2 GROUP BY user_id), act AS (SELECT user_id, min(ts)::DATE AS acted FROM events WHERE event_type = 'purchase' AND value > 90 GROUP BY user_id)
SELECT user_id, acted, flagged, datediff('day', flagged, acted) AS lead_days FROM act LEFT JOIN first_ USING (user_id)""" % _DAILY)
def lead_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = first_flags(spark, sf_dir).where("status = 'Watch Negative'").select("user_id", F.col("first_day").alias("flagged"))
    acted = table(spark, sf_dir, "events").where("event_type = 'purchase' and value > 90").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("acted"))
    return acted.join(flags, "user_id", "left").select("user_id", "acted", "flagged", F.datediff("acted", "flagged").cast("long").alias("lead_days"))


@R.add("""WITH RECURSIVE d AS (%s), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM d),
f AS (SELECT user_id, i, day, CASE WHEN score >= 3 THEN 2 WHEN score >= 1.5 THEN 1 ELSE 0 END AS s FROM n WHERE i = 1
 UNION ALL SELECT n.user_id, n.i, n.day, CASE WHEN n.score >= 3 OR (f.s = 2 AND n.score >= 2.5) THEN 2 WHEN n.score >= 1.5 OR (f.s > 0 AND n.score >= 1.0) THEN 1 ELSE 0 END FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1),
own AS (SELECT user_id, min(day) AS flagged FROM f WHERE s = 2 GROUP BY user_id), act AS (SELECT user_id, min(ts)::DATE AS acted FROM events WHERE event_type = 'signup' AND value > 60 GROUP BY user_id),
home AS (SELECT c_nationkey, min(flagged) AS flagged FROM own JOIN customer ON c_custkey = user_id GROUP BY c_nationkey)
SELECT user_id, acted, coalesce(own.flagged, home.flagged) AS flagged, CASE WHEN own.flagged IS NOT NULL THEN 'own' WHEN home.flagged IS NOT NULL THEN 'country' END AS by_, datediff('day', coalesce(own.flagged, home.flagged), acted) AS lead_days,
 coalesce(own.flagged, home.flagged) < acted AS ahead FROM act LEFT JOIN own USING (user_id) LEFT JOIN customer ON c_custkey = user_id LEFT JOIN home USING (c_nationkey)""" % _DAILY)
def lead_times_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long before an action its name was flagged, or where it never was, the first name of its country; and whether that was ahead of it."""
    flags = first_flags(spark, sf_dir).where("status = 'Watch Negative'").select("user_id", F.col("first_day").alias("own"))
    country = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    home = flags.join(country, "user_id").groupBy("c_nationkey").agg(F.min("own").alias("home"))
    acted = table(spark, sf_dir, "events").where("event_type = 'signup' and value > 60").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("acted"))
    rows = acted.join(flags, "user_id", "left").join(country, "user_id", "left").join(home, "c_nationkey", "left").withColumn("flagged", F.coalesce("own", "home"))
    by = F.when(F.col("own").isNotNull(), "own").when(F.col("home").isNotNull(), "country")
    return rows.select("user_id", "acted", "flagged", by.alias("by_"), F.datediff("acted", "flagged").cast("long").alias("lead_days"), (F.col("flagged") < F.col("acted")).alias("ahead"))
