"""Queries over price panels made from orders: as-of joins, returns, signal statistics, the tilted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import beta_sql, softmax, t_tails
from tidemark.operators import asof, panel, tilt
from tidemark.plans.common import Registry, table

R = Registry()

_PRICES = "SELECT o_orderpriority AS ticker, o_orderdate::DATE AS day, round(avg(o_totalprice), 6) AS px, count(*) AS n FROM orders GROUP BY ALL"
_SIGNALS = "SELECT ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][(user_id % 5 + 1)::INT] AS ticker, ts::DATE AS day, round(avg(value) / 50 - 1, 6) AS s, count(*) AS volume, round(max(value), 6) AS top FROM events GROUP BY ALL"


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-tickers: orders averaged by priority and day."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice"), 6).alias("px"), F.count("*").alias("n"))


def daily_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of pseudo-tickers: events averaged by user group and day."""
    names = F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]))
    return table(spark, sf_dir, "events").groupBy(F.element_at(names, (F.col("user_id") % 5 + 1).cast("int")).alias("ticker"), F.to_date("ts").alias("day")).agg(F.round(F.avg("value") / 50 - 1, 6).alias("s"), F.count("*").alias("volume"), F.round(F.max("value"), 6).alias("top"))


@R.add("""WITH p AS (SELECT o_custkey AS c, o_orderdate AS at, max(o_totalprice) AS px FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT o_orderkey, px FROM (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus <> 'F') t ASOF LEFT JOIN p ON t.o_custkey = p.c AND t.o_orderdate >= p.at""")
def asof_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "c", "o_orderdate": "at"})
    quotes = orders.where("o_orderstatus = 'F'").select("c", "at", F.col("o_totalprice").alias("px"))
    return asof.asof_join(orders.where("o_orderstatus <> 'F'").select("o_orderkey", "c", "at"), quotes, ["c"], "at", ["px"]).select("o_orderkey", "px")


@R.add("""WITH p AS (SELECT o_custkey AS c, o_orderdate AS seen, max(o_totalprice) AS px FROM orders GROUP BY ALL)
SELECT o_orderkey, CASE WHEN seen >= o_orderdate - INTERVAL 90 DAY THEN px END AS px FROM orders t ASOF LEFT JOIN p ON t.o_custkey = p.c AND t.o_orderdate > p.seen""")
def asof_before_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "c", "o_orderdate": "at"})
    return asof.asof_join(orders.select("o_orderkey", "c", "at"), orders.select("c", "at", F.col("o_totalprice").alias("px")), ["c"], "at", ["px"], strict=True, tolerance="interval 90 days").select("o_orderkey", "px")


@R.add(f"""WITH p AS ({_PRICES}), m AS (SELECT day, avg(px) AS idx FROM p GROUP BY day),
r AS (SELECT ticker, day, px, idx, lag(px) OVER w AS pb, lead(px) OVER w AS pa, lag(idx) OVER w AS ib, lead(idx) OVER w AS ia FROM p JOIN m USING (day) WINDOW w AS (PARTITION BY ticker ORDER BY day))
SELECT ticker, day, round(px / pb - 1, 6) AS ret_prev, round(pa / px - 1, 6) AS ret_next, round(pa / pb - 1, 6) AS ret_around, round((pa / pb - 1) - (ia / ib - 1), 6) AS abnormal FROM r""")
def returns_abnormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prices(spark, sf_dir)
    rows = p.join(p.groupBy("day").agg(F.avg("px").alias("idx")), "day")
    rows = panel.returns(panel.returns(rows, "ticker", "day", "idx").withColumnRenamed("ret_around", "market").drop("ret_prev", "ret_next"), "ticker", "day", "px")
    return rows.select("ticker", "day", *[F.round(c, 6).alias(c) for c in ("ret_prev", "ret_next", "ret_around")], F.round(F.col("ret_around") - F.col("market"), 6).alias("abnormal"))


@R.add(f"""WITH p AS ({_PRICES}), s AS ({_SIGNALS}) SELECT coalesce(p.ticker, s.ticker) AS ticker, coalesce(p.day, s.day) AS day, px, s, coalesce(volume, 0) AS volume FROM p FULL JOIN s ON p.ticker = s.ticker AND p.day = s.day""")
def outer_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices(spark, sf_dir).drop("n").join(daily_signals(spark, sf_dir).select("ticker", "day", "s", "volume"), ["ticker", "day"], "full_outer").na.fill(0, ["volume"]).select("ticker", "day", "px", "s", "volume")


@R.add(f"""WITH s AS ({_SIGNALS}), g AS (SELECT ticker, day FROM (SELECT DISTINCT ticker FROM s), (SELECT DISTINCT day FROM s)) SELECT g.ticker, g.day, coalesce(s, 0) AS s, coalesce(volume, 0) AS volume FROM g LEFT JOIN s USING (ticker, day)""")
def filled_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = daily_signals(spark, sf_dir)
    grid = panel.grid(s, "ticker", "day")
    return grid.join(s, ["ticker", "day"], "left").select("ticker", "day", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("volume", F.lit(0)).alias("volume"))


@R.add(f"WITH s AS ({_SIGNALS}) SELECT day, round(sum(s * volume) / sum(volume), 6) AS tone, round(avg(s), 6) AS plain, sum(volume)::BIGINT AS volume FROM s GROUP BY day")
def weighted_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's tone, tickers weighted by how much is said of them."""
    return daily_signals(spark, sf_dir).groupBy("day").agg(F.round(F.try_divide(F.sum(F.col("s") * F.col("volume")), F.sum("volume")), 6).alias("tone"), F.round(F.avg("s"), 6).alias("plain"), F.sum("volume").alias("volume"))


_BUCKET = "CASE WHEN top < 20 THEN 1 WHEN top < 40 THEN 2 WHEN top < 60 THEN 3 WHEN top < 80 THEN 4 WHEN top < 95 THEN 5 ELSE 6 END"


@R.add(f"""WITH s AS ({_SIGNALS}) SELECT {_BUCKET} AS bucket, count(*) AS n, round(avg(s), 6) AS mean_s, round(median(s), 6) AS median_s, round(avg((s > 0)::INT), 6) AS share_up, round(quantile_cont(s, 0.9), 6) AS top_decile FROM s GROUP BY 1""")
def impact_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("top")
    bucket = F.when(t < 20, 1).when(t < 40, 2).when(t < 60, 3).when(t < 80, 4).when(t < 95, 5).otherwise(6)
    r = lambda c: F.round(c, 6)
    return daily_signals(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), r(F.avg("s")).alias("mean_s"), r(F.median("s")).alias("median_s"), r(F.avg((F.col("s") > 0).cast("int"))).alias("share_up"), r(F.percentile("s", F.lit(0.9))).alias("top_decile"))


@R.add(f"""WITH s AS ({_SIGNALS}), r AS (SELECT ticker, rank() OVER (PARTITION BY ticker ORDER BY s) + (count(*) OVER (PARTITION BY ticker, s) - 1) / 2 AS a, rank() OVER (PARTITION BY ticker ORDER BY volume) + (count(*) OVER (PARTITION BY ticker, volume) - 1) / 2 AS b FROM s)
SELECT ticker, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY ticker""")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.spearman(daily_signals(spark, sf_dir), ["ticker"], "s", "volume").withColumn("rho", F.round("rho", 6))


@R.add(f"""WITH s AS ({_SIGNALS}), f AS (SELECT *, lead(s) OVER (PARTITION BY ticker ORDER BY day) - s AS move FROM s), g AS (SELECT * FROM f WHERE move IS NOT NULL),
r AS (SELECT day, rank() OVER (PARTITION BY day ORDER BY s) + (count(*) OVER (PARTITION BY day, s) - 1) / 2 AS a, rank() OVER (PARTITION BY day ORDER BY move) + (count(*) OVER (PARTITION BY day, move) - 1) / 2 AS b FROM g),
d AS (SELECT day, corr(a, b) AS ic FROM r GROUP BY day HAVING count(*) >= 5)
SELECT round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / stddev_samp(ic) * sqrt(count(*)), 5) AS t_stat, count(*) AS days, round(avg((ic > 0)::INT), 6) AS share_positive FROM d""")
def information_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    move = F.lead("s").over(Window.partitionBy("ticker").orderBy("day")) - F.col("s")
    daily = panel.spearman(daily_signals(spark, sf_dir).withColumn("move", move), ["day"], "s", "move", least=5, name="ic")
    ic = F.col("ic")
    return daily.agg(F.round(F.avg(ic), 6).alias("mean_ic"), F.round(F.stddev_samp(ic), 6).alias("ic_std"), F.round(F.avg(ic) / F.stddev_samp(ic) * F.sqrt(F.count("*")), 5).alias("t_stat"), F.count("*").alias("days"), F.round(F.avg((ic > 0).cast("int")), 6).alias("share_positive"))


@R.add()
def ols_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.ols_hc1(daily_signals(spark, sf_dir).withColumn("log_volume", F.log1p("volume")), "s", ["log_volume", "top"])


_MEASURES = ("top", "volume", "tone")


@R.add(f"""WITH s AS (SELECT top, volume, -s AS tone, abs(s) AS size FROM ({_SIGNALS})), e AS (SELECT unnest({list(_MEASURES)}) AS measure, unnest([top::DOUBLE, volume::DOUBLE, tone::DOUBLE]) AS m, size FROM s),
r AS (SELECT measure, rank() OVER (PARTITION BY measure ORDER BY m) + (count(*) OVER (PARTITION BY measure, m) - 1) / 2 AS a, rank() OVER (PARTITION BY measure ORDER BY size) + (count(*) OVER (PARTITION BY measure, size) - 1) / 2 AS b FROM e),
c AS (SELECT measure, corr(a, b) AS rho, count(*) AS n FROM r GROUP BY measure), k AS (SELECT measure, quantile_cont(m, 0.9) AS cut, avg(size) AS everywhere FROM e GROUP BY measure),
t AS (SELECT measure, avg(size) AS top_mean, avg(size) / first(everywhere) AS lift FROM e JOIN k USING (measure) WHERE m >= cut GROUP BY measure)
SELECT measure, round(rho, 6) AS rho, round({beta_sql("(1 - rho * rho)", "((n - 2) / 2e0)", "0.5e0")}, 9) AS p_value, n, round(top_mean, 6) AS top_mean, round(lift, 6) AS lift FROM c JOIN t USING (measure)""")
def rank_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what is said of a day goes with how large its signal is, and by how much more where most is said."""
    rows = daily_signals(spark, sf_dir).select("top", "volume", (-F.col("s")).alias("tone"), F.abs("s").alias("size"))
    found = panel.significance(rows, list(_MEASURES), "size")
    return found.select("measure", F.round("rho", 6).alias("rho"), F.round("p_value", 9).alias("p_value"), "n", F.round("top_mean", 6).alias("top_mean"), F.round("lift", 6).alias("lift"))


@R.add()
def ols_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust least squares of a signal's size on standardised measures, with p-values."""
    rows = daily_signals(spark, sf_dir).select(F.col("top").cast("double").alias("top"), F.log1p("volume").alias("log_volume"), (-F.col("s")).alias("tone"), F.abs("s").alias("size"))
    names = ["top", "log_volume", "tone"]
    found = panel.ols_hc1(panel.standardised(rows, names), "size", names)
    return found.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n")))).withColumn("p_value", F.round(t_tails(F.col("t"), F.col("n") - len(names) - 1), 9))  # one row


@R.add(f"""WITH s AS ({_SIGNALS}), f AS (SELECT *, lead(s) OVER (PARTITION BY ticker ORDER BY day) - s AS move FROM s), g AS (SELECT * FROM f WHERE move IS NOT NULL),
r AS (SELECT day, rank() OVER (PARTITION BY day ORDER BY s) + (count(*) OVER (PARTITION BY day, s) - 1) / 2 AS a, rank() OVER (PARTITION BY day ORDER BY move) + (count(*) OVER (PARTITION BY day, move) - 1) / 2 AS b FROM g),
d AS (SELECT day, corr(a, b) AS ic FROM r GROUP BY day HAVING count(*) >= 5), x AS (SELECT avg(ic) / stddev_samp(ic) * sqrt(count(*)) AS t, count(*) AS days FROM d)
SELECT days, round(t, 5) AS t_stat, CASE WHEN days > 1 THEN round({beta_sql("((days - 1) / (days - 1 + t * t))", "((days - 1) / 2e0)", "0.5e0")}, 9) END AS p_value FROM x""")
def ic_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the information coefficient's mean is likely by chance."""
    from pyspark.sql import Window

    move = F.lead("s").over(Window.partitionBy("ticker").orderBy("day")) - F.col("s")
    daily = panel.spearman(daily_signals(spark, sf_dir).withColumn("move", move), ["day"], "s", "move", least=5, name="ic")
    found = daily.agg(F.count("*").alias("days"), (F.avg("ic") / F.stddev_samp("ic") * F.sqrt(F.count("*"))).alias("t"))
    return found.select("days", F.round("t", 5).alias("t_stat"), F.when(F.col("days") > 1, F.round(t_tails(F.col("t"), F.col("days") - 1), 9)).alias("p_value"))


_PANEL = f"""SELECT day AS date, ticker, CASE WHEN ticker < '3' THEN 'fast' ELSE 'slow' END AS sector, 0.2 AS parent, s AS sentiment FROM ({_SIGNALS})"""


def index_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_signals(spark, sf_dir).select(F.col("day").alias("date"), "ticker", F.when(F.col("ticker") < "3", "fast").otherwise("slow").alias("sector"), F.lit(0.2).alias("parent"), F.col("s").alias("sentiment"))


@R.add(f"SELECT date, ticker, round(exp(2 * greatest(-1, least(1, sentiment))) / sum(exp(2 * greatest(-1, least(1, sentiment)))) OVER (PARTITION BY date), 6) AS weight FROM ({_PANEL})")
def tilt_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tilt.tilted(index_panel(spark, sf_dir)).select("date", "ticker", F.round("weight", 6).alias("weight"))


_WIDE = tilt.TiltConfig(max_weight=0.5)


@R.add()
def bounded_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tilt.targets(filled_index(spark, sf_dir), _WIDE)


def filled_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_grid(spark, sf_dir).select(F.col("day").alias("date"), "ticker", F.when(F.col("ticker") < "3", "fast").otherwise("slow").alias("sector"), F.lit(0.2).alias("parent"), F.col("s").alias("sentiment"))


@R.add()
def index_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rets = filled_grid(spark, sf_dir).select(F.col("day").alias("date"), "ticker", F.coalesce((F.lead("s").over(Window.partitionBy("ticker").orderBy("day")) - F.col("s")) / 50, F.lit(0.0)).alias("ret"))
    goals = bounded_weights(spark, sf_dir).withColumn("strategy", F.lit("tilted"))
    flat = goals.select(F.lit("equal").alias("strategy"), "date", "ticker", F.lit(0.2).alias("target"))
    return tilt.backtest(goals.select("strategy", "date", "ticker", "target").unionByName(flat), rets, _WIDE)


@R.add("""WITH d AS (SELECT event_type AS strategy, ts::DATE AS day, round(avg(value) / 1000 - 0.05, 8) AS ret FROM events GROUP BY ALL), b AS (SELECT day, round(avg(ret), 8) AS bench FROM d GROUP BY day), j AS (SELECT * FROM d JOIN b USING (day)),
l AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY day)) AS level FROM j), p AS (SELECT *, max(level) OVER (PARTITION BY strategy ORDER BY day) AS peak FROM l)
SELECT strategy, round(exp(sum(ln(1 + ret)) * 252 / count(*)) - 1, 5) AS annual_return, round(stddev_samp(ret) * sqrt(252), 5) AS annual_volatility, round(avg(ret) / stddev_samp(ret) * sqrt(252), 5) AS sharpe, round(min(level / peak - 1), 5) AS max_drawdown,
 round(stddev_samp(ret - bench) * sqrt(252), 5) AS tracking_error, round(avg((ret > bench)::INT), 5) AS days_ahead FROM p GROUP BY strategy""")
def strategy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("strategy"), F.to_date("ts").alias("day")).agg(F.round(F.avg("value") / 1000 - 0.05, 8).alias("ret"))
    rows = d.join(d.groupBy("day").agg(F.round(F.avg("ret"), 8).alias("bench")), "day")
    m = panel.strategy_metrics(rows, ["strategy"], "day", "ret", "bench")
    return m.select("strategy", *[F.round(c, 5).alias(c) for c in ("annual_return", "annual_volatility", "sharpe", "max_drawdown", "tracking_error", "days_ahead")])


@R.add("""WITH l AS (SELECT label % 3 AS y, list_transform([0, 1, 2], lambda k: 4 * list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN (i - 1) % 3 = k THEN embedding[i]::DOUBLE ELSE 0 END))) AS z FROM embeddings), g AS (SELECT unnest([0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 6.0, 8.0]) AS temperature),
p AS (SELECT temperature, exp((z[(y + 1)::INT] - list_max(z)) / temperature) / list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / temperature))) AS p FROM l, g), n AS (SELECT temperature, round(-avg(ln(greatest(p, 1e-12))), 6) AS nll FROM p GROUP BY temperature)
SELECT temperature, nll, row_number() OVER (ORDER BY nll, temperature) = 1 AS best FROM n""")
def temperature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well softened logits, each a sum over every third component, fit the labels, and which temperature is best."""
    from pyspark.sql import Window

    temperatures = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 6.0, 8.0)
    logit = lambda k: 4 * F.aggregate(F.transform("embedding", lambda x, i: F.when(i % 3 == k, x.cast("double")).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") % 3 + 1).cast("int").alias("y"), F.array(*[logit(k) for k in range(3)]).alias("z"))
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("temperature"), F.element_at(softmax(F.col("z"), t), F.col("y")).alias("p")) for t in temperatures]))
    fit = rows.select(each.alias("e")).groupBy(F.col("e.temperature").alias("temperature")).agg(F.round(-F.avg(F.log(F.greatest("e.p", F.lit(1e-12)))), 6).alias("nll"))
    return fit.withColumn("best", F.row_number().over(Window.orderBy("nll", "temperature")) == 1)  # a row for each temperature


@R.add("""WITH h AS (SELECT vec_id, list_transform(range(0, 4), lambda j: greatest(0, list_sum(list_transform(range(0, len(embedding)), lambda i: embedding[i + 1]::DOUBLE * (((i * 7 + j * 3) % 11) - 5) / 10)) + 0.1 * j)) AS h FROM embeddings),
o AS (SELECT vec_id, list_transform(range(0, 3), lambda k: (list_sum(list_transform(range(0, 4), lambda j: h[j + 1] * (((j * 5 + k * 2) % 7) - 3) / 2)) + 0.2 * k) / 1.5) AS o FROM h)
SELECT vec_id, round(exp(o[1]) / (exp(o[1]) + exp(o[2]) + exp(o[3])), 6) AS p0, round(exp(o[2]) / (exp(o[1]) + exp(o[2]) + exp(o[3])), 6) AS p1, round(exp(o[3]) / (exp(o[1]) + exp(o[2]) + exp(o[3])), 6) AS p2 FROM o""")
def hidden_layer_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A head with one hidden layer, its weights made by a rule, over all embeddings."""
    import numpy as np

    from tidemark.operators.models import mlp

    first = np.fromfunction(lambda i, j: ((i * 7 + j * 3) % 11 - 5) / 10, (64, 4))
    second = np.fromfunction(lambda j, k: ((j * 5 + k * 2) % 7 - 3) / 2, (4, 3))
    head = mlp([first, second], [0.1 * np.arange(4), 0.2 * np.arange(3)], 1.5)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", head(F.col("embedding").cast("array<double>")).alias("p"))
    return rows.select("vec_id", *[F.round(F.get("p", F.lit(k)), 6).alias(f"p{k}") for k in range(3)])


@R.add(f"""WITH p AS ({_PRICES}), s AS ({_SIGNALS}), r AS (SELECT ticker, day, lead(px) OVER w / lag(px) OVER w - 1 AS ret FROM p WINDOW w AS (PARTITION BY ticker ORDER BY day)),
j AS (SELECT s, ret FROM (SELECT ticker, day, s FROM s WHERE s <> 0) s ASOF JOIN r ON s.ticker = r.ticker AND s.day >= r.day WHERE ret IS NOT NULL)
SELECT count(*) AS n, count(*) FILTER (s > 0) AS up, round(avg(((ret > 0) = (s > 0))::INT), 6) AS agreement, count(*) FILTER (abs(ret) >= 0.03) AS big, round(avg(((ret > 0) = (s > 0))::INT) FILTER (abs(ret) >= 0.03), 6) AS big_agreement, round(greatest(avg((ret > 0)::INT), avg((ret <= 0)::INT)), 6) AS majority FROM j""")
def direction_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the signal's direction is that of the last price move, in all and among large moves, beside always saying the more common one."""
    r = panel.returns(prices(spark, sf_dir), "ticker", "day", "px").select("ticker", "day", F.col("ret_around").alias("ret"))
    said = daily_signals(spark, sf_dir).where("s <> 0").select("ticker", "day", "s")
    j = asof.asof_join(said, r, ["ticker"], "day", ["ret"]).where("ret is not null")
    same, large = ((F.col("ret") > 0) == (F.col("s") > 0)).cast("int"), F.abs("ret") >= 0.03
    up = F.avg((F.col("ret") > 0).cast("int"))
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("s") > 0).alias("up"), F.round(F.avg(same), 6).alias("agreement"), F.count_if(large).alias("big"), F.round(F.avg(F.when(large, same)), 6).alias("big_agreement"), F.round(F.greatest(up, 1 - up), 6).alias("majority"))


@R.add(f"SELECT day, " + ", ".join(f"max(px) FILTER (ticker LIKE '{i}-%') AS t{i}" for i in range(1, 6)) + f" FROM ({_PRICES}) GROUP BY day")
def wide_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prices(spark, sf_dir).withColumn("t", F.concat(F.lit("t"), F.substring("ticker", 1, 1)))
    return rows.groupBy("day").pivot("t", [f"t{i}" for i in range(1, 6)]).agg(F.max("px"))


# Episodes of this repository's own.
_EPISODES = [("a", "1995-03-01", "1995-06-15"), ("b", "1996-09-10", "1997-01-20"), ("c", "1998-08-01", "1998-10-10")]
_EPISODE_SQL = "(VALUES " + ", ".join(f"('{i}', DATE '{s}', DATE '{e}')" for i, s, e in _EPISODES) + ") e(episode, start_, end_)"


@R.add(f"""WITH p AS ({_PRICES}), g AS (SELECT episode, start_, end_, ticker FROM {_EPISODE_SQL}, (SELECT DISTINCT ticker FROM p)),
s AS (SELECT g.*, CASE WHEN p.day >= start_ - 5 THEN p.px END AS a FROM g ASOF LEFT JOIN p ON g.ticker = p.ticker AND g.start_ >= p.day),
b AS (SELECT s.episode, s.ticker, s.a, CASE WHEN p.day >= s.end_ - 5 THEN p.px END AS b FROM s ASOF LEFT JOIN p ON s.ticker = p.ticker AND s.end_ >= p.day)
SELECT episode, ticker, round((b / a - 1) * 100, 4) AS pct, round(b - a, 4) AS pts FROM b""")
def analog_shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prices(spark, sf_dir).select("ticker", "day", "px")
    episodes = F.explode(F.array(*[F.struct(F.lit(i).alias("episode"), F.lit(s).cast("date").alias("start"), F.lit(e).cast("date").alias("end")) for i, s, e in _EPISODES]))
    rows = p.select("ticker").distinct().select("ticker", episodes.alias("e")).select("ticker", "e.*")
    rows = asof.asof_join(rows.withColumnRenamed("start", "day"), p, ["ticker"], "day", ["px"], tolerance="interval 5 days").withColumnRenamed("px", "a").drop("day")
    rows = asof.asof_join(rows.withColumnRenamed("end", "day"), p, ["ticker"], "day", ["px"], tolerance="interval 5 days").withColumnRenamed("px", "b")
    return rows.select("episode", "ticker", F.round((F.col("b") / F.col("a") - 1) * 100, 4).alias("pct"), F.round(F.col("b") - F.col("a"), 4).alias("pts"))


@R.add(f"""WITH p AS ({_PRICES}), s AS ({_SIGNALS}), o AS (SELECT coalesce(p.ticker, s.ticker) AS ticker, coalesce(p.day, s.day) AS day, px FROM p FULL JOIN s ON p.ticker = s.ticker AND p.day = s.day)
SELECT ticker, day, last_value(px IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY day) AS px FROM o""")
def filled_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ticker's price of every day that has a price or a signal: the last one known."""
    return asof.forward_fill(outer_daily(spark, sf_dir).select("ticker", "day", "px"), ["ticker"], "day", "px")


@R.add(f"""WITH p AS ({_PRICES}), s AS ({_SIGNALS}), k AS (SELECT DISTINCT CASE WHEN dayofmonth(day) % 7 < 5 THEN make_date(2024, 1, 1 + (dayofyear(day) % 31)::INT) END AS session FROM p), e AS (SELECT session FROM k WHERE session IS NOT NULL AND dayofmonth(session) % 7 <> 0),
j AS (SELECT s.*, (SELECT max(session) FROM e WHERE e.session <= s.day) AS session FROM s)
SELECT ticker, session, count(*) AS days, round(max(top), 6) AS top, sum(volume)::BIGINT AS volume, round(sum(s * volume) / sum(volume), 6) AS tone FROM j WHERE session IS NOT NULL GROUP BY ALL""")
def company_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of calendar days folded onto sessions: the highest top, all volume, and tone weighted by volume.  Sessions are the days of a month on which orders are found, closed days left out."""
    day = F.col("day")
    found = prices(spark, sf_dir).select(F.when(F.dayofmonth(day) % 7 < 5, F.make_date(F.lit(2024), F.lit(1), 1 + F.dayofyear(day) % 31)).alias("session")).where("session is not null").where(F.dayofmonth("session") % 7 != 0)
    rows = panel.on_sessions(daily_signals(spark, sf_dir), "day", found).where("session is not null")
    tone = F.sum(F.col("s") * F.col("volume")) / F.sum("volume")
    return rows.groupBy("ticker", "session").agg(F.count("*").alias("days"), F.round(F.max("top"), 6).alias("top"), F.sum("volume").alias("volume"), F.round(tone, 6).alias("tone"))
