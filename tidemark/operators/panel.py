"""Price panels in long form, returns, and the statistics of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import rank_tails


def returns(panel: DataFrame, by: str, time: str, price: str) -> DataFrame:
    """With prev, day, next and around: the return up to, at and after each row, and over the three."""
    w = Window.partitionBy(by).orderBy(time)
    p, before, after = F.col(price), F.lag(price).over(w), F.lead(price).over(w)
    return panel.withColumns({"ret_prev": p / before - 1, "ret_next": after / p - 1, "ret_around": after / before - 1})


def average_rank(value: str, by: list[str]) -> Column:
    """Rank with ties sharing their average."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def spearman(rows: DataFrame, by: list[str], x: str, y: str, least: int = 2, name: str = "rho") -> DataFrame:
    """Rank correlation in each group of at least so many rows."""
    ranked = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_x": average_rank(x, by), "_y": average_rank(y, by)})
    return ranked.groupBy(*by).agg(F.corr("_x", "_y").alias(name), F.count("*").alias("n")).where(F.col("n") >= least)


def ols_hc1(rows: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Rows (term, beta, t) of least squares with an intercept and HC1 robust errors.

    Two aggregations over the rows; the system of a few equations is solved on the driver.
    """
    import numpy as np

    terms = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    k = len(terms)
    used = rows.dropna(subset=[y, *xs])
    first = used.agg(*[F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(k)], *[F.sum(terms[i] * F.col(y)).alias(f"b{i}") for i in range(k)], F.count("*").alias("n")).first()
    a = np.array([[first[f"a{i}_{j}"] for j in range(k)] for i in range(k)], float)
    inv = np.linalg.pinv(a)
    beta = inv @ np.array([first[f"b{i}"] for i in range(k)], float)
    error = F.col(y) - sum((terms[i] * float(beta[i]) for i in range(k)), F.lit(0.0))
    second = used.agg(*[F.sum(terms[i] * terms[j] * error * error).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
    meat = np.array([[second[f"m{i}_{j}"] for j in range(k)] for i in range(k)], float)
    n = first["n"]
    se = np.sqrt(np.diag(inv @ meat @ inv) * n / max(n - k, 1))
    return rows.sparkSession.createDataFrame([(t, round(float(b), 9), round(float(b / s), 6) if s else None) for t, b, s in zip(["intercept", *xs], beta, se, strict=True)], "term string, beta double, t double")


def significance(rows: DataFrame, measures: list[str], outcome: str) -> DataFrame:
    """Rows (measure, rho, p_value, n, top_mean, lift): the rank correlation of each measure with the outcome, how likely chance gives one as strong, and the outcome's mean where the measure is in its top tenth, also over the mean of all."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("_m")) for m in measures])).alias("e"), F.col(outcome).cast("double").alias("_o")).select("e.*", "_o").where("_m is not null and _o is not null")
    rho = spearman(each, ["measure"], "_m", "_o")
    cut = each.groupBy("measure").agg(F.percentile("_m", F.lit(0.9)).alias("_cut"), F.avg("_o").alias("_all"))
    top = each.join(F.broadcast(cut), "measure").where("_m >= _cut").groupBy("measure").agg(F.avg("_o").alias("top_mean"), (F.avg("_o") / F.first("_all")).alias("lift"))  # a row for each measure
    return rho.join(top, "measure").withColumn("p_value", rank_tails(F.col("rho"), F.col("n"))).select("measure", "rho", "p_value", "n", "top_mean", "lift")


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with columns less their mean, over their deviation; a constant one becomes 0."""
    m = rows.agg(*[f(c).alias(f"_{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    spread = lambda i: F.when(F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"_s{i}"))
    return rows.crossJoin(F.broadcast(m)).withColumns({c: (F.col(c) - F.col(f"_m{i}")) / spread(i) for i, c in enumerate(columns)}).drop(*m.columns)  # one row


def strategy_metrics(daily: DataFrame, by: list[str], time: str, ret: str, benchmark: str, days: int = 252) -> DataFrame:
    """Annual return and volatility, Sharpe ratio, drawdown, tracking error, information ratio and share of days ahead, for each strategy."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = daily.withColumn("_level", F.exp(F.sum(F.log1p(ret)).over(w)))
    rows = rows.withColumn("_peak", F.max("_level").over(w)).withColumn("_active", F.col(ret) - F.col(benchmark))
    year = lambda c: F.exp(F.sum(F.log1p(c)) * days / F.count("*")) - 1
    root = days**0.5
    return rows.groupBy(*by).agg(
        year(ret).alias("annual_return"), (F.stddev_samp(ret) * root).alias("annual_volatility"), (F.avg(ret) / F.stddev_samp(ret) * root).alias("sharpe"),
        F.min(F.col("_level") / F.col("_peak") - 1).alias("max_drawdown"), (year(ret) - year(benchmark)).alias("excess_return"), (F.stddev_samp("_active") * root).alias("tracking_error"),
        (F.avg("_active") * days / (F.stddev_samp("_active") * root)).alias("information_ratio"), F.avg((F.col("_active") > 0).cast("double")).alias("days_ahead"),
    )


def classification_report(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Rows (label, support, precision, recall, f1) from one confusion count; labels that only one side has included."""
    counts = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    sides = counts.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("right")), F.struct(F.col("g").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("right")))).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("right").alias("right"))
    p, r = F.coalesce(F.try_divide("right", "said"), F.lit(0.0)), F.coalesce(F.try_divide("right", "support"), F.lit(0.0))
    return sums.select("label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def grid(rows: DataFrame, name: str, day: str) -> DataFrame:
    """Rows (name, day) for every name on every day that any has.  Days, some 400 a year, are gathered and exploded beside each name, so names are not joined."""
    days = rows.select(day).distinct().agg(F.array_sort(F.collect_list(day)).alias("_days"))
    return rows.select(name).distinct().crossJoin(F.broadcast(days)).select(name, F.explode("_days").alias(day))


def on_sessions(rows: DataFrame, day: str, sessions: DataFrame, session: str = "session") -> DataFrame:
    """rows with the session that each day belongs to, the last one up to it, so that what a weekend brings meets the day before it; null before the first.

    sessions: one column of days, some 250 a year; they are gathered into one array beside each row.
    """
    days = sessions.toDF("_d").distinct().agg(F.array_sort(F.collect_list(F.col("_d").cast("date"))).alias("_days"))
    return rows.crossJoin(F.broadcast(days)).withColumn(session, F.array_max(F.filter("_days", lambda d: d <= F.col(day)))).drop("_days")


def agreement_summary(rows: DataFrame, truth: str, guess: str, part: Column | None = None) -> DataFrame:
    """One row (n, accuracy, macro_f1, part_n, part_accuracy): how often guess is truth, the mean of all labels' F1, and the same share where part holds."""
    counts = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    each = counts.select(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).alias("said"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("ok")).unionAll(counts.select("g", F.lit(0), "n", F.lit(0)))
    f1 = each.where("label is not null").groupBy("label").agg(F.coalesce(F.try_divide(2 * F.sum("ok"), F.sum("support") + F.sum("said")), F.lit(0.0)).alias("f1"))
    right = F.coalesce((F.col(truth) == F.col(guess)).cast("int"), F.lit(0))
    inside = F.coalesce(part if part is not None else F.lit(False), F.lit(False))
    total = rows.agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.count_if(inside).alias("part_n"), F.avg(F.when(inside, right)).alias("part_accuracy"))
    return total.crossJoin(F.broadcast(f1.agg(F.avg("f1").alias("macro_f1")))).select("n", "accuracy", "macro_f1", "part_n", "part_accuracy")  # one row each
