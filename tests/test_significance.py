"""The Student-t tail against closed forms, and what rests on it."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import numeric
from tidemark.plans import markets


def tails(t, df):
    """Finite sums for whole degrees of freedom."""
    theta = math.atan(abs(t) / math.sqrt(df))
    if df % 2:
        total, term = 0.0, math.cos(theta)
        for k in range(1, (df - 1) // 2 + 1):
            total += term
            term *= math.cos(theta) ** 2 * (2 * k) / (2 * k + 1)
        inside = 2 / math.pi * (theta + math.sin(theta) * total)
    else:
        total, term = 0.0, 1.0
        for k in range(1, df // 2 + 1):
            total += term
            term *= math.cos(theta) ** 2 * (2 * k - 1) / (2 * k)
        inside = math.sin(theta) * total
    return 1 - inside


def test_tails_of_whole_degrees(spark):
    cases = [(t, df) for df in (1, 2, 3, 4, 7, 10, 30, 101, 1000, 4865) for t in (0.0, 0.02, -0.7, 1.0, 1.96, -3.3, 6.0, 25.0)]
    df = spark.createDataFrame([(float(t), d) for t, d in cases], "t double, d int")
    for r in df.select("t", "d", numeric.t_tails(F.col("t"), F.col("d")).alias("p")).collect():
        assert r["p"] == pytest.approx(tails(r["t"], r["d"]), abs=1e-11), (r["t"], r["d"])


def test_many_degrees_are_normal_and_odd_input(spark):
    df = spark.createDataFrame([(1.5, 4e6), (0.3, 4e6), (-2.8, 4e6)], "t double, d double")
    for r in df.select("t", numeric.t_tails(F.col("t"), F.col("d")).alias("p")).collect():
        assert r["p"] == pytest.approx(2 * (1 - statistics.NormalDist().cdf(abs(r["t"]))), abs=1e-6)
    odd = spark.createDataFrame([(1.0, 0.0), (None, 3.0), (float("nan"), 3.0), (float("inf"), 3.0)], "t double, d double")
    assert [r["p"] for r in odd.select(numeric.t_tails(F.col("t"), F.col("d")).alias("p")).collect()] == [None, None, None, 0.0]


def test_log_gamma(spark):
    xs = [0.01, 0.5, 1.0, 2.0, 3.7, 12.0, 170.0, 1e6]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(numeric.log_gamma(F.col("x")).alias("g")).collect()
    assert [r["g"] for r in got] == pytest.approx([math.lgamma(x) for x in xs], rel=1e-13, abs=1e-13)


def test_standardised_least_squares(spark, sf):
    rows = markets.daily_signals(spark, sf).toPandas()
    z = lambda v: (v - v.mean()) / (v.std() or 1.0)
    x = np.column_stack([np.ones(len(rows)), z(rows["top"]), z(np.log1p(rows["volume"])), z(-rows["s"])]).astype(float)
    y = rows["s"].abs().to_numpy()
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    n, k = x.shape
    t = beta / np.sqrt(np.diag(inv @ (x.T * e**2) @ x @ inv) * n / (n - k))
    got = {r["term"]: r for r in markets.R.queries["ols_significance"](spark, sf).collect()}
    for name, b, s in zip(("intercept", "top", "log_volume", "tone"), beta, t, strict=True):
        assert (got[name]["beta"], got[name]["t"]) == pytest.approx((b, s), rel=1e-5, abs=1e-8)
        assert got[name]["p_value"] == pytest.approx(tails(s, n - k), abs=2e-6) and got[name]["n"] == n
