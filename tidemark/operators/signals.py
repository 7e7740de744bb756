"""Signals: the impact scorecard, the document gate, watch-list scores and their hysteresis, and whom an event is about."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.monitors import folded

# Thresholds of the watch list, and the points of the scorecards below.
WATCH, MONITOR, HYSTERESIS = 3.0, 1.5, 0.5


def impact(x: dict[str, Column] | None = None) -> Column:
    """A struct (score, factors) from the columns of a cluster.

    base, confidence, sentiment, n_scored, n_stories, n_news, stories_last_hour, extreme_docs,
    high_docs, scale_docs, n_sectors, n_regions, market_docs.  Each factor has a name and points; the
    score is their sum, from 1 to 10.
    """
    c = x or {}
    g = lambda n: c.get(n, F.col(n))
    n = F.greatest(g("n_scored"), F.lit(1))
    share = lambda d: F.when(d == 0, 0.0).when((d / n >= 0.2) | (n <= 3), 1.0).otherwise(0.5)
    severe = F.when(g("extreme_docs") > 0, 1.0 * share(g("extreme_docs"))).when(g("high_docs") > 0, 0.5 * share(g("high_docs"))).otherwise(0.0)
    intensity = F.least(F.lit(1.5), severe + 0.3 * share(g("scale_docs")) + F.when(F.abs(g("sentiment")) >= 0.6, 0.3).otherwise(0.0))
    corroboration = F.when(g("n_stories") > 2, F.least(F.lit(2.0), 0.5 * F.log2(g("n_stories") / 2))).otherwise(0.0)
    velocity = F.when(g("stories_last_hour") >= 40, 1.0).when(g("stories_last_hour") >= 15, 0.5).when(g("stories_last_hour") >= 5, 0.25).otherwise(0.0)
    breadth = F.least(F.lit(0.75), F.when(g("n_sectors") >= 3, 0.5).otherwise(0.0) + F.when(g("n_regions") >= 2, 0.25).otherwise(0.0))
    part = g("market_docs") / n
    market = F.when((part >= 0.25) | (g("market_docs") >= 25), 0.5).when((part < 0.10) & (g("market_docs") < 5), -1.0).otherwise(0.0)
    credibility = F.when(g("n_news") == 0, -1.0).when(g("n_stories") == 1, -1.0).when(g("n_stories") == 2, -0.5).otherwise(0.0)
    certainty = F.when(g("confidence") < 0.5, -0.5).otherwise(0.0)
    named = {"event type": g("base"), "intensity": intensity, "corroboration": corroboration, "velocity": velocity, "breadth": breadth, "market linkage": market, "credibility": credibility, "classification": certainty}
    factors = F.filter(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("points")) for k, v in named.items()]), lambda f: f["points"] != 0)
    score = F.aggregate(factors, F.lit(0.0), lambda s, f: s + f["points"])
    return F.struct(F.greatest(F.lit(1.0), F.least(F.lit(10.0), score)).alias("score"), factors.alias("factors"))


def gate(finance_feed: Column, entities: Column, companies: Column, themes: Column, risk_themes: list[str], cue_hits: Column) -> Column:
    """Whether a document goes on: a finance feed always; else a company, or an entity with a risk theme or a cue."""
    risky = F.arrays_overlap(themes, F.array(*map(F.lit, risk_themes)))
    return finance_feed | (F.size(companies) > 0) | ((F.size(entities) > 0) & (F.coalesce(risky, F.lit(False)) | (cue_hits > 0)))


def next_status(score: float, before: str | None) -> str | None:
    """The status that a score gives; one that is held is only lost HYSTERESIS below its threshold."""
    for status, bar, holders in (("Watch Negative", WATCH, ("Watch Negative",)), ("Monitor", MONITOR, ("Watch Negative", "Monitor"))):
        if score >= bar - (HYSTERESIS if before in holders else 0.0):
            return status
    return None


def next_status_of(score: Column) -> Column:
    """The status of a score where none was held before."""
    return F.when(score >= WATCH, "Watch Negative").when(score >= MONITOR, "Monitor")


def watch_status(scores: DataFrame, by: str, time: str, score: str) -> DataFrame:
    """Rows (by, time, score, status): each key's scores in order of time, folded with hysteresis.  A null score keeps the status."""
    kinds = [scores.schema[c].dataType.simpleString() for c in (by, time, score)]

    def start() -> Callable:
        held = None

        def step(r) -> list[tuple]:
            nonlocal held
            if not pd.isna(r.score):
                held = next_status(r.score, held)
            return [(r.key, r.time, r.score, held)]

        return step

    rows = scores.select(F.col(by).alias("key"), F.col(time).alias("time"), F.col(score).alias("score"))
    return folded(rows, "key", ["time", "score"], start, f"key {kinds[0]}, time {kinds[1]}, score {kinds[2]}, status string").toDF(by, time, score, "status")


def watch_score(x: dict[str, Column] | None = None) -> Column:
    """Points of a name from its columns: credit_impact, credit_focus, news_impact, news_focus, epicentre_impact, sentiment, evidence, trend, notches, defaulted; null is no such thing."""
    c = x or {}
    g = lambda n: c.get(n, F.col(n))
    full = F.least(F.lit(4.0), g("credit_impact") - 5.5)
    credit = F.when(g("credit_impact") > 5.5, F.when(g("credit_focus"), full).otherwise(F.least(F.lit(1.0), 0.5 * full)))
    news = F.when(g("news_impact") >= 7, F.least(F.lit(1.5), 0.5 + 0.5 * (g("news_impact") - 7)) * F.when(g("news_focus"), 1.0).otherwise(0.5))
    # least and greatest pass over nulls
    centre = F.when(g("epicentre_impact").isNotNull(), F.least(F.lit(1.5), F.greatest(F.lit(0.5), 1.5 * (g("epicentre_impact") - 6) / 3)))
    low = (g("sentiment") <= -0.15) & (g("evidence") >= 2)
    tone = F.when(low, F.least(F.lit(2.0), (-g("sentiment") - 0.1) * 5) + F.when(g("trend") <= -0.15, 0.5).otherwise(0.0))
    moved = F.when(g("defaulted"), 2.0).when(g("notches").isNotNull(), F.least(F.lit(2.0), 0.5 * g("notches")))
    zero = F.lit(0.0)
    return sum((F.coalesce(F.bround(p, 2), zero) for p in (credit, news, centre, tone, moved)), zero)


def epicentre(event_type: Column, market_wide: Column, regions: Column, named: Column, mentions: Column) -> Column:
    """Whom an event hits: nobody for macro events, the first two regions but US and EU if market-wide, else the most-named companies and those named half as often, three at most."""
    top = F.coalesce(mentions[F.get(named, F.lit(0))], F.lit(0))
    firms = F.filter(named, lambda e: F.coalesce(mentions[e], F.lit(0)) >= 0.5 * top)
    places = F.filter(regions, lambda r: ~r.isin("US", "EU"))
    return F.when(event_type == "MACROECONOMIC", F.array().cast("array<string>")).when(market_wide, F.slice(places, 1, 2)).otherwise(F.slice(firms, 1, 3))
