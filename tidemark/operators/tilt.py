"""A sentiment-tilted index: target weights within bounds and sector bands, turnover rules, and a backtest in units."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.monitors import folded


# The index's published rules.
@dataclass(frozen=True)
class TiltConfig:
    strength: float = 2.0
    min_multiple: float = 0.4
    max_multiple: float = 2.0
    max_weight: float = 0.12
    sector_band: float = 0.08
    max_turnover: float = 0.10
    no_trade: float = 0.0025
    cost_bps: float = 5.0


def tilted(panel: DataFrame, strength: float = 2.0) -> DataFrame:
    """panel (date, ticker, sector, parent, sentiment) with weight: the parent's times exp(strength * sentiment), adding up to one each date."""
    raw = F.col("parent") * F.exp(strength * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("sentiment", F.lit(0.0)))))
    return panel.withColumn("_raw", raw).withColumn("weight", F.col("_raw") / F.sum("_raw").over(Window.partitionBy("date"))).drop("_raw")


def poured(shape: np.ndarray, low: np.ndarray, high: np.ndarray, total: float) -> np.ndarray:
    """clip(level * shape, low, high) for the one level at which it adds up to total; shape is positive.

    The sum grows with the level in straight pieces that meet where an entry leaves its lower
    or reaches its upper bound, so the piece that total falls in is found by sorting these.
    """
    if not low.sum() - 1e-9 <= total <= high.sum() + 1e-9:
        raise ValueError(f"nothing within these bounds adds up to {total}")
    corners = np.sort(np.concatenate([low / shape, high / shape]))
    sums = np.clip(corners[:, None] * shape, low, high).sum(axis=1)
    k = int(np.searchsorted(sums, total))
    if k == 0 or k == len(sums):
        return np.clip(corners[min(k, len(sums) - 1)] * shape, low, high)
    gap = sums[k] - sums[k - 1]
    level = corners[k - 1] + (corners[k] - corners[k - 1]) * ((total - sums[k - 1]) / gap if gap > 0 else 0.0)
    return np.clip(level * shape, low, high)


def goal(shape: np.ndarray, parent: np.ndarray, sector: np.ndarray, config: TiltConfig) -> np.ndarray:
    """Weights in the proportions of shape, sectors within their band around the parent's weight, then stocks within their bounds."""
    low = config.min_multiple * parent
    high = np.maximum(np.minimum(config.max_multiple * parent, config.max_weight), low)
    names, of = np.unique(sector, return_inverse=True)
    by = lambda v: np.bincount(of, v, len(names))
    floor, ceiling = by(low), by(high)
    if len(names) > 1:
        floor, ceiling = np.maximum(floor, by(parent) - config.sector_band), np.minimum(ceiling, by(parent) + config.sector_band)
    shares = poured(by(shape), floor, ceiling, 1.0)
    out = np.empty(len(shape))
    for k, share in enumerate(shares):
        out[of == k] = poured(shape[of == k], low[of == k], high[of == k], share)
    return out


def targets(panel: DataFrame, config: TiltConfig = TiltConfig()) -> DataFrame:
    """Rows (date, ticker, target): the tilt within stock bounds and sector bands, date by date in parallel.  A date's group is one index's constituents."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ticker")
        return rows[["date", "ticker"]].assign(target=goal(rows["weight"].to_numpy(), rows["parent"].to_numpy(), rows["sector"].to_numpy(), config))

    rows = tilted(panel, config.strength).select("date", "ticker", "sector", "parent", "weight")
    return rows.groupBy("date").applyInPandas(one, f"date {panel.schema['date'].dataType.simpleString()}, ticker string, target double")


def traded(now: np.ndarray, target: np.ndarray, config: TiltConfig) -> tuple[np.ndarray, float]:
    """Weights after the turnover rules, and the one-way turnover.

    Moves under no_trade are not made.  Sales pay for purchases: of B to buy and S to sell,
    both sides become 2BS / (B + S), and no more than max_turnover.
    """
    wish = np.where(np.abs(target - now) < config.no_trade, 0.0, target - now)
    buys, sells = np.maximum(wish, 0.0), np.maximum(-wish, 0.0)
    b, s = buys.sum(), sells.sum()
    if b == 0 or s == 0:
        return now, 0.0
    both = min(2 * b * s / (b + s), config.max_turnover)
    return now + buys * (both / b) - sells * (both / s), float(both)


def backtest(goals: DataFrame, rets: DataFrame, config: TiltConfig = TiltConfig()) -> DataFrame:
    """Rows (strategy, date, net, turnover): each day trades from drifted weights towards the target, pays for it and earns the returns.

    goals: strategy, date, ticker, target; rets: date, ticker, ret.  Between trades units are
    held, so that weights drift with prices.  A day depends on the one before: a strategy is one
    fold over its days, each a row with its constituents; a task holds one strategy's units.
    """

    def start() -> Callable:
        units: dict[str, float] = {}
        price: dict[str, float] = {}

        def step(r) -> list[tuple]:
            day = list(r.names)
            names = [x["ticker"] for x in day]
            for n in names:
                price.setdefault(n, 1.0)
            if not units:
                units.update({n: 1 / len(names) for n in names})
            held = sorted({*units, *names})
            p = np.array([price.setdefault(n, 1.0) for n in held])
            worth = p * np.array([units.get(n, 0.0) for n in held])
            value = worth.sum()
            wanted = {x["ticker"]: x["target"] for x in day if x["target"] is not None}
            now = worth / value
            weights, turnover = traded(now, np.array([wanted.get(n, w) for n, w in zip(held, now, strict=True)]), config)
            before = value
            value *= 1 - turnover * config.cost_bps / 1e4
            ret = {x["ticker"]: x["ret"] or 0.0 for x in day}
            for n, w, at in zip(held, weights, p, strict=True):
                units[n] = w * value / at
                price[n] = at * (1 + ret.get(n, 0.0))
            return [(r.strategy, r.date, sum(units[n] * price[n] for n in held) / before - 1, turnover)]

        return step

    rows = goals.join(rets, ["date", "ticker"]).groupBy("strategy", "date").agg(F.array_sort(F.collect_list(F.struct("ticker", "target", "ret"))).alias("names"))  # the constituents of one day
    return folded(rows, "strategy", ["date"], start, f"strategy string, date {goals.schema['date'].dataType.simpleString()}, net double, turnover double")
