"""Scenarios from past episodes: who may serve as a model, the closest ones, blends, and how well they would have done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rules of scenarios from history and of prices that reports say are moving.
EXTREME_IMPACT, SHARPNESS, CREDIBILITY, REFERENCE_IMPACT = 9.5, 12.0, 0.5, 8.5
OVERLAYS = [("OIL", "CMD_OIL", 30.0), ("GAS", "CMD_OIL", 15.0), ("GOLD", "CMD_GOLD", 10.0), ("SPX", "EQ_US", 8.0)]
LEAST_REPORTS, LEAST_AGREEMENT, LEAST_PRIOR = 5, 0.2, 4
MOVES = [
    ("equities", ["EQ_US", "EQ_EU", "EQ_EM"], "fall", "rise", 1.0), ("credit spreads", ["CS_IG", "CS_HY", "CS_EM"], "tighten", "widen", 5.0), ("government bond yields", ["IR_USD_10Y"], "fall", "rise", 5.0),
    ("oil", ["CMD_OIL"], "falls", "rises", 2.0), ("gold", ["CMD_GOLD"], "falls", "rises", 1.0), ("market volatility", ["VOL_VIX"], "falls", "rises", 1.0),
]
#: Episodes of history that are broadcast beside events at most.
MOST_EPISODES = 10_000
#: Moves too small to judge a direction by, in each unit.
MATERIAL = {"pct": 1.0, "bp": 5.0, "pts": 1.0}


def eligible(events: DataFrame, episodes: DataFrame) -> DataFrame:
    """Pairs of an event and an episode that ended before it; extreme episodes only for events of EXTREME_IMPACT or more.

    An inequality is all that joins them, and every earlier episode counts for every event; so there may be
    MOST_EPISODES of them, which is checked.
    """
    n = episodes.limit(MOST_EPISODES + 1).count()
    if n > MOST_EPISODES:
        raise ValueError(f"over {MOST_EPISODES} episodes")
    ok = (F.col("end") < F.to_date("as_of")) & (~F.coalesce("extreme", F.lit(False)) | (F.col("impact") >= EXTREME_IMPACT))
    return events.join(F.broadcast(episodes.withColumnRenamed("event_type", "episode_type")), ok)


def rank_analogs(pairs: DataFrame, related: dict[str, list[str]], similarity: Column, top_k: int = 3) -> DataFrame:
    """The closest episodes of each event, with weights that add up to one.  Same type counts in full, a related one 0.4, others not at all."""
    kin = F.create_map(*[x for k, v in related.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if related else None
    kind = F.when(F.col("episode_type") == F.col("event_type"), 1.0)
    if kin is not None:
        kind = kind.when(F.coalesce(F.array_contains(kin[F.col("event_type")], F.col("episode_type")), F.lit(False)), 0.4)
    rows = pairs.withColumn("score", kind.otherwise(0.0) * F.exp(SHARPNESS * similarity)).where("score > 0")
    place = Window.partitionBy("event_id").orderBy(F.desc("score"), "episode_id")
    rows = rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top_k)
    return rows.withColumn("weight", F.col("score") / F.sum("score").over(Window.partitionBy("event_id")))


def blend(weighted: DataFrame, shocks: DataFrame) -> DataFrame:
    """Rows (event_id, factor, shock): the weighted mean over the episodes that have the factor measured."""
    rows = weighted.select("event_id", "episode_id", "weight").join(shocks.where("shock is not null"), "episode_id")
    return rows.groupBy("event_id", "factor").agg((F.sum(F.col("weight") * F.col("shock")) / F.sum("weight")).alias("shock"))


def mixed(nearest: DataFrame, average: DataFrame, credibility: float = CREDIBILITY) -> DataFrame:
    """The closest episodes' shocks mixed with the average crisis; where one lacks a factor the other speaks alone."""
    both = nearest.withColumnRenamed("shock", "near").join(average.withColumnRenamed("shock", "mean"), ["event_id", "factor"], "full_outer")
    return both.select("event_id", "factor", (credibility * F.coalesce("near", "mean") + (1 - credibility) * F.coalesce("mean", "near")).alias("shock"))


def overridden(base: DataFrame, changes: DataFrame) -> DataFrame:
    """A scenario with an analyst's factors put over it."""
    return base.join(changes.withColumnRenamed("shock", "new"), ["event_id", "factor"], "full_outer").select("event_id", "factor", F.coalesce("new", "shock").alias("shock"))


def unknown_factors(shocks: DataFrame, factors: DataFrame) -> DataFrame:
    return shocks.select("factor").subtract(factors.select("factor"))


def factor_hits(candidate: DataFrame, realised: DataFrame, units: DataFrame) -> DataFrame:
    """Rows (method, factor, scored, hits, rate): how often each method's direction of each factor was right, over moves that were material in the factor's unit."""
    limit = F.create_map(*[F.lit(x) for kv in MATERIAL.items() for x in kv])
    rows = realised.join(units, "factor").where(F.abs("realised") >= limit[F.col("unit")]).join(candidate, ["event_id", "factor"])
    right = F.round("shock", 2) * F.col("realised") > 0
    return rows.groupBy("method", "factor").agg(F.count("*").alias("scored"), F.count_if(right).alias("hits"), (F.count_if(right) / F.count("*")).alias("rate"))


def severity(impact: Column) -> Column:
    """How far history is scaled for an impact: one at REFERENCE_IMPACT, from 0.25 to 1.35."""
    return F.greatest(F.lit(0.25), F.least(F.lit(1.35), (impact - 4.0) / (REFERENCE_IMPACT - 4.0)))


def stated_moves(moves: DataFrame, overlays: list[tuple[str, str, float]] = OVERLAYS) -> DataFrame:
    """Rows (event_id, factor, implied): the moves that reports agree on, before scaling.

    moves: event_id, price, up, down.  Where several prices speak for a factor, the first of
    overlays that enough reports agree on does.
    """
    ranks = F.create_map(*[x for i, (price, factor, scale) in enumerate(overlays) for x in (F.lit(price), F.struct(F.lit(i).alias("rank"), F.lit(factor).alias("factor"), F.lit(scale).alias("scale")))])
    said = F.col("up") + F.col("down")
    rows = moves.where((said >= LEAST_REPORTS) & (F.abs(F.col("up") - F.col("down")) / said >= LEAST_AGREEMENT)).withColumn("_o", ranks[F.col("price")]).where("_o is not null")
    implied = F.col("_o.scale") * (F.col("up") - F.col("down")) / said
    return rows.groupBy("event_id", F.col("_o.factor").alias("factor")).agg(F.min_by(implied, F.col("_o.rank")).alias("implied"))


def for_events(events: DataFrame, history: DataFrame, templates: DataFrame, moves: DataFrame, fallback: str, overlays: list[tuple[str, str, float]] = OVERLAYS) -> DataFrame:
    """Rows (event_id, factor, shock, method): each event's scenario.

    events: event_id, event_type, impact; history: event_id, factor, shock (see ``mixed``); templates:
    event_type, factor, shock, used where an event has no history, those of fallback for a type that has
    none; moves as in ``stated_moves``.  Shocks are scaled by severity; stated moves replace history's.
    """
    events = events.withColumn("_severity", severity(F.col("impact")))
    known = history.select("event_id").distinct()
    typed = templates.select("event_type").distinct().withColumn("_has", F.lit(True))
    bare = events.join(known, "event_id", "left_anti").join(typed, "event_type", "left").withColumn("event_type", F.when(F.col("_has"), F.col("event_type")).otherwise(fallback)).join(templates, "event_type")
    base = history.join(events.select("event_id", "_severity"), "event_id").select("event_id", "factor", "shock", "_severity", F.lit("analog").alias("method")).unionByName(bare.select("event_id", "factor", "shock", "_severity", F.lit("template").alias("method")))
    base = base.select("event_id", "factor", F.round(F.col("shock") * F.col("_severity"), 2).alias("shock"), "method")
    told = stated_moves(moves, overlays).join(events.select("event_id", "_severity"), "event_id").select("event_id", "factor", F.round(F.col("implied") * F.col("_severity"), 2).alias("told"))
    return base.join(told, ["event_id", "factor"], "full_outer").select("event_id", "factor", F.coalesce("told", "shock").alias("shock"), F.when(F.col("told").isNotNull(), "stated").otherwise(F.col("method")).alias("method"))


def epicentre_notches(impact: Column) -> Column:
    return 1 + (impact >= 8).cast("int") + (impact >= 9).cast("int")


def candidates(pairs: DataFrame, shocks: DataFrame, nearest: DataFrame, average: DataFrame, naive: dict[str, float], templates: DataFrame, fallback: str, least: int = LEAST_PRIOR) -> DataFrame:
    """Rows (event_id, method, factor, shock): what six methods would have said of each event with enough earlier episodes.

    pairs as from ``eligible``; nearest and average as from ``blend``.  naive is one shock for all.
    """
    prior = pairs.groupBy("event_id", "event_type").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kept = prior.select("event_id")
    named = lambda df, name: df.join(kept, "event_id").select("event_id", F.lit(name).alias("method"), "factor", "shock")
    same = blend(pairs.where("episode_type = event_type").withColumn("weight", F.lit(1.0)), shocks)
    same = same.unionByName(average.join(same.select("event_id").distinct(), "event_id", "left_anti").select(same.columns))
    fixed = prior.select("event_id", F.lit("naive").alias("method"), F.explode(F.create_map(*[F.lit(x) for kv in naive.items() for x in kv])).alias("factor", "shock"))
    typed = templates.select("event_type").distinct().withColumn("_has", F.lit(True))
    expert = prior.join(typed, "event_type", "left").withColumn("event_type", F.when(F.col("_has"), F.col("event_type")).otherwise(fallback)).join(templates, "event_type").select("event_id", F.lit("template").alias("method"), "factor", "shock")
    out = fixed.unionByName(expert)
    for name, df in (("all_mean", average), ("same_type_mean", same), ("nearest", nearest), ("blended", mixed(nearest, average))):
        out = out.unionByName(named(df, name))
    return out


def backtest(candidate: DataFrame, realised: DataFrame, exposure: DataFrame, units: DataFrame) -> DataFrame:
    """One row for each method: episodes, direction hit rate, mean and median error of the loss, and how often it was closer than naive and than the average.

    realised: event_id, factor, realised; exposure: factor, exposure (loss for a move of one); units: factor, unit.
    Factors without a realised move are shocked by no method.
    """
    said = candidate.join(realised, ["event_id", "factor"]).withColumn("shock", F.round("shock", 2))
    limit = F.create_map(*[F.lit(x) for kv in MATERIAL.items() for x in kv])
    judged = said.join(units, "factor").where(F.abs("realised") >= limit[F.col("unit")])
    rates = judged.groupBy("method").agg((F.count_if(F.col("shock") * F.col("realised") > 0) / F.count("*")).alias("hit_rate"))
    real = realised.join(exposure, "factor").groupBy("event_id").agg(F.sum(F.col("realised") * F.col("exposure")).alias("_real"))
    every = candidate.select("event_id", "method").distinct()
    loss = every.join(said.join(exposure, "factor").groupBy("event_id", "method").agg(F.sum(F.col("shock") * F.col("exposure")).alias("_pnl")), ["event_id", "method"], "left").join(real, "event_id")
    errors = loss.select("event_id", "method", F.round(F.abs(F.coalesce("_pnl", F.lit(0.0)) - F.col("_real")), 4).alias("error"))
    against = errors.groupBy("event_id").agg(F.max(F.when(F.col("method") == "naive", F.col("error"))).alias("_naive"), F.max(F.when(F.col("method") == "all_mean", F.col("error"))).alias("_mean"))
    sums = errors.join(against, "event_id").groupBy("method").agg(F.count("*").alias("episodes"), F.avg("error").alias("error_mean"), F.median("error").alias("error_median"), F.count_if(F.col("error") < F.col("_naive")).alias("closer_than_naive"), F.count_if(F.col("error") < F.col("_mean")).alias("closer_than_average"))
    return sums.join(rates, "method", "left")


def in_words(shocks: DataFrame, by: str, moves: list = MOVES) -> DataFrame:
    """Rows (by, words): a scenario's direction without its figures, like "equities fall, oil rises"."""
    said = []
    for name, factors, down, up, floor in moves:
        mean = F.avg(F.when(F.col("factor").isin(factors), F.col("shock")))
        said.append(F.when(F.abs(mean) >= floor, F.when(mean > 0, f"{name} {up}").otherwise(f"{name} {down}")))
    return shocks.groupBy(by).agg(F.concat_ws(", ", *said).alias("words"))


def measured(unit: Column, start: Column, end: Column, ref_start: Column, ref_end: Column, duration: Column, invert: Column) -> Column:
    """A factor's move over an episode from prices: points, basis points of a yield, spread implied by a bond and its treasury (both moves over the duration), or percent, inverted or less a reference's."""
    move, ref = F.try_divide(end, start) - 1, F.try_divide(ref_end, ref_start) - 1
    percent = F.when(invert, F.try_divide(start, end) - 1).otherwise(move) * 100 - F.when(ref_start.isNotNull(), ref * 100).otherwise(0.0)
    return F.when(unit == "pts", end - start).when((unit == "bp") & duration.isNull(), (end - start) * 100).when(unit == "bp", -(move - ref) / duration * 1e4).otherwise(percent)
