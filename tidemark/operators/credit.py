"""Stress tests of a bank book: default probabilities, losses, market value changes and capital, by position and scenario."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import GRADES, RATING_PD, STANDARD_WEIGHT, Steps, case_sql, correlation_sql, irb_weight_steps, lifetime_pd_sql, stressed_pd_steps, with_steps

# Assumptions of the stress test.
EQUITY_SIGMA = 20.0
REGION_EQUITY = {"US": "eq_us", "EU": "eq_eu", "UK": "eq_eu", "IN": "eq_in", "EM": "eq_em", "JP": "eq_em"}
CURRENCY_FX = {"EUR": "fx_eur", "GBP": "fx_gbp", "INR": "fx_inr", "JPY": "fx_jpy"}
RATE_BETA = {"USD": 1.0, "EUR": 0.6, "GBP": 0.8, "INR": 0.3}
CET1_START, CET1_REQUIREMENT, DERIVATIVE_WEIGHT, RECOVERY, POINT_IN_TIME = 0.135, 0.095, 0.05, 0.4, 0.3
FACTORS = ["eq_us", "eq_eu", "eq_in", "eq_em", "ir_5y", "ir_10y", "cs_ig", "cs_hy", "cs_em", "fx_eur", "fx_gbp", "fx_inr", "fx_jpy", "cmd_oil", "sec_tech", "sec_energy", "sec_financials", "sec_consumer", "sec_industrials"]
SECTOR_FACTOR = {"tech": "sec_tech", "energy": "sec_energy", "financials": "sec_financials", "consumer": "sec_consumer", "industrials": "sec_industrials"}
CHANNELS = ["ecl", "rates", "spreads", "cds_default", "fx", "equity", "commodities"]
#: Scenarios that one run may hold: they are broadcast to all positions.
MOST_SCENARIOS = 10_000


def _pick(column: str, names: dict[str, str]) -> str:
    return f"(CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in names.items()) + " ELSE 0e0 END)"


_IG = "rating_after IN ('AAA', 'AA', 'A', 'BBB')"
_ORDINAL = "(CASE {} " + " ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(GRADES)) + " END)"
_GRADE_AT = "(CASE {} " + " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(GRADES)) + " END)"

#: What a position goes through, one column after another; SQL that most engines read.
STRESS_STEPS: Steps = [
    ("eq_region", _pick("region", REGION_EQUITY)),
    ("eq_sector", _pick("sector", SECTOR_FACTOR)),
    ("eq_move", "eq_region + eq_sector"),
    ("z", f"eq_move / {EQUITY_SIGMA}e0"),
    ("rating_after", "CASE WHEN notches <= 0 OR rating = 'D' THEN rating ELSE " + _GRADE_AT.format(f"least({_ORDINAL.format('rating')} + notches, {len(GRADES) - 1})") + " END"),
    ("pd0", case_sql("rating", RATING_PD)),
    ("pd_notched", case_sql("rating_after", RATING_PD)),
    *stressed_pd_steps("pd_notched", "least(z, 2e0)", "pd_stressed"),
    ("pd1", "CASE WHEN rating_after = 'D' THEN 1e0 ELSE pd_stressed END"),
    ("downturn", "greatest(0e0, -z)"),
    ("lgd1", "least(lgd * (1e0 + 0.15e0 * downturn), 0.9e0)"),
    ("ead0", "drawn + ccf * undrawn"),
    ("ead1", "drawn + least(1e0, ccf + 0.15e0 * downturn) * undrawn"),
    ("lending", "asset_class IN ('loan', 'revolver')"),
    ("bond", "asset_class = 'bond'"),
    ("stage2_before", "rating = 'CCC'"),
    ("stage2_after", "rating = 'CCC' OR pd1 >= 3e0 * pd0 OR rating_after IN ('CCC', 'D')"),
    ("ecl0", f"CASE WHEN lending THEN (CASE WHEN stage2_before THEN {lifetime_pd_sql('pd0', 'maturity')} ELSE pd0 END) * lgd * ead0 ELSE 0e0 END"),
    ("ecl1", f"CASE WHEN lending THEN (CASE WHEN stage2_after THEN {lifetime_pd_sql('pd1', 'maturity')} ELSE pd1 END) * lgd1 * ead1 ELSE 0e0 END"),
    ("rate_bp", f"(ir_5y + (ir_10y - ir_5y) * greatest(0e0, least(1e0, (maturity - 5e0) / 5e0))) * {case_sql('currency', RATE_BETA, '1e0')}"),
    ("sovereign", "coalesce(bond_type, '') = 'sovereign'"),
    ("sector_addon", f"CASE WHEN sovereign THEN 0e0 ELSE greatest(0e0, -eq_sector) * (CASE WHEN {_IG} THEN 3e0 ELSE 8e0 END) END"),
    ("idio", f"notches * (CASE WHEN {_IG} THEN 25e0 ELSE 75e0 END)"),
    ("credit_bp", f"CASE WHEN {_IG} THEN cs_ig ELSE cs_hy END"),
    ("spread_bp", "(CASE WHEN sovereign THEN (CASE WHEN country IN ('US', 'DE', 'GB', 'JP') THEN 0e0 ELSE cs_em END) ELSE credit_bp END) + sector_addon + idio"),
    ("rate_part", "-duration * (rate_bp / 1e4) + 0.5e0 * convexity * pow(rate_bp / 1e4, 2)"),
    ("total_part", "-duration * ((rate_bp + spread_bp) / 1e4) + 0.5e0 * convexity * pow((rate_bp + spread_bp) / 1e4, 2)"),
    ("fx_move", _pick("currency", CURRENCY_FX) + " / 100e0"),
    ("pnl_ecl", "-(ecl1 - ecl0)"),
    ("pnl_rates", "CASE WHEN bond THEN notional * rate_part WHEN asset_class = 'irs' THEN -direction * notional * duration * 1e-4 * rate_bp ELSE 0e0 END"),
    ("pnl_spreads", "CASE WHEN bond THEN notional * (total_part - rate_part) WHEN asset_class = 'cds' AND rating_after <> 'D' THEN direction * notional * duration * 1e-4 * (credit_bp + sector_addon + idio) ELSE 0e0 END"),
    ("pnl_cds_default", f"CASE WHEN asset_class = 'cds' AND rating_after = 'D' THEN direction * notional * (1e0 - {RECOVERY}e0) ELSE 0e0 END"),
    ("pnl_fx", "CASE WHEN asset_class = 'fx_forward' THEN direction * notional * fx_move WHEN lending THEN (drawn - ecl1) * fx_move WHEN bond THEN notional * (1e0 + total_part) * fx_move ELSE 0e0 END"),
    ("pnl_equity", "CASE WHEN asset_class = 'equity_trs' THEN direction * notional * (eq_move / 100e0 - 0.05e0 * notches) ELSE 0e0 END"),
    ("pnl_commodities", "CASE WHEN asset_class = 'commodity_swap' THEN direction * notional * cmd_oil / 100e0 ELSE 0e0 END"),
    ("pnl", " + ".join(f"pnl_{c}" for c in CHANNELS)),
    ("carrying", "CASE WHEN lending THEN drawn - ecl0 WHEN bond THEN notional ELSE 0e0 END"),
    *irb_weight_steps("pd0", "lgd", "maturity", "rw0"),
    ("pd_capital", f"pow(pd0, {1 - POINT_IN_TIME}e0) * pow(pd1, {POINT_IN_TIME}e0)"),
    ("lgd_capital", f"lgd + {POINT_IN_TIME}e0 * (lgd1 - lgd)"),
    *irb_weight_steps("pd_capital", "lgd_capital", "maturity", "rw_live"),
    ("rw1", "CASE WHEN rating_after = 'D' THEN greatest(12.5e0 * greatest(lgd1 - lgd, 0e0), 1e0) ELSE rw_live END"),
    ("rwa0", f"CASE WHEN lending THEN rw0 * ead0 WHEN bond THEN {case_sql('rating', STANDARD_WEIGHT)} * notional ELSE notional * {DERIVATIVE_WEIGHT}e0 END"),
    ("rwa1", f"CASE WHEN lending THEN rw1 * ead1 WHEN bond THEN {case_sql('rating_after', STANDARD_WEIGHT)} * notional * (1e0 + total_part) ELSE notional * {DERIVATIVE_WEIGHT}e0 END"),
]


def stress(book: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every position under every scenario, with all columns of STRESS_STEPS.

    book has the position columns; scenarios has scenario_id, the FACTORS (percent or basis
    points; null is no move) and epicentre, a map from obligor or country to notches down.
    Scenarios are few, at most MOST_SCENARIOS, and broadcast; the book is read once and not shuffled.
    """
    n = scenarios.limit(MOST_SCENARIOS + 1).count()
    if n > MOST_SCENARIOS:
        raise ValueError(f"{n} scenarios are too many for one run")
    moves = scenarios.select("scenario_id", "epicentre", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FACTORS])
    rows = book.crossJoin(F.broadcast(moves))
    rows = rows.withColumn("notches", F.greatest(F.coalesce(F.col("epicentre")[F.col("obligor_id")], F.lit(0)), F.coalesce(F.col("epicentre")[F.col("country")], F.lit(0))))
    return with_steps(rows, STRESS_STEPS)


#: What of a position P&L, losses and weights are proportional to.
AMOUNTS = ["notional", "drawn", "undrawn"]


def netted(book: DataFrame, scenarios: DataFrame) -> DataFrame:
    """book with one row, and its number n, for all positions that differ in nothing but their AMOUNTS and obligors that no scenario names.

    What a position loses is proportional to its amounts, so sums over these rows under ``stress`` are those over the
    positions.  As many rows as kinds of position are stressed, at most those of the book.
    """
    named = scenarios.select(F.explode(F.map_keys("epicentre")).alias("_key")).distinct()
    rows = book.drop("position_id").join(F.broadcast(named), F.col("obligor_id") == F.col("_key"), "left").withColumn("obligor_id", F.col("_key")).drop("_key")
    kinds = [c for c in rows.columns if c not in AMOUNTS]
    return rows.groupBy(*kinds).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in AMOUNTS])


def totals(stressed: DataFrame) -> DataFrame:
    """One row for each scenario: P&L by channel, losses, capital before and after."""
    lend = F.col("lending")
    sums = stressed.groupBy("scenario_id").agg(
        F.count("*").alias("positions"), F.sum("carrying").alias("value_before"), F.sum("pnl").alias("pnl"), *[F.sum(f"pnl_{c}").alias(f"pnl_{c}") for c in CHANNELS],
        F.sum("rwa0").alias("rwa_before"), F.sum("rwa1").alias("rwa_after"), F.sum("ecl0").alias("ecl_before"), F.sum("ecl1").alias("ecl_after"),
        F.count_if(lend & F.col("stage2_before")).alias("stage2_before"), F.count_if(lend & F.col("stage2_after")).alias("stage2_after"),
        F.count_distinct(F.when(lend & (F.col("rating") != F.col("rating_after")), F.col("obligor_id"))).alias("downgraded"),
        (F.sum(F.when(lend, F.col("pd0") * F.col("ead0"))) / F.sum(F.when(lend, F.col("ead0")))).alias("pd_before"), (F.sum(F.when(lend, F.col("pd1") * F.col("ead1"))) / F.sum(F.when(lend, F.col("ead1")))).alias("pd_after"),
    )
    after = (CET1_START * F.col("rwa_before") + F.col("pnl")) / F.col("rwa_after")
    return sums.withColumns({"cet1_after": after, "breach": after < CET1_REQUIREMENT})


def roll_up(stressed: DataFrame, dims: list[str]) -> DataFrame:
    """P&L by scenario and each dimension's values in one pass; null values are left out.  A row with n stands for n positions."""
    n = F.col("n") if "n" in stressed.columns else F.lit(1)
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims]))
    cells = stressed.groupBy("scenario_id", *dims).agg(F.sum("pnl").alias("pnl"), F.sum(n).alias("n"))
    return cells.select("scenario_id", "pnl", "n", each.alias("d")).where("d.value is not null").groupBy("scenario_id", "d.dim", "d.value").agg(F.sum("pnl").alias("pnl"), F.sum("n").alias("positions"))


def exposures(book: DataFrame) -> DataFrame:
    """For each obligor its exposure at default, the protection bought against it, and the rating of its first position."""
    lending, cds = F.col("asset_class").isin("loan", "revolver"), F.col("asset_class") == "cds"
    held = F.when(lending, F.col("drawn") + F.col("ccf") * F.col("undrawn")).otherwise(0.0) + F.when((F.col("asset_class") == "bond") | (cds & (F.col("direction") < 0)), F.col("notional")).otherwise(0.0)
    return book.groupBy("obligor_id").agg(F.sum(held).alias("exposure"), F.sum(F.when(cds & (F.col("direction") > 0), F.col("notional")).otherwise(0.0)).alias("protection"), F.min_by("rating", "position_id").alias("rating"))


def concentration(stressed: DataFrame, house: str, top: int = 3) -> DataFrame:
    """Rows (scenario_id, losers, top): how many lose, and the share of all losses that the largest ones are.  An obligor's positions add up; trades with the clearing house count one by one."""
    name = F.when(F.col("obligor_id") == house, F.col("position_id").cast("string")).otherwise(F.col("obligor_id"))
    losers = stressed.groupBy("scenario_id", name.alias("name")).agg(F.round(F.sum("pnl"), 2).alias("pnl")).where("pnl < 0")
    worst = losers.withColumn("_r", F.row_number().over(Window.partitionBy("scenario_id").orderBy("pnl", "name"))).where(F.col("_r") <= top).groupBy("scenario_id").agg(F.sum("pnl").alias("_top"))
    return losers.groupBy("scenario_id").agg(F.count("*").alias("losers"), F.sum("pnl").alias("_all")).join(worst, "scenario_id").select("scenario_id", "losers", (F.col("_top") / F.col("_all")).alias("top"))


def worst_migration(stressed: DataFrame) -> DataFrame:
    """For each obligor that is downgraded in any scenario its rating and the worst one after."""
    place = F.expr(_ORDINAL.format("rating_after"))
    return stressed.where("rating_after <> rating").groupBy("obligor_id").agg(F.min_by("rating", "position_id").alias("rating"), F.max_by("rating_after", place).alias("worst"), F.max(place - F.expr(_ORDINAL.format("rating"))).alias("notches"))


__all__ = ["AMOUNTS", "CHANNELS", "FACTORS", "STRESS_STEPS", "concentration", "correlation_sql", "exposures", "netted", "roll_up", "stress", "totals", "worst_migration"]
