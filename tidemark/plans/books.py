"""Queries over books made from customers, orders and lines: profiles, exposures, credit, stress tests, scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import GRADES, RATING_PD, case_sql, irb_weight_steps, nearest_grade_sql, steps_sql, stressed_pd_steps, with_steps
from tidemark.operators import asof, credit, scenarios
from tidemark.operators.shared import checkpointed
from tidemark.plans.common import Registry, table

R = Registry()

_SECTORS = [(1, 10, "tech"), (11, 20, "energy"), (21, 30, "financials"), (31, 40, "consumer")]


@R.add("SELECT p_partkey, CASE " + " ".join(f"WHEN p_size BETWEEN {a} AND {b} THEN '{s}'" for a, b, s in _SECTORS) + " ELSE 'industrials' END AS sector FROM part")
def range_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", asof.range_name(F.col("p_size"), _SECTORS, "industrials").alias("sector"))


_MONTHLY = """SELECT l_suppkey AS merchant, strftime(o_orderdate, '%Y-%m') AS month, sum(l_extendedprice) FILTER (l_returnflag <> 'R') AS turnover, count(*) FILTER (l_returnflag = 'R') AS refunds, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"""
_PROFILES = f"""WITH m AS ({_MONTHLY}), r AS (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY month DESC) AS k FROM m),
p AS (SELECT merchant, count(*) AS months, coalesce(sum(turnover) FILTER (k <= 12), 0) AS last12, coalesce(sum(turnover) FILTER (k BETWEEN 13 AND 24), 0) AS prev12, stddev_samp(turnover) FILTER (k <= 36) / greatest(avg(turnover) FILTER (k <= 36), 1e-9) AS vol, sum(refunds) / sum(n) AS refund_rate FROM r GROUP BY merchant HAVING count(*) >= 24),
c AS (SELECT l_suppkey AS merchant, count(DISTINCT o_custkey) AS customers FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash-flow profiles of suppliers with two years of history or more."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    rows = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    back = F.col("l_returnflag") == "R"
    monthly = rows.groupBy(F.col("l_suppkey").alias("merchant"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(F.when(~back, F.col("l_extendedprice"))).alias("turnover"), F.count_if(back).alias("refunds"), F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("merchant").orderBy(F.desc("month")))
    upto = lambda a, b: F.when(F.col("k").between(a, b), F.col("turnover"))
    found = monthly.withColumn("k", k).groupBy("merchant").agg(F.count("*").alias("months"), F.coalesce(F.sum(upto(1, 12)), F.lit(0.0)).alias("last12"), F.coalesce(F.sum(upto(13, 24)), F.lit(0.0)).alias("prev12"), (F.stddev_samp(upto(1, 36)) / F.greatest(F.avg(upto(1, 36)), F.lit(1e-9))).alias("vol"), (F.sum("refunds") / F.sum("n")).alias("refund_rate")).where("months >= 24")
    customers = rows.groupBy(F.col("l_suppkey").alias("merchant")).agg(F.count_distinct("o_custkey").alias("customers"))
    return found.join(customers, "merchant")


@R.add(f"""{_PROFILES} SELECT merchant, months, round(last12, 2) AS annual_turnover, round(vol, 6) AS volatility, round(CASE WHEN prev12 > 0 THEN last12 / prev12 - 1 ELSE 0 END, 6) AS growth, round(refund_rate, 6) AS refund_rate, customers FROM p JOIN c USING (merchant)""")
def merchant_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    growth = F.when(F.col("prev12") > 0, F.col("last12") / F.col("prev12") - 1).otherwise(0.0)
    return profiles(spark, sf_dir).select("merchant", "months", F.round("last12", 2).alias("annual_turnover"), F.round("vol", 6).alias("volatility"), F.round(growth, 6).alias("growth"), F.round("refund_rate", 6).alias("refund_rate"), "customers")


@R.add(f"""{_PROFILES}, t AS (SELECT *, row_number() OVER (ORDER BY round(last12, 2) DESC, merchant) AS place FROM p JOIN c USING (merchant)), h AS (SELECT *, round(-vol + 0.5 * ln(1 + customers), 6) AS score FROM t WHERE place <= 120), q AS (SELECT *, row_number() OVER (ORDER BY score, merchant) AS rn, count(*) OVER () AS n FROM h)
SELECT merchant, ['CCC', 'B', 'BB', 'BB', 'BBB'][greatest(ceil((rn - 1) * 5 / greatest(n - 1, 1)) - 1, 0)::INT + 1] AS rating FROM q""")
def merchant_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = profiles(spark, sf_dir).orderBy(F.desc(F.round("last12", 2)), "merchant").limit(120).withColumn("score", F.round(-F.col("vol") + 0.5 * F.log1p("customers"), 6))
    every = Window.partitionBy(F.lit(1))  # 120 rows at most
    rows = top.withColumns({"rn": F.row_number().over(every.orderBy("score", "merchant")), "n": F.count("*").over(every)})
    at = F.greatest(F.ceil((F.col("rn") - 1) * 5 / F.greatest(F.col("n") - 1, F.lit(1))) - 1, F.lit(0)).cast("int")
    return rows.select("merchant", F.element_at(F.array(*map(F.lit, ["CCC", "B", "BB", "BB", "BBB"])), at + 1).alias("rating"))


_GRADE = "CASE WHEN c_acctbal < -500 THEN 'CCC' WHEN c_acctbal < 1000 THEN 'B' WHEN c_acctbal < 3000 THEN 'BB' WHEN c_acctbal < 6000 THEN 'BBB' WHEN c_acctbal < 8500 THEN 'A' ELSE 'AA' END"
#: Position columns from orders, customers and nations; SQL that most engines read.
_POSITION = {
    "position_id": "o_orderkey",
    "asset_class": "CASE o_orderkey % 8 WHEN 0 THEN 'loan' WHEN 1 THEN 'revolver' WHEN 2 THEN 'bond' WHEN 3 THEN 'irs' WHEN 4 THEN 'fx_forward' WHEN 5 THEN 'cds' WHEN 6 THEN 'equity_trs' ELSE 'commodity_swap' END",
    "bond_type": "CASE WHEN o_orderkey % 8 = 2 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'sovereign' ELSE 'corporate' END END",
    "obligor_id": "concat('C', CAST(c_custkey AS VARCHAR(20)))",
    "country": "CASE WHEN n_nationkey < 5 THEN 'US' WHEN n_nationkey < 10 THEN 'DE' WHEN n_nationkey < 15 THEN 'GB' WHEN n_nationkey < 20 THEN 'IN' ELSE 'BR' END",
    "region": "CASE WHEN n_nationkey < 5 THEN 'US' WHEN n_nationkey < 10 THEN 'EU' WHEN n_nationkey < 15 THEN 'UK' WHEN n_nationkey < 20 THEN 'IN' ELSE 'EM' END",
    "currency": "CASE WHEN n_nationkey < 5 THEN 'USD' WHEN n_nationkey < 10 THEN 'EUR' WHEN n_nationkey < 15 THEN 'GBP' WHEN n_nationkey < 20 THEN 'INR' ELSE 'USD' END",
    "sector": "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'consumer' WHEN 'BUILDING' THEN 'industrials' WHEN 'MACHINERY' THEN 'energy' WHEN 'HOUSEHOLD' THEN 'tech' ELSE 'financials' END",
    "rating": _GRADE,
    "lgd": "CASE WHEN o_orderkey % 8 < 2 THEN 0.45e0 ELSE 0.6e0 END",
    "notional": "o_totalprice",
    "drawn": "CASE WHEN o_orderkey % 8 = 0 THEN o_totalprice WHEN o_orderkey % 8 = 1 THEN o_totalprice * 0.4e0 ELSE 0e0 END",
    "undrawn": "CASE WHEN o_orderkey % 8 = 1 THEN o_totalprice * 0.6e0 ELSE 0e0 END",
    "ccf": "CASE WHEN o_orderkey % 8 = 1 THEN 0.5e0 ELSE 0e0 END",
    "maturity": "1e0 + o_orderkey % 10",
    "duration": "0.9e0 * (1e0 + o_orderkey % 10)",
    "convexity": "1.1e0 * (1e0 + o_orderkey % 10) * (1e0 + o_orderkey % 10)",
    "direction": "CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END",
}
_BOOK = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _POSITION.items()) + " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(*[F.expr(e).alias(n) for n, e in _POSITION.items()])


@R.add(f"""SELECT obligor_id, round(sum(CASE WHEN asset_class IN ('loan', 'revolver') THEN drawn + ccf * undrawn ELSE 0 END + CASE WHEN asset_class = 'bond' OR (asset_class = 'cds' AND direction < 0) THEN notional ELSE 0 END), 4) AS exposure, round(sum(CASE WHEN asset_class = 'cds' AND direction > 0 THEN notional ELSE 0 END), 4) AS protection, min(rating) AS rating FROM ({_BOOK}) GROUP BY obligor_id""")
def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credit.exposures(book(spark, sf_dir)).select("obligor_id", F.round("exposure", 4).alias("exposure"), F.round("protection", 4).alias("protection"), "rating")


_DIMS = ["asset_class", "sector", "region", "rating", "currency"]


@R.add(" UNION ALL ".join(f"SELECT '{d}' AS dim, {d} AS value, count(*) AS n, round(sum(notional), 2) AS notional FROM ({_BOOK}) GROUP BY {d}" for d in _DIMS))
def book_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in _DIMS])).alias("d")
    return book(spark, sf_dir).select("notional", each).groupBy("d.dim", "d.value").agg(F.count("*").alias("n"), F.round(F.sum("notional"), 2).alias("notional"))


_Z = "(c_acctbal - 4500e0) / 4000e0"
_CREDIT = [("grade", _GRADE), ("pd", case_sql("grade", RATING_PD)), *stressed_pd_steps("pd", _Z, "spd"), *irb_weight_steps("pd", "0.45e0", "2.5e0", "rw"), ("after", nearest_grade_sql("spd"))]


@R.add(f"SELECT c_custkey, grade, round(spd, 7) AS stressed, after, round(rw, 6) AS risk_weight FROM ({steps_sql('SELECT * FROM customer', _CREDIT)})")
def credit_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_steps(table(spark, sf_dir, "customer"), _CREDIT)
    return rows.select("c_custkey", "grade", F.round("spd", 7).alias("stressed"), "after", F.round("rw", 6).alias("risk_weight"))


# Three scenarios of this repository's own, in percent and basis points.
_SCENARIOS = {
    "rates_up": {"ir_5y": 150.0, "ir_10y": 120.0, "cs_ig": 20.0, "cs_hy": 80.0, "eq_us": -5.0, "eq_eu": -6.0},
    "crash": {"eq_us": -30.0, "eq_eu": -28.0, "eq_in": -25.0, "eq_em": -35.0, "ir_5y": -80.0, "ir_10y": -60.0, "cs_ig": 120.0, "cs_hy": 500.0, "cs_em": 250.0, "fx_eur": -4.0, "fx_gbp": -6.0, "fx_inr": -8.0, "cmd_oil": -35.0, "sec_financials": -10.0, "sec_energy": -8.0},
    "calm": {},
}
_EPICENTRE = {"rates_up": {}, "crash": {"BR": 2, "C7": 3}, "calm": {}}


def own_scenarios(spark: SparkSession) -> DataFrame:
    rows = [(n, *[s.get(f) for f in credit.FACTORS], _EPICENTRE[n]) for n, s in _SCENARIOS.items()]
    return spark.createDataFrame(rows, "scenario_id string, " + ", ".join(f"{f} double" for f in credit.FACTORS) + ", epicentre map<string,int>")


_MOVES = "(VALUES " + ", ".join("('" + n + "', " + ", ".join(f"{s.get(f, 0.0)!r}::DOUBLE" for f in credit.FACTORS) + f", {_EPICENTRE[n].get('C7', 0)}, {_EPICENTRE[n].get('BR', 0)})" for n, s in _SCENARIOS.items()) + ") m(scenario_id, " + ", ".join(credit.FACTORS) + ", at_obligor, at_country)"
_STRESSED = steps_sql(f"SELECT b.*, m.*, greatest(CASE WHEN obligor_id = 'C7' THEN at_obligor ELSE 0 END, CASE WHEN country = 'BR' THEN at_country ELSE 0 END) AS notches FROM ({_BOOK}) b, {_MOVES}", credit.STRESS_STEPS)


@R.add(f"""SELECT scenario_id, count(*) AS positions, {', '.join(f'round(sum(pnl_{c}), 0) + 0e0 AS pnl_{c}' for c in credit.CHANNELS)}, round(sum(pnl), 0) + 0e0 AS pnl, round(sum(rwa0), 0) AS rwa_before, round(sum(rwa1), 0) AS rwa_after, round(sum(ecl1), 0) AS ecl_after, count(*) FILTER (lending AND stage2_after) AS stage2_after,
 count(DISTINCT CASE WHEN lending AND rating <> rating_after THEN obligor_id END) AS downgraded, (0.135 * sum(rwa0) + sum(pnl)) / sum(rwa1) < 0.095 AS breach FROM ({_STRESSED}) GROUP BY scenario_id""")
def stress_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = credit.totals(credit.stress(book(spark, sf_dir), own_scenarios(spark)))
    return t.select("scenario_id", "positions", *[(F.round(c, 0) + 0.0).alias(c) for c in (*[f"pnl_{c}" for c in credit.CHANNELS], "pnl", "rwa_before", "rwa_after", "ecl_after")], "stage2_after", "downgraded", "breach")


@R.add(" UNION ALL ".join(f"SELECT scenario_id, '{d}' AS dim, {d} AS value, round(sum(pnl), 0) + 0e0 AS pnl, count(*) AS positions FROM ({_STRESSED}) GROUP BY scenario_id, {d}" for d in ("asset_class", "sector", "region")))
def stress_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = own_scenarios(spark)
    return credit.roll_up(credit.stress(credit.netted(book(spark, sf_dir), moves), moves), ["asset_class", "sector", "region"]).withColumn("pnl", F.round("pnl", 0) + 0.0)


@R.add(f"SELECT scenario_id, position_id, round(pnl, 2) + 0e0 AS pnl FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY round(pnl, 2) + 0e0, position_id) AS r FROM ({_STRESSED})) WHERE r <= 10")
def top_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.state import first_n

    rows = credit.stress(book(spark, sf_dir), own_scenarios(spark)).select("scenario_id", "position_id", (F.round("pnl", 2) + 0.0).alias("pnl"))
    return first_n(rows, ["scenario_id"], ["pnl", "position_id"], 10).drop("place")


_ORD = "(CASE {} " + " ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(GRADES)) + " END)"


@R.add(f"SELECT obligor_id, max({_ORD.format('rating_after')} - {_ORD.format('rating')}) AS notches, arg_max(rating_after, {_ORD.format('rating_after')}) AS worst FROM ({_STRESSED}) WHERE rating_after <> rating GROUP BY obligor_id")
def worst_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credit.worst_migration(credit.stress(book(spark, sf_dir), own_scenarios(spark))).select("obligor_id", "notches", "worst")


# Episodes and events from orders: a priority is a type, a quarter an episode, its factors are averages by status.

def episode_shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    q = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    return o.groupBy(q.alias("episode_id"), F.concat(F.lit("f_"), F.col("o_orderstatus")).alias("factor")).agg(F.round(F.avg("o_totalprice") / 1e4 - 15, 4).alias("shock"), F.to_date(F.max("o_orderdate")).alias("day"))


_SHOCKS = "SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS episode_id, 'f_' || o_orderstatus AS factor, round(avg(o_totalprice) / 1e4 - 15, 4) AS shock, max(o_orderdate)::DATE AS day FROM orders GROUP BY ALL"


@R.add(f"""WITH s AS ({_SHOCKS}), e AS (SELECT episode_id, max(day) AS "end", substr(episode_id, 6, 1) AS kind FROM s GROUP BY episode_id), v AS (SELECT episode_id AS event_id, kind, "end" AS as_of FROM e),
c AS (SELECT v.event_id, e.episode_id, (CASE WHEN e.kind = v.kind THEN 1.0 WHEN e.kind::INT = v.kind::INT - 1 THEN 0.4 ELSE 0.0 END) * exp(12 * (0.5 - 0.01 * abs(hash_dist))) AS score FROM (SELECT v.*, 0 AS z FROM v) v JOIN e ON e."end" < v.as_of, LATERAL (SELECT (substr(v.event_id, 1, 4)::INT - substr(e.episode_id, 1, 4)::INT) AS hash_dist)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, episode_id) AS place FROM c WHERE score > 0), w AS (SELECT event_id, episode_id, score / sum(score) OVER (PARTITION BY event_id) AS weight FROM r WHERE place <= 3),
near AS (SELECT event_id, factor, sum(weight * shock) / sum(weight) AS shock FROM w JOIN s USING (episode_id) GROUP BY ALL),
mean AS (SELECT v.event_id, factor, avg(shock) AS shock FROM v JOIN e ON e."end" < v.as_of JOIN s USING (episode_id) GROUP BY ALL)
SELECT coalesce(n.event_id, m.event_id) AS event_id, coalesce(n.factor, m.factor) AS factor, round(0.5 * coalesce(n.shock, m.shock) + 0.5 * coalesce(m.shock, n.shock), 6) AS shock FROM near n FULL JOIN mean m ON n.event_id = m.event_id AND n.factor = m.factor""")
def scenario_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    shocks = episode_shocks(spark, sf_dir)
    episodes = shocks.groupBy("episode_id").agg(F.max("day").alias("end")).select("episode_id", "end", F.substring("episode_id", 6, 1).alias("event_type"), F.lit(False).alias("extreme"))
    events = episodes.select(F.col("episode_id").alias("event_id"), "event_type", F.col("end").alias("as_of"), F.lit(8.0).alias("impact"))
    pairs = scenarios.eligible(events, episodes)
    years = F.abs(F.substring("event_id", 1, 4).cast("int") - F.substring("episode_id", 1, 4).cast("int"))
    near = scenarios.blend(scenarios.rank_analogs(pairs, {"2": ["1"], "3": ["2"], "4": ["3"]}, 0.5 - 0.01 * years), shocks)
    mean = scenarios.blend(pairs.withColumn("weight", F.lit(1.0)), shocks)
    return scenarios.mixed(near, mean).withColumn("shock", F.round("shock", 6))


@R.add(f"""WITH l AS (SELECT scenario_id, CASE WHEN obligor_id = 'C1' THEN position_id::VARCHAR ELSE obligor_id END AS name, round(sum(pnl), 2) AS pnl FROM ({_STRESSED}) GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY pnl, name) AS r FROM l WHERE pnl < 0)
SELECT scenario_id, count(*) AS losers, round(sum(pnl) FILTER (r <= 3) / sum(pnl), 6) AS top_three FROM n GROUP BY scenario_id""")
def loss_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of all losses the three largest are; trades of the house C1 count one by one."""
    rows = credit.stress(book(spark, sf_dir), own_scenarios(spark))
    return credit.concentration(rows, "C1").select("scenario_id", "losers", F.round("top", 6).alias("top_three"))


@R.add(f"""WITH p AS (SELECT obligor_id, round(sum(pnl), 2) AS pnl FROM ({_STRESSED}) WHERE scenario_id = 'crash' GROUP BY obligor_id)
SELECT 'C' || c_custkey AS obligor_id, round(least(coalesce(pnl, 0), 0), 0) + 0e0 AS hit FROM customer LEFT JOIN p ON p.obligor_id = 'C' || c_custkey WHERE c_acctbal < 0 ORDER BY least(coalesce(pnl, 0), 0), c_acctbal, c_custkey""")
def names_to_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged names, those that the crash hits hardest first, the others in the list's own order."""
    pnl = credit.stress(book(spark, sf_dir), own_scenarios(spark)).where("scenario_id = 'crash'").groupBy("obligor_id").agg(F.round(F.sum("pnl"), 2).alias("pnl"))
    listed = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("C"), "c_custkey").alias("obligor_id"), "c_acctbal", "c_custkey")
    hit = F.least(F.coalesce("pnl", F.lit(0.0)), F.lit(0.0))
    return listed.join(pnl, "obligor_id", "left").orderBy(hit, "c_acctbal", "c_custkey").select("obligor_id", (F.round(hit, 0) + 0.0).alias("hit"))


_TEMPLATES = {"1": {"f_F": -2.0, "f_O": 1.0}, "2": {"f_F": 1.5, "f_P": -1.0}, "3": {"f_O": -2.5, "f_P": 2.0}}
_NAIVE = {"f_F": -1.0, "f_O": -1.0}
_EXPOSURE = {"f_F": 2.0, "f_O": -1.0, "f_P": 0.5}
_OWN_OVERLAYS = [("OIL", "f_F", 30.0), ("GAS", "f_F", 15.0), ("GOLD", "f_O", 10.0), ("SPX", "f_P", 8.0)]
_PRICES = {"1-URGENT": "OIL", "2-HIGH": "GAS", "3-MEDIUM": "GOLD", "4-NOT SPECIFIED": "SPX"}


def _templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, f, v) for t, fs in _TEMPLATES.items() for f, v in fs.items()], "event_type string, factor string, shock double")


_T = "(VALUES " + ", ".join(f"('{t}', '{f}', {v}::DOUBLE)" for t, fs in _TEMPLATES.items() for f, v in fs.items()) + ") t(kind, factor, shock)"
_HISTORY = f"""s AS ({_SHOCKS}), e AS (SELECT episode_id, max(day) AS "end", substr(episode_id, 6, 1) AS kind FROM s GROUP BY episode_id), v AS (SELECT episode_id AS event_id, kind, "end" AS as_of FROM e),
pr AS (SELECT v.event_id, v.kind, e.episode_id, e.kind AS other, (CASE WHEN e.kind = v.kind THEN 1.0 WHEN e.kind::INT = v.kind::INT - 1 THEN 0.4 ELSE 0.0 END) * exp(12 * (0.5 - 0.01 * abs(substr(v.event_id, 1, 4)::INT - substr(e.episode_id, 1, 4)::INT))) AS score FROM v JOIN e ON e."end" < v.as_of),
rk AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, episode_id) AS place FROM pr WHERE score > 0),
near AS (SELECT event_id, factor, sum(score * shock) / sum(score) AS shock FROM rk JOIN s USING (episode_id) WHERE place <= 3 GROUP BY ALL), mean AS (SELECT event_id, factor, avg(shock) AS shock FROM pr JOIN s USING (episode_id) GROUP BY ALL),
mix AS (SELECT coalesce(n.event_id, m.event_id) AS event_id, coalesce(n.factor, m.factor) AS factor, 0.5 * coalesce(n.shock, m.shock) + 0.5 * coalesce(m.shock, n.shock) AS shock FROM near n FULL JOIN mean m ON n.event_id = m.event_id AND n.factor = m.factor)"""


def history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Shocks, pairs of events and earlier episodes, and what the nearest and all of these say."""
    shocks = checkpointed(episode_shocks(spark, sf_dir))  # a few rows a quarter, read many times
    episodes = shocks.groupBy("episode_id").agg(F.max("day").alias("end")).select("episode_id", "end", F.substring("episode_id", 6, 1).alias("event_type"), F.lit(False).alias("extreme"))
    events = episodes.select(F.col("episode_id").alias("event_id"), "event_type", F.col("end").alias("as_of"), F.lit(8.0).alias("impact"))
    pairs = scenarios.eligible(events, episodes)
    years = F.abs(F.substring("event_id", 1, 4).cast("int") - F.substring("episode_id", 1, 4).cast("int"))
    near = scenarios.blend(scenarios.rank_analogs(pairs, {"2": ["1"], "3": ["2"], "4": ["3"]}, 0.5 - 0.01 * years), shocks)
    return shocks, pairs, near, scenarios.blend(pairs.withColumn("weight", F.lit(1.0)), shocks)


@R.add(f"""WITH {_HISTORY}, ev AS (SELECT event_id, kind, 4.0 + (substr(event_id, 4, 1)::INT) AS impact, greatest(0.25, least(1.35, substr(event_id, 4, 1)::INT / 4.5)) AS sv FROM v),
b AS (SELECT event_id, factor, round(shock * sv, 2) AS shock, 'analog' AS method FROM mix JOIN ev USING (event_id) UNION ALL SELECT event_id, factor, round(t.shock * sv, 2), 'template' FROM ev JOIN {_T} ON t.kind = CASE WHEN ev.kind IN ('1', '2', '3') THEN ev.kind ELSE '1' END WHERE event_id NOT IN (SELECT event_id FROM mix)),
mv AS (SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS event_id, o_orderpriority AS price, count(*) FILTER (o_totalprice >= 150000) AS up, count(*) FILTER (o_totalprice < 150000) AS down FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL),
o AS (SELECT event_id, price, (CASE price WHEN '1-URGENT' THEN 30.0 WHEN '2-HIGH' THEN 15.0 WHEN '3-MEDIUM' THEN 10.0 ELSE 8.0 END) * (up - down) / (up + down)::DOUBLE AS implied, CASE price WHEN '3-MEDIUM' THEN 'f_O' WHEN '4-NOT SPECIFIED' THEN 'f_P' ELSE 'f_F' END AS factor FROM mv WHERE up + down >= 5 AND abs(up - down) / (up + down)::DOUBLE >= 0.2),
i AS (SELECT event_id, factor, round(arg_min(implied, price) * any_value(sv), 2) AS told FROM o JOIN ev USING (event_id) GROUP BY ALL)
SELECT coalesce(b.event_id, i.event_id) AS event_id, coalesce(b.factor, i.factor) AS factor, round(coalesce(told, b.shock), 1) AS shock, CASE WHEN told IS NOT NULL THEN 'stated' ELSE method END AS method FROM b FULL JOIN i ON b.event_id = i.event_id AND b.factor = i.factor""")
def event_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    shocks, pairs, near, mean = history(spark, sf_dir)
    events = shocks.select(F.col("episode_id").alias("event_id")).distinct().select("event_id", F.substring("event_id", 6, 1).alias("event_type"), (4.0 + F.substring("event_id", 4, 1).cast("int")).alias("impact"))
    names = F.create_map(*[F.lit(x) for kv in _PRICES.items() for x in kv])
    q = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    moves = table(spark, sf_dir, "orders").groupBy(q.alias("event_id"), names[F.col("o_orderpriority")].alias("price")).agg(F.count_if(F.col("o_totalprice") >= 150000).alias("up"), F.count_if(F.col("o_totalprice") < 150000).alias("down")).where("price is not null")
    made = scenarios.for_events(events, scenarios.mixed(near, mean), _templates(spark), moves, "1", _OWN_OVERLAYS)
    return made.withColumn("shock", F.round("shock", 1))


@R.add(f"""WITH {_HISTORY}, k AS (SELECT event_id, kind FROM pr GROUP BY ALL HAVING count(*) >= 4), sm AS (SELECT event_id, factor, avg(shock) AS shock FROM pr JOIN s USING (episode_id) WHERE other = pr.kind GROUP BY ALL),
c AS (SELECT event_id, 'naive' AS method, factor, shock FROM k, (VALUES {", ".join(f"('{f}', {v}::DOUBLE)" for f, v in _NAIVE.items())}) n(factor, shock) UNION ALL SELECT event_id, 'template', factor, shock FROM k JOIN {_T} ON t.kind = CASE WHEN k.kind IN ('1', '2', '3') THEN k.kind ELSE '1' END
 UNION ALL SELECT event_id, 'all_mean', factor, shock FROM mean SEMI JOIN k USING (event_id) UNION ALL SELECT event_id, 'same_type_mean', factor, shock FROM sm SEMI JOIN k USING (event_id) UNION ALL SELECT event_id, 'same_type_mean', factor, shock FROM mean SEMI JOIN k USING (event_id) WHERE event_id NOT IN (SELECT event_id FROM sm)
 UNION ALL SELECT event_id, 'nearest', factor, shock FROM near SEMI JOIN k USING (event_id) UNION ALL SELECT event_id, 'blended', factor, shock FROM mix SEMI JOIN k USING (event_id)),
x AS (SELECT c.event_id, method, c.factor, round(c.shock, 2) AS shock, s.shock AS realised, CASE c.factor {" ".join(f"WHEN '{f}' THEN {v}" for f, v in _EXPOSURE.items())} END AS ex FROM c JOIN s ON s.episode_id = c.event_id AND s.factor = c.factor),
h AS (SELECT method, count(*) FILTER (shock * realised > 0) / count(*) AS hit_rate FROM x WHERE abs(realised) >= 1 GROUP BY method),
rl AS (SELECT episode_id AS event_id, sum(shock * CASE factor {" ".join(f"WHEN '{f}' THEN {v}" for f, v in _EXPOSURE.items())} END) AS pnl FROM s GROUP BY episode_id),
er AS (SELECT event_id, method, round(abs(coalesce(p, 0) - pnl), 4) AS error FROM (SELECT event_id, method, sum(shock * ex) AS p FROM x GROUP BY ALL) RIGHT JOIN (SELECT DISTINCT event_id, method FROM c) USING (event_id, method) JOIN rl USING (event_id)),
ag AS (SELECT event_id, max(error) FILTER (method = 'naive') AS na, max(error) FILTER (method = 'all_mean') AS me FROM er GROUP BY event_id)
SELECT method, count(*) AS episodes, round(avg(error), 2) AS error_mean, round(median(error), 2) AS error_median, count(*) FILTER (error < na) AS closer_than_naive, count(*) FILTER (error < me) AS closer_than_average, round(any_value(hit_rate), 6) AS hit_rate FROM er JOIN ag USING (event_id) LEFT JOIN h USING (method) GROUP BY method""")
def scenario_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    shocks, pairs, near, mean = history(spark, sf_dir)
    said = scenarios.candidates(pairs, shocks, near, mean, _NAIVE, _templates(spark), "1")
    realised = shocks.select(F.col("episode_id").alias("event_id"), "factor", F.col("shock").alias("realised"))
    exposure = spark.createDataFrame(list(_EXPOSURE.items()), "factor string, exposure double")
    units = exposure.select("factor", F.lit("pct").alias("unit"))
    b = scenarios.backtest(said, realised, exposure, units)
    return b.select("method", "episodes", F.round("error_mean", 2).alias("error_mean"), F.round("error_median", 2).alias("error_median"), "closer_than_naive", "closer_than_average", F.round("hit_rate", 6).alias("hit_rate"))


_OVERRIDES = [("f_F", -7.5), ("f_X", 2.0)]
_LAST = f"""l AS (SELECT episode_id AS event_id, factor, shock FROM ({_SHOCKS}))"""


@R.add(f"""WITH {_LAST}, o AS (SELECT event_id, factor, shock FROM (SELECT DISTINCT event_id FROM l), (VALUES {", ".join(f"('{f}', {v}::DOUBLE)" for f, v in _OVERRIDES)}) v(factor, shock))
SELECT coalesce(l.event_id, o.event_id) AS event_id, coalesce(l.factor, o.factor) AS factor, coalesce(o.shock, l.shock) AS shock FROM l FULL JOIN o ON l.event_id = o.event_id AND l.factor = o.factor""")
def scenario_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quarter's shocks with an analyst's factors put over them."""
    base = episode_shocks(spark, sf_dir).select(F.col("episode_id").alias("event_id"), "factor", "shock")
    own = F.explode(F.create_map(*[F.lit(x) for kv in _OVERRIDES for x in kv])).alias("factor", "shock")
    return scenarios.overridden(base, base.select("event_id").distinct().select("event_id", own))


_OWN_MOVES = [("finished orders", ["f_F"], "shrink", "grow", 0.2), ("other orders", ["f_O", "f_P"], "shrink", "grow", 0.5)]


@R.add(f"""WITH s AS ({_SHOCKS}), m AS (SELECT episode_id, avg(shock) FILTER (factor = 'f_F') AS f, avg(shock) FILTER (factor IN ('f_O', 'f_P')) AS o FROM s GROUP BY episode_id)
SELECT episode_id, concat_ws(', ', CASE WHEN abs(f) >= 0.2 THEN 'finished orders ' || CASE WHEN f > 0 THEN 'grow' ELSE 'shrink' END END, CASE WHEN abs(o) >= 0.5 THEN 'other orders ' || CASE WHEN o > 0 THEN 'grow' ELSE 'shrink' END END) AS words FROM m""")
def scenario_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quarter's direction in words."""
    return scenarios.in_words(episode_shocks(spark, sf_dir), "episode_id", _OWN_MOVES)


_ENDS = """SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS episode_id, o_orderstatus AS status, avg(o_totalprice) FILTER (month(o_orderdate) % 3 = 1) / 1e4 AS a, avg(o_totalprice) FILTER (month(o_orderdate) % 3 = 0) / 1e4 AS b,
  avg(o_totalprice) FILTER (month(o_orderdate) % 3 = 2) / 1e4 AS c FROM orders GROUP BY ALL"""
_UNITS = {"F": ("pct", None, False, True), "O": ("bp", None, False, False), "P": ("bp", 4.5, False, True), "X": ("pct", None, True, False), "Y": ("pts", None, False, False)}


@R.add(f"""WITH e AS ({_ENDS}), u AS (SELECT e.*, k FROM e, (SELECT unnest(['F', 'O', 'P', 'X', 'Y']) AS k))
SELECT episode_id, status, k AS kind, round(CASE k WHEN 'F' THEN (b / a - 1) * 100 - (b / c - 1) * 100 WHEN 'O' THEN (b - a) * 100 WHEN 'P' THEN -((b / a - 1) - (b / c - 1)) / 4.5 * 1e4 WHEN 'X' THEN (a / b - 1) * 100 ELSE b - a END, 6) AS shock FROM u""")
def measured_shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of prices over a quarter in every unit: percent less a reference, yield in basis points, spread implied by two moves over a duration, inverted percent, and points."""
    month, price = F.month("o_orderdate") % 3, F.col("o_totalprice")
    q = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    mean = lambda m: (F.avg(F.when(month == m, price)) / 1e4)
    ends = table(spark, sf_dir, "orders").groupBy(q.alias("episode_id"), F.col("o_orderstatus").alias("status")).agg(mean(1).alias("a"), mean(0).alias("b"), (F.avg(F.when(month == 2, price)) / 1e4).alias("c"))
    kinds = spark.createDataFrame([(k, *v) for k, v in _UNITS.items()], "kind string, unit string, duration double, invert boolean, against boolean")
    rows = ends.crossJoin(F.broadcast(kinds))  # five kinds
    against = lambda c: F.when(F.col("against"), F.col(c))
    shock = scenarios.measured(F.col("unit"), F.col("a"), F.col("b"), against("c"), against("b"), F.col("duration"), F.col("invert"))
    return rows.select("episode_id", "status", "kind", F.round(shock, 6).alias("shock"))


@R.add(f"""WITH {_HISTORY}, c AS (SELECT event_id, 'nearest' AS method, factor, shock FROM near UNION ALL SELECT event_id, 'all_mean', factor, shock FROM mean UNION ALL SELECT event_id, 'blended', factor, shock FROM mix)
SELECT method, c.factor, count(*) AS scored, count(*) FILTER (round(c.shock, 2) * s.shock > 0) AS hits, round(count(*) FILTER (round(c.shock, 2) * s.shock > 0) / count(*), 6) AS rate FROM c JOIN s ON s.episode_id = c.event_id AND s.factor = c.factor WHERE abs(s.shock) >= CASE c.factor WHEN 'f_P' THEN 5 ELSE 1 END GROUP BY ALL""")
def backtest_by_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each method had the direction of each factor right."""
    shocks, _, near, mean = history(spark, sf_dir)
    named = lambda df, name: df.select("event_id", F.lit(name).alias("method"), "factor", "shock")
    said = named(near, "nearest").unionByName(named(mean, "all_mean")).unionByName(named(scenarios.mixed(near, mean), "blended"))
    realised = shocks.select(F.col("episode_id").alias("event_id"), "factor", F.col("shock").alias("realised"))
    units = shocks.select("factor").distinct().withColumn("unit", F.when(F.col("factor") == "f_P", "bp").otherwise("pct"))
    return scenarios.factor_hits(said, realised, units).withColumn("rate", F.round("rate", 6))


@R.add(f"""WITH s AS ({_SHOCKS}), e AS (SELECT episode_id, max(day) AS "end", max(abs(shock)) >= 1 AS extreme, 7 + least(3, max(abs(shock))) AS impact FROM s GROUP BY episode_id)
SELECT v.episode_id AS event_id, count(*) AS episodes, count(*) FILTER (e.extreme) AS extreme FROM e v JOIN e ON e."end" < v."end" AND (NOT e.extreme OR v.impact >= 9.5) GROUP BY v.episode_id""")
def extreme_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many earlier quarters may serve as a model for each, extreme ones only where the impact is."""
    quarters = episode_shocks(spark, sf_dir).groupBy("episode_id").agg(F.max("day").alias("end"), F.max(F.abs("shock")).alias("most"))
    episodes = quarters.select("episode_id", "end", F.lit("q").alias("event_type"), (F.col("most") >= 1).alias("extreme"))
    events = quarters.select(F.col("episode_id").alias("event_id"), F.lit("q").alias("event_type"), F.col("end").alias("as_of"), (7 + F.least(F.lit(3.0), "most")).alias("impact"))
    pairs = scenarios.eligible(events, episodes)
    return pairs.groupBy("event_id").agg(F.count("*").alias("episodes"), F.count_if("extreme").alias("extreme"))


_BOND = {"coupon": "0.02e0 + (o_orderkey % 7) / 100e0", "y": "0.01e0 + (o_custkey % 5) / 100e0", "years": "0.25e0 * (1 + o_orderkey % 40)"}


@R.add(f"""WITH b AS (SELECT o_orderkey, {", ".join(f"{e} AS {n}" for n, e in _BOND.items())} FROM orders), t AS (SELECT *, list_transform(range(1, greatest(ceil(years), 1)::BIGINT + 1), lambda k: years - greatest(ceil(years), 1) + k) AS ts FROM b),
f AS (SELECT *, list_sum(list_transform(ts, lambda t: CASE WHEN t >= years - 1e-9 THEN coupon + 1 ELSE coupon END * pow(1 + y, -t))) AS price, list_sum(list_transform(ts, lambda t: t * CASE WHEN t >= years - 1e-9 THEN coupon + 1 ELSE coupon END * pow(1 + y, -t))) AS d,
 list_sum(list_transform(ts, lambda t: t * (t + 1) * CASE WHEN t >= years - 1e-9 THEN coupon + 1 ELSE coupon END * pow(1 + y, -t))) AS c FROM t)
SELECT o_orderkey, round(d / price / (1 + y), 6) AS duration, round(c / price / pow(1 + y, 2), 6) AS convexity FROM f""")
def bond_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modified duration and convexity of a bond for every order, broken first years among them."""
    from tidemark.functions.numeric import bond_duration

    rows = table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(e).alias(n) for n, e in _BOND.items()])
    found = rows.select("o_orderkey", bond_duration(F.col("coupon"), F.col("y"), F.col("years")).alias("b"))
    return found.select("o_orderkey", F.round("b.duration", 6).alias("duration"), F.round("b.convexity", 6).alias("convexity"))
