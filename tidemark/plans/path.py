"""Queries over the event path: cue rules, stories, events, entities, the watch list and signals at openings, over documents with made-up scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import cues as C
from tidemark.functions import text as T
from tidemark.operators import event_path as P
from tidemark.operators.shared import checkpointed
from tidemark.plans.common import Registry, table

R = Registry()

TYPES = ["GEOPOLITICAL", "CREDIT_EVENT", "REGULATORY", "MARKET_COMMENTARY", "MACROECONOMIC", "OTHER"]
BASE = {"GEOPOLITICAL": 5.5, "CREDIT_EVENT": 6.0, "REGULATORY": 4.0, "MARKET_COMMENTARY": 3.0, "MACROECONOMIC": 5.0, "OTHER": 1.0}
#: Cues of each type, and of severe language; the tables' words are invented, so each document is read with one of the headlines in front.
CUES = {
    "GEOPOLITICAL": [r"\b(war|invasion|missiles?|airstrikes?)\b", r"\bsanctions?\b", r"\b(troops|ceasefire)\b"], "CREDIT_EVENT": [r"\b(default(s|ed)?|bankruptcy|insolven\w+)\b", r"\bdowngrad\w+\b", r"\bbank run\b"],
    "REGULATORY": [r"\b(antitrust|regulators?|fine[ds]?)\b", r"\blawsuit\b"], "MARKET_COMMENTARY": [r"\b(analysts?|traders?|outlook)\b"], "MACROECONOMIC": [r"\b(inflation|rate hike|recession)\b"], "OTHER": [],
}
SEVERITY = {"extreme": r"\b(invasion|collapse[ds]?|default(s|ed)?)\b", "high": r"\b(plunge[ds]?|crisis|missiles?)\b", "scale": r"\b[0-9]+ (billion|million)\b"}
HEADLINES = [
    "Grocery price war squeezes margins", "Silent war between two retailers", "War on inflation drags on", "Troops cross border as war begins", "Ticking time bomb on balance sheets", "Missiles hit port, sanctions follow",
    "Analyst downgrades stock to sell", "Agency downgrades bank after default", "Lawmakers hold hearings on lenders", "Senators testify about sanctions", "Antitrust lawsuit and a fine of 3 billion", "War chest grows as outlook brightens",
    "Recession fears and a rate hike", "Streaming wars: traders plunge in", "Lender defaulted in bankruptcy crisis", "Nothing much happened today",
]


def _list_sql(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _hits_sql(name: str, text: str = "lit") -> str:
    return "(" + (" + ".join(f"regexp_matches({text}, '(?i){p}')::INT" for p in CUES[name]) or "0") + ")"


_RAW = ", ".join(f"((doc_id * {i + 2}) % 7 + 1 + CASE WHEN doc_id % 12 % 6 = {i} THEN 6 ELSE 0 END)::DOUBLE" for i in range(6))
_CUE_SQL = f"""
WITH h AS (SELECT doc_id, {_list_sql(HEADLINES)}[(doc_id % 16 + 1)::INT] || '. ' || coalesce(text, '') AS said, doc_id % 4 = 0 AS geo, doc_id % 8 = 0 AS abroad, [{_RAW}] AS raw FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(said, '\\b((?:price|pricing|bidding|talent|streaming|console|culture|fare|format|flame|turf|patent|browser|cola|subscription|search|cloud|smartphone|delivery|grocery|discount|deposit)\\s+)wars?\\b', '\\1 ', 'gi'), '\\b(god of )war\\b', '\\1 ', 'gi'), '\\b(star )wars\\b', '\\1 ', 'gi'), '\\bwar( (?:chest|room)s?)\\b', ' \\1', 'gi') AS always FROM h),
x AS (SELECT *, CASE WHEN geo THEN always ELSE regexp_replace(regexp_replace(always, '\\b((?:silent|secret|quiet|stealth)\\s+)wars?\\b', '\\1 ', 'gi'), '\\bwar( (?:on|against) (?:inflation|cash|talent|counterfeits?|fraud|waste|costs?|prices|bots|spam))\\b', ' \\1', 'gi') END AS now FROM w),
y AS (SELECT *, CASE WHEN geo THEN now ELSE regexp_replace(now, '\\b(?:ticking\\s+)?time[- ]?bombs?\\b', ' ', 'gi') END AS lit FROM x),
c AS (SELECT *, {", ".join(f"{_hits_sql(t)} AS c{i}" for i, t in enumerate(TYPES))}, regexp_matches(said, '(?i)\\b(upgrad\\w+|downgrad\\w+|initiat\\w+|reiterat\\w+)\\b.{{0,60}}\\b(buy|sell|hold|neutral|overweight|underweight|outperform|underperform|price target|equal[- ]weight|market perform)\\b|\\bprice target\\b') AS rating,
  regexp_matches(said, '(?i)\\b(congress\\w*|senat(?:e|ors?)|lawmakers?|legislat\\w+|lobb(?:y|ied|ying|yists?)|repeal\\w*|deregulat\\w+|dodd-frank|white house|governor|hearings?|testif\\w+|regulators?)\\b') AS home,
  len(regexp_extract_all(lit, '(?i){SEVERITY["extreme"]}')) AS extreme, len(regexp_extract_all(lit, '(?i){SEVERITY["high"]}')) AS high, len(regexp_extract_all(lit, '(?i){SEVERITY["scale"]}')) AS scale FROM y),
g AS (SELECT * REPLACE (c1 - (c1 > 0 AND rating)::INT AS c1, c3 + (c1 > 0 AND rating)::INT AS c3), lit <> said AND c0 = 0 AND now <> said AS fig_war, lit <> said AND c0 = 0 AND now = said AS fig_bomb, NOT abroad AND c0 = 0 AND home AS domestic FROM c),
p AS (SELECT *, list_sum(raw) AS total, fig_war OR fig_bomb OR domestic AS moved FROM g),
q AS (SELECT *, [CASE WHEN moved THEN 0 ELSE raw[1] END * (1 + 0.5 * c0), raw[2] * (1 + 0.5 * c1), (raw[3] + CASE WHEN domestic AND NOT fig_war AND NOT fig_bomb THEN raw[1] ELSE 0 END) * (1 + 0.5 * c2), (raw[4] + CASE WHEN fig_war THEN raw[1] ELSE 0 END) * (1 + 0.5 * c3), raw[5] * (1 + 0.5 * c4), raw[6] * (1 + 0.5 * c5)] AS bent FROM p)
SELECT doc_id, c0::INT AS geopolitical, c1::INT AS credit, c2::INT AS regulatory, c3::INT AS commentary, c4::INT AS macro, extreme::INT AS extreme, high::INT AS high, scale::INT AS scale, fig_war, fig_bomb, domestic,
  round(bent[1] / list_sum(bent), 6) AS p_geopolitical, round(bent[3] / list_sum(bent), 6) AS p_regulatory, round(bent[4] / list_sum(bent), 6) AS p_commentary FROM q
"""


def _probs() -> F.Column:
    raw = F.array(*[((F.col("doc_id") * (i + 2)) % 7 + 1 + F.when(F.col("doc_id") % 12 % 6 == i, 6).otherwise(0)).cast("double") for i in range(6)])
    return T.bound(raw, lambda r: F.transform(r, lambda p: p / F.aggregate(r, F.lit(0.0), lambda a, x: a + x)))


@R.add(_CUE_SQL)
def cue_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    headline = F.element_at(F.array(*map(F.lit, HEADLINES)), (F.col("doc_id") % 16 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.concat(headline, F.lit(". "), F.coalesce("text", F.lit(""))).alias("said"), _probs().alias("probs"))
    rows = docs.withColumn("h", C.cue_hits(F.col("said"), F.col("doc_id") % 4 == 0, F.col("doc_id") % 8 == 0, CUES, SEVERITY)).withColumn("p", C.fused(F.col("probs"), F.col("h"), TYPES))
    by, names = F.col("h.by_type"), ("geopolitical", "credit", "regulatory", "commentary", "macro")
    r = lambda i: F.round(F.get("p", F.lit(i)), 6)
    return rows.select("doc_id", *[by[t].alias(n) for t, n in zip(TYPES, names, strict=False)], *[F.col("h.severity")[k].alias(k) for k in SEVERITY], F.col("h.figurative_war").alias("fig_war"), F.col("h.figurative_bomb").alias("fig_bomb"), F.col("h.domestic_policy").alias("domestic"), r(0).alias("p_geopolitical"), r(2).alias("p_regulatory"), r(3).alias("p_commentary"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with made-up scores, stories and events, for want of a trained model and of a news stream."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select(
        "doc_id", F.timestamp_seconds(F.lit(1704067200) + (i * 977) % 604800).alias("at"), F.when(i % 3 == 0, "social").otherwise("news").alias("kind"), F.col("source").alias("publisher"),
        F.concat(F.lit("v"), i % 12).alias("event_id"), F.concat(F.lit("s"), i % 60).alias("story_id"), (((i * 7919) % 201 - 100) / 100.0).alias("sentiment"), (((i * 31) % 100) / 100.0).alias("neutral"),
        (((i * 17) % 50) / 100.0 + 0.5).alias("relevance"), (((i * 13) % 100) / 100.0).alias("similarity"), F.regexp_extract("text", "^[^.!?]*", 0).alias("headline"), _probs().alias("probs"),
        (i % 11 == 0).alias("extreme"), (i % 7 == 0).alias("high"), (i % 5 == 0).alias("scale"), (i % 4 == 0).alias("market"),
        F.array_distinct(F.array(F.concat(F.lit("N"), i % 25), F.concat(F.lit("N"), (i * 7) % 25))).alias("entities"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("fp"),
    )
    return checkpointed(P.mark_duplicates(docs, "fp").drop("fp"))  # without texts; all that follows reads this


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as entities: regions are sectors, and every third is a country in the sense of the path, the others companies."""
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("entity"), F.concat(F.lit("R"), "n_regionkey").alias("sector"), F.when(F.col("n_nationkey") % 3 == 0, "country").otherwise("company").alias("type"))


_SCORED = f"""
d AS (SELECT doc_id, TIMESTAMP '2024-01-01' + to_seconds((doc_id * 977) % 604800) AS moment, CASE WHEN doc_id % 3 = 0 THEN 'social' ELSE 'news' END AS kind, source AS publisher, 'v' || (doc_id % 12) AS event_id, 's' || (doc_id % 60) AS story_id,
  ((doc_id * 7919) % 201 - 100) / 100.0::DOUBLE AS sentiment, ((doc_id * 31) % 100) / 100.0::DOUBLE AS neutral, ((doc_id * 17) % 50) / 100.0::DOUBLE + 0.5 AS relevance, ((doc_id * 13) % 100) / 100.0::DOUBLE AS similarity, regexp_extract(text, '^[^.!?]*') AS headline,
  list_transform([{_RAW}], lambda r: r / list_sum([{_RAW}])) AS probs, doc_id % 11 = 0 AS extreme, doc_id % 7 = 0 AS high, doc_id % 5 = 0 AS scale, doc_id % 4 = 0 AS market,
  CASE WHEN doc_id % 25 = (doc_id * 7) % 25 THEN ['N' || (doc_id % 25)] ELSE ['N' || (doc_id % 25), 'N' || ((doc_id * 7) % 25)] END AS entities, coalesce(text, '') AS fp FROM documents WHERE doc_id IS NOT NULL),
sd AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY moment, doc_id) > 1 AS dup FROM d),
sw AS (SELECT *, CASE WHEN dup THEN 0 ELSE CASE kind WHEN 'news' THEN 1.0 ELSE 0.35 END * relevance * (0.1 + 0.9 * (1 - neutral)) END AS w FROM sd),
em AS (SELECT 'N' || n_nationkey AS entity, 'R' || n_regionkey AS sector, CASE WHEN n_nationkey % 3 = 0 THEN 'country' ELSE 'company' END AS type FROM nation),
st AS (SELECT event_id, story_id, min(moment) AS first_seen, count(*) AS n_docs, count(DISTINCT publisher) AS n_publishers, coalesce(sum(w * sentiment) / nullif(sum(w), 0), 0) AS sentiment,
  arg_max(headline, struct_pack(a := kind = 'news', b := similarity, c := -doc_id)) FILTER (NOT dup AND headline IS NOT NULL) AS headline, coalesce(max(CASE WHEN NOT dup THEN market::INT END), 0) + coalesce(max(CASE WHEN NOT dup THEN (extreme OR high)::INT END), 0) AS told FROM sw GROUP BY ALL),
ev AS (SELECT event_id, min(moment) AS first_seen, max(moment) AS last_seen, count(*) AS n_docs, count(*) FILTER (NOT dup) AS n_scored, count(DISTINCT publisher) AS n_publishers, count(*) FILTER (NOT dup AND kind = 'news') AS n_news, count(*) FILTER (NOT dup AND kind <> 'news') AS n_social,
  sum(w * sentiment) / sum(w) AS sentiment, {", ".join(f"sum(w * probs[{i + 1}]) / sum(w) AS p{i}" for i in range(6))},
  count(*) FILTER (NOT dup AND extreme) AS extreme_docs, count(*) FILTER (NOT dup AND high) AS high_docs, count(*) FILTER (NOT dup AND scale) AS scale_docs, count(*) FILTER (NOT dup AND market) AS market_docs FROM sw GROUP BY event_id),
et AS (SELECT *, CASE greatest(p0, p1, p2, p3, p4, p5) {" ".join(f"WHEN p{i} THEN '{t}'" for i, t in enumerate(TYPES))} END AS event_type, greatest(p0, p1, p2, p3, p4, p5) AS confidence FROM ev),
sr AS (SELECT st.*, row_number() OVER (PARTITION BY event_id ORDER BY (st.first_seen >= last_seen - INTERVAL 12 HOUR AND st.n_publishers >= 3) DESC, st.n_publishers * (1 + told) DESC, st.n_docs DESC, st.first_seen, story_id) AS place FROM st JOIN ev USING (event_id)),
fs AS (SELECT event_id, count(*) AS n_stories, count(*) FILTER (st.first_seen >= last_seen - INTERVAL 1 HOUR) AS stories_last_hour FROM st JOIN ev USING (event_id) GROUP BY event_id),
rp AS (SELECT event_id, count(*) FILTER (moment >= last_seen - INTERVAL 1 HOUR) AS reports_last_hour FROM sw JOIN ev USING (event_id) GROUP BY event_id),
mx AS (SELECT event_id, moment, doc_id, sentiment, w, unnest(entities) AS entity, unnest(range(0, len(entities))) AS i FROM sw WHERE NOT dup),
mn AS (SELECT event_id, entity, count(*) AS mentions, coalesce(sum(w * sentiment) / nullif(sum(w), 0), 0) AS sentiment, row_number() OVER (PARTITION BY event_id ORDER BY count(*) DESC, min(struct_pack(a := moment, b := doc_id, c := i))) AS place FROM mx GROUP BY event_id, entity),
br AS (SELECT event_id, string_agg(mn.entity, ',' ORDER BY place) AS entities, count(DISTINCT sector) AS n_sectors, count(*) FILTER (type = 'country') AS n_regions FROM mn LEFT JOIN em USING (entity) WHERE place <= 12 GROUP BY event_id),
ea AS (SELECT et.*, n_stories, stories_last_hour, reports_last_hour, sr.headline, coalesce(br.entities, '') AS entities, coalesce(n_sectors, 0) AS n_sectors, coalesce(n_regions, 0) AS n_regions, CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in BASE.items())} END AS base FROM et JOIN fs USING (event_id) JOIN rp USING (event_id) JOIN sr ON sr.event_id = et.event_id AND place = 1 LEFT JOIN br ON br.event_id = et.event_id),
ei AS (SELECT *, greatest(1, least(10, base + least(1.5, CASE WHEN extreme_docs > 0 THEN CASE WHEN extreme_docs / n_scored >= 0.2 OR n_scored <= 3 THEN 1.0 ELSE 0.5 END WHEN high_docs > 0 THEN 0.5 * CASE WHEN high_docs / n_scored >= 0.2 OR n_scored <= 3 THEN 1.0 ELSE 0.5 END ELSE 0 END
    + CASE WHEN scale_docs = 0 THEN 0 WHEN scale_docs / n_scored >= 0.2 OR n_scored <= 3 THEN 0.3 ELSE 0.15 END + CASE WHEN abs(sentiment) >= 0.6 THEN 0.3 ELSE 0 END)
  + CASE WHEN n_stories > 2 THEN least(2.0, 0.5 * log2(n_stories / 2)) ELSE 0 END + CASE WHEN stories_last_hour >= 40 THEN 1.0 WHEN stories_last_hour >= 15 THEN 0.5 WHEN stories_last_hour >= 5 THEN 0.25 ELSE 0 END
  + least(0.75, CASE WHEN n_sectors >= 3 THEN 0.5 ELSE 0 END + CASE WHEN n_regions >= 2 THEN 0.25 ELSE 0 END) + CASE WHEN market_docs / n_scored >= 0.25 OR market_docs >= 25 THEN 0.5 WHEN market_docs / n_scored < 0.1 AND market_docs < 5 THEN -1.0 ELSE 0 END
  + CASE WHEN n_news = 0 OR n_stories = 1 THEN -1.0 WHEN n_stories = 2 THEN -0.5 ELSE 0 END + CASE WHEN confidence < 0.5 THEN -0.5 ELSE 0 END)) AS impact FROM ea)
"""


def signals_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = scored(spark, sf_dir)
    return docs, P.event_signals(docs, master(spark, sf_dir), TYPES, BASE)


@R.add(f"WITH {_SCORED} SELECT event_id, first_seen, last_seen, n_docs, n_scored, n_publishers, n_news, n_social, round(sentiment, 6) AS sentiment, event_type, round(confidence, 6) AS confidence, n_stories, stories_last_hour, reports_last_hour, headline, entities, n_sectors, n_regions, round(impact, 6) AS impact FROM ei")
def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, events = signals_of(spark, sf_dir)
    naive = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen")]
    return events.select("event_id", *naive, "n_docs", "n_scored", "n_publishers", "n_news", "n_social", F.round("sentiment", 6).alias("sentiment"), "event_type", F.round("confidence", 6).alias("confidence"), "n_stories", "stories_last_hour", "reports_last_hour", "headline", F.coalesce(F.array_join("entities", ","), F.lit("")).alias("entities"), "n_sectors", "n_regions", F.round("impact", 6).alias("impact"))


@R.add(f"WITH {_SCORED} SELECT event_id, story_id, first_seen, n_docs, n_publishers, round(sentiment, 6) AS sentiment, headline, place FROM sr WHERE place <= 5")
def event_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading stories of each event, in order."""
    docs, events = signals_of(spark, sf_dir)
    top = P.ranked_stories(P.stories(docs), events).where("place <= 5")
    return top.select("event_id", "story_id", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), "n_docs", "n_publishers", F.round("sentiment", 6).alias("sentiment"), "headline", F.col("place").cast("long").alias("place"))


@R.add(f"WITH {_SCORED} SELECT doc_id, round(impact, 6) AS impact FROM sd JOIN ei USING (event_id)")
def documents_with_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, events = signals_of(spark, sf_dir)
    return P.with_impact(docs, events).select("doc_id", F.round("impact", 6).alias("impact"))


@R.add(f"""WITH {_SCORED}, lv AS (SELECT * FROM ei WHERE last_seen >= TIMESTAMP '2024-01-09' - INTERVAL 48 HOUR), pr AS (SELECT DISTINCT unnest(d.entities) AS entity, event_id FROM sd d WHERE NOT dup)
SELECT entity, event_id, event_type, round(impact, 6) AS impact, sector FROM (SELECT pr.entity, lv.event_id, event_type, impact, row_number() OVER (PARTITION BY pr.entity ORDER BY impact DESC, lv.event_id) AS r FROM pr JOIN lv USING (event_id)) JOIN em USING (entity) WHERE r = 1""")
def entity_top_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, events = signals_of(spark, sf_dir)
    top = P.top_events(docs, events, F.lit("2024-01-09 00:00:00").cast("timestamp"))
    return top.join(master(spark, sf_dir), "entity").select("entity", "event_id", "event_type", F.round("impact", 6).alias("impact"), "sector")


@R.add(f"WITH {_SCORED} SELECT entity, moment::DATE AS day, round(max(impact), 6) AS impact, round(avg(x.sentiment), 6) AS tone, count(*) AS reports FROM (SELECT unnest(entities) AS entity, moment, event_id, sentiment FROM sd WHERE NOT dup) x JOIN em USING (entity) JOIN ei USING (event_id) WHERE type = 'company' GROUP BY ALL")
def company_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, events = signals_of(spark, sf_dir)
    rows = P.company_days(docs, events, master(spark, sf_dir))
    return rows.select("entity", "day", F.round("impact", 6).alias("impact"), F.round("tone", 6).alias("tone"), "reports")


_NOW = "TIMESTAMP '2024-01-08 00:00:00'"


@R.add(f"""WITH {_SCORED},
ob AS (SELECT unnest(entities) AS entity, kind, sentiment AS s, pow(0.5, (epoch_us({_NOW}) - epoch_us(moment)) / 3.6e9 / CASE kind WHEN 'news' THEN 36 ELSE 12 END) * CASE kind WHEN 'news' THEN 1.0 ELSE 0.35 END AS w FROM sd WHERE NOT dup),
tn AS (SELECT entity, round(sum(w), 6) AS evidence, round(sum(w * s) / (sum(w) + 2), 6) AS sentiment FROM ob GROUP BY entity),
ct AS (SELECT key, max(impact) AS impact FROM (SELECT split_part(entities, ',', 1) AS key, impact FROM ei WHERE impact > 7 AND event_type <> 'MACROECONOMIC') GROUP BY key),
co AS (SELECT entity, 'N0' AS country FROM em WHERE type = 'company'),
nv AS (SELECT mn.entity, ei.event_type, ei.impact, CASE WHEN event_type IN ('MACROECONOMIC', 'GEOPOLITICAL') THEN mn.place <= 3 OR mentions >= 0.2 * greatest(n_docs, 1) ELSE ct.key IS NOT NULL OR (mn.sentiment <= -0.3 AND (mentions >= 50 OR mentions >= 0.1 * n_docs)) END AS fo, coalesce(mn.sentiment, ei.sentiment) AS tone
  FROM mn JOIN co USING (entity) JOIN ei USING (event_id) LEFT JOIN ct ON ct.key = mn.entity WHERE mn.place <= 12 AND last_seen >= {_NOW} - INTERVAL 48 HOUR),
tp AS (SELECT entity, max(struct_pack(f := fo, i := impact)) FILTER (event_type = 'CREDIT_EVENT' AND impact > 5.5) AS c, max(struct_pack(f := fo, i := impact)) FILTER (event_type <> 'CREDIT_EVENT' AND impact >= 7 AND tone <= -0.1) AS n FROM nv GROUP BY entity),
pt AS (SELECT co.entity, CASE WHEN c.i IS NULL THEN 0 ELSE round_even(CASE WHEN c.f THEN least(4, c.i - 5.5) ELSE least(1, 0.5 * least(4, c.i - 5.5)) END, 2) END AS credit, CASE WHEN n.i IS NULL THEN 0 ELSE round_even(least(1.5, 0.5 + 0.5 * (n.i - 7)) * CASE WHEN n.f THEN 1.0 ELSE 0.5 END, 2) END AS news,
  CASE WHEN coalesce(o.impact, h.impact) IS NULL THEN 0 ELSE round_even(least(1.5, greatest(0.5, 1.5 * (coalesce(o.impact, h.impact) - 6) / 3)), 2) END AS centre, CASE WHEN sentiment <= -0.15 AND evidence >= 2 THEN round_even(least(2, (-sentiment - 0.1) * 5) + CASE WHEN sentiment <= -0.15 THEN 0.5 ELSE 0 END, 2) ELSE 0 END AS tone, CASE WHEN substr(co.entity, 2)::INT % 4 <> 1 THEN 0 WHEN substr(co.entity, 2)::INT % 8 = 5 THEN 2.0 ELSE least(2.0, 0.5 * (substr(co.entity, 2)::INT % 5)) END AS moved
  FROM co LEFT JOIN tp USING (entity) LEFT JOIN ct o ON o.key = co.entity LEFT JOIN ct h ON h.key = co.country LEFT JOIN tn USING (entity))
SELECT entity, round(credit + news + centre + tone + moved, 2) AS score, CASE WHEN round(credit + news + centre + tone + moved, 2) >= 3 THEN 'Watch Negative' WHEN round(credit + news + centre + tone + moved, 2) >= 1.5 THEN 'Monitor' END AS status FROM pt""")
def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.state import decayed_state

    docs, events = signals_of(spark, sf_dir)
    now = F.expr(_NOW)
    seen = docs.where(~F.col("duplicate")).select(F.explode("entities").alias("entity"), "kind", F.col("sentiment").alias("score"), F.lit(1.0).alias("weight"), "at")
    tone = decayed_state(seen, now, {"news": 36.0, "social": 12.0}, {"news": 1.0, "social": 0.35}).select("entity", "evidence", "sentiment", F.col("sentiment").alias("trend"))
    companies = master(spark, sf_dir).where("type = 'company'").select("entity", F.lit("N0").alias("country"))
    centres = events.where("impact > 7 and event_type <> 'MACROECONOMIC'").select(F.get("entities", F.lit(0)).alias("key"), "impact")
    moved = companies.where(F.substring("entity", 2, 9).cast("int") % 4 == 1).select("entity", (F.substring("entity", 2, 9).cast("int") % 5).alias("notches"), (F.substring("entity", 2, 9).cast("int") % 8 == 5).alias("defaulted"))
    wide = events.withColumn("market_wide", F.col("event_type").isin("MACROECONOMIC", "GEOPOLITICAL"))
    listed = P.watch_list(wide, P.mentions(docs, master(spark, sf_dir)), companies, centres, tone, moved, now)
    rank = F.when(F.col("status") == "Watch Negative", 2).when(F.col("status") == "Monitor", 1).otherwise(0)
    return listed.orderBy(F.desc(rank), F.desc("score"), "entity").select("entity", "score", "status")


@R.add(f"""WITH {_SCORED}, op AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 14:30:00', TIMESTAMP '2024-01-08 00:00:00', INTERVAL 1 DAY)) AS open UNION ALL SELECT unnest(generate_series(TIMESTAMP '2024-01-01 21:00:00', TIMESTAMP '2024-01-08 00:00:00', INTERVAL 1 DAY))),
ob AS (SELECT unnest(entities) AS entity, kind, sentiment AS s, moment FROM sd WHERE NOT dup),
ww AS (SELECT open, entity, s, pow(0.5, (epoch_us(open) - epoch_us(moment)) / 3.6e9 / CASE kind WHEN 'news' THEN 36 ELSE 12 END) * CASE kind WHEN 'news' THEN 1.0 ELSE 0.35 END AS w FROM op JOIN ob ON moment < open)
SELECT entity, open, round(sum(w), 6) AS evidence, round(sum(w * s) / (sum(w) + 2), 6) AS sentiment FROM ww GROUP BY ALL""")
def signals_at_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings and closings of a week put together, and each entity's state as of each."""
    at = lambda t: spark.range(7).select((F.to_timestamp(F.lit(f"2024-01-01 {t}")) + F.make_interval(days=F.col("id").cast("int"))).alias("open"))
    docs = scored(spark, sf_dir).where(~F.col("duplicate")).select(F.explode("entities").alias("entity"), "kind", F.col("sentiment").alias("score"), F.lit(1.0).alias("weight"), "at")
    rows = P.signals_at(docs, at("14:30:00").unionByName(at("21:00:00")), {"news": 36.0, "social": 12.0}, {"news": 1.0, "social": 0.35})
    return rows.select("entity", F.col("open").cast("timestamp_ntz").alias("open"), F.round("evidence", 6).alias("evidence"), F.round("sentiment", 6).alias("sentiment"))


@R.add(f"WITH {_SCORED} SELECT event_id, event_type, round(impact, 6) AS impact, n_docs FROM ei WHERE impact >= 5 AND event_type <> 'OTHER' ORDER BY impact DESC, n_docs DESC, event_id LIMIT 50")
def top_impact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of events over an impact, most severe first, fifty at most."""
    _, events = signals_of(spark, sf_dir)
    return P.listed_events(events, 5.0).where("event_type <> 'OTHER'").limit(50).select("event_id", "event_type", F.round("impact", 6).alias("impact"), "n_docs")


@R.add(f"WITH {_SCORED} SELECT doc_id, event_id, kind FROM sd WHERE list_contains(entities, 'N3') AND NOT dup ORDER BY moment DESC, doc_id DESC LIMIT 40")
def entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest documents of one entity, without copies."""
    return P.latest_documents(scored(spark, sf_dir).where(~F.col("duplicate")), 40, entity="N3").select("doc_id", "event_id", "kind")


@R.add(f"""WITH {_SCORED}, f AS (SELECT doc_id, unnest(entities) AS entity FROM sd), c AS (SELECT f.* FROM f JOIN em USING (entity) WHERE type = 'company'), n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
t AS (SELECT doc_id, entity FROM c JOIN n USING (doc_id) WHERE n BETWEEN 2 AND 5 UNION ALL SELECT doc_id, entity FROM f WHERE entity = 'N0')
SELECT doc_id, string_agg(entity || '=' || round(((doc_id * 31 + substr(entity, 2)::INT) % 200 - 100) / 100.0::DOUBLE, 2), ',' ORDER BY entity) AS scores FROM t GROUP BY doc_id""")
def target_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the entities that are scored apart, made up by a rule, as a map for each document."""
    docs = scored(spark, sf_dir)
    firms = [f"N{i}" for i in range(25) if i % 3]
    pairs = P.target_pairs(docs, F.filter("entities", lambda e: e.isin(firms)), F.filter("entities", lambda e: e == "N0"))
    made = pairs.withColumn("score", F.round(((F.col("doc_id") * 31 + F.substring("entity", 2, 9).cast("int")) % 200 - 100) / 100.0, 2))
    maps = P.scores_by_document(made)
    return maps.select("doc_id", F.array_join(F.transform(F.map_entries("scores"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("scores"))


_WEAK = f"""WITH h AS (SELECT doc_id, lang, source, {_list_sql(HEADLINES)}[(doc_id % 16 + 1)::INT] || '. ' || coalesce(text, '') AS said FROM documents WHERE doc_id IS NOT NULL),
c AS (SELECT *, {", ".join(f"{_hits_sql(t, 'said')} AS c{i}" for i, t in enumerate(TYPES))} FROM h), m AS (SELECT *, greatest(c0, c1, c2, c3, c4) AS top FROM c)
SELECT doc_id, CASE WHEN top = 0 THEN 'OTHER' WHEN (c0 = top)::INT + (c1 = top)::INT + (c2 = top)::INT + (c3 = top)::INT + (c4 = top)::INT = 1 THEN CASE WHEN c0 = top THEN 'GEOPOLITICAL' WHEN c1 = top THEN 'CREDIT_EVENT' WHEN c2 = top THEN 'REGULATORY' WHEN c3 = top THEN 'MARKET_COMMENTARY' ELSE 'MACROECONOMIC' END END AS weak,
 CASE source WHEN 'src0' THEN 'REGULATORY' WHEN 'src1' THEN 'MACROECONOMIC' ELSE CASE WHEN top > 0 THEN CASE WHEN c0 = top THEN 'GEOPOLITICAL' WHEN c1 = top THEN 'CREDIT_EVENT' WHEN c2 = top THEN 'REGULATORY' WHEN c3 = top THEN 'MARKET_COMMENTARY' ELSE 'MACROECONOMIC' END WHEN source = 'src2' THEN 'OTHER' END END AS topic FROM m"""


@R.add(_WEAK)
def weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by rule: the type of most cues if it is alone with that, noise without any; and by topic, where mixed topics go by their cues."""
    headline = F.element_at(F.array(*map(F.lit, HEADLINES)), (F.col("doc_id") % 16 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "source", T.cue_counts(F.concat(headline, F.lit(". "), F.coalesce("text", F.lit(""))), CUES).alias("cues"))
    topic = P.topic_label(F.col("source"), {"src0": "REGULATORY", "src1": "MACROECONOMIC"}, {"src2": "OTHER"}, T.best_type(F.col("cues"), TYPES[:-1]))
    return docs.select("doc_id", P.weak_label(F.col("cues"), TYPES[:-1], "OTHER").alias("weak"), topic.alias("topic"))


@R.add("WITH t AS (SELECT lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, url, page_id FROM pages) SELECT title, min(page_id) AS page_id, count(*) AS found FROM t WHERE title <> '' GROUP BY title")
def searched_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles once each, whatever their case, with the first page that has it."""
    rows = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), "page_id").where("title <> ''")
    return rows.groupBy("title").agg(F.min("page_id").alias("page_id"), F.count("*").alias("found"))


@R.add(f"""WITH {_SCORED}, tp AS (SELECT event_id, mn.entity, mentions, place, type FROM mn JOIN em USING (entity) WHERE place <= 12),
fi AS (SELECT event_id, entity, mentions, place, max(CASE WHEN rn = 1 THEN mentions END) OVER (PARTITION BY event_id) AS top FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY place) AS rn FROM tp WHERE type = 'company')),
fn AS (SELECT event_id, entity, row_number() OVER (PARTITION BY event_id ORDER BY place) AS r FROM fi WHERE mentions >= 0.5 * top), rg AS (SELECT event_id, entity, row_number() OVER (PARTITION BY event_id ORDER BY place) AS r FROM tp WHERE type = 'country')
SELECT event_id, event_type, CASE WHEN event_type = 'MACROECONOMIC' THEN '' WHEN event_type = 'GEOPOLITICAL' THEN coalesce((SELECT string_agg(entity, ',' ORDER BY r) FROM rg WHERE rg.event_id = ei.event_id AND r <= 2), '') ELSE coalesce((SELECT string_agg(entity, ',' ORDER BY r) FROM fn WHERE fn.event_id = ei.event_id AND r <= 3), '') END AS hit FROM ei""")
def event_epicentres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom each event hits: countries or companies, or nobody."""
    from tidemark.operators.signals import epicentre

    docs, events = signals_of(spark, sf_dir)
    top = P.mentions(docs, master(spark, sf_dir)).where(F.col("place") <= P.TOP_ENTITIES)
    row = F.array_sort(F.collect_list(F.struct("place", "entity", "type", "mentions")))  # TOP_ENTITIES at most
    named = top.groupBy("event_id").agg(row.alias("t"))
    of = lambda kind: F.transform(F.filter("t", lambda x: x["type"] == kind), lambda x: x["entity"])
    rows = events.select("event_id", "event_type").join(named, "event_id").withColumns({"firms": of("company"), "places": of("country"), "counts": F.map_from_entries(F.transform("t", lambda x: F.struct(x["entity"], x["mentions"])))})
    hit = epicentre(F.col("event_type"), F.col("event_type") == "GEOPOLITICAL", F.col("places"), F.col("firms"), F.col("counts"))
    return rows.select("event_id", "event_type", F.array_join(hit, ",").alias("hit"))
