"""From scored documents with their story and event to the signals of stories, events, entities and company days.

A scored document has: doc_id, at, kind (news or social), publisher, event_id, story_id, sentiment,
neutral (its probability), relevance, similarity, probs (of the types), extreme, high, scale, market
(booleans), entities (array), headline, and duplicate, true of a copy of an earlier text, which
only corroborates.  Everything is an aggregation that combines before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.signals import impact

CREDIBILITY = {"news": 1.0, "social": 0.35}
RECENT_HOURS, RECENT_PUBLISHERS, TOP_ENTITIES, WINDOW_HOURS = 12, 3, 12, 48


def weight() -> Column:
    """How much a document counts: credible, relevant and opinionated ones most; a duplicate nothing."""
    credible = F.when(F.col("kind") == "news", CREDIBILITY["news"]).otherwise(CREDIBILITY["social"])
    return F.when(F.col("duplicate"), 0.0).otherwise(credible * F.col("relevance") * (0.1 + 0.9 * (1 - F.col("neutral"))))


def mean(value: Column, w: Column) -> Column:
    return F.coalesce(F.try_divide(F.sum(w * value), F.sum(w)), F.lit(0.0))


def mark_duplicates(docs: DataFrame, key: str) -> DataFrame:
    """docs with duplicate: whether an earlier document (by at, then doc_id) has the same key."""
    first = docs.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct("at", "doc_id")).alias("_first"))
    return docs.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn("duplicate", F.struct("at", "doc_id") != F.col("_first")).drop("_key", "_first")


def stories(docs: DataFrame) -> DataFrame:
    """Rows (event_id, story_id, first_seen, n_docs, n_publishers, sentiment, headline, told): told says in market terms, or severely, each one."""
    fresh = ~F.col("duplicate")
    elected = F.struct((F.col("kind") == "news").alias("news"), "similarity", (-F.col("doc_id")).alias("early"))  # news before social, the closest, the earliest
    return docs.groupBy("event_id", "story_id").agg(
        F.min("at").alias("first_seen"), F.count("*").alias("n_docs"), F.count_distinct("publisher").alias("n_publishers"), mean(F.col("sentiment"), weight()).alias("sentiment"),
        F.max_by("headline", F.when(fresh, elected)).alias("headline"), (F.max((fresh & F.col("market")).cast("int")) + F.max((fresh & (F.col("extreme") | F.col("high"))).cast("int"))).alias("told"),
    )


def ranked_stories(told: DataFrame, last: DataFrame) -> DataFrame:
    """stories with place within their event: recent ones that enough publishers have come first if there are any, then by reach, documents and age."""
    rows = told.join(last.select("event_id", "last_seen"), "event_id")
    recent = (F.col("first_seen") >= F.col("last_seen") - F.expr(f"interval {RECENT_HOURS} hours")) & (F.col("n_publishers") >= RECENT_PUBLISHERS)
    reach = F.col("n_publishers") * (1 + F.col("told"))
    order = [F.desc(recent), F.desc(reach), F.desc("n_docs"), "first_seen", "story_id"]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("event_id").orderBy(*order))).drop("last_seen")


def mentions(docs: DataFrame, master: DataFrame) -> DataFrame:
    """Rows (event_id, entity, mentions, sentiment, place, sector, type): the entities of each event, most mentioned first, then those named earlier, with the master's columns."""
    rows = docs.where(~F.col("duplicate")).withColumn("_w", weight()).select("event_id", "at", "doc_id", "sentiment", "_w", F.posexplode("entities").alias("_i", "entity"))
    named = rows.groupBy("event_id", "entity").agg(F.count("*").alias("mentions"), mean(F.col("sentiment"), F.col("_w")).alias("sentiment"), F.min(F.struct("at", "doc_id", "_i")).alias("_first"))
    place = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("mentions"), "_first"))
    return named.withColumn("place", place).drop("_first").join(master, "entity", "left")


def event_signals(docs: DataFrame, master: DataFrame, types: list[str], base: dict[str, float]) -> DataFrame:
    """One row for each event: when, what type and how sure, tone, counts, velocity, headline, top entities, breadth and impact.  master: entity, sector, type."""
    fresh, w = ~F.col("duplicate"), weight()
    n = lambda c: F.count_if(fresh & c)
    sums = docs.groupBy("event_id").agg(
        F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count("*").alias("n_docs"), F.count_if(fresh).alias("n_scored"), F.count_distinct("publisher").alias("n_publishers"),
        n(F.col("kind") == "news").alias("n_news"), n(F.col("kind") != "news").alias("n_social"), mean(F.col("sentiment"), w).alias("sentiment"),
        F.array(*[mean(F.get("probs", F.lit(i)), w) for i in range(len(types))]).alias("probs"),
        n(F.col("extreme")).alias("extreme_docs"), n(F.col("high")).alias("high_docs"), n(F.col("scale")).alias("scale_docs"), n(F.col("market")).alias("market_docs"),
    )
    best = F.array_max(F.transform("probs", lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    sums = sums.withColumn("_best", best).withColumns({"event_type": F.get(F.array(*map(F.lit, types)), -F.col("_best.i")), "confidence": F.col("_best.p")}).drop("_best", "probs")
    told = stories(docs)
    placed = ranked_stories(told, sums)
    hour = F.expr("interval 1 hour")
    lasts = sums.select("event_id", "last_seen")
    fast = told.join(lasts, "event_id").groupBy("event_id").agg(F.count("*").alias("n_stories"), F.count_if(F.col("first_seen") >= F.col("last_seen") - hour).alias("stories_last_hour"))
    reports = docs.select("event_id", "at").join(lasts, "event_id").groupBy("event_id").agg(F.count_if(F.col("at") >= F.col("last_seen") - hour).alias("reports_last_hour"))
    top = mentions(docs, master).where(F.col("place") <= TOP_ENTITIES)
    broad = top.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("place", "entity"))).alias("_top"), F.count_distinct("sector").alias("n_sectors"), F.count_if(F.col("type") == "country").alias("n_regions"))  # TOP_ENTITIES at most
    rows = sums.join(fast, "event_id").join(reports, "event_id").join(placed.where("place = 1").select("event_id", "headline"), "event_id").join(broad, "event_id", "left")
    rows = rows.fillna(0, ["n_sectors", "n_regions"]).withColumn("entities", F.transform("_top", lambda x: x["entity"])).drop("_top")
    points = F.create_map(*[x for k, v in base.items() for x in (F.lit(k), F.lit(v))])
    return rows.withColumn("base", points[F.col("event_type")]).withColumn("impact", impact()["score"]).drop("base")


def with_impact(docs: DataFrame, events: DataFrame) -> DataFrame:
    """docs with the impact of their event as of this batch."""
    return docs.join(events.select("event_id", "impact"), "event_id", "left")


def top_events(docs: DataFrame, events: DataFrame, now: Column, hours: int = WINDOW_HOURS) -> DataFrame:
    """Rows (entity, event_id, event_type, impact): for each entity the live event of highest impact, the first by id among equals; live is what was seen in the last hours."""
    live = events.where(F.col("last_seen") >= now - F.expr(f"interval {hours} hours")).select("event_id", "event_type", "impact")
    pairs = docs.where(~F.col("duplicate")).select(F.explode("entities").alias("entity"), "event_id").distinct().join(live, "event_id")
    high = pairs.groupBy("entity").agg(F.max("impact").alias("impact"))
    ties = pairs.join(high, ["entity", "impact"])
    return ties.groupBy("entity", "impact").agg(F.min_by(F.struct("event_id", "event_type"), "event_id").alias("_e")).select("entity", "_e.event_id", "_e.event_type", "impact")


def company_days(docs: DataFrame, events: DataFrame, master: DataFrame) -> DataFrame:
    """Rows (entity, day, impact, tone, reports): for each company and day the highest impact of its events and the mean tone of its reports."""
    rows = with_impact(docs.where(~F.col("duplicate")), events).select(F.explode("entities").alias("entity"), F.to_date("at").alias("day"), "impact", "sentiment")
    firms = master.where("type = 'company'").select("entity")
    return rows.join(firms, "entity").groupBy("entity", "day").agg(F.max("impact").alias("impact"), F.avg("sentiment").alias("tone"), F.count("*").alias("reports"))


def novelty_weight(n_companies: Column, novelty: Column, relevance: Column, most: int = 5, least_share: float = 0.3) -> Column:
    """What a document weighs in its entities' sentiment: news more than a rehash, a long list of companies less for each."""
    return relevance * (least_share + (1 - least_share) * novelty) * F.when(n_companies > most, most / n_companies).otherwise(1.0)


def with_subject(entities: Column, symbol: Column, known: Column) -> Column:
    """Entities and the symbol that a feed is about, if it is a known one and not among them."""
    return F.when(known & symbol.isNotNull() & ~F.array_contains(entities, symbol), F.array_append(entities, symbol)).otherwise(entities)


def target_pairs(docs: DataFrame, companies: Column, prices: Column, most: int = 5) -> DataFrame:
    """Rows (doc_id, entity) that are scored apart: the companies of texts that name two to most of them, and every price."""
    firms = F.when(F.size(companies).between(2, most), companies).otherwise(F.array().cast("array<string>"))
    return docs.select("doc_id", F.explode(F.concat(firms, prices)).alias("entity"))


def scores_by_document(scored: DataFrame) -> DataFrame:
    """Rows (doc_id, scores): from rows (doc_id, entity, score) a map for each document; of repeated pairs the highest score."""
    return scored.groupBy("doc_id", "entity").agg(F.max("score").alias("score")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity", "score")))).alias("scores"))


def focus(market_wide: Column, in_epicentre: Column, place: Column, mentions_: Column, tone: Column, n_docs: Column) -> Column:
    """Whether an event is about a company rather than names it in passing."""
    firm = in_epicentre | ((tone <= -0.3) & ((mentions_ >= 50) | (mentions_ >= 0.1 * n_docs)))
    return F.when(market_wide, (place <= 3) | (mentions_ >= 0.2 * F.greatest(n_docs, F.lit(1)))).otherwise(firm)


def trends(samples: DataFrame, hours: float = 24.0, apart_minutes: float = 10.0) -> DataFrame:
    """Rows (entity, at, sentiment, trend): the change since the last sample that is hours old, or the whole value where there is none.

    samples: entity, at (seconds), sentiment.  Samples nearer than apart_minutes to the one kept before are
    not kept, so an entity is one fold; a task holds one entity's last hours.
    """
    from collections import deque
    from collections.abc import Callable

    from tidemark.operators.monitors import folded

    def start() -> Callable:
        kept: deque = deque()

        def step(r) -> list[tuple]:
            if not kept or r.at - kept[-1][0] >= apart_minutes * 60:
                kept.append((r.at, r.sentiment))
            then = r.at - hours * 3600
            while len(kept) > 1 and kept[1][0] <= then:
                kept.popleft()
            return [(r.entity, r.at, r.sentiment, r.sentiment - (kept[0][1] if kept[0][0] <= then else 0.0))]

        return step

    return folded(samples, "entity", ["at"], start, "entity string, at double, sentiment double, trend double")


def watch_list(events: DataFrame, named: DataFrame, companies: DataFrame, epicentres: DataFrame, tone: DataFrame, migrations: DataFrame, now: Column) -> DataFrame:
    """Rows (entity, score, status and the columns of ``watch_score``) for every company, to be ordered by rank, score and id.

    events: event_id, event_type, last_seen, impact, n_docs, sentiment, market_wide; named: event_id, entity, place,
    mentions, sentiment; companies: entity, country; epicentres: key (a company or a country), impact;
    tone: entity, sentiment, evidence, trend; migrations: entity, notches, defaulted.
    """
    from tidemark.operators.signals import next_status_of, watch_score

    live = events.where(F.col("last_seen") >= now - F.expr(f"interval {WINDOW_HOURS} hours")).withColumnRenamed("sentiment", "overall")
    seen = named.where(F.col("place") <= TOP_ENTITIES).join(companies.select("entity"), "entity").join(live, "event_id").join(epicentres.select(F.col("key").alias("_key")).distinct(), F.col("entity") == F.col("_key"), "left")
    about = focus(F.col("market_wide"), F.col("_key").isNotNull(), F.col("place"), F.col("mentions"), F.col("sentiment"), F.col("n_docs"))
    best = lambda c: F.max(F.when(c, F.struct(about.alias("focus"), "impact")))
    credit = (F.col("event_type") == "CREDIT_EVENT") & (F.col("impact") > 5.5)
    news = (F.col("event_type") != "CREDIT_EVENT") & (F.col("impact") >= 7) & (F.coalesce("sentiment", "overall") <= -0.1)
    top = seen.groupBy("entity").agg(best(credit).alias("_c"), best(news).alias("_n"))
    top = top.select("entity", F.col("_c.impact").alias("credit_impact"), F.col("_c.focus").alias("credit_focus"), F.col("_n.impact").alias("news_impact"), F.col("_n.focus").alias("news_focus"))
    centre = epicentres.groupBy("key").agg(F.max("impact").alias("impact"))
    own, home = centre.select(F.col("key").alias("entity"), F.col("impact").alias("_own")), centre.select(F.col("key").alias("country"), F.col("impact").alias("_home"))
    rows = companies.join(top, "entity", "left").join(own, "entity", "left").join(home, "country", "left").withColumn("epicentre_impact", F.coalesce("_own", "_home")).drop("_own", "_home")
    rows = rows.join(tone, "entity", "left").join(migrations, "entity", "left")
    return rows.withColumn("score", F.round(watch_score(), 2)).withColumn("status", next_status_of(F.col("score")))


#: Half-lives of a segment that decayed sums are taken over at once: 2 to this power is far inside the range of doubles.
SEGMENT = 400


def signals_at(observations: DataFrame, opens: DataFrame, half_life: dict[str, float], credibility: dict[str, float], prior: float = 2.0) -> DataFrame:
    """Rows (entity, open, evidence, sentiment): each entity's decayed state as of each opening, from what came before it.

    observations: entity, kind, score, weight, at; opens: open (timestamps).  Observations and openings of an
    entity and kind are sorted together, and sums run along; so work grows with both, not with their product.  Sums are taken
    in segments of time, each with its own scale, and carried from segment to segment: openings may span any time.
    """
    hl, cred = (F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("kind")] for d in (half_life, credibility))
    hours = lambda c: F.unix_micros(c) / 3.6e9
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score")))
    seen = observations.where((F.col("weight") > 0) & F.col("kind").isin(list(half_life))).select("entity", "kind", (hours("at") / hl).alias("_t"), F.lit(1).alias("_after"), F.col("weight").cast("double").alias("_w"), (F.col("weight") * score).alias("_ws"), F.lit(None).cast("timestamp").alias("open"))
    times = opens.select("open").where("open is not null").distinct().agg(F.collect_list("open").alias("_opens"))
    asked = seen.select("entity", "kind").distinct().crossJoin(F.broadcast(times)).select("entity", "kind", F.explode("_opens").alias("open"))  # one row beside each entity
    zero = F.lit(0.0)
    both = seen.unionByName(asked.select("entity", "kind", (hours("open") / hl).alias("_t"), F.lit(0).alias("_after"), zero.alias("_w"), zero.alias("_ws"), "open"))  # an opening does not see what comes with it
    both = both.withColumn("_segment", F.floor(F.col("_t") / SEGMENT)).withColumn("_scale", F.pow(F.lit(2.0), F.col("_t") - F.col("_segment") * SEGMENT))
    so_far = Window.partitionBy("entity", "kind", "_segment").orderBy("_t", "_after").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumns({c: F.sum(F.col(c) * F.col("_scale")).over(so_far) / F.col("_scale") for c in ("_w", "_ws")}).where("open is not null")
    # What a segment leaves at its end; behind three segments nothing of it is left in a double.
    ends = both.where("open is null").groupBy("entity", "kind", "_segment").agg(*[(F.sum(F.col(c) * F.col("_scale")) * 2.0**-SEGMENT).alias(c) for c in ("_w", "_ws")])
    later = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("_by")
    carried = ends.select("*", later).groupBy("entity", "kind", (F.col("_segment") + F.col("_by")).alias("_segment")).agg(*[F.sum(F.col(c) * F.pow(F.lit(2.0), -SEGMENT * (F.col("_by") - 1.0))).alias(f"{c}_0") for c in ("_w", "_ws")])
    full = inside.join(carried, ["entity", "kind", "_segment"], "left")
    full = full.withColumns({c: F.col(c) + F.coalesce(f"{c}_0", zero) / F.col("_scale") for c in ("_w", "_ws")})
    sums = full.groupBy("entity", "open").agg(F.sum(cred * F.col("_w")).alias("evidence"), F.sum(cred * F.col("_ws")).alias("_s"))
    return sums.where("evidence > 0").select("entity", "open", "evidence", (F.col("_s") / (F.col("evidence") + prior)).alias("sentiment"))


def listed_events(events: DataFrame, least: float = 0.0, event_type: str | None = None) -> DataFrame:
    """Events of an impact or more, of one type if that is given, most severe and most reported first."""
    rows = events.where(F.col("impact") >= least)
    return (rows.where(F.col("event_type") == event_type) if event_type else rows).orderBy(F.desc("impact"), F.desc("n_docs"), "event_id")


def latest_documents(docs: DataFrame, n: int, entity: str | None = None, event: str | None = None) -> DataFrame:
    """The last n documents, of an entity or an event if one is given, newest first."""
    rows = docs.where(F.array_contains("entities", entity)) if entity else docs
    return (rows.where(F.col("event_id") == event) if event else rows).orderBy(F.desc("at"), F.desc("doc_id")).limit(n)


def weak_label(counts: Column, order: list[str], noise: str) -> Column:
    """The type of most cues, null where several have as many, noise without any."""
    numbers = F.array(*[counts[t] for t in order])
    top = F.array_max(numbers)
    alone = F.size(F.filter(numbers, lambda n: n == top)) == 1
    return F.when(top == 0, noise).when(alone, F.element_at(F.array(*map(F.lit, order)), F.array_position(numbers, top).cast("int")))


def topic_label(topic: Column, clear: dict[str, str], mixed: dict[str, str | None], by_cues: Column) -> Column:
    """The type of a clear topic; else what the cues say, or the mixed topic's own type, or null."""
    pick = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() if v for x in (k, v)])[topic]
    return F.coalesce(pick(clear), by_cues, pick(mixed))


def analysed(docs: DataFrame, text: str, cues: dict[str, list[str]], severity: dict[str, str], positive: list[str], negative: list[str], negators: list[str], base: dict[str, float]) -> DataFrame:
    """docs with sentiment, event_type, confidence and impact of each text alone, as a single report that nobody corroborates.  OTHER must be the last of cues."""
    from tidemark.functions.cues import cue_hits, fused
    from tidemark.operators.models import rules

    types = list(cues)
    rows = rules(docs.withColumn("_text", F.coalesce(text, F.lit(""))), "_text", cues, positive, negative, negators)
    rows = rows.withColumn("_h", cue_hits(F.col("_text"), F.lit(True), F.lit(True), cues, severity)).withColumn("_p", fused(F.col("event"), F.col("_h"), types))
    best = F.array_max(F.transform("_p", lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    rows = rows.withColumn("_b", best).withColumns({"event_type": F.get(F.array(*map(F.lit, types)), -F.col("_b.i")), "confidence": F.col("_b.p"), "sentiment": F.get("sentiment", F.lit(2)) - F.get("sentiment", F.lit(0))})
    one, points = F.lit(1), F.create_map(*[F.lit(x) for kv in base.items() for x in kv])
    given = {k: F.lit(0) for k in ("n_sectors", "n_regions", "market_docs")} | {k: one for k in ("n_scored", "n_stories", "n_news", "stories_last_hour")}
    given |= {f"{k}_docs": (F.col("_h.severity")[k] > 0).cast("int") for k in ("extreme", "high", "scale")} | {"base": points[F.col("event_type")]}
    return rows.withColumn("impact", impact(given)["score"]).drop("_text", "_h", "_p", "_b", "event")
