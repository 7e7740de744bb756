"""The watch list over time: batch and stream against plain Python that looks at all updates anew at every moment."""

import json
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_path_fold import rocks  # noqa: F401
from tidemark.operators import signals, watch_feed
from tidemark.plans import books, watch

HOUR = 3_600_000_000
C = watch_feed.FeedConfig()


def opinion(rows, now):
    w = ws = 0.0
    for kind, half, credible in (("news", 36, 1.0), ("social", 12, 0.35)):
        mine = [(r["weight"] * 0.5 ** ((now - r["at"]) / HOUR / half), max(-1, min(1, r["tone"]))) for r in rows if r["what"] == "opinion" and r["kind"] == kind]
        w, ws = w + credible * sum(a for a, _ in mine), ws + credible * sum(a * t for a, t in mine)
    return round(ws / (w + 2), 4), round(w, 3)


def plain(rows, until):
    """Changes of one name: at each moment everything is worked out from all rows so far."""
    rows = sorted(rows, key=lambda r: r["at"])
    times, out, held, flagged, samples, now = sorted({r["at"] for r in rows}), [], None, set(), [], None
    while True:
        ahead = [t for t in times if now is None or t > now]
        known = [r for r in rows if now is not None and r["at"] <= now]
        ends = [r["at"] + 48 * HOUR + 1 for r in known if r["what"] in ("situation", "migration") or (r["what"] == "event" and r["impact"] >= 6)]
        ahead += [e for e in ends if e > now] + ([(now // HOUR + 1) * HOUR] if held else [])
        if not ahead or min(ahead) > until:
            return out
        now = min(ahead)
        known = [r for r in rows if r["at"] <= now]
        live = [r for r in known if r["at"] >= now - 48 * HOUR]
        sentiment, evidence = opinion(known, now)
        if not samples or now - samples[-1][0] >= HOUR / 6:
            samples.append((now, sentiment))
        while len(samples) > 1 and samples[1][0] <= now - 24 * HOUR:
            samples.pop(0)
        trend = sentiment - (samples[0][1] if samples[0][0] <= now - 24 * HOUR else 0)
        named = {}
        events = [r for r in live if r["what"] == "event" and r["impact"] >= 6]
        if credit := [(r["focus"], r["impact"]) for r in events if r["event_type"] == "CREDIT_EVENT"]:
            focus, impact = max(credit)
            named["credit event"] = min(4, impact - 5.5) if focus else min(1, 0.5 * min(4, impact - 5.5))
        if news := [(r["focus"], r["impact"]) for r in events if r["event_type"] != "CREDIT_EVENT" and r["impact"] >= 7 and r["tone"] <= -0.1]:
            focus, impact = max(news)
            named["high-impact news"] = min(1.5, 0.5 + 0.5 * (impact - 7)) * (1 if focus else 0.5)
        centres = [(r["focus"], r["impact"]) for r in live if r["what"] == "situation"]
        if centres:
            impact = max(i for f, i in centres if f == max(f for f, _ in centres))
            named["epicentre"] = min(1.5, max(0.5, 1.5 * (impact - 6) / 3))
        if sentiment <= -0.15 and evidence >= 2:
            named["sentiment"] = min(2, (-sentiment - 0.1) * 5)
            if trend <= -0.15:
                named["sentiment trend"] = 0.5
        if moves := [(r["focus"], r["impact"]) for r in live if r["what"] == "migration"]:
            named["stress migration"] = 2.0 if max(moves)[0] else min(2, 0.5 * max(moves)[1])
        named = {k: round(v, 2) for k, v in named.items()}
        score = round(sum(named.values()), 2)
        bar = {"Watch Negative": 2.5 if held == "Watch Negative" else 3.0, "Monitor": 1.0 if held else 1.5}
        status = next((s for s, b in bar.items() if score >= b), None)
        if status != held:
            out.append((now, held, status, score, max(named, key=named.get) if named else "evidence has gone stale", status is not None and status not in flagged))
            flagged.add(status)
            held = status


@pytest.fixture(scope="module")
def given(spark, sf):
    rows = [r.asDict() for r in watch.updates(spark, sf).withColumn("at", F.unix_micros("at")).collect()]
    names = {}
    for r in rows:
        names.setdefault(r["entity"], []).append(r)
    return names, max(r["at"] for r in rows)


def shown(df):
    return sorted((r["entity"], r["us"], r["before"], r["status"], r["score"], r["reason"], r["first"]) for r in df.withColumn("us", F.unix_micros("at")).collect())


@pytest.fixture(scope="module")
def wanted(given):
    names, until = given
    return sorted((n, *c) for n, rows in names.items() for c in plain(rows, until))


def test_all_users_as_plain_python(spark, sf, wanted):
    assert shown(watch.feed(spark, sf)) == wanted
    reasons, leaves = Counter(w[5] for w in wanted), sum(w[3] is None for w in wanted)
    assert len(reasons) >= 4 and leaves > 5 and any(w[2] == "Watch Negative" and w[3] == "Monitor" for w in wanted)


def test_names_leave_without_any_update(wanted, given):
    """Most departures are at a moment at which nothing came in."""
    names, _ = given
    times = {(n, r["at"]) for n, rows in names.items() for r in rows}
    assert sum(w[3] is None and (w[0], w[1]) not in times for w in wanted) > 5


def test_the_list_and_its_exposures(spark, sf, wanted):
    got = {r["entity"]: r for r in watch.R.queries["watch_exposures"](spark, sf).collect()}
    held = {r["obligor_id"]: (round(r["exposure"] / 1e6 + 1e-12, 1), round(r["protection"] / 1e6 + 1e-12, 1), r["rating"]) for r in books.R.queries["exposures"](spark, sf).collect()}
    last = {}
    for w in wanted:
        last[w[0]] = w
    assert got.keys() == {n for n, w in last.items() if w[3]} and got
    for n, r in got.items():
        assert (r["status"], r["score"]) == (last[n][3], last[n][4])
        assert (r["exposure"], r["protection"], r["rating"]) == held.get(n, (0.0, 0.0, None))
        first = {s: min(w[1] for w in wanted if w[0] == n and w[3] == s and w[6]) for s in ("Monitor", "Watch Negative") if any(w[0] == n and w[3] == s for w in wanted)}
        assert (r["first_monitor"] is not None) == ("Monitor" in first) and (r["first_watch"] is not None) == ("Watch Negative" in first)


def test_stream_as_batch(rocks, sf, wanted, given):  # noqa: F811
    """Five files in order, then one row of nobody that moves the watermark: timers bring up the rest."""
    _, until = given
    columns = "entity string, at timestamp, what string, id string, event_type string, impact double, focus boolean, tone double, kind string, weight double"
    rows = watch.updates(rocks, sf).select(*[c.split()[0] for c in columns.split(", ")]).cache()
    source, checkpoint, out = (tempfile.mkdtemp(prefix="spark-feed-") for _ in range(3))
    low = rows.agg(F.min(F.unix_micros("at"))).first()[0]
    step = (until - low) // 5 + 1
    query = lambda: watch_feed.change_feed(rocks.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    for i in range(5):
        part = (F.unix_micros("at") - low) / step
        rows.where((part >= i) & (part < i + 1)).coalesce(1).write.mode("append").parquet(source)
        if i in (1, 4):
            query().awaitTermination()
    rocks.sql(f"select 'nobody' entity, timestamp_micros({until}) at, 'opinion' what, null id, null event_type, null impact, null focus, 0.0 tone, 'news' kind, 1.0 weight").select([F.col(f.name).cast(f.dataType) for f in rows.schema]).coalesce(1).write.mode("append").parquet(source)
    query().awaitTermination()
    got = shown(rocks.read.parquet(out).where("entity <> 'nobody'"))
    assert [g for g in got if g[1] <= until // 1000 * 1000] == [w for w in wanted if w[1] <= until // 1000 * 1000]


def test_points_as_columns(spark):
    """The same points as the scorecard in columns gives."""
    cases = [dict(credit=c, news=n, centre=e, sentiment=s, evidence=w, trend=t, moved=m) for c in (None, (True, 9.0), (False, 9.0), (True, 6.1)) for n in (None, (False, 8.3)) for e in (None, 6.5, 9.7) for s, w, t in ((-0.4, 3.0, -0.2), (-0.4, 1.0, 0.0), (-0.16, 2.0, 0.1)) for m in (None, (True, 1.0), (False, 3.0))]
    rows = [(i, *(c["credit"] or (None, None))[::-1], *(c["news"] or (None, None))[::-1], c["centre"], c["sentiment"], c["evidence"], c["trend"], c["moved"] and c["moved"][1], c["moved"] and c["moved"][0]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, credit_impact double, credit_focus boolean, news_impact double, news_focus boolean, epicentre_impact double, sentiment double, evidence double, trend double, notches double, defaulted boolean")
    got = {r["i"]: r["s"] for r in df.select("i", signals.watch_score().alias("s")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == pytest.approx(sum(p for _, p in watch_feed.points(c)), abs=0.0151), json.dumps(c)


def test_empty_and_odd(spark):
    none = watch_feed.updates(spark.createDataFrame([], "entity string, at timestamp"), what=F.lit("opinion"))
    assert watch_feed.changes(none, 0).count() == 0
    odd = watch_feed.updates(spark.sql("select 'a' entity, null at union all select null, timestamp '2024-01-01'"), what=F.lit("event"), id=F.lit("x"), impact=F.lit(9.9), focus=F.lit(True), event_type=F.lit("CREDIT_EVENT"), tone=F.lit(0.0))
    assert watch_feed.changes(odd, 2_000_000_000_000_000).count() == 0
