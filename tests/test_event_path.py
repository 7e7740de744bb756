"""Parts of the event path, scenarios, settings and caches on cases of known result."""

import json
from dataclasses import dataclass, field

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import cues
from tidemark.operators import clusters, event_path, models, scenarios, signals
from tidemark.plans import path
from tidemark.sources import settings


@pytest.mark.parametrize(("text", "geo", "foreign", "want"), [
    ("Grocery price war deepens", True, True, ("figurative_war", {})),
    ("A silent war between grocers", False, True, ("figurative_war", {})),
    ("A silent war between grocers", True, True, (None, {"GEOPOLITICAL": 1})),
    ("Balance-sheet time bomb ticks", False, True, ("figurative_bomb", {})),
    ("Time bomb found", True, True, (None, {})),
    ("Price war while missiles fly", True, True, (None, {"GEOPOLITICAL": 1})),
    ("Analyst downgrades it to sell", True, True, (None, {"MARKET_COMMENTARY": 2})),
    ("Broker downgrades to sell after default", True, True, (None, {"CREDIT_EVENT": 1, "MARKET_COMMENTARY": 1})),
    ("Senators hold hearings", True, False, ("domestic_policy", {})),
    ("Senators hold hearings on sanctions", True, False, (None, {"GEOPOLITICAL": 1})),
    ("WAR CHEST and war rooms", True, True, ("figurative_war", {})),
    (None, True, True, (None, {})),
])
def test_cue_hits(spark, text, geo, foreign, want):
    row = spark.createDataFrame([(text,)], "t string").select(cues.cue_hits(F.col("t"), F.lit(geo), F.lit(foreign), path.CUES, path.SEVERITY).alias("h")).first()["h"]
    flags = [f for f in ("figurative_war", "figurative_bomb", "domestic_policy") if row[f]]
    assert flags == ([want[0]] if want[0] else []) and {k: n for k, n in row["by_type"].items() if n} == want[1]


def test_fused_moves_what_geopolitics_had(spark):
    df = spark.createDataFrame([("Grocery price war deepens",), ("Nothing",), ("Time bombs",)], "t string")
    probs = F.array(*[F.lit(x) for x in (0.5, 0.1, 0.1, 0.1, 0.1, 0.1)])
    hits = cues.cue_hits(F.col("t"), F.lit(False), F.lit(True), path.CUES, path.SEVERITY)
    got = [r[0] for r in df.select(cues.fused(probs, hits, path.TYPES)).collect()]
    assert got[0] == pytest.approx([0, 0.1, 0.1, 0.6, 0.1, 0.1]) and got[1] == [0.5, 0.1, 0.1, 0.1, 0.1, 0.1] and got[2] == pytest.approx([0, 0.2, 0.2, 0.2, 0.2, 0.2])


def test_trends_keep_samples_apart(spark):
    h = 3600.0
    rows = [("a", 0.0, 0.5), ("a", 300.0, 0.9), ("a", 10 * h, 0.2), ("a", 25 * h, 0.1), ("a", 34.5 * h, -0.3), ("b", 0.0, 0.4)]
    got = [(r["at"], round(r["trend"], 6)) for r in event_path.trends(spark.createDataFrame(rows, "entity string, at double, sentiment double")).orderBy("entity", "at").collect()]
    assert got == [(0.0, 0.5), (300.0, 0.9), (10 * h, 0.2), (25 * h, -0.4), (34.5 * h, -0.5), (0.0, 0.4)]


def test_watch_score_of_what_is_not_there(spark):
    none = {k: F.lit(None).cast("double") for k in ("credit_impact", "news_impact", "epicentre_impact", "sentiment", "evidence", "trend", "notches")} | {k: F.lit(None).cast("boolean") for k in ("credit_focus", "news_focus", "defaulted")}
    some = none | {"notches": F.lit(3), "epicentre_impact": F.lit(9.0), "credit_impact": F.lit(7.5), "credit_focus": F.lit(False)}
    row = spark.range(1).select(signals.watch_score(none), signals.watch_score(some)).first()
    assert tuple(row) == (0.0, 1.5 + 1.5 + 1.0)


def test_subjects_and_weights(spark):
    row = spark.range(1).select(
        event_path.with_subject(F.array(F.lit("A")), F.lit("B"), F.lit(True)), event_path.with_subject(F.array(F.lit("A")), F.lit("A"), F.lit(True)), event_path.with_subject(F.array(F.lit("A")), F.lit("B"), F.lit(False)),
        event_path.novelty_weight(F.lit(10), F.lit(1.0), F.lit(0.8)), event_path.novelty_weight(F.lit(2), F.lit(0.0), F.lit(1.0)),
    ).first()
    assert tuple(row) == (["A", "B"], ["A"], ["A"], pytest.approx(0.4), pytest.approx(0.3))


def test_one_text_alone(spark):
    docs = spark.createDataFrame([("Lender defaults, a crisis of 3 billion",), ("A quiet day",), (None,)], "t string")
    got = event_path.analysed(docs, "t", path.CUES, path.SEVERITY, ["quiet"], ["crisis"], ["not"], path.BASE).collect()
    assert [r["event_type"] for r in got] == ["CREDIT_EVENT", "OTHER", "OTHER"] and got[0]["impact"] > got[1]["impact"] >= 1 and got[0]["sentiment"] < 0


def test_scenario_words_and_measures(spark):
    shocks = spark.createDataFrame([("s", "EQ_US", -5.0), ("s", "EQ_EU", -3.0), ("s", "CMD_OIL", 1.0), ("t", "CS_IG", 40.0)], "id string, factor string, shock double")
    assert {r["id"]: r["words"] for r in scenarios.in_words(shocks, "id").collect()} == {"s": "equities fall", "t": "credit spreads widen"}
    rows = [("pct", 100.0, 90.0, None, None, None, False), ("pct", 100.0, 90.0, 100.0, 95.0, None, False), ("pct", 1.2, 1.0, None, None, None, True), ("bp", 4.0, 4.5, None, None, None, False), ("bp", 100.0, 96.0, 100.0, 101.0, 4.0, False), ("pts", 20.0, 31.0, None, None, None, False)]
    df = spark.createDataFrame(rows, "unit string, a double, b double, c double, d double, dur double, inv boolean")
    got = [round(r[0], 6) for r in df.select(scenarios.measured(*[F.col(c) for c in ("unit", "a", "b", "c", "d", "dur", "inv")])).collect()]
    assert got == [-10.0, -5.0, 20.0, 50.0, 125.0, 11.0]
    with pytest.raises(ValueError):
        scenarios.MOST_EPISODES, most = 1, scenarios.MOST_EPISODES
        try:
            scenarios.eligible(shocks, spark.range(3).selectExpr("id as episode_id", "current_date() as end", "'x' as event_type", "false as extreme"))
        finally:
            scenarios.MOST_EPISODES = most


def test_events_of_firms_need_a_shared_name(spark):
    v, t = [1.0, 0.0], "2024-01-01 00:00:00"
    rows = [("FIRM", "1", 1, v, ["A"]), ("FIRM", "2", 2, v, ["B"]), ("FIRM", "3", 3, [0.8, 0.6], ["A"]), ("WIDE", "4", 4, v, []), ("WIDE", "5", 5, v, ["B"]), ("WIDE", "6", 6, [0.72, 0.69], ["B"])]
    df = spark.createDataFrame(rows, "event_type string, doc_id string, seq int, embedding array<double>, names array<string>").withColumn("at", F.lit(t).cast("timestamp"))
    got = {r["doc_id"]: r["cluster_id"] for r in clusters.event_clusters(df, ["FIRM"]).collect()}
    assert got == {"1": "1", "2": "2", "3": "1", "4": "4", "5": "4", "6": "4"}


def test_the_first_model_that_loads():
    def broken():
        raise OSError("no file")

    assert models.first_available([broken, lambda: "second"], "rules") == "second" and models.first_available([broken], "rules") == "rules"


def test_head_with_a_hidden_layer_and_nulls(spark):
    head = models.mlp([np.eye(2), np.eye(2)], [np.zeros(2), np.zeros(2)])
    got = [r[0] for r in spark.createDataFrame([([1.0, -1.0],), (None,)], "e array<double>").select(head(F.col("e"))).collect()]
    assert got[0] == pytest.approx([np.e / (np.e + 1), 1 / (np.e + 1)]) and got[1] is None


@dataclass
class Inner:
    hours: float = 48.0
    names: list[str] = field(default_factory=list)


@dataclass
class Outer:
    title: str
    inner: Inner = field(default_factory=Inner)
    weights: dict[str, float] = field(default_factory=dict)


@pytest.mark.parametrize(("text", "fault"), [("title: 3", "title"), ("{}", "missing"), ("title: a\ninner: {hours: x}", "inner.hours"), ("title: a\nother: 1", "unknown"), ("title: a\nweights: {a: b}", "weights.a"), ("- 1", "mapping")])
def test_faulty_settings_are_named(spark, tmp_path, text, fault):
    (tmp_path / "s.yaml").write_text(text)
    with pytest.raises(ValueError, match=fault):
        settings.load_settings(spark, str(tmp_path / "s.yaml"), Outer)


def test_settings_and_packs(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"title": "t", "inner": {"hours": 3, "names": ["a"]}, "weights": {"x": 1}}))
    assert settings.load_settings(spark, str(tmp_path / "s.json"), Outer) == Outer("t", Inner(3.0, ["a"]), {"x": 1.0})
    for name, body in (("one", {"title": "One", "start": "2022-01-01", "news": {"kept_articles": 5}}), ("two", {"social": {"posts": 7}})):
        (tmp_path / "packs" / name).mkdir(parents=True)
        (tmp_path / "packs" / name / "manifest.json").write_text(json.dumps(body, indent=1))
    assert sorted(map(tuple, settings.packs(spark, str(tmp_path / "packs")).collect())) == [("one", "One", "2022-01-01", None, 5, None), ("two", "two", None, None, None, 7)]


def test_texts_are_embedded_once(spark, tmp_path):
    docs = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "text string")
    size = lambda c: F.array(F.length(c).cast("double"))
    got = settings.embedded(docs, str(tmp_path / "c"), size, "e1").collect()
    assert sorted((r["text"], r["embedding"]) for r in got if r["text"]) == [("a", [1.0]), ("a", [1.0]), ("bb", [2.0])]
    other = lambda c: F.array(F.lit(-1.0))
    again = {r["text"]: r["embedding"] for r in settings.embedded(docs.union(spark.createDataFrame([("new",)], "text string")), str(tmp_path / "c"), other, "e1").collect()}
    assert again == {"a": [1.0], "bb": [2.0], "new": [-1.0], None: None}


def test_small_helpers(spark):
    from tidemark.functions import text

    df = spark.createDataFrame([("First one. The bank fell! Last.", -1.26e9), ("Nothing here", 35e6), (None, 900.0)], "t string, x double")
    assert [r[0] for r in df.select(text.excerpt(F.col("t"), "(?i)bank")).collect()] == ["The bank fell!", "Nothing here", None]
    assert [r[0] for r in df.select(text.money(F.col("x"))).collect()] == ["-$1.3bn", "$35.0m", "$900"]


def test_signals_at_openings_of_many_years(spark):
    """Thousands of half-lives apart, ties with an opening, gaps longer than a segment, against plain sums."""
    from datetime import datetime, timedelta, timezone

    start, rng = datetime(1990, 1, 1, tzinfo=timezone.utc), np.random.default_rng(4)
    at = [start + timedelta(hours=float(h)) for h in [*rng.uniform(0, 500, 30), *rng.uniform(60_000, 60_100, 20), 260_000.0, 260_010.0]]
    rows = [(f"E{i % 3}", "news" if i % 4 else "social", float(rng.uniform(-1.5, 1.5)), float(rng.uniform(0.1, 2)), t) for i, t in enumerate(at)] + [("E0", "news", 1.0, -1.0, start), ("E0", "other", 1.0, 1.0, start)]
    opens = [start + timedelta(hours=h) for h in (0, 100, 499, 700, 7_000, 20_000, 60_050, 61_000, 120_000, 260_010, 260_011, 300_000)]
    hl, cred = {"news": 36.0, "social": 12.0}, {"news": 1.0, "social": 0.35}
    df = spark.createDataFrame(rows, "entity string, kind string, score double, weight double, at timestamp")
    got = {(r["entity"], r["open"]): (r["evidence"], r["sentiment"]) for r in event_path.signals_at(df, spark.createDataFrame([(o,) for o in opens], "open timestamp"), hl, cred).collect()}
    want = {}
    for e in ("E0", "E1", "E2"):
        for o in opens:
            parts = [(w * 0.5 ** ((o - t).total_seconds() / 3600 / hl[k]) * cred[k], max(-1, min(1, s))) for n, k, s, w, t in rows if n == e and t < o and w > 0 and k in hl]
            if sum(w for w, _ in parts) > 0:
                want[e, o] = sum(w for w, _ in parts), sum(w * s for w, s in parts) / (sum(w for w, _ in parts) + 2)
    naive = {(e, o.astimezone(timezone.utc)): v for (e, o), v in got.items()}
    assert naive.keys() == want.keys() and len({v[0] < 1e-50 for v in want.values()}) == 2
    for k, (evidence, sentiment) in want.items():
        assert naive[k][0] == pytest.approx(evidence, rel=1e-9, abs=1e-300) and naive[k][1] == pytest.approx(sentiment, rel=1e-9, abs=1e-300)
