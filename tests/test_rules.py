"""Linking, price directions, monitors, models and memos on cases of known result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import linking, models, monitors, reports
from tidemark.operators.linking import Entity, Linker, MoveWords

W = MoveWords()
LINKER = Linker([Entity("ACME", aliases=("acme", "acme corp"), tags=("ACM",)), Entity("GAP", ambiguous=("Gap",)), Entity("INT", exact=("Intel",), excluded=(r"U\.S\. Intel",)), Entity("RU", aliases=("russia",))], r"shares|stock|profit")


@pytest.mark.parametrize(("text", "finance", "want"), [
    ("Acme Corp sues Russia", False, ["ACME", "RU"]),
    ("The Gap between them", False, []),
    ("Gap shares rise", False, ["GAP"]),
    ("Gap closes stores", True, ["GAP"]),
    ("U.S. Intel shows; Intel falls", False, ["INT"]),
    ("$acm up, acmeology down", False, ["ACME"]),
    (None, False, []),
    ("", False, []),
])
def test_links(text, finance, want):
    assert [m["entity"] for m in LINKER.link(text, finance)] == want


def test_longest_mention_wins(spark):
    df = spark.createDataFrame([("We saw ACME CORP and acme",), (None,)], "t string")
    rows = df.select(linking.link(LINKER, F.col("t")).alias("m")).select("m", linking.ids(F.col("m")).alias("ids")).collect()
    assert [m["surface"] for m in rows[0]["m"]] == ["ACME CORP", "acme"] and rows[0]["ids"] == ["ACME"] and rows[1]["ids"] == []


@pytest.mark.parametrize(("text", "want"), [
    ("Oil prices surge as talks fail", {"OIL": 1}),
    ("Gold slips, stocks tumble", {"GOLD": -1, "SPX": -1}),
    ("Oil output falls again", {}),
    ("A jump in crude", {"OIL": 1}),
    ("Falling gas prices help", {"GAS": -1}),
    ("Easter demand for gold in Los Angeles", {}),
    ("Oil and gold gain", {"OIL": 1, "GOLD": 1}),
    ("The committee met", {}),
    (None, {}),
])
def test_price_directions(text, want):
    assert linking.directions(text, W) == want


@pytest.mark.parametrize(("text", "want"), [("Acme shares slump", -1), ("Acme jumps 9%", 1), ("Acme plunges into plastics", 0), ("Acme's stock soars", 1), ("Others fall", 0)])
def test_share_direction(text, want):
    assert linking.share_direction(text, "Acme") == want


def test_situations(spark):
    h = 3600.0
    rows = [("GEO", "e1", 0.0, 7.0, 1, ["RU"]), ("GEO", "e1", h, 7.5, 10, ["RU", "UA"]), ("GEO", "e2", 2 * h, 7.6, 10, ["UA"]), ("GEO", "e3", 3 * h, 8.4, 10, ["RU"]), ("GEO", "e4", 4 * h, 8.0, 90, ["RU"]), ("GEO", "e5", 5 * h, 9.9, 999, []), ("GEO", "e6", 90 * h, 7.5, 1, ["RU"]), ("MACROECONOMIC", "m1", 0.0, 7.9, 1, []), ("MACROECONOMIC", "m2", 1.0, 8.1, 1, [])]
    got = monitors.situations(spark.createDataFrame(rows, "event_type string, event_id string, at double, impact double, reports int, keys array<string>")).collect()
    assert sorted((r["event_id"], r["situation"], r["reason"]) for r in got) == [("e1", "e1", "new"), ("e3", "e1", "impact"), ("e4", "e1", "coverage"), ("e6", "e6", "new"), ("m2", "m2", "new")]


def test_trades(spark):
    m = 60.0
    rows = [("i", 0.0, "A", 0.0, 2.0, 1.0, "x"), ("i", 5 * m, "A", 0.3, 2.0, 1.0, "x"), ("i", 20 * m, "B", 0.0, 2.0, 1.0, "x"), ("i", 40 * m, "B", 0.0, 2.0, 8.0, "y"), ("i", 70 * m, "B", 0.0, 2.0, 8.0, "y"), ("i", 120 * m, "A", 0.9, 0.5, 1.0, "x")]
    got = monitors.trades(spark.createDataFrame(rows, "index_id string, at double, ticker string, sentiment double, evidence double, impact double, event_id string"))
    assert [(r["at"] / m, r["reason"]) for r in got.orderBy("at").collect()] == [(0, "initial"), (20, "tactical"), (40, "tactical"), (120, "scheduled")]


def test_rule_model_and_batched_model(spark):
    docs = spark.createDataFrame([(1, "default looms"), (2, "nothing here"), (3, None)], "id int, t string")
    rows = {r["id"]: r for r in models.relevant(models.rules(docs.fillna(""), "t", {"CREDIT": ["default"], "OTHER": []}, ["good"], ["looms"], ["not"]), 1).collect()}
    assert rows[1]["relevant"] and not rows[2]["relevant"] and sum(rows[1]["event"]) == pytest.approx(1)

    def load():
        return lambda texts: (np.array([[len(t), 1.0] for t in texts]), np.tile([0.2, 0.3, 0.5], (len(texts), 1)), np.ones((len(texts), 1)))

    got = {r["id"]: r["o"] for r in docs.select("id", models.batched(load)(F.col("t")).alias("o")).collect()}
    assert got[1]["embedding"] == [13.0, 1.0] and got[3]["embedding"] == [0.0, 1.0]


def test_head_learns_labels(spark, sf):
    rows = spark.read.parquet(f"{sf}/../sf0.01/embeddings.parquet").withColumn("y", (F.col("embedding")[0] + F.col("embedding")[1] > 0).cast("double"))
    train, test = rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0")
    right = models.apply_head(models.fit_head(train, "y"), test).select(F.avg((F.col("guess") == F.col("y")).cast("double"))).first()[0]
    assert right > 0.85


FACTS = {"scenario_id": "crash & x", "positions": 10, "pnl": -2.5e9, "cet1_after": 0.081, "breach": True, "downgraded": 3, "pnl_fx": -1e9, "pnl_ecl": 5.0}


def test_summaries_are_held_to_the_facts():
    good = reports.summary(FACTS)
    assert reports.faults(good, FACTS) == []
    assert reports.checked_summary(FACTS, lambda p: good.replace("10 positions", "11 positions")) == good
    assert reports.checked_summary(FACTS, lambda p: "The book loses $2.5bn.") == "The book loses $2.5bn."
    for bad in ("", "word " * 200, "It loses {x}", "We recommend selling", "It loses 77"):
        assert reports.faults(bad, FACTS)
    assert len(reports.actions(FACTS)) == 3


def test_memo_escapes(spark):
    totals = spark.createDataFrame([tuple(FACTS.values())], list(FACTS))
    losses = spark.createDataFrame([("crash & x", "<p>", -5.0)], "scenario_id string, position_id string, pnl double")
    text = reports.memo(totals, losses, "crash & x")
    assert "crash &amp; x" in text and "<td>&lt;p&gt;</td>" in text
    with pytest.raises(LookupError):
        reports.memo(totals, losses, "other")
