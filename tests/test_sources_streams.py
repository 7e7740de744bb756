"""File sources, sinks and streams: a stream that has ended must say what the batch says."""

import json
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clusters, state
from tidemark.sources import files
from tidemark.streaming import live

T0 = datetime(2024, 1, 1)


def test_news_index(spark, tmp_path):
    def line(ts="20240101120000", title="A title that is long enough", themes="ECON_X;TAX;ECON_A;ECON_X", tone="-2.5,1"):
        c = [""] * 27
        c[1], c[4], c[7], c[15], c[26] = ts, "http://u", themes, tone, f"<PAGE_TITLE>{title}</PAGE_TITLE>"
        return "\t".join(c)

    (tmp_path / "a.csv").write_text("\n".join([line(), line(ts="bad"), line(title="short"), "x\ty", line(tone="")]) + "\n")
    rows = files.news_index(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and rows[0]["themes"] == ["ECON_A", "ECON_X"] and {r["tone"] for r in rows} == {-2.5, None}


def test_slots(spark):
    got = files.slots(spark, "2024-01-01 00:00:00", "2024-01-01 01:00:00").collect()
    assert [r["file"][:14] for r in got] == ["20240101000000", "20240101001500", "20240101003000", "20240101004500"]


def test_book_keeps_na_country(spark, tmp_path):
    names = [f.split()[0] for f in files.POSITION.split(", ")]
    (tmp_path / "b.csv").write_text(",".join(names) + "\n" + ",".join("NA" if n == "country" else "" if n == "bond_type" else "1" for n in names) + "\n")
    r = files.book(spark, str(tmp_path / "b.csv")).first()
    assert r["country"] == "NA" and r["bond_type"] is None and r["notional"] == 1.0


def test_wide_csv_and_phrases(spark, tmp_path):
    (tmp_path / "w.csv").write_text("id,a,b\nx,1.5,\ny,,2\n")
    assert sorted(tuple(r) for r in files.wide_csv(spark, str(tmp_path / "w.csv"), "id").collect()) == [("x", "a", 1.5), ("y", "b", 2.0)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "50.txt").write_bytes("Le caf\xe9 a ferm\xe9@negative\nnoise\n".encode("latin-1"))
    (tmp_path / "p" / "90.txt").write_bytes("Le caf\xe9 a ferm\xe9@neutral\n".encode("latin-1"))
    assert [tuple(r) for r in files.phrase_files(spark, str(tmp_path / "p")).collect()] == [("Le café a fermé", "neutral")]


def test_replay_pack_and_capped_writer(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text("\n".join(json.dumps({"doc_id": str(i), "text": "t", "published_at": f"2024-01-0{3 - i}T00:00:00Z"}) for i in range(3)))
    docs = files.replay_pack(spark, str(tmp_path / "n.jsonl"))
    assert [r["doc_id"] for r in docs.collect()] == ["2", "1", "0"]
    files.write_capped(docs, str(tmp_path / "out"), "text", ["published_at"], 2)
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_labels_and_markdown(spark):
    rows = spark.createDataFrame([("t", '{"A": "pos", "B": "neg"}'), ("u", "broken")], "text string, d string")
    assert files.labelled_entities(rows, "text", "d").count() == 2
    assert files.report_markdown(spark.createDataFrame([("a", 1)], "n string, v long")).splitlines()[1] == "|---|---:|"


def write_batches(spark, rows, schema, path, size):
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").json(path)


OBS = "entity string, seq long, at timestamp, score double, weight double"


def test_decayed_stream_equals_batch(spark, tmp_path):
    rows = [("e" if i % 3 else "f", i, T0 + timedelta(minutes=7 * i), math.sin(i), 1.0) for i in range(40)]
    write_batches(spark, rows, OBS, str(tmp_path / "in"), 10)
    seen = {}
    stream = live.decayed(live.replay(spark, str(tmp_path / "in"), OBS), 36.0)
    live.to_sinks(stream, str(tmp_path / "cp"), lambda df, n: seen.update({r["entity"]: r for r in df.collect()}), mode="update").awaitTermination()
    now = T0 + timedelta(days=2)
    batch = state.decayed_state(spark.createDataFrame(rows, OBS).withColumn("kind", F.lit("news")), F.lit(now), {"news": 36.0, "social": 12.0}, {"news": 1.0, "social": 0.35}, 9)
    for r in batch.collect():
        s = seen[r["entity"]]
        f = 0.5 ** ((now.timestamp() - s["at"]) / 3600 / 36)
        assert r["evidence"] == pytest.approx(s["weight"] * f) and r["sentiment"] == pytest.approx(s["weighted"] * f / (s["weight"] * f + 2), abs=1e-6)


def test_cluster_stream_equals_batch(spark, tmp_path):
    schema = "shard string, doc_id string, seq long, at timestamp, embedding array<double>, names array<string>"
    rows = [("s", str(i), i, T0 + timedelta(minutes=i), [math.cos(i % 4 * 0.3), math.sin(i % 4 * 0.3)], []) for i in range(30)]
    write_batches(spark, rows, schema, str(tmp_path / "in"), 10)
    got = {}
    stream = clusters.cluster_stream(live.replay(spark, str(tmp_path / "in"), schema))
    live.to_sinks(stream, str(tmp_path / "cp"), lambda df, n: got.update({r["doc_id"]: r["cluster_id"] for r in df.collect()})).awaitTermination()
    batch = {r["doc_id"]: r["cluster_id"] for r in clusters.cluster(spark.createDataFrame(rows, schema)).collect()}
    assert got == batch


def test_first_copies_and_sinks(spark, tmp_path):
    schema = "doc_id string, text string, at timestamp"
    rows = [(str(i), f"Story {i % 4}!", T0 + timedelta(minutes=i)) for i in range(16)]
    write_batches(spark, rows, schema, str(tmp_path / "in"), 8)
    stream = live.first_copies(live.replay(spark, str(tmp_path / "in"), schema), "at")
    out, table = str(tmp_path / "out"), str(tmp_path / "table")
    live.to_sinks(stream, str(tmp_path / "cp"), live.json_lines(out), live.upsert(table, ["fp"], ["at"])).awaitTermination()
    assert spark.read.json(out).count() == 4
    newest = sorted(p.name for p in (tmp_path / "table").iterdir())[-1]
    assert spark.read.parquet(f"{table}/{newest}").count() == 4


def test_windows_over_a_stream(spark, tmp_path):
    schema = "at timestamp, k string, value double"
    rows = [(T0 + timedelta(minutes=i), "a", 1.0) for i in range(60)]
    write_batches(spark, rows, schema, str(tmp_path / "in"), 30)
    total = []
    stream = live.windowed(live.replay(spark, str(tmp_path / "in"), schema), "at", "15 minutes", None, ["k"])
    live.to_sinks(stream, str(tmp_path / "cp"), lambda df, n: total.extend(df.collect()), mode="complete").awaitTermination()
    last = {r["window"]["start"]: r["n"] for r in total}
    assert sum(last.values()) == 60 and set(last.values()) == {15}
