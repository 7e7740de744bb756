"""Slot streams with a late file, RSS and posts."""

import json

from tidemark.sources import feeds


def slot(path, name, text):
    (path / f"{name}.csv").write_text(text)


def test_slot_stream_waits_for_a_late_file_then_gives_up(tmp_path):
    s = feeds.SlotStream({"path": str(tmp_path), "start": "20240101000000"})
    told = lambda a, b: [r[1] for p in s.partitions(a, b) for r in s.read(p)]
    first = s.initialOffset()
    assert s.latestOffset() == {"slot": "20240101000000"}
    slot(tmp_path, "20240101000000", "a\nb\n")
    slot(tmp_path, "20240101003000", "d\n")
    offset = s.latestOffset()
    assert told(first, offset) == ["a", "b"] and offset == {"slot": "20240101001500"}
    slot(tmp_path, "20240101001500", "c\n")
    after = s.latestOffset()
    assert told(offset, after) == ["c", "d"] and after == {"slot": "20240101004500"}
    slot(tmp_path, "20240101014500", "z\n")
    later = s.latestOffset()
    assert told(after, later) == [] and later == {"slot": "20240101010000"}  # a slot that is four old is passed over
    assert told(first, after) == ["a", "b", "c", "d"]
    again = feeds.SlotStream({"path": str(tmp_path), "start": "20240101000000"})
    again.commit(after)
    assert again.latestOffset() == later


def test_slot_feed_as_a_source(spark, tmp_path):
    spark.dataSource.register(feeds.SlotFeed)
    (tmp_path / "in").mkdir()
    for i, text in enumerate(("a\nb\n", "c\n")):
        slot(tmp_path / "in", f"2024010100{15 * i:02d}00", text)
    load = {"path": str(tmp_path / "in"), "start": "20240101000000"}
    assert spark.read.format("slot_feed").options(**load).load().count() == 3
    out = str(tmp_path / "out")
    q = spark.readStream.format("slot_feed").options(**load).load().writeStream.format("json").option("checkpointLocation", str(tmp_path / "cp")).start(out)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r["line"] for r in spark.read.json(out).collect()) == ["a", "b", "c"]


def test_rss(spark, tmp_path):
    item = "<item><title>{}</title><link>{}</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>"
    (tmp_path / "f.xml").write_text("<rss><channel>" + item.format("A headline of some length", "u1") + item.format("short", "u2") + item.format("A headline of some length", "u1") + "</channel></rss>")
    rows = feeds.rss_items(spark, str(tmp_path / "f.xml"), "wire").collect()
    assert len(rows) == 1 and rows[0]["published_at"].hour == 10 and len(rows[0]["doc_id"]) == 16


def test_posts(spark, tmp_path):
    (tmp_path / "p.json").write_text("\n".join(json.dumps(r) for r in [{"id": "1", "body": "to the moon and back", "symbol": "X"}, {"id": "1", "body": "to the moon and back"}, {"id": "2", "body": "short"}]))
    rows = feeds.posts(spark, str(tmp_path / "p.json")).collect()
    assert len(rows) == 1 and rows[0]["finance_feed"]
