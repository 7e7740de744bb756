"""Many feeds in one stream, with restarts."""

import json
import os
import tempfile

import pytest

from tidemark.sources import many_feeds


def put(path, feed, name, items):
    os.makedirs(os.path.join(path, feed), exist_ok=True)
    with open(os.path.join(path, feed, name), "w", encoding="utf-8") as f:
        for x in items:
            f.write((x if isinstance(x, str) else json.dumps(x)) + "\n")


def item(feed, k, title=None, minute=0):
    return {"key": f"{feed}-{k}", "title": title or f"A long headline number {k} of {feed}", "at": f"2024-01-01T00:{minute:02d}:00+00:00", "url": f"http://x/{feed}/{k}"}


@pytest.fixture
def registered(spark):
    spark.dataSource.register(many_feeds.ManyFeeds)
    return spark


def run(spark, path, out, checkpoint, once=True, **options):
    reader = spark.readStream.format("many_feeds").option("path", path).option("log", f"{checkpoint}-log")
    for k, v in options.items():
        reader = reader.option(k, v)
    items = reader.load()
    query = (many_feeds.fresh(items) if once else items).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        for _ in range(3):
            query.processAllAvailable()
    finally:
        query.stop()


def test_two_restarts_lose_and_repeat_nothing(registered):
    path, out, checkpoint = (tempfile.mkdtemp(prefix="spark-feeds-") for _ in range(3))
    want = set()
    for turn in range(3):
        for feed in (f"f{i:02d}" for i in range(5 + turn)):
            n = 9 if feed == "f01" else 1  # one feed floods
            for j in range(n):
                put(path, feed, f"202401010{turn}{j:02d}00.json", [item(feed, f"{turn}.{j}"), item(feed, "same")])
                want |= {f"{feed}-{turn}.{j}", f"{feed}-same"}
        run(registered, path, out, checkpoint, feeds_per_batch=2, files_per_feed=3)
        got = [r["key"] for r in registered.read.parquet(out).collect()]
        assert sorted(got) == sorted(want)


def test_no_file_is_read_twice(registered):
    """Without the keyed state behind it: each file's rows are there once, after two restarts."""
    path, out, checkpoint = (tempfile.mkdtemp(prefix="spark-feeds-") for _ in range(3))
    for turn in range(3):
        for feed in "abcd":
            put(path, feed, f"202401010{turn}0000.json", [item(feed, turn)])
        run(registered, path, out, checkpoint, once=False, feeds_per_batch=3)
        assert sorted(r["key"] for r in registered.read.parquet(out).collect()) == sorted(f"{f}-{t}" for f in "abcd" for t in range(turn + 1))


def test_gate_in_the_scan(registered):
    path, out, checkpoint = (tempfile.mkdtemp(prefix="spark-feeds-") for _ in range(3))
    put(path, "a", "20240101000000.json", [item("a", 1, "Bank collapses after a run on deposits"), item("a", 2, "A quiet day in the country"), item("a", 3, "Bank"), "no json", json.dumps({"key": "a-4"}), json.dumps([1])])
    put(path, "b", "20240101000000.json", [item("b", 1, "Nothing much happened here today"), {"title": "Without any key, url or time at all"}])
    run(registered, path, out, checkpoint, must=r"\b(bank|deposits)\b", finance="b")
    rows = registered.read.parquet(out)
    assert sorted(r["key"] for r in rows.collect()) == ["Without any key, url or time at all", "a-1", "b-1"]
    assert {r["source"] for r in many_feeds.documents(rows).collect()} == {"a", "b"}
    assert str(rows.where("key like 'Without%'").first()["published_at"]) == "2024-01-01 00:00:00"


def test_turns_go_round():
    path = tempfile.mkdtemp(prefix="spark-feeds-")
    for feed in "abcde":
        for j in range(4):
            put(path, feed, f"2024010100{j:02d}00.json", [item(feed, j)])
    stream = many_feeds.FeedStream({"path": path, "feeds_per_batch": "2", "files_per_feed": "1", "log": f"{path}/log"})
    seen, at = [], stream.initialOffset()
    for _ in range(5):
        end = json.loads(json.dumps(stream.latestOffset()))
        seen.append("".join(p.feed for p in stream.partitions(at, end)))
        at = end
    assert seen == ["ab", "cd", "ae", "bc", "de"]
    again = many_feeds.FeedStream({"path": path, "feeds_per_batch": "2", "files_per_feed": "1", "log": f"{path}/log"})
    assert again.partitions(at, at) == [] and [p.feed for p in again.partitions(at, again.latestOffset())] == ["a", "b"]
