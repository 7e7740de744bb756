"""Copies, stories and events: batch and stream against plain Python."""

import hashlib
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import path_fold

SCHEMA = "shard string, doc_id string, fp string, batch long, seq long, at timestamp, type int, relevance double, embedding array<double>, entities array<string>, companies array<string>"


def made(seed, n=160, dim=6, hours=0.4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(9, dim))
    rows, texts = [], []
    at = 0.0
    for i in range(n):
        at += rng.exponential(hours) + (80 if i in (70, 120) else 0)
        k = int(rng.integers(9))
        copy = texts and rng.random() < 0.3
        fp = texts[int(rng.integers(len(texts)))] if copy else f"t{i}"
        texts.append(fp)
        v = base[k] + rng.normal(size=dim) * rng.choice([0.05, 0.3, 0.6])
        firms = sorted({f"C{int(c)}" for c in rng.integers(0, 4, rng.integers(0, 3))})
        places = sorted({f"L{int(c)}" for c in rng.integers(0, 3, rng.integers(0, 2))})
        rows.append((f"s{k % 2}", f"d{i}", fp if rng.random() < 0.95 else None, int(at // 2), i, at * 3600, k % 3, None if i == 5 else float(rng.choice([0.2, 0.5, 0.9])), None if i == 9 else v.tolist(), firms + places, firms))
    return rows


def plain(rows, c):
    """The same in the simplest way: every cluster kept with all its vectors, the window applied when the real one is."""
    out = []
    for shard in sorted({r[0] for r in rows}):
        stories, events, seen = {}, {}, []
        calls = {"s": 0, "e": 0}

        def unit(vs):
            return np.sum(vs, axis=0) / np.linalg.norm(np.sum(vs, axis=0))

        def sweep(kind, groups, every, now):
            calls[kind] += 1
            if calls[kind] == every:
                calls[kind] = 0
                for g in [g for g, x in groups.items() if x["last"] < now - c.window_hours * 3600]:
                    del groups[g]

        for _, doc, fp, batch, _, at, kind, relevance, v, names, firms in sorted((r for r in rows if r[0] == shard), key=lambda r: (r[3], r[5], r[4])):
            hit = next((x for x in seen if fp is not None and x[0] == fp), None)
            if hit:
                story = stories.get(hit[1]) if hit[2] < batch or not c.wait_for_batch else None
                event = events.get(story["event"]) if story else None
                if event:
                    story["last"], event["last"] = max(story["last"], at), max(event["last"], at)
                out.append((doc, True, False, hit[1] if event else None, story["event"] if event else None, None, False, False))
                continue
            found = (None, None, None, False, False)
            if relevance is not None and relevance >= c.relevance and v is not None:
                v = np.array(v) / np.linalg.norm(v)
                sweep("s", stories, c.story_checks, at)
                best = sorted(((-(float(unit(x["v"]) @ v)), i, s) for i, (s, x) in enumerate(stories.items())))[: c.candidates]
                best = [(-s - (c.apart if firms and stories[n]["names"] and not set(firms) & stories[n]["names"] else 0), -i, n) for s, i, n in best]
                top = max(best, default=(-1, 0, None), key=lambda b: b[0])
                new = top[0] < c.story
                story = "sty_" + hashlib.sha1(doc.encode()).hexdigest()[:10] if new else top[2]
                event = None if new else stories[story]["event"]
                lost = not new and event not in events
                if new or lost:
                    sweep("e", events, c.event_checks, at)
                    able = []
                    for e, x in events.items():
                        bar = c.event - (c.shared if set(names) & x["names"] else 0)
                        over = float(unit(x["v"]) @ v) - bar
                        if x["type"] == kind and over >= 0 and (kind in c.market_wide or set(firms) & x["names"]):
                            able.append((over, e))
                    event = max(able, key=lambda a: a[0])[1] if able else "evt_" + hashlib.sha1(doc.encode()).hexdigest()[:10]
                    events.setdefault(event, {"v": [], "names": set(), "type": kind, "last": at})
                stories.setdefault(story, {"v": [], "names": set(), "last": at})["event"] = event
                for x, more in ((stories[story], firms), (events[event], names)):
                    x["v"].append(v)
                    x["names"] |= set(more)
                    x["last"] = max(x["last"], at)
                found = (story, event, 1.0 if new else 1 - top[0], new, lost)
            if fp is not None:
                seen = [x for x in seen if x[0] != fp] + [(fp, found[0], batch)]
                seen = seen[-c.copies :]
            out.append((doc, False, found[0] is None, *found))
    return sorted(out)


def shown(df):
    return sorted((r["doc_id"], r["duplicate"], r["noise"], r["story_id"], r["event_id"], r["novelty"], r["founds_story"], r["refounded"]) for r in df.collect())


def same(got, want):
    assert [g[:5] + g[6:] for g in got] == [w[:5] + w[6:] for w in want]
    assert all(g[5] is None if w[5] is None else g[5] == pytest.approx(min(max(w[5], 0), 1), abs=1e-9) for g, w in zip(got, want, strict=True))


CONFIGS = {
    "small": path_fold.FoldConfig(story=0.9, event=0.7, market_wide=(0,), copies=12, story_checks=3, event_checks=1, window_hours=6),
    "plain": path_fold.FoldConfig(market_wide=(0, 1)),
    "at once": path_fold.FoldConfig(story=0.9, event=0.7, market_wide=(0, 1, 2), copies=40, story_checks=7, event_checks=2, window_hours=10, wait_for_batch=False),
}


def frame(spark, rows):
    return spark.createDataFrame([(*r[:5], None, *r[6:]) for r in rows], SCHEMA).drop("at").join(spark.createDataFrame([(r[1], r[5]) for r in rows], "doc_id string, s double"), "doc_id").withColumn("at", F.timestamp_seconds(F.lit(1704067200) + F.col("s")))


@pytest.mark.parametrize("name", CONFIGS)
def test_batch_as_plain_python(spark, name):
    for seed in (1, 2):
        rows = made(seed)
        same(shown(path_fold.fold_batch(frame(spark, rows), CONFIGS[name])), plain(rows, CONFIGS[name]))


def test_the_cases_are_all_there():
    """An event that dies before its story, a copy that comes back after it was forgotten, copies that count and copies that do not."""
    want = plain(made(1), CONFIGS["small"]) + plain(made(2), CONFIGS["small"])
    assert any(w[7] for w in want) and any(w[6] for w in want) and any(w[2] for w in want)
    assert any(w[1] and w[3] for w in want) and any(w[1] and not w[3] for w in want)
    few, many = (sum(w[1] for w in plain(made(1), path_fold.FoldConfig(copies=n))) for n in (5, 1000))
    assert few < many


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def run_stream(spark, docs, config, folders, checkpoint, out):
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(folders)
    query = path_fold.fold_stream(stream, config).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_stream_as_batch(rocks):
    """Micro-batch by micro-batch, with a restart in the middle: the same ids as one batch, and as plain Python."""
    rows = made(1)
    docs = frame(rocks, rows).select([c.split()[0] for c in SCHEMA.split(", ")]).cache()
    source, checkpoint, out = (tempfile.mkdtemp(prefix="spark-stream-") for _ in range(3))
    numbers = sorted({r[3] for r in rows})
    cuts = [numbers[0], *numbers[15::15], numbers[-1] + 1]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            docs.where((F.col("batch") >= a) & (F.col("batch") < b)).coalesce(1).write.mode("append").parquet(source)
            if a in cuts[:2] or b == cuts[-1]:
                run_stream(rocks, docs, CONFIGS["small"], source, checkpoint, out)
    same(shown(rocks.read.parquet(out)), plain(rows, CONFIGS["small"]))


def test_no_rows_and_odd_rows(spark):
    assert path_fold.fold_batch(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("a", "1", None, None, None, None, None, None, None, None, None), ("a", "2", "x", 0, 1, None, 0, 0.9, [0.0, 0.0], None, None), (None, "3", "x", 0, 1, None, 0, 0.9, [1.0, 0.0], [], [])]
    got = shown(path_fold.fold_batch(spark.createDataFrame(rows, SCHEMA)))
    assert [g[1:3] for g in got] == [(False, True), (False, False), (False, False)]
