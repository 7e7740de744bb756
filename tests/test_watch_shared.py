"""Situations of a nation travel once for each share of it, with the changes that they make as updates of each name."""

import random
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from tidemark.operators import watch_feed
from tidemark.plans import watch


@pytest.mark.parametrize("share", [8_000, 40])
def test_same_changes_as_with_updates_of_each_name(spark, sf, monkeypatch, share):
    monkeypatch.setattr(watch_feed, "SHARE", share)
    rows, home, members = watch.parts(spark, sf)
    until = spark.read.parquet(f"{sf}/events.parquet").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    each = sorted(map(tuple, watch_feed.changes(watch.updates(spark, sf), until).collect()))
    assert each and sorted(map(tuple, watch_feed.changes(rows, until, shared=home, members=members).collect())) == each


def test_rows_grow_with_the_events(spark, sf):
    rows, home, _ = watch.parts(spark, sf)
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    assert rows.count() + home.count() <= 3 * events


@pytest.mark.parametrize("seed", range(6))
def test_few_of_the_moments_of_a_group_are_scored(monkeypatch, seed):
    """The same changes as with a score at each moment, from fewer scores than moments."""
    row, r, c, hour = namedtuple("row", "entity at what id event_type impact focus tone kind weight"), random.Random(seed), watch_feed.FeedConfig(), watch_feed.HOUR
    until, scored, score = 20 * 24 * hour, [0], watch_feed.Name.score
    home = sorted((r.randrange(until) // (hour if seed % 2 else 1) * (hour if seed % 2 else 1), r.choice([6.2, 7.0, 8.9, 8.96, 9.0, 10.0][: 2 + seed])) for _ in range((30, 300, 3_000)[seed % 3]))
    home = sorted({at: impact for at, impact in home}.items())
    own = []
    for i in range(120):
        at, what = r.randrange(until), r.choice(["opinion", "opinion", "opinion", "event", "situation", "migration"])
        if what == "opinion":
            own.append(row("a", at, what, str(i), None, None, None, r.choice([-1.0, -0.6, -0.3, 0.1]), r.choice(["news", "social"]), 1.0))
        elif what == "event":
            own.append(row("a", at, what, str(i), r.choice(["CREDIT_EVENT", "REGULATORY"]), r.uniform(5, 9), r.random() < 0.5, r.uniform(-1, 1), None, None))
        elif r.random() < 0.3:
            own.append(row("a", at, what, str(i), None, r.uniform(0, 9), what == "situation" or r.random() < 0.2, None, None, None))

    def changes(name, rows):
        return [x for u in sorted(rows, key=lambda u: u[1:4]) for x in name.take(u, c)] + name.advance("a", c, until)

    each = changes(watch_feed.Name(), own + [row("a", at, "situation", f"h{k}", None, impact, False, None, None, None) for k, (at, impact) in enumerate(home)])
    monkeypatch.setattr(watch_feed.Name, "score", lambda self, *a: scored.__setitem__(0, scored[0] + 1) or score(self, *a))
    assert changes(watch_feed.Name(shared=watch_feed.Shared(home, c)), own) == each and len(each) > 5
    assert scored[0] < 120 + len(own) + 20 * len(each) and (len(home) < 2_500 or scored[0] < len(home) / 2)
