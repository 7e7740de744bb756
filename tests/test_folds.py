"""Folds go on from batch to batch, and hold no key's rows at once."""

import pytest

from tidemark.plans import events


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["stress_situations", "index_trades", "story_clusters"])
def test_folds_are_the_same_in_small_batches(spark, sf, name):
    queries = events.R.queries if name in events.R.queries else __import__("tidemark.plans.documents", fromlist=["R"]).R.queries
    df = queries[name](spark, sf)
    assert "FlatMapGroupsInPandas" not in plan(df)
    whole = sorted(map(tuple, df.collect()), key=repr)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert whole and sorted(map(tuple, queries[name](spark, sf).collect()), key=repr) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_report_costs_the_same_however_many_came_before():
    import random
    import time

    from tidemark.operators.monitors import Desk, MonitorConfig

    draw, desk, n = random.Random(1), Desk(MonitorConfig()), 40_000
    start = time.process_time()
    for i in range(n):
        user = draw.randrange(n // 4)
        desk.report(str(user), frozenset({f"K{user % 7}"}), 7 + draw.random() * 3, draw.randrange(100), i * 30 * 86400 / n)
    assert len(desk.member) > n // 8 and time.process_time() - start < 8  # 40 seconds when every report looked through all of them
