"""The stress test's roll-up over netted positions against that over each position."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import credit
from tidemark.plans import books


def test_netted_roll_up(spark, sf):
    book, moves, dims = books.book(spark, sf), books.own_scenarios(spark), ["asset_class", "sector", "region"]
    twice = book.unionByName(book.withColumns({"position_id": F.col("position_id") + 10**9, "notional": F.col("notional") * 2})).cache()
    few = credit.netted(twice, moves)
    kinds = few.select("n", "obligor_id").collect()
    assert sum(r["n"] for r in kinds) == twice.count() and len(kinds) <= book.count()
    assert {r["obligor_id"] for r in kinds} == {None, "C7"}  # the one that a scenario names
    whole, net = ({(r["scenario_id"], r["dim"], r["value"]): r for r in credit.roll_up(credit.stress(b, moves), dims).collect()} for b in (twice, few))
    assert whole.keys() == net.keys() and len(net) > 30
    for k, r in whole.items():
        assert (net[k]["positions"], net[k]["pnl"]) == (r["positions"], pytest.approx(r["pnl"], rel=1e-9, abs=1e-3)), k


def test_kinds_do_not_grow(spark, sf):
    book, moves = books.book(spark, sf), books.own_scenarios(spark)
    more = book
    for i in range(1, 4):
        more = more.unionByName(book.withColumn("position_id", F.col("position_id") + i * 10**9))
    assert credit.netted(more, moves).count() == credit.netted(book, moves).count()
