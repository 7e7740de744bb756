"""Every registered query against its SQL on the small tables."""

import os

import duckdb
import pytest

from tidemark.plans import books, documents, events, markets, path, text_path, watch

REGISTRIES = (documents.R, events.R, path.R, markets.R, books.R, text_path.R, watch.R)
QUERIES = {n: q for r in REGISTRIES for n, q in r.queries.items()}
SQL = {n: s for r in REGISTRIES for n, s in r.sql.items()}


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    found = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert plain(df.collect(), df.columns) == plain(found.fetchall(), found.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_points_without_the_text_package(spark, sf):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).limit(1).count() == 1
