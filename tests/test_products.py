"""Stories' neighbours by blocks of products against the query's SQL: copies, ties, odd vectors; and a group against a share in little time."""

import time

import duckdb
import numpy as np
import pyarrow as pa

from tidemark.operators import knn
from tidemark.plans import documents


def test_same_as_sql_with_copies_in_shares(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(knn, "SHARE", 50)
    monkeypatch.setattr(knn, "GROUP", 4)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(60, 64)), 5, axis=0)
    rows = [(i, i % 2 if i % 50 else None, [float(e) for e in v]) for i, v in enumerate(x)] + [(1000, 7, [1.0] * 64), (1020, 7, [2.0] * 64)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = documents.R.queries["knn_stories"](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({documents.R.sql['knn_stories']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_a_group_against_a_share():
    rng = np.random.default_rng(1)
    left = pa.table({"query_id": np.arange(2048), "q": pa.array(list(rng.normal(size=(2048, 64))))})
    right = pa.table({"id": np.arange(8192), "x": pa.array(list(rng.normal(size=(8192, 64))))})
    start = time.process_time()
    assert knn._products(left, right, 5).num_rows >= 5 * 2048
    assert time.process_time() - start < 4
