"""The sink in two phases, counters from one scan, and order of arrival."""

import json
import os
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import path_fold
from tidemark.plans.documents import clean_sql
from tidemark.functions import text as T
from tidemark.sources import audit, sinks

ROW = "id long, text string"


def lines(path):
    out = []
    for top, _, names in os.walk(path):
        if "_pending" not in top:
            out += [json.loads(x) for n in names for x in open(os.path.join(top, n), encoding="utf-8")]
    return sorted((r["id"] for r in out))


@pytest.fixture(scope="module")
def written(spark):
    spark.dataSource.register(sinks.CommittedLines)
    return spark


def test_a_failed_task_leaves_no_row(written):
    path = tempfile.mkdtemp(prefix="spark-sink-")
    fine = written.range(0, 100, 1, 4).select("id", F.lit("é").alias("text"))
    fine.write.format("committed_lines").option("path", path).option("name", "one").mode("append").save()
    broken = fine.where("id >= 50").select("id", F.when(F.col("id") == 73, F.raise_error(F.lit("bad row"))).otherwise(F.col("text")).alias("text"))
    with pytest.raises(Exception, match="bad row"):
        broken.write.format("committed_lines").option("path", path).option("name", "two").mode("append").save()
    assert lines(path) == list(range(100)) and os.listdir(os.path.join(path, "_pending")) is not None
    assert sorted(r["id"] for r in sinks.committed(written, path, ROW).collect()) == list(range(100))


def test_a_batch_that_is_run_again_is_there_once(written):
    path = tempfile.mkdtemp(prefix="spark-sink-")
    for _ in range(3):
        written.range(20).select("id", F.lit("x").alias("text")).write.format("committed_lines").option("path", path).option("name", "b").mode("append").save()
    assert lines(path) == list(range(20))
    sink = sinks.StreamSink({"path": path})
    one, two = sink.put(iter([])), sink.put(iter(written.range(7).collect()))
    sink.commit([one, None, two], 5)
    again = sink.put(iter(written.range(7).collect()))
    sink.commit([again], 5)
    gone = sink.put(iter(written.range(3).collect()))
    sink.abort([gone, None], 6)
    assert lines(path) == sorted([*range(20), *range(7)]) and os.listdir(os.path.join(path, "_pending")) == []


def test_stream_with_a_restart(written):
    path, source, checkpoint = (tempfile.mkdtemp(prefix="spark-sink-") for _ in range(3))
    for i in range(4):
        written.range(i * 10, i * 10 + 10).select("id", F.lit("t").alias("text")).coalesce(1).write.mode("append").parquet(source)
        if i in (1, 3):
            stream = written.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(source)
            stream.writeStream.format("committed_lines").option("path", path).option("columns", "id").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert lines(path) == list(range(40)) and len([n for n in os.listdir(path) if n.startswith("batch=")]) == 4
    assert sinks.committed(written, tempfile.mkdtemp(), ROW).count() == 0


def test_counters_from_one_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", T.clean_text(F.col("text")).alias("cleaned"))
    found = audit.audited(docs, {"no_text": F.col("text").isNull(), "too_short": F.length("cleaned") < 200, "file_name": T.is_file_name(F.col("cleaned"))}, {"long": F.length("cleaned") > 2000})
    sql = f"SELECT count(*), count(*) FILTER (text IS NULL), count(*) FILTER (text IS NOT NULL AND n < 200), count(*) FILTER (n > 2000) FROM (SELECT text, length({clean_sql('text')}) AS n FROM '{sf}/documents.parquet')"
    rows, none, short, long = duckdb.sql(sql).fetchall()[0]
    c = found.counters
    assert (c["rows"], c["no_text"], c["too_short"], c["long"]) == (rows, none, short, long) and c["accepted"] == rows - none - short - c["file_name"]
    assert found.accepted.count() == c["accepted"] and found.accepted.columns == docs.columns
    assert {r["reject"]: r["count"] for r in found.rejects.groupBy("reject").count().collect()} == {k: c[k] for k in ("no_text", "too_short", "file_name") if c[k]}
    assert short > 3 and long > 3
    with pytest.raises(ValueError, match="names of their own"):
        audit.audited(docs, {"rows": F.lit(True)})
    assert audit.audited(docs.where("doc_id < 0"), {"x": F.lit(True)}).counters == {"rows": 0, "accepted": 0, "x": 0}


def test_ids_do_not_follow_the_splits(spark):
    """Texts of one time, told apart by their arrival alone: the same stories however the files are cut."""
    folder = tempfile.mkdtemp(prefix="spark-arrival-")
    names = ["d%02d" % ((i * 7) % 60) for i in range(60)]  # ids are in another order than lines
    for part in range(2):
        with open(f"{folder}/f{part}.json", "w", encoding="utf-8") as f:
            for name in names[part * 30 : part * 30 + 30]:
                f.write(json.dumps({"doc_id": name, "kind": int(name[1:]) % 3}) + "\n")
    got = []
    for size in ("100m", "300b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        rows = audit.ordered(spark.read.schema("doc_id string, kind int").json(folder))
        n = rows.rdd.getNumPartitions()
        docs = rows.select(F.lit("s").alias("shard"), "doc_id", F.lit(None).cast("string").alias("fp"), F.lit(0).alias("batch"), F.col("arrival").alias("seq"), F.timestamp_seconds(F.lit(0)).alias("at"), F.lit(0).alias("type"), F.lit(0.9).alias("relevance"), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i == F.col("kind"), 1.0).otherwise(0.0)).alias("embedding"), F.array().cast("array<string>").alias("entities"), F.array().cast("array<string>").alias("companies"))
        made = path_fold.fold_batch(docs, path_fold.FoldConfig(market_wide=(0,)))
        got.append((n, sorted((r["doc_id"], r["story_id"], r["founds_story"]) for r in made.collect()), [r["doc_id"] for r in rows.orderBy("arrival").collect()]))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got[0][0] < got[1][0] and got[0][1:] == got[1][1:] and got[0][2] == names
    first = {n: next(x for x in names if int(x[1:]) % 3 == n) for n in range(3)}
    assert {d for d, _, founds in got[0][1] if founds} == set(first.values())


def test_arrival_in_parquet(spark):
    folder = tempfile.mkdtemp(prefix="spark-arrival-")
    spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).coalesce(1).write.mode("overwrite").option("parquet.block.size", 1024).parquet(folder)
    rows = audit.ordered(spark.read.parquet(folder)).orderBy("arrival").collect()
    assert [r["v"] for r in rows] == [i * 7919 % 1000 for i in range(1000)]
