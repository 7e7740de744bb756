"""Settings and catalogues: validated files, replay packs, and a table of embeddings made once for each text."""

from __future__ import annotations

import dataclasses
import json
import typing
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checked(kind: type, values: dict, where: str = ""):
    """A dataclass from a mapping; an error names the place of an unknown key, a missing one, or a value of another type.  Dataclasses and lists and maps of them nest."""
    if not isinstance(values, dict):
        raise ValueError(f"{where or kind.__name__}: a mapping is needed")
    hints, fields = typing.get_type_hints(kind), {f.name: f for f in dataclasses.fields(kind)}
    for name in values:
        if name not in fields:
            raise ValueError(f"{where}{name}: unknown")
    for name, f in fields.items():
        if name not in values and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
            raise ValueError(f"{where}{name}: missing")
    return kind(**{name: _value(hints[name], v, f"{where}{name}") for name, v in values.items()})


def _value(kind, v, where: str):
    outer, inner = typing.get_origin(kind), typing.get_args(kind)
    if dataclasses.is_dataclass(kind):
        return checked(kind, v, where + ".")
    if outer in (list, tuple) and isinstance(v, list):
        return outer(_value(inner[0], x, f"{where}[{i}]") for i, x in enumerate(v))
    if outer is dict and isinstance(v, dict):
        return {k: _value(inner[1], x, f"{where}.{k}") for k, x in v.items()}
    if kind is float and isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    if not isinstance(kind, type) or not isinstance(v, kind) or (isinstance(v, bool) and kind is not bool):
        raise ValueError(f"{where}: {v!r} is no {kind}")
    return v


def load_settings(spark: SparkSession, path: str, kind: type):
    """Settings of a dataclass from a JSON or YAML file wherever Spark reads; an empty file gives the defaults."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith(".json"):
        return checked(kind, json.loads(text) if text.strip() else {})
    import yaml

    return checked(kind, yaml.safe_load(text) or {})


def packs(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (name, title, start, end, news, social) of the packs under a folder, each a folder with a manifest.json; a pack without a title is called by its name."""
    schema = "title string, start string, end string, news struct<kept_articles:long>, social struct<posts:long>"
    rows = spark.read.schema(schema).json(f"{folder}/*/manifest.json", multiLine=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.select(name.alias("name"), F.coalesce("title", name).alias("title"), "start", "end", F.col("news.kept_articles").alias("news"), F.col("social.posts").alias("social"))


def embedded(texts: DataFrame, path: str, encode: Callable[[Column], Column], encoder: str) -> DataFrame:
    """texts (text, ...) with embedding, from a table at path that each encoder's texts are added to once, keyed by their MD5."""
    spark = texts.sparkSession
    root = f"{path}/encoder={encoder}"
    try:
        known = spark.read.schema("key string, embedding array<double>").parquet(root)
        known.limit(0).count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], "key string, embedding array<double>")
    keyed = texts.withColumn("_key", F.md5(F.col("text").cast("binary")))
    missing = keyed.where("text is not null").groupBy(F.col("_key").alias("key")).agg(F.any_value("text").alias("text")).join(known.select("key"), "key", "left_anti")
    missing.select("key", encode(F.col("text")).cast("array<double>").alias("embedding")).write.mode("append").parquet(root)
    table = spark.read.schema("key string, embedding array<double>").parquet(root)
    return keyed.join(table, keyed["_key"] == table["key"], "left").drop("_key", "key")
