"""File formats of feeds and books, read with explicit schemas, and result writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "doc_id string, source string, kind string, published_at timestamp, text string, url string, publisher string, finance_feed boolean, meta map<string,string>"
POSITION = "position_id string, asset_class string, bond_type string, obligor_id string, obligor_name string, sector string, country string, region string, currency string, rating string, lgd double, notional double, drawn double, undrawn double, ccf double, maturity double, fixed_float string, coupon double, duration double, convexity double, direction int, source string"
# Column places (from 0) of a news index file: time, themes, tone, and the page data that has the title.
NEWS_TIME, NEWS_URL, NEWS_THEMES, NEWS_TONE, NEWS_EXTRA, NEWS_COLUMNS = 1, 4, 7, 15, 26, 27
KEPT_THEMES = "^(ECON_|SANCTIONS|ARMEDCONFLICT)"


def news_index(spark: SparkSession, path: str) -> DataFrame:
    """Documents of unpacked tab-separated news index files.  Rows with too few columns, no readable time or a title under 15 characters are left out; up to eight themes are kept, sorted."""
    cols = F.split("value", "\t")
    rows = spark.read.text(path).select(cols.alias("c")).where(F.size("c") >= NEWS_COLUMNS)
    title = F.trim(F.regexp_extract(F.col("c")[NEWS_EXTRA], "<PAGE_TITLE>(.*?)</PAGE_TITLE>", 1))
    themes = F.slice(F.array_sort(F.array_distinct(F.filter(F.split(F.col("c")[NEWS_THEMES], ";"), lambda t: t.rlike(KEPT_THEMES)))), 1, 8)
    tone = F.split(F.col("c")[NEWS_TONE], ",")[0].try_cast("double")
    rows = rows.select(F.try_to_timestamp(F.col("c")[NEWS_TIME], F.lit("yyyyMMddHHmmss")).alias("published_at"), F.col("c")[NEWS_URL].alias("url"), title.alias("text"), tone.alias("tone"), themes.alias("themes"))
    return rows.where(F.col("published_at").isNotNull() & (F.length("text") >= 15))


def slots(spark: SparkSession, start: str, end: str) -> DataFrame:
    """The quarter hours from start up to and without end, each a file's name."""
    at = F.explode(F.sequence(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end)) - F.expr("interval 1 second"), F.expr("interval 15 minutes")))
    return spark.range(1).select(at.alias("slot")).withColumn("file", F.concat(F.date_format("slot", "yyyyMMddHHmmss"), F.lit(".csv.zip")))


def replay_pack(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON lines files, compressed or not, in the order of time; ties keep the order of files and lines."""
    from tidemark.sources.audit import ordered

    return ordered(spark.read.schema(DOCUMENT).json(path)).orderBy("published_at", "arrival").drop("arrival")


def book(spark: SparkSession, path: str) -> DataFrame:
    """Positions of a CSV file; only an empty field is null, so that the country NA stays."""
    return spark.read.csv(path, header=True, schema=POSITION, nullValue="", emptyValue="")


def wide_csv(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows (key, factor, shock) of a wide CSV of numbers; empty cells are left out."""
    rows = spark.read.csv(path, header=True)
    names = [c for c in rows.columns if c != key]
    return rows.unpivot([key], names, "factor", "text").select(key, "factor", F.col("text").try_cast("double").alias("shock")).where("shock is not null")


def phrase_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (text, label) of Latin-1 files of sentence@label; of a sentence in several files the last by name counts."""
    rows = spark.read.csv(path, schema="value string", sep="\x01", quote="", encoding="ISO-8859-1").withColumn("tier", F.input_file_name())
    rows = rows.select(F.trim(F.regexp_extract("value", "^(.*)@([a-z]+)\\s*$", 1)).alias("text"), F.regexp_extract("value", "^(.*)@([a-z]+)\\s*$", 2).alias("label"), "tier").where("text <> ''")
    return rows.groupBy("text").agg(F.max_by("label", F.struct("tier", "label")).alias("label"))


def labelled_entities(rows: DataFrame, text: str, labels: str) -> DataFrame:
    """Rows (text, entity, label) from a JSON object of entity to label; what is no such object gives none."""
    return rows.select(F.col(text).alias("text"), F.explode(F.from_json(labels, "map<string,string>")).alias("entity", "label"))


def write_capped(docs: DataFrame, path: str, key: str, order: list[str], copies: int) -> None:
    """JSON lines with at most so many rows of each key, the first ones in order."""
    from tidemark.operators.state import first_n

    first_n(docs, [key], order, copies).drop("place").write.mode("overwrite").json(path)


def report_markdown(rows: DataFrame) -> str:
    """A Markdown table of a result, which has to be short, as reports are; numbers to the right."""
    names = rows.columns
    number = {c for c, t in rows.dtypes if t in ("int", "bigint", "double", "float")}
    lines = ["| " + " | ".join(names) + " |", "|" + "|".join("---:" if c in number else "---" for c in names) + "|"]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.collect())])
