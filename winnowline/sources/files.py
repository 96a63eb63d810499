"""Reading raw items with row-level quarantine, and feeds; writing lanes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_ITEM = "source_kind string, source_name string, external_id string, url string, text string, metadata map<string,string>"


def parse_raw_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (a column value of JSON text) with item and reason; the reason is null for good rows."""
    rows = lines.where(F.trim("value") != "").withColumn("item", F.from_json("value", RAW_ITEM + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    reason = F.when(F.col("item").isNull() | F.col("item._corrupt").isNotNull(), "invalid_json").when(blank("item.source_name"), "blank_source").when(blank("item.external_id") & blank("item.url"), "no_identity").when(F.col("item.url").isNotNull() & ~F.col("item.url").rlike("^https?://[^/]+"), "bad_url")
    return rows.withColumn("reason", reason)


def read_raw_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good items, quarantined lines with a reason) of a JSONL file."""
    rows = parse_raw_lines(spark.read.text(path))
    good = rows.where("reason IS NULL").select("item.*").drop("_corrupt")
    return good, rows.where("reason IS NOT NULL").select(F.col("value").alias("line"), "reason")


def read_feed(spark: SparkSession, path: str, row_tag: str = "item", cutoff: str | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Entries of an XML feed, those seen before (by guid) and those older than ``cutoff`` left out."""
    items = spark.read.format("xml").option("rowTag", row_tag).schema("title string, link string, description string, guid string, pubDate string").load(path)
    date = F.regexp_replace("pubDate", "^[A-Za-z]{3}, ", "")
    items = items.withColumn("published", F.coalesce(F.try_to_timestamp(date, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("pubDate")))
    if cutoff:
        items = items.where(F.col("published") >= F.lit(cutoff).cast("timestamp"))
    return items if seen is None else items.join(seen.select("guid"), "guid", "left_anti")


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources as one table with the name of each; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("source_id", F.lit(k)) for k, d in sources.items()])


def write_lanes(df: DataFrame, path: str) -> None:
    """One folder for each lane."""
    df.write.partitionBy("lane").mode("overwrite").json(path)
