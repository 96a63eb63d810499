"""First-seen deduplication, history joins, change capture, versions, grouping and interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnowline.operators.ranges import ranked


def mark_duplicates(df: DataFrame, key: Column, order: list[Column | str], id_col: str) -> DataFrame:
    """Adds ``first_id``, the id of the first row with the same key, and ``is_duplicate``.

    The first is an aggregate, joined back: a hot key is pre-aggregated and its rows can be split.
    """
    k = df.withColumn("__key", key)
    first = k.groupBy("__key").agg(F.min(F.struct(*order, F.col(id_col).alias("__id"))).alias("f")).select("__key", F.col("f.__id").alias("first_id"))
    return k.join(first, "__key").withColumn("is_duplicate", F.col(id_col) != F.col("first_id")).drop("__key")


def unseen(df: DataFrame, history: DataFrame, key: str, cooldown: tuple[str, Column] | None = None) -> DataFrame:
    """Rows whose key isn't in the history, or isn't cooling down there any more."""
    h = history if cooldown is None else history.where(F.col(cooldown[0]) > cooldown[1])
    return df.join(h.select(key).distinct(), key, "left_anti")


def snapshot_changes(before: DataFrame, after: DataFrame, key: list[str], content: str) -> DataFrame:
    """NEW, CHANGED, UNCHANGED and GONE rows between two runs."""
    a = before.select(*key, F.col(content).alias("old_hash"), F.lit(True).alias("__a"))
    b = after.select(*key, F.col(content).alias("new_hash"), F.lit(True).alias("__b"))
    state = F.when(F.col("__a").isNull(), "NEW").when(F.col("__b").isNull(), "GONE").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "UNCHANGED").otherwise("CHANGED")
    return a.join(b, key, "full").select(*key, state.alias("state"))


def content_versions(df: DataFrame, key: list[str], content: str, seen: str) -> DataFrame:
    """Version numbers of distinct contents of a key, by first sight."""
    first = df.groupBy(*key, content).agg(F.min(seen).alias("first_seen"), F.count("*").alias("observations"))
    return first.withColumn("version", F.row_number().over(W.partitionBy(*key).orderBy("first_seen", content)))


def merge_by_priority(df: DataFrame, group: str, priority: str, id_col: str, first: list[str], longest: str, largest: list[str], union: list[str]) -> DataFrame:
    """One row for each group: first non-null by (priority, id), longest text, maxima, sorted unions, members."""
    order = lambda c: F.when(F.col(c).isNotNull(), F.struct(priority, id_col))
    aggs = [F.min_by(c, order(c)).alias(c) for c in first]
    aggs.append(F.max_by(longest, F.struct(F.length(longest), -F.col(id_col))).alias(longest))
    aggs += [F.max(c).alias(c) for c in largest] + [F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in union]
    return df.groupBy(group).agg(*aggs, F.count("*").alias("members"))


def interleave(df: DataFrame, bucket: list[str], order: list[str]) -> DataFrame:
    """Round-robin position: turn within the bucket first, then bucket. A hot bucket is ranked in ranges."""
    return ranked(df, order, bucket, "turn")


def latest_per(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
