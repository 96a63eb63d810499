"""Rank fusion, grouped results and keyset pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def top_ranked(scored: DataFrame, by: str, item: str, score: str, k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), item))).where(F.col("rank") <= k)


def fuse_ranks(lists: list[DataFrame], by: str, item: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists of (by, item, rank)."""
    all_lists = lists[0].select(by, item, "rank")
    for x in lists[1:]:
        all_lists = all_lists.unionByName(x.select(by, item, "rank"))
    return all_lists.groupBy(by, item).agg(F.round(F.sum(1 / (k + F.col("rank"))), 8).alias("rrf"))


def keyset_page(df: DataFrame, order: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The rows strictly after a cursor of the ordering columns; one more than ``limit`` tells if a page follows."""
    if after is not None:
        df = df.where(F.struct(*order) > F.struct(*[F.lit(v).cast(dict(df.dtypes)[c]) for c, v in zip(order, after)]))
    return df.orderBy(*order).limit(limit + 1)


def grouped_ranks(ranked: DataFrame, by: str, item: str, groups: DataFrame, group: str, k: int) -> DataFrame:
    """A ranked list of items as one of their groups: each group once, at its best item's rank, numbered anew."""
    g = ranked.join(groups.select(item, group), item).groupBy(by, group).agg(F.min("rank").alias("at"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy("at", group))).where(F.col("rank") <= k).select(by, group, "rank")


def hybrid(text_ranks: DataFrame, vector_ranks: DataFrame, by: str, item: str, groups: DataFrame, group: str, k: int) -> DataFrame:
    """Text and vector lists (by, item, rank), each as groups, fused by reciprocal rank: the k best groups of each query."""
    lists = [grouped_ranks(x, by, item, groups, group, 3 * k) for x in (text_ranks, vector_ranks)]
    return top_ranked(fuse_ranks(lists, by, group), by, group, "rrf", k)


def in_rank_order(ranks: DataFrame, payload: DataFrame, key: str) -> DataFrame:
    """Payloads of a ranked list; ids without one are left out, ranks stay as they are."""
    return ranks.join(payload, key)


def overfetched(ranked: DataFrame, by: str, groups: DataFrame, item: str, group: str, limit: int, factor: int = 5) -> DataFrame:
    """``limit`` groups of each query from the first ``limit * factor`` items."""
    return grouped_ranks(ranked.where(F.col("rank") <= limit * factor), by, item, groups, group, limit)
