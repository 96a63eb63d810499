"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowline.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    joined = edges.join(least, edges["a"] == least["u"]).select("a", "b", "m")
    return joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): the label is the least node of the component.

    Each step is a grouped minimum and a join, in O(log n) rounds; each round's edges are written to
    the shared folder, so the plan stays short and lost executors cost one round. It ends when a round
    changes nothing; more rounds than ``max_rounds`` are an error, never a wrong label.
    """
    big = F.greatest("a", "b")
    now = cut(edges.where("a <> b").select(big.alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now).distinct()).distinct())
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
