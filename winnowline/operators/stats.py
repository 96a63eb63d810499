"""Run and source statistics, classification metrics, thresholds, quantiles and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnowline.operators.ranges import running


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.when(b > 0, F.round(a / b, digits)).otherwise(0.0)


def confusion(df: DataFrame, predicted: Column, gold: Column, by: list[str] = ()) -> DataFrame:
    count = lambda c, n: F.count_if(c).alias(n)
    g = df.groupBy(*by).agg(count(predicted & gold, "tp"), count(predicted & ~gold, "fp"), count(~predicted & gold, "fn"), count(~predicted & ~gold, "tn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return g.select(*by, "tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def confusion_adjusted(df: DataFrame, predicted: Column, gold: Column, exit_stage: Column, dedup_stage: str, by: list[str] = ()) -> DataFrame:
    """As ``confusion``, but a gold row that left at the deduplication stage counts as found: its first copy stands for it."""
    as_copy = F.coalesce(exit_stage == dedup_stage, F.lit(False)) & gold
    return confusion(df, predicted | as_copy, gold, by)


def threshold_curve(df: DataFrame, score: str, gold: str) -> DataFrame:
    """tp, fp, precision, recall and f1 at each distinct score; counts by score first, then running sums over ranges of scores."""
    g = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(gold).alias("p"), F.count("*").alias("n"))
    g = running(g, [F.desc("threshold")], {"tp": F.col("p"), "seen": F.col("n")})
    positives = df.agg(F.sum(gold).alias("positives"))
    g = g.crossJoin(F.broadcast(positives)).select("threshold", "tp", (F.col("seen") - F.col("tp")).alias("fp"), "positives")  # one row
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp"), 6), ratio(F.col("tp"), F.col("positives"), 6)
    f1 = ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives"), 6)
    return g.select("threshold", "tp", "fp", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def nearest_rank(df: DataFrame, by: str, value: str, quantiles: list[float], buckets: int = 1024) -> DataFrame:
    """Order statistics at round((n - 1) q).

    Values are counted by range first; only those in the ranges that hold a wanted place are put in order, so a
    large group isn't sorted in one task.
    """
    d = df.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    ends = d.groupBy(F.col("g").alias("eg")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    width = F.when(F.col("high") > F.col("low"), (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    d = d.join(ends, F.col("g").eqNullSafe(F.col("eg"))).select("g", "v", "n", F.floor(width * buckets).alias("b"))
    counts = d.groupBy("g", "b").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("g").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = F.array(*[F.struct(F.lit(k).alias("k"), F.round((F.col("n") - 1) * q).cast("long").alias("i")) for k, q in enumerate(quantiles)])
    inside = F.filter(places, lambda x: (x["i"] >= F.col("before")) & (x["i"] < F.col("before") + F.col("c")))
    wanted = counts.withColumn("before", before).select(F.col("g").alias("wg"), F.col("b").alias("wb"), "before", inside.alias("places")).where(F.size("places") > 0)
    rows = d.join(wanted, F.col("g").eqNullSafe(F.col("wg")) & (F.col("b") == F.col("wb")))
    ranked = rows.withColumn("i", F.col("before") + F.row_number().over(W.partitionBy("g", "b").orderBy("v")) - 1).select("g", "v", "i", F.explode("places").alias("p")).where("i = p.i")
    return ranked.groupBy(F.col("g").alias(by)).agg(*[F.max(F.when(F.col("p.k") == k, F.col("v"))).alias(f"q{int(q * 100)}") for k, q in enumerate(quantiles)])


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, rank): tied values share their mean rank; ranks come from counts of distinct values, summed over ranges of them."""
    g = running(df.groupBy(value).agg(F.count("*").alias("ties")), [value], {"upto": F.col("ties")})
    return g.select(value, (F.col("upto") - F.col("ties") + (F.col("ties") + 1) / 2).alias("rank"))


def bootstrap_means(df: DataFrame, id_col: str, value: str, rounds: int) -> DataFrame:
    """Means of ``rounds`` resamples with Poisson(1) weights from a hash of (id, round), so reruns agree."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col(id_col), "round"), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    weight = F.when(h < 0.36787944, 0).when(h < 0.73575888, 1).when(h < 0.91969860, 2).when(h < 0.98101184, 3).otherwise(4)
    d = df.select(id_col, value).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    return d.groupBy("round").agg(F.sum(weight).cast("long").alias("n"), F.round(F.sum(weight * F.col(value)) / F.sum(weight), 6).alias("mean"))
