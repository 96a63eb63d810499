"""Mixing sources to target weights by weighted fair queueing.

Each source's documents queue in hash order, the whole queue again for each further epoch. A queued
document's virtual finish time is the source's tokens so far divided by the source's target, so all
sources reach 1 together; sorting by finish time and stopping at the total budget leaves each source
near its target. Running sums are taken in two levels (sums of hash buckets, then within one bucket),
so neither a hot source nor the whole mix passes through one task; ranges are summed by ranges of ranges.

A document's place depends on its key, source and text only, so reruns and other layouts give the same
mix. The number of buckets grows with the rows: none holds more than a few thousand on average. Only the
table of sources (one row each) is ordered in one task.

Edge cases: null or blank texts have size 0 and cost nothing, they are taken in every epoch their
place allows; a null source is a source, ordered last; rows with equal key, source and text queue one
behind the other and each counts (which of them is taken can't be told apart); an empty table gives an
empty result; other columns are ignored by the report and kept by ``apply_mix``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnowline.llm.common import cut, set_aside, word_array


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """One row for each source: source_size, weight, target.

    Weights repeat ``cycle`` over the sources in code-point order, null last. The budget is ``share``
    of all sizes. A target stops at ``max_epochs`` times its source; what is over goes to the others
    by weight: with sources sorted by cap / weight, the first level that no later cap undercuts holds.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("budget", F.sum("source_size").over(whole).cast("double") * share).withColumn("all_weight", F.sum("weight").over(whole))
    left_budget = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left_budget / left_weight)
    s = s.withColumn("held", F.col("level") * F.col("weight") <= F.col("cap"))
    # From the first source that its cap doesn't hold back, one level serves all.
    s = s.withColumn("final", F.min(F.when(F.col("held"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(whole)["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return s.select("source", "source_size", "weight", target.alias("target"), "budget")


def place_hashes(seed: int, key: str, source: str, text: str) -> tuple[Column, Column]:
    """(place in the queue, tie-break by text): both are functions of the row's content."""
    return F.xxhash64(F.lit(seed), F.col(key), F.col(source)), F.xxhash64(F.lit(seed), F.col(text))


def document_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42) -> DataFrame:
    h, t = place_hashes(seed, key, source, text)
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.size(word_array(F.col(text))).cast("long").alias("size"), h.alias("h"), t.alias("t"), F.monotonically_increasing_id().alias("row"))


def queue_order() -> list:
    """Rows behind each other in a queue: by hash, then key and text; ``row`` only parts rows that are equal in all of these."""
    return ["h", F.col("key").asc_nulls_last(), "t", "size", "row"]


def sums_before(df: DataFrame, by: list[str], place: str, value: str, places: int) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the group's rows at smaller places (0 for none).

    Ranges of the square root of ``places`` are summed first, so no window orders more than about so many rows.
    """
    width = math.isqrt(places) + 1
    d = df.withColumn("range", F.floor(F.col(place) / width))
    ranges = d.groupBy(*by, "range").agg(F.sum(value).alias("in_range"))
    start = F.sum("in_range").over(W.partitionBy(*by).orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.select(*[F.col(c).alias(f"of_{c}") for c in (*by, "range")], F.coalesce(start, F.lit(0)).alias("start"))
    same = F.lit(True)
    for c in (*by, "range"):
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    inside = F.sum(value).over(W.partitionBy(*by, "range").orderBy(place).rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("inside", F.coalesce(inside, F.lit(0))).join(ranges, same)
    return d.withColumn("before", F.col("start") + F.col("inside")).drop("range", "inside", "start", *[f"of_{c}" for c in (*by, "range")])


def queue_positions(sizes: DataFrame, buckets: int) -> DataFrame:
    """Adds ``through``: the source's words in hash order up to and with the document."""
    d = sizes.withColumn("bucket", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * buckets))
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    offsets = sums_before(sums, ["source"], "bucket", "in_bucket", buckets).select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.col("before").alias("offset"))
    inside = W.partitionBy("source", "bucket").orderBy(*queue_order()).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("inside", F.sum("size").over(inside))
    d = d.join(offsets, d["source"].eqNullSafe(offsets["s"]) & (d["bucket"] == offsets["b"]))
    return d.withColumn("through", F.col("offset") + F.col("inside")).drop("s", "b", "offset", "inside", "bucket")


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cycle: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, share: float = 1.0, seed: int = 42, bucket_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(the mix, the sizes). The mix has a row for each taken copy: row (of the sizes), key, source, h, t, size, epoch, finish."""
    sizes = cut(document_sizes(docs, key, text, source, seed))
    buckets = max(4096, math.ceil(sizes.count() / bucket_rows))
    targets = source_targets(sizes, cycle, max_epochs, share).withColumnRenamed("source", "s")
    queued = queue_positions(sizes, buckets).join(targets, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    queued = queued.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(max_epochs))))
    words = (F.col("epoch") - 1) * F.col("source_size") + F.col("through")
    queued = queued.withColumn("finish", F.when(F.col("target") > 0, words / F.col("target")).otherwise(F.lit(0.0)))
    # Global range sort and truncation: sums of finish-time ranges first, exact order only in the range where the budget ends.
    queued = cut(queued.withColumn("slot", F.when(F.col("finish") <= 2, F.floor(F.col("finish") * 2 * buckets)).otherwise(4 * buckets + F.floor(F.log2("finish") * buckets / 16))))
    sums = queued.groupBy("slot").agg(F.sum("size").alias("in_slot"), F.max("budget").alias("budget"))
    ends = sums_before(sums, [], "slot", "in_slot", 4 * buckets)
    ends = ends.select(F.col("slot").alias("b"), "before", (F.col("before") + F.col("in_slot") <= F.col("budget")).alias("whole"), (F.col("before") < F.col("budget")).alias("some"))
    d = queued.join(ends, queued["slot"] == ends["b"]).where("whole or some")
    edge = d.where("not whole")
    through = F.col("before") + F.sum("size").over(W.partitionBy("slot").orderBy("finish", F.col("source").asc_nulls_last(), *queue_order(), "epoch").rowsBetween(W.unboundedPreceding, 0))
    edge = edge.withColumn("through", through).where(F.col("through") <= F.col("budget"))
    columns = ["row", "key", "source", "h", "t", "size", "epoch", "finish"]
    return d.where("whole").select(*columns).unionByName(edge.select(*columns)), sizes


def mix_report(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """Per document: key, size, source_size, target and taken, the words that the mix takes of it."""
    taken, sizes = mixture(docs, key, text, source, **options)
    per_row = taken.groupBy("row").agg(F.sum("size").alias("taken"))
    targets = source_targets(sizes, **{k: v for k, v in options.items() if k in ("cycle", "max_epochs", "share")}).withColumnRenamed("source", "s")
    d = sizes.join(per_row, "row", "left").join(targets, F.col("source").eqNullSafe(F.col("s")))
    return d.select(F.col("key").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", ordered: bool = True, seed: int = 42, **options) -> DataFrame:
    """The documents of the mix with their columns, one row for each taken copy, range-sorted by finish time if ``ordered``."""
    docs, named = set_aside(docs, key, text, source)
    taken, sizes = mixture(docs, key, text, source, seed=seed, **options)
    same = ["h", "t"]
    picked = taken.groupBy(*same, "epoch").agg(F.min("finish").alias("__finish"), F.count("*").alias("__taken"))
    picked = cut(picked.join(sizes.groupBy(*same).agg(F.count("*").alias("__rows")), same).withColumnsRenamed({"h": "__h", "t": "__t", "epoch": "__epoch"}))
    h, t = place_hashes(seed, key, source, text)
    d = docs.select("*", h.alias("__h"), t.alias("__t"))
    split = picked.where("__taken < __rows")
    out = d.join(picked.where("__taken = __rows"), ["__h", "__t"])
    if not split.isEmpty():
        # Of equal rows, which stand behind each other, the edge of the budget takes some and leaves others.
        some = d.join(split, ["__h", "__t"])
        some = some.withColumn("__n", F.row_number().over(W.partitionBy("__h", "__t", "__epoch").orderBy(F.lit(0)))).where("__n <= __taken").drop("__n")
        out = out.unionByName(some)
    if ordered:
        out = out.repartitionByRange(F.col("__finish"), F.col("__h")).sortWithinPartitions("__finish", "__h")
    return named(out.select(*[F.col(f"`{c}`") for c in docs.columns]))
