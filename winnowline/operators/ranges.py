"""Running sums and ranks in an order that no single task sees whole.

Rows are dealt to ranges of the order, each range is summed on its own, and what stands before a range is
added. So neither one order over all rows nor one very large group is sorted in a single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnowline.sources.scratch import stored


def running(df: DataFrame, order: list[Column | str], sums: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """Adds to each row the sums of it and all rows before it, in its group if ``by`` is given. Null values count as 0, nulls in ``by`` as a group.

    ``order`` should tell all rows of a group apart; equal ones come in any order. The rows are written once to the
    shared folder, for ranges are drawn from a sample and must be the same for both readings. What is broadcast is a
    row for each range and group that began in an earlier range: never more rows than ranges.
    """
    values = {f"__v{k}": F.coalesce(c, F.lit(0)) for k, c in enumerate(sums.values())}
    ranged = df.withColumns(values).repartitionByRange(*by, *order)
    parts = stored(ranged.withColumn("__part", F.spark_partition_id()))
    inside = W.partitionBy("__part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = parts.withColumns({f"__s{k}": F.sum(v).over(inside) for k, v in enumerate(values)})

    totals = parts.groupBy("__part", *by).agg(*[F.sum(v).alias(v) for v in values])
    earlier = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    before = totals.select(F.col("__part").alias("__bp"), *[F.col(c).alias(f"__b_{c}") for c in by], *[F.sum(v).over(earlier).alias(f"__o{k}") for k, v in enumerate(values)])
    before = before.where(reduce(lambda a, b: a | b, [F.col(f"__o{k}").isNotNull() for k in range(len(values))]))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in by], F.col("__part") == F.col("__bp"))
    out = out.join(F.broadcast(before), same, "left")
    return out.select(*df.columns, *[(F.col(f"__s{k}") + F.coalesce(F.col(f"__o{k}"), F.lit(0))).alias(name) for k, name in enumerate(sums)])


def ranked(df: DataFrame, order: list[Column | str], by: list[str] = (), name: str = "rank") -> DataFrame:
    """Adds each row's place, from 1, in the order or in its group's order."""
    r = running(df, order, {name: F.lit(1)}, by)
    return r.withColumn(name, F.col(name).cast("int"))
