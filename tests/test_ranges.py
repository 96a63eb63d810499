"""Running sums and ranks over ranges against plain ones."""

import random
from itertools import accumulate

from pyspark.sql import functions as F

from winnowline.operators import stats as A
from winnowline.operators.ranges import ranked, running


def test_running_over_all_and_by_group(spark):
    rnd = random.Random(5)
    # One group holds most rows; some values and groups are null.
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 7}", rnd.randrange(1000), None if i % 13 == 0 else rnd.randrange(-5, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, g string, o int, v int").repartition(6)
    got = {r.id: (r.s, r.n) for r in running(df, ["o", "id"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    line = sorted(rows, key=lambda r: (r[2], r[0]))
    assert got == {r[0]: (s, k) for k, (r, s) in enumerate(zip(line, accumulate(r[3] or 0 for r in line)), 1)}
    got = {r.id: (r.s, r.place) for r in ranked(running(df, [F.desc("o"), "id"], {"s": F.col("v")}, ["g"]), [F.desc("o"), "id"], ["g"], "place").collect()}
    want = {}
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        want |= {r[0]: (s, k) for k, (r, s) in enumerate(zip(own, accumulate(r[3] or 0 for r in own)), 1)}
    assert got == want


def test_ranges_are_used(spark):
    """A hot group is summed in several tasks."""
    df = spark.range(20000).select(F.col("id"), F.lit("hot").alias("g"), (F.rand(3) * 1000).alias("o"))
    plan = df.repartitionByRange(8, "g", "o").select(F.spark_partition_id().alias("p"), "o")
    assert plan.select("p").distinct().count() > 1
    r = ranked(df, ["o", "id"], ["g"])
    assert r.agg(F.count_distinct("rank"), F.max("rank")).first() == (20000, 20000)


def test_empty_and_one_row(spark):
    df = spark.createDataFrame([(1, "a")], "id int, g string")
    assert ranked(df, ["id"], ["g"]).collect()[0].rank == 1
    assert ranked(df.where("false"), ["id"]).count() == 0


def test_curve_and_ranks(spark):
    rnd = random.Random(8)
    rows = [(rnd.randrange(200) / 200, rnd.randrange(2)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "s double, y int")
    positives = sum(y for _, y in rows)
    for r in A.threshold_curve(df, "s", "y").collect():
        tp = sum(y for s, y in rows if s >= r.threshold)
        n = sum(s >= r.threshold for s, _ in rows)
        assert (r.tp, r.fp) == (tp, n - tp) and abs(r.recall - tp / positives) < 1e-6
    values = sorted(s for s, _ in rows)
    for r in A.average_ranks(df, "s").collect():
        first = values.index(r.s)
        assert r["rank"] == first + (values.count(r.s) + 1) / 2
