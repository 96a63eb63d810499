"""Streams over landed files: duplicates, late rows, restarts, the outbox."""

from pyspark.sql import functions as F

from winnowline.streaming import ingest, stateful

SCHEMA = "id string, ts timestamp, n int"


def land(spark, folder, rows):
    spark.createDataFrame(rows, "id string, ts string, n int").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path):
    stream = ingest.dedup_stream(ingest.file_stream(spark, f"file://{tmp_path}/in", SCHEMA), "id", "ts", "1 hour")
    return ingest.run_available(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state")


def test_duplicates_late_rows_and_restarts(spark, tmp_path):
    land(spark, f"file://{tmp_path}/in", [("a", "2024-01-01 10:00:00", 1), ("a", "2024-01-01 10:05:00", 2), ("b", "2024-01-01 10:10:00", 3)])
    assert sorted(r["id"] for r in run(spark, tmp_path).collect()) == ["a", "b"]
    # The stream starts again where it ended: a duplicate inside the watermark, a new row.
    land(spark, f"file://{tmp_path}/in", [("a", "2024-01-01 10:20:00", 4), ("c", "2024-01-01 15:00:00", 5)])
    assert sorted(r["id"] for r in run(spark, tmp_path).collect()) == ["a", "b", "c"]
    # By now the watermark stands at 14:00: an older row is too late, and "a" has been forgotten.
    land(spark, f"file://{tmp_path}/in", [("late", "2024-01-01 09:00:00", 6), ("a", "2024-01-01 16:00:00", 7)])
    assert sorted(r["id"] for r in run(spark, tmp_path).collect()) == ["a", "a", "b", "c"]
    assert sorted(r["id"] for r in run(spark, tmp_path).collect()) == ["a", "a", "b", "c"]


def test_outbox_sends_once(spark, tmp_path):
    write = ingest.outbox_writer(f"file://{tmp_path}/out", "key", 4)
    for keys in (["a", "b", "a"], ["b", "c"], ["a", "b", "c"]):
        write(spark.createDataFrame([(k,) for k in keys], "key string"), 0)
    assert sorted(r["key"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["a", "b", "c"]


def claim_rows(spark, folder, rows):
    d = spark.createDataFrame(rows, "key string, row long, action string, claim string, at string").withColumn("at", F.col("at").cast("timestamp"))
    d.coalesce(1).write.mode("append").parquet(folder)
    return d


def run_claims(spark, tmp_path):
    spark = stateful.with_state_store(spark)
    stream = ingest.file_stream(spark, f"file://{tmp_path}/in", "key string, row long, action string, claim string, at timestamp")
    out = ingest.run_available(stateful.claims_stream(stream, "2 hours", "30 minutes", "1 hour"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    return sorted((r["key"], r["row"], r["outcome"]) for r in out.collect())


def test_claims_over_restarts_give_the_rows_of_the_batch_form(spark, tmp_path):
    runs = [
        [("a", 2, "claim", "y", "2024-01-01 10:10:00"), ("a", 1, "claim", "x", "2024-01-01 10:00:00"), ("a", 3, "commit", "x", "2024-01-01 10:20:00"), ("b", 4, "claim", "x", "2024-01-01 10:00:00"), ("b", 5, "release", "x", "2024-01-01 10:05:00")],
        # Another run: the mark of a holds, the claim of b is open again, c's lease runs out.
        [("a", 6, "claim", "z", "2024-01-01 11:00:00"), ("b", 7, "claim", "y", "2024-01-01 11:00:00"), ("c", 8, "claim", "x", "2024-01-01 10:30:00"), ("c", 9, "commit", "x", "2024-01-01 11:01:00"), ("c", 10, "other", "x", "2024-01-01 11:02:00")],
        # By now the mark of a and the lease of b have expired.
        [("a", 11, "claim", "z", "2024-01-01 15:00:00"), ("b", 12, "commit", "y", "2024-01-01 15:00:00"), ("a", 13, "commit", "z", "2024-01-01 15:01:00")],
    ]
    batch = None
    for rows in runs:
        d = claim_rows(spark, f"file://{tmp_path}/in", rows)
        batch = d if batch is None else batch.union(d)
        got = run_claims(spark, tmp_path)
        assert got == sorted((r["key"], r["row"], r["outcome"]) for r in stateful.claims_batch(batch, "2 hours", "30 minutes").collect())
    assert [o for k, _, o in got if k == "a"] == ["granted", "busy", "committed", "duplicate", "granted", "committed"]
    assert [o for k, _, o in got if k == "b"] == ["granted", "released", "granted", "stale"]
    assert [o for k, _, o in got if k == "c"] == ["granted", "stale", "ignored"]
    # A row behind the watermark is dropped, and a restart without input adds nothing.
    claim_rows(spark, f"file://{tmp_path}/in", [("d", 14, "claim", "x", "2024-01-01 09:00:00")])
    assert run_claims(spark, tmp_path) == got == run_claims(spark, tmp_path)


def test_parents_end_with_their_last_child(spark, tmp_path):
    stateful.with_state_store(spark)

    def run(rows):
        spark.createDataFrame(rows, "parent long, child long, final boolean, expected int").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = ingest.file_stream(spark, f"file://{tmp_path}/in", "parent long, child long, final boolean, expected int")
        out = ingest.run_available(stateful.finished_parents(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
        return sorted((r["parent"], r["children"]) for r in out.collect())

    assert run([(1, 1, True, 2), (1, 2, False, 2), (2, 1, True, 1), (3, 1, None, 1)]) == [(2, 1)]
    assert run([(1, 1, True, 2), (2, 1, True, 1), (3, 1, False, 1)]) == [(2, 1)]
    assert run([(1, 2, True, 2), (3, 1, True, 1)]) == [(1, 2), (2, 1), (3, 1)]


def test_parents_come_as_rows_and_an_unknown_number_of_children_never_ends(spark, tmp_path):
    stateful.with_state_store(spark)
    shape = "parent long, child long, final boolean, expected int"
    # The rows of a parent have one expectation, the greatest that is known, wherever it stands among them.
    rows = [(1, 1, True, None), (2, 1, True, 2), (2, 2, True, None), (3, 1, True, 1)]
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = ingest.file_stream(spark, f"file://{tmp_path}/in", shape)
    assert "InPandas" not in stateful.finished_parents(stream)._jdf.queryExecution().logical().toString()
    out = ingest.run_available(stateful.finished_parents(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    assert sorted((r["parent"], r["children"]) for r in out.collect()) == [(2, 2), (3, 1)]
