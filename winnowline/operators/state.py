"""Keyed state as tables: upserts, versioned ledgers, snapshots, task queues, outbox states, run reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[Column | str], keep_greatest: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new``, of which the last by ``order`` counts for each key; columns ``keep_greatest`` never fall."""
    values = [c for c in old.columns if c not in key]
    last = new.groupBy(*key).agg(F.max(F.struct(*order, F.struct(*values).alias("__v"))).alias("__n")).select(*key, F.col("__n.__v").alias("__v"), F.lit(True).alias("__new"))
    both = old.join(last, key, "full")
    pick = lambda c: F.greatest(F.col(c), F.col("__v")[c]) if c in keep_greatest else F.when(F.col("__new"), F.col("__v")[c]).otherwise(F.col(c))
    return both.select(*key, *[pick(c).alias(c) for c in values])


def ledger_insert(ledger: DataFrame, new: DataFrame, key: list[str], content: str, seen: str) -> DataFrame:
    """Rows that a ledger (key, content, version) doesn't have yet, numbered on from each key's last version.

    A content that the ledger knows, or that comes twice, is inserted once: running it again adds nothing.
    """
    fresh = new.groupBy(*key, content).agg(F.min(seen).alias(seen)).join(ledger.select(*key, content), [*key, content], "left_anti")
    last = ledger.groupBy(*key).agg(F.max("version").alias("__last"))
    n = F.row_number().over(W.partitionBy(*key).orderBy(seen, content))
    return fresh.join(last, key, "left").select(*key, content, seen, (F.coalesce("__last", F.lit(0)) + n).cast("long").alias("version"))


def latest_snapshot(rows: DataFrame, source: str, run: str, since: Column | None = None) -> DataFrame:
    """The rows of each source's latest run, of runs not older than ``since``."""
    kept = rows if since is None else rows.where(F.col(run) >= since)
    last = kept.groupBy(F.col(source).alias("__s")).agg(F.max(run).alias("__r"))
    return kept.join(last, F.col(source).eqNullSafe(F.col("__s")) & (F.col(run) == F.col("__r"))).drop("__s", "__r")


def unchanged_rows(before: DataFrame, now: DataFrame, key: list[str], content: str, incomplete: DataFrame, source: str) -> DataFrame:
    """``now`` with ``drop`` (the last run had the same content) and ``commit`` (false for sources that came in part)."""
    b = before.select(*key, F.col(content).alias("__old")).distinct()
    i = incomplete.select(F.col(source).alias("__i")).distinct()
    d = now.join(b, key, "left").join(i, F.col(source) == F.col("__i"), "left")
    return d.withColumns({"drop": F.coalesce(F.col("__old") == F.col(content), F.lit(False)), "commit": F.col("__i").isNull()}).drop("__old", "__i")


def claim(tasks: DataFrame, cooling: DataFrame, now: Column, limit: int, lease: Column) -> DataFrame:
    """The next ``limit`` tasks that are due, ready or with a lease that ran out, and whose source isn't cooling down; each with a lease."""
    due = (F.col("available_at") <= now) & ((F.col("state") == "ready") | ((F.col("state") == "leased") & (F.col("lease_until") <= now)))
    free = tasks.where(due).join(cooling.where(F.col("until") > now).select("source").distinct(), "source", "left_anti")
    batch = free.orderBy("available_at", "created_at", "task_id").limit(limit)
    return batch.withColumns({"state": F.lit("leased"), "lease_until": lease})


def outbox_states(outbox: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """state of each message: delivered once any attempt was, uncertain after one without an answer, deferred after failures, else pending."""
    a = attempts.groupBy(key).agg(F.bool_or(F.col("result") == "ok").alias("ok"), F.bool_or(F.col("result") == "unknown").alias("unknown"), F.count("*").alias("attempts"))
    state = F.when(F.col("ok"), "delivered").when(F.col("unknown"), "uncertain").when(F.col("attempts") > 0, "deferred").otherwise("pending")
    return outbox.join(a, key, "left").select(*outbox.columns, state.alias("state"), F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"))


def newest(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """Of each group so many rows, the newest first: a bounded ledger."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def run_report(runs: DataFrame, parts: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Left joins of one row each: a run without outcomes, quality or flags is still reported."""
    return reduce(lambda d, part: d.join(part, key, "left"), parts.values(), runs)


def fan_in(sources: dict[str, DataFrame | Exception]) -> tuple[DataFrame, DataFrame]:
    """(all rows with source_id, a result row for each source). A source that failed to open doesn't stop the others."""
    good = {k: v for k, v in sources.items() if isinstance(v, DataFrame)}
    spark = next(iter(good.values())).sparkSession
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [v.withColumn("source_id", F.lit(k)) for k, v in good.items()])
    names = spark.createDataFrame([(k, None if k in good else type(v).__name__) for k, v in sources.items()], "source_id string, error string")
    counts = rows.groupBy("source_id").agg(F.count("*").alias("n"))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("n").isNull(), "empty").otherwise("ok")
    return rows, names.join(counts, "source_id", "left").select("source_id", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"), "error")


def replay(ledger: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """Raw items from a ledger of observations: the newest envelope of each."""
    return newest(ledger, [key], order, 1).select(*columns)


def date_coverage(df: DataFrame, by: str, dates: list[str], least: float = 0.8) -> DataFrame:
    """Of each source, how well its date columns are filled, their range, and the one to judge freshness by (none if all are thin)."""
    aggs = [x for c in dates for x in (F.round(F.count(c) / F.count("*"), 4).alias(f"{c}_share"), F.min(c).alias(f"{c}_from"), F.max(c).alias(f"{c}_to"))]
    g = df.groupBy(by).agg(F.count("*").alias("n"), *aggs)
    field = F.lit(None).cast("string")
    for c in reversed(dates):
        field = F.when(F.col(f"{c}_share") >= least, F.lit(c)).otherwise(field)
    return g.withColumn("freshness_field", field)


def expand_search(sources: DataFrame, terms: DataFrame, template: str, most: int) -> DataFrame:
    """Each source's queries: template with the term filled in, ``most`` a source at most, by the terms' order."""
    t = terms.where(F.col("place") < most)  # terms are numbered from 0
    return sources.crossJoin(F.broadcast(t)).select("source", "term", F.replace(F.replace(F.lit(template), F.lit("{source}"), F.col("source")), F.lit("{term}"), F.replace("term", F.lit(" "), F.lit("+"))).alias("url"))


def fresh_enough(df: DataFrame, at: str, cutoff: Column, undated_pass: bool = True) -> DataFrame:
    """Rows not older than the cutoff; undated ones as told."""
    return df.where((F.col(at) >= cutoff) | F.col(at).isNull() if undated_pass else F.col(at) >= cutoff)


def spread_budget(df: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """``work`` of each row: the first ``most`` of a group are done now, the rest is deferred to the next batch."""
    n = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return df.withColumn("work", F.when(n <= most, "now").otherwise("deferred"))
