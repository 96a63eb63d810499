"""Source outcomes: stable categories of their statuses, and quality labels over the newest real runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses that count as failures, and words in an error's text that tell a failed connection.
FAILED = (
    "protected",
    "waf_challenge",
    "deadline_exceeded",
    "source_error",
    "transport_error",
    "upstream_error",
    "parser_error",
    "failed",
    "listing_discovery_failed",
    "detail_extraction_failed",
    "board_gone",
    "stale_url",
    "provider_tunnel_denied",
    "rate_limited",
)
CONNECTION = ("transporterror", "transport error", "connecterror", "connecttimeout", "networkerror", "connection refused")
HARD_DEADLINE = "source_hard_deadline_exceeded"
KEYWORD_CLONE = "_kw[0-9]+$"


def status_category(status: Column, error: Column) -> Column:
    """One of a few categories for a status and its error text: what the source says of itself first, then connections, failures, skips; the rest is ok."""
    s, e = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (status, error))
    lost = reduce(lambda a, b: a | b, [F.contains(e, F.lit(t)) for t in CONNECTION])
    return (
        F.when(s.isin("policy_not_scraped", "unconfirmed_empty"), s)
        .when(s.isin("partial", "partial_with_items"), "partial")
        .when((s == "transport_error") | lost, "transport_error")
        .when(s.isin(*FAILED) | F.contains(e, F.lit(HARD_DEADLINE)), "hard_failure")
        .when(s.isin("not_due", "skipped"), "skipped")
        .when(s.isin("", "unknown"), "unknown")
        .otherwise("ok")
    )


def source_key(source_id: Column, name: Column) -> Column:
    """The id (else the name) behind its kind and without a keyword clone's number; null if there is neither."""
    raw = F.coalesce(F.nullif(F.trim(source_id), F.lit("")), F.nullif(F.trim(name), F.lit("")))
    own = F.when(F.contains(raw, F.lit(":")), F.substring(raw, F.locate(":", raw) + 1, F.length(raw))).otherwise(raw)
    return F.nullif(F.regexp_replace(own, KEYWORD_CLONE, ""), F.lit("unknown"))


def rolling_quality(runs: DataFrame, outcomes: DataFrame, emitted: DataFrame, window: int = 20, least_fetched: int = 10, least_outcomes: int = 2) -> DataFrame:
    """A row for each source over the newest ``window`` real runs, with the labels reliable, rich and high_relevance.

    ``runs`` has (run, at, fetched, skipped), ``outcomes`` (run, source_id, source_name, status, yielded) and
    ``emitted`` (run, source_id, emitted). A run is real if it wasn't skipped, fetched enough and has enough
    outcomes. A source failed in a run if it has a failure there and nothing else. It is reliable if it was
    tried in four fifths of the runs (8 at least), with at most .15 failures and at least .8 successes; rich
    (or of high relevance) if of 4 runs or more half yielded (or emitted) something.
    """
    sizes = outcomes.groupBy(F.col("run").alias("of")).agg(F.count("*").alias("outcomes"))
    real = runs.join(sizes, F.col("run") == F.col("of")).where(~F.coalesce("skipped", F.lit(False)) & (F.col("fetched") >= least_fetched) & (F.col("outcomes") >= least_outcomes))
    newest = real.orderBy(F.desc("at"), F.desc("run")).limit(window).select(F.col("run").alias("of"))  # the window is the feature
    within = lambda df: df.join(newest, F.col("run") == F.col("of"), "left_semi")
    bad = F.coalesce("status", F.lit("unknown")).isin(*FAILED)
    tried = within(outcomes).withColumn("key", source_key(F.col("source_id"), F.col("source_name"))).where("key IS NOT NULL").groupBy("run", "key").agg(F.sum(F.coalesce("yielded", F.lit(0))).alias("yielded"), F.bool_and(bad).alias("failed"))
    sent = within(emitted).withColumn("key", source_key(F.col("source_id"), F.lit(None).cast("string"))).where("key IS NOT NULL").groupBy("run", "key").agg(F.sum("emitted").alias("emitted"))
    both = tried.join(sent, ["run", "key"], "full").fillna({"yielded": 0, "emitted": 0, "failed": False})
    g = both.groupBy("key").agg(F.count("*").alias("attempted"), F.count_if("failed").alias("fail"), F.count_if(F.col("yielded") > 0).alias("yield_hits"), F.count_if(F.col("emitted") > 0).alias("relevant_hits"), F.sum("yielded").alias("yield_sum"), F.sum("emitted").alias("emitted_sum"))
    g = g.crossJoin(F.broadcast(newest.agg(F.count("*").alias("window_runs"))))  # one row
    rate = lambda c: F.col(c) / F.col("attempted")
    often = F.greatest(F.lit(8), F.floor(0.8 * F.col("window_runs")))
    g = g.withColumn("ok", F.col("attempted") - F.col("fail"))
    labels = {"reliable": (F.col("attempted") >= often) & (rate("fail") <= 0.15) & (rate("ok") >= 0.8), "rich": (F.col("attempted") >= 4) & (rate("yield_hits") >= 0.5), "high_relevance": (F.col("attempted") >= 4) & (rate("relevant_hits") >= 0.5)}
    return g.withColumns(labels).withColumns({"ok_rate": F.round(rate("ok"), 4), "yield_rate": F.round(rate("yield_hits"), 4), "relevant_rate": F.round(rate("relevant_hits"), 4)})
