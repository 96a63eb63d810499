"""Comparing runs and judging results: shadow runs, loss reports, field rates, feature matrices, calibration, gates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowline.operators.stats import ratio
from winnowline.sources.scratch import stored


def id_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side that lacks them."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.exceptAll(y).withColumn("missing_from", F.lit("candidate")).unionByName(y.exceptAll(x).withColumn("missing_from", F.lit("baseline")))


def shadow_compare(baseline: DataFrame, candidate: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Disagreements of two runs over their common rows, by source and profile of the baseline: (by, compared, disagreements, pairs)."""
    b = baseline.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("unprofiled")).alias(c) for c in by], F.col("decision").alias("before"))
    j = b.join(candidate.select(key, F.col("decision").alias("after")), key)
    differs = ~F.col("before").eqNullSafe(F.col("after"))
    pair = F.when(differs, F.concat_ws("->", F.coalesce("before", F.lit("none")), F.coalesce("after", F.lit("none"))))
    return j.groupBy(*by).agg(F.count("*").alias("compared"), F.count_if(differs).alias("disagreements"), F.array_join(F.array_sort(F.collect_set(pair)), ",").alias("changes"))


def require_same_ids(a: DataFrame, b: DataFrame, key: str) -> None:
    """A shadow run means something only over the same rows; else this raises with how many differ."""
    n = {r["missing_from"]: r["count"] for r in id_differences(a, b, key).groupBy("missing_from").count().collect()}
    if n:
        raise ValueError(f"runs over different rows: {n}")


def per_class(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """precision, recall, f1 and support of each class, from counts of (predicted, gold)."""
    c = df.where(F.col(gold).isNotNull()).groupBy(F.coalesce(predicted, F.lit("")).alias("p"), F.col(gold).alias("g")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("p") == F.col("g"), F.col("n")).otherwise(0)
    by_pred = c.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("predicted"), F.sum(hit).alias("tp"))
    by_gold = c.groupBy(F.col("g").alias("class")).agg(F.sum("n").alias("support"))
    j = by_gold.join(by_pred, "class", "left").fillna(0, ["predicted", "tp"])
    return j.select("class", "support", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"))


def first_loss(events: DataFrame, key: str, place: str, node: str, lost: Column) -> DataFrame:
    """The first node at which each row was lost, and the flags it met up to there."""
    f = events.groupBy(key).agg(F.min(F.when(lost, F.struct(place, node))).alias("f"))
    return f.where("f IS NOT NULL").select(key, F.col("f")[place].alias("at"), F.col("f")[node].alias("node"))


def loss_attribution(gold: DataFrame, lost: DataFrame, key: str) -> DataFrame:
    """Positives by the node that lost them; those that were never seen and those that arrived count, too."""
    j = gold.join(lost, key, "left")
    return j.groupBy(F.coalesce("node", F.when(F.col("seen"), "arrived").otherwise("never_seen")).alias("node")).agg(F.count("*").alias("n"))


def field_match(df: DataFrame, expected: str, found: str, by: list[str]) -> DataFrame:
    """Of each field of a map column, how many rows expect it, find it, and find it right (trimmed, lower-cased)."""
    e = df.select(*by, F.explode(expected).alias("field", "want"), F.col(found).alias("f")).where("want IS NOT NULL")
    got = F.try_element_at("f", F.col("field"))
    same = F.lower(F.trim(got)) == F.lower(F.trim("want"))
    return e.groupBy(*by, "field").agg(F.count("*").alias("expected"), F.count_if(got.isNotNull()).alias("found"), F.count_if(same).alias("right"), ratio(F.count_if(same), F.count("*")).alias("rate"))


def feature_matrix(atoms: DataFrame, key: str, names: list[tuple[str, str]]) -> DataFrame:
    """count, greatest and summed mass of each (claim, polarity) as columns; of one independence key the heaviest atom counts."""
    one = atoms.groupBy(key, "claim", "polarity", "independence_key").agg(F.max(F.col("strength") * F.col("reliability")).alias("m"))
    aggs = []
    for claim, polarity in names:
        hit = (F.col("claim") == claim) & (F.col("polarity") == polarity)
        stem = f"{claim}_{polarity}".lower()
        aggs += [F.count_if(hit).alias(f"{stem}_n"), F.round(F.coalesce(F.max(F.when(hit, F.col("m"))), F.lit(0.0)), 6).alias(f"{stem}_max"), F.round(F.coalesce(F.sum(F.when(hit, F.col("m"))), F.lit(0.0)), 6).alias(f"{stem}_sum")]
    return one.groupBy(key).agg(*aggs)


def usage_ledger(calls: DataFrame, prices: DataFrame, by: str) -> DataFrame:
    """Tokens and cost by model, whether every call had a known price; an unknown one leaves the cost open."""
    j = calls.join(F.broadcast(prices), "model", "left")  # models are few
    cost = F.col("tokens") * F.col("price") / 1_000_000
    return j.groupBy(by).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum(cost), 8).alias("cost"), F.bool_and(F.col("price").isNotNull()).alias("complete"))


def balance(df: DataFrame, by: list[str], label: str, least_rows: int, least_positive: int, low: float, high: float) -> DataFrame:
    """Rows, positives and their share, and the gates that a training set misses."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(label).alias("positive"), F.round(F.avg(label), 6).alias("share"))
    miss = F.array(F.when(F.col("n") < least_rows, "rows"), F.when(F.col("positive") < least_positive, "positives"), F.when(~F.col("share").between(low, high), "share"))
    return g.withColumn("missed", F.array_join(F.array_compact(miss), ","))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's r of every pair of columns, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 6).alias("r")) for a, b in pairs]).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.*")


def point_biserial(df: DataFrame, flag: str, value: str) -> Column:
    return F.round(F.corr(F.col(flag).cast("double"), F.col(value)), 6)


def redundancy_groups(pairs: DataFrame, least: float = 0.9) -> list[list[str]]:
    """Columns that are bound by correlations of ``least`` or more: a few names, settled on the driver."""
    edges = [(r["a"], r["b"]) for r in pairs.where(F.abs("r") >= least).collect()]  # pairs of columns
    group: dict[str, set] = {}
    for a, b in edges:
        merged = group.get(a, {a}) | group.get(b, {b})
        group.update({name: merged for name in merged})
    return sorted({tuple(sorted(g)) for g in group.values()})


def paired_bootstrap(df: DataFrame, id_col: str, baseline: str, candidate: str, rounds: int = 1000, level: float = 0.95) -> DataFrame:
    """mean difference of two scores over the same rows, with the interval of ``rounds`` resamples (nearest rank).

    A resample weighs each row by a Poisson(1) draw from a hash of (id, round), the same for both scores. Sums
    by round are combined before the shuffle; only one row a round is ordered.
    """
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col(id_col), "round"), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    weight = F.lit(5)
    cumulative, p = [], math.exp(-1)
    for k in range(5):
        cumulative.append((sum(cumulative[-1:]) if cumulative else 0.0) + p)
        p /= k + 1
    for k in reversed(range(5)):
        weight = F.when(h < round(cumulative[k], 8), k).otherwise(weight)
    d = df.select(id_col, (F.col(candidate) - F.col(baseline)).alias("delta"))
    per = d.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("w", weight)
    means = per.groupBy("round").agg((F.sum(F.col("w") * F.col("delta")) / F.sum("w")).alias("m"))
    low, high = round((rounds - 1) * (1 - level) / 2), round((rounds - 1) * (1 + level) / 2)
    ends = means.agg(F.array_sort(F.collect_list("m")).alias("m")).select(F.get("m", F.lit(low)).alias("low"), F.get("m", F.lit(high)).alias("high"))  # one number a round
    return d.agg(F.avg("delta").alias("delta"), F.count("*").alias("n")).crossJoin(ends).select("n", *[F.round(c, 6).alias(c) for c in ("delta", "low", "high")])


def promotion(baseline: DataFrame, candidate: DataFrame, regressions: DataFrame) -> DataFrame:
    """Named checks of a candidate against a baseline (one row of recall and precision each) and the verdict."""
    b, c = (x.select(F.struct("recall", "precision").alias(n)) for x, n in ((baseline, "b"), (candidate, "c")))
    n = regressions.agg(F.count("*").alias("regressions"))
    row = b.crossJoin(c).crossJoin(n)  # one row each
    checks = [("recall_improves", F.col("c.recall") > F.col("b.recall")), ("precision_holds", F.col("c.precision") >= F.col("b.precision")), ("no_regressions", F.col("regressions") == 0)]
    row = row.select(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in checks]).alias("checks"))
    row = row.withColumn("status", F.when(F.forall("checks", lambda x: x["ok"]), "pass").otherwise("inconclusive"))
    return row.select("status", F.explode("checks").alias("k")).select("k.check", "k.ok", "status")


def logistic_fit(df: DataFrame, features: list[str], label: str, rounds: int = 800, rate: float = 0.15, decay: float = 0.997, l2: float = 0.01, in_memory: int = 20_000) -> list[float]:
    """Intercept and weights by full-batch gradient descent.

    Rows that agree in features and label are counted once. Up to ``in_memory`` such rows are fitted on the
    driver; with more of them each gradient is a sum in Spark.
    """
    counts = stored(df.groupBy(*features, label).agg(F.count("*").alias("__n")))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    w = np.zeros(len(features) + 1)
    if not total:
        return w.tolist()
    small = counts.limit(in_memory + 1).toPandas() if counts.count() <= in_memory else None
    for _ in range(rounds):
        if small is not None:
            x, y, n = small[features].to_numpy(float), small[label].to_numpy(float), small["__n"].to_numpy(float)
            error = (1 / (1 + np.exp(-(w[0] + x @ w[1:]))) - y) * n
            g = np.append(error.sum(), error @ x)
        else:
            z = F.lit(float(w[0]))
            for k, f in zip(w[1:], features):
                z = z + F.lit(float(k)) * F.col(f)
            error = (1 / (1 + F.exp(-z)) - F.col(label)) * F.col("__n")
            g = np.array(counts.agg(F.sum(error), *[F.sum(error * F.col(f)) for f in features]).first())
        w = w - rate * (g / total + l2 * np.append(0.0, w[1:]))
        rate *= decay
    return w.tolist()


def violations(df: DataFrame) -> DataFrame:
    """Every release blocker of each row, one row each."""
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    # The codes and their order.
    codes = [
        ("accepted_hard_constraint", (c("decision") == "accept") & yes(c("hard_constraint"))),
        ("accepted_high_risk", (c("decision") == "accept") & (c("risk_level") == "high")),
        ("overlapping_output_lanes", F.size(F.array_distinct("lanes")) > 1),
        ("incomplete_terminal_drop", yes(c("terminal_drop")) & ~F.forall("drop_fields", lambda x: x.isNotNull() & (x != ""))),
        ("changed_content_skipped", yes(c("changed_content_skipped"))),
        ("retryable_failure_duplicate", yes(c("retryable_failure_duplicate"))),
        ("one_to_many_candidate_loss", yes(c("candidate_loss"))),
        ("synthetic_input_only_improvement", yes(c("synthetic_only"))),
        ("reranker_silent_reject", yes(c("reranker_unavailable")) & (c("decision") == "reject")),
        ("unexplained_source_coverage_regression", yes(c("coverage_regression")) & c("explanation").isNull()),
    ]
    return df.select("id", F.explode(F.array_compact(F.array(*[F.when(ok, name) for name, ok in codes]))).alias("violation"))
