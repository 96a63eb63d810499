"""Profile scores, vector margins, evidence and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cross_small(df: DataFrame, small: DataFrame, limit: int = 10_000) -> DataFrame:
    """df x small, with a check that the small side is small: a product with a large table is an error."""
    n = small.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"more than {limit} rows on the small side of a product")
    return df.crossJoin(F.broadcast(small))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def fuse(margin: Column, k: float = 20.0) -> Column:
    return 1 / (1 + F.exp(-k * margin))


def evidence(atoms: DataFrame, params: DataFrame, by: list[str]) -> DataFrame:
    """Claim assessments from signed atoms.

    An atom weighs min(cap, strength * reliability). Of one independence key and polarity only the
    heaviest counts. belief = sigmoid(logit(prior) + support - contradiction), coverage = 1 - e^(-rate *
    mass), conflict = min / max, certainty = coverage * (1 - penalty * conflict). A claim without
    parameters has the defaults.
    """
    p = atoms.join(params, "claim", "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (("prior", 0.5), ("cap", 1.0), ("rate", 1.0), ("penalty", 0.5))})
    one = p.withColumn("mass", F.least("cap", F.col("strength") * F.col("reliability"))).groupBy(*by, "polarity", "independence_key", "prior", "rate", "penalty").agg(F.max("mass").alias("mass"))
    sums = one.groupBy(*by, "prior", "rate", "penalty").agg(*[F.sum(F.when(F.col("polarity") == s, F.col("mass")).otherwise(0.0)).alias(n) for s, n in ((1, "support"), (-1, "against"))])
    logit = F.ln(F.col("prior") / (1 - F.col("prior"))) + F.col("support") - F.col("against")
    most = F.greatest("support", "against")
    conflict = F.when(most > 0, F.least("support", "against") / most).otherwise(0.0)
    coverage = 1 - F.exp(-F.col("rate") * (F.col("support") + F.col("against")))
    return sums.select(*by, F.round("support", 6).alias("support"), F.round("against", 6).alias("against"), F.round(1 / (1 + F.exp(-logit)), 6).alias("belief"), F.round(coverage * (1 - F.col("penalty") * conflict), 6).alias("certainty"))


def decide(belief: Column, certainty: Column, veto: Column) -> Column:
    """The first rule that holds."""
    return F.when(veto, "reject").when(certainty < 0.45, "deferred").when(belief >= 0.7, "accept").when(belief < 0.3, "reject").otherwise("review")


def weighted_signals(signals: DataFrame, by: str) -> DataFrame:
    """Of each independence group the largest value * weight, then the weighted mean."""
    best = signals.groupBy(by, "family").agg(F.max(F.struct(F.col("value") * F.col("weight"), "value", "weight")).alias("b"))
    return best.groupBy(by).agg(F.round(F.sum(F.col("b.value") * F.col("b.weight")) / F.sum("b.weight"), 4).alias("policy_score"), F.count("*").alias("families"))
