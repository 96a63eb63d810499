"""Rows against profiles and anchors: overlap prefilters, constraint states, weighted scores, convolved margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnowline.operators.scoring import cosine, cross_small


def phrase_overlap(tokens: Column, phrases: Column) -> Column:
    """The best share of a phrase's words that the tokens hold; 0 without phrases."""
    share = F.transform(F.filter(phrases, lambda p: F.trim(p) != ""), lambda p: F.size(F.array_intersect(F.array_distinct(F.split(F.lower(F.trim(p)), " +")), tokens)) / F.size(F.array_distinct(F.split(F.lower(F.trim(p)), " +"))))
    return F.round(F.coalesce(F.array_max(share), F.lit(0.0)), 4)


def holds_phrase(low: Column, phrases: Column) -> Column:
    return F.exists(phrases, lambda p: F.contains(p, F.lit(" ")) & F.contains(low, F.lower(p)))


def overlap_prefilter(docs: DataFrame, key: str, text: str, profiles: DataFrame, ratio: float = 0.75, foreign: Column | None = None) -> DataFrame:
    """Best profile and score of each row by word overlap, and whether it is uncertain; never a drop.

    Profiles have roles, domains, hard, soft, anti (arrays of phrases), w_title, w_domain, threshold. A phrase of
    several words that stands in the text lifts roles to .85 and domains to .7. Texts in another script are
    held to half the threshold, for profile words are English.
    """
    low = F.lower(text)
    d = docs.select(key, low.alias("low"), F.array_distinct(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}+#]+"), 0)).alias("tokens"), (F.lit(0.0) if foreign is None else foreign).alias("foreign"))
    x = cross_small(d, profiles)
    title = F.greatest(phrase_overlap(F.col("tokens"), F.col("roles")), F.when(holds_phrase(F.col("low"), F.col("roles")), 0.85).otherwise(0.0))
    domain = F.greatest(phrase_overlap(F.col("tokens"), F.col("domains")), F.when(holds_phrase(F.col("low"), F.col("domains")), 0.7).otherwise(0.0))
    hard, soft, anti = (phrase_overlap(F.col("tokens"), F.col(c)) for c in ("hard", "soft", "anti"))
    score = F.col("w_title") * title + F.col("w_domain") * domain + 0.25 * hard + 0.25 * soft - 0.35 * anti
    x = x.select(key, "profile", "place", "threshold", "foreign", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 4))).alias("score"))
    best = x.groupBy(key).agg(F.max(F.struct("score", (-F.col("place")).alias("p"), "profile")).alias("b"), F.max("threshold").alias("t"), F.max("foreign").alias("f"))
    limit = F.col("t") * F.when(F.col("f") > 0.4, F.lit(min(ratio, 0.5))).otherwise(ratio)
    return best.select(key, F.col("b.profile").alias("profile"), F.col("b.score").alias("score"), (F.col("b.score") < limit).alias("uncertain"))


def embedding_prefilter(vectors: DataFrame, roles: DataFrame, passing: float = 0.5, low: float = 0.35) -> DataFrame:
    """Best role vector of each row by cosine and what follows: pass, low_signal or uncertain."""
    s = cross_small(vectors, roles).select("vec_id", "profile", cosine(F.col("embedding"), F.col("role")).alias("sim"))
    best = s.groupBy("vec_id").agg(F.max(F.struct(F.round("sim", 6).alias("sim"), "profile")).alias("b"))
    sim = F.greatest(F.col("b.sim"), F.lit(0.0))
    return best.select("vec_id", F.col("b.profile").alias("profile"), sim.alias("sim"), F.when(sim >= passing, "pass").when(sim < low, "low_signal").otherwise("uncertain").alias("decision"))


def rescue(margin: Column, threshold: float, strong: Column, positive: Column, logic: str) -> Column:
    """Whether a row passes a margin gate: by its margin, or by what the rescue logic accepts."""
    saved = {"strong_signal": strong, "any_positive": positive | strong, "none": F.lit(False)}[logic]
    return (margin >= threshold) | saved


def convolved(sims: DataFrame, by: list[str], order: str, value: str, kernel: tuple[float, float, float] = (0.25, 0.5, 0.25)) -> DataFrame:
    """A three-tap convolution along the anchors of each row, ends repeated, then the greatest value."""
    w = W.partitionBy(*by).orderBy(order)  # anchors of one row
    before, after = F.coalesce(F.lag(value).over(w), F.col(value)), F.coalesce(F.lead(value).over(w), F.col(value))
    c = sims.withColumn("c", kernel[0] * before + kernel[1] * F.col(value) + kernel[2] * after)
    return c.groupBy(*by).agg(F.max("c").alias("pooled"))


LEVELS = ("intern", "junior", "middle", "senior", "lead")


def level(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), c)


def constraint_states(language: Column, languages: Column, company: Column, blocked: Column, seniority: Column, low: Column, high: Column, skills: Column, required: Column) -> Column:
    """present, unknown or contradicted for each constraint that a profile sets; absence never contradicts."""
    known = F.coalesce(language, F.lit("unknown"))
    lang = F.when(F.size(languages) > 0, F.when(known == "unknown", "unknown").when(F.array_contains(languages, known), "present").otherwise("contradicted"))
    firm = F.when(F.size(blocked) > 0, F.when(company.isNull(), "unknown").when(F.exists(blocked, lambda b: F.contains(F.lower(company), F.lower(b))), "contradicted").otherwise("present"))
    here = F.coalesce(level(seniority), F.lit(0))
    outside = (low.isNotNull() & (here < level(low))) | (high.isNotNull() & (here > level(high)))
    rank = F.when(low.isNotNull() | high.isNotNull(), F.when(here == 0, "unknown").when(F.coalesce(outside, F.lit(False)), "contradicted").otherwise("present"))
    able = F.when(F.size(required) > 0, F.when(F.size(F.array_except(required, skills)) == 0, "present").otherwise("unknown"))
    pairs = F.array(*[F.when(s.isNotNull(), F.struct(F.lit(n).alias("key"), s.alias("value"))) for n, s in (("language", lang), ("company", firm), ("seniority", rank), ("required_skills", able))])
    return F.map_from_entries(F.array_compact(pairs))


def neutral(known: Column, value: Column) -> Column:
    """A sub-score: .5 where nothing is known."""
    return F.when(known, value).otherwise(0.5)


def sub_scores(seniority: Column, low: Column, high: Column, place: Column, regions: Column, pay: Column, currency: Column, floor: Column, floor_currency: Column, culture: Column, wanted: Column) -> dict[str, Column]:
    """seniority, region, salary and culture of a row for a profile."""
    here = level(seniority)
    inside = (low.isNull() | (here >= level(low))) & (high.isNull() | (here <= level(high)))
    region = F.when(F.size(regions) == 0, 1.0).when(F.exists(regions, lambda r: F.contains(F.lower(F.coalesce(place, F.lit(""))), F.lower(r))), 1.0).otherwise(0.0)
    salary = F.when(floor_currency.isNull() | currency.isNull(), 0.5).when(currency != floor_currency, 0.0).when(floor.isNull() | pay.isNull(), 0.5).when(pay >= floor, 1.0).otherwise(0.0)
    share = F.least(F.lit(1.0), F.size(F.array_intersect(culture, wanted)) / F.size(wanted))
    return {"seniority": neutral(seniority.isNotNull(), F.when(inside, 1.0).otherwise(0.0)), "region": region, "salary": salary, "culture": neutral(F.size(wanted) > 0, share)}


WEIGHTS = {"role": 0.25, "skills": 0.2, "domain": 0.15, "seniority": 0.1, "region": 0.05, "salary": 0.05, "culture": 0.0, "vector": 0.0}


def weighted_score(scores: dict[str, Column], is_job: Column, risks: Column, worst_vector: Column, weights: dict[str, float] | None = None) -> Column:
    """Sum of weights and scores, a bonus for a vacancy, less .15 a risk and less .6 or .2 for likeness to a negative vector; within 0 and 1."""
    total = F.when(is_job, 0.05).otherwise(0.0)
    for name, w in (weights or WEIGHTS).items():
        total = total + F.lit(w) * scores.get(name, F.lit(0.0))
    penalty = F.least(F.lit(1.0), 0.15 * F.size(risks)) + F.when(worst_vector > 0.8, 0.6).when(worst_vector > 0.7, 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(total - penalty, 2)))


def band(score: Column, threshold: Column, hard_pass: Column) -> Column:
    return F.when(~hard_pass, "reject").when(score >= threshold, "accept").when(score >= F.greatest(F.lit(0.2), 0.75 * threshold), "review").otherwise("reject")


def best_of(scores: DataFrame, key: str) -> DataFrame:
    """One row of each key: any accepted profile before any in review, then the best score, then the profile's place."""
    rank = F.when(F.col("decision") == "accept", 2).when(F.col("decision") == "review", 1).otherwise(0)
    best = scores.groupBy(key).agg(F.max(F.struct(rank.alias("rank"), "score", (-F.col("place")).alias("p"), "profile", "decision")).alias("b"))
    return best.select(key, "b.profile", "b.score", "b.decision")
