"""Prefilter, profile, list and plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnowline.operators import matching as M
from winnowline.operators import state as S
from winnowline.operators.scoring import fuse
from winnowline.plans import conditions as C
from winnowline.queries import Registry, table
from winnowline.queries.records import GATED_SQL
from winnowline.queries.scoring import COS_SQL

R = Registry()

PROFILES = [("english", 0, ["of the", "and"], ["thing"], ["the"], ["in"], ["und"], 0.4, 0.2, 0.6), ("german", 1, ["der die", "und"], ["heit ung"], ["das"], ["in"], ["the"], 0.4, 0.2, 0.5)]
PROFILE_SCHEMA = "profile string, place int, roles array<string>, domains array<string>, hard array<string>, soft array<string>, anti array<string>, w_title double, w_domain double, threshold double"


def _overlap_sql(phrases: list[str]) -> str:
    parts = []
    for p in phrases:
        words = sorted(set(p.split()))
        parts.append("(" + " + ".join(f"list_contains(t, '{w}')::INTEGER" for w in words) + f") / {len(words)}.0::DOUBLE")
    return f"round(greatest({', '.join(parts)}, 0.0::DOUBLE), 4)"


def _profile_sql(p) -> str:
    name, place, roles, domains, hard, soft, anti, wt, wd, _ = p
    lifted = lambda ps, v: " OR ".join(f"contains(low, '{x}')" for x in ps if " " in x) or "false"
    title = f"greatest({_overlap_sql(roles)}, CASE WHEN {lifted(roles, 0.85)} THEN 0.85 ELSE 0 END)"
    domain = f"greatest({_overlap_sql(domains)}, CASE WHEN {lifted(domains, 0.7)} THEN 0.7 ELSE 0 END)"
    return f"SELECT doc_id, '{name}' AS profile, {place} AS place, f, greatest(0.0::DOUBLE, least(1.0::DOUBLE, round({wt}::DOUBLE * {title} + {wd}::DOUBLE * {domain} + 0.25::DOUBLE * {_overlap_sql(hard)} + 0.25::DOUBLE * {_overlap_sql(soft)} - 0.35::DOUBLE * {_overlap_sql(anti)}, 4))) AS score FROM d"


@R.add(rf"WITH d AS (SELECT doc_id, lower(text) AS low, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}+#]+')) AS t, CASE WHEN lang = 'fr' THEN 0.5 ELSE 0.0 END AS f FROM documents), s AS ({' UNION ALL '.join(_profile_sql(p) for p in PROFILES)}) SELECT doc_id, profile, score, score < 0.6::DOUBLE * CASE WHEN f > 0.4 THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END AS uncertain FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) = 1")
def semantic_prefilter(spark, d):
    docs = table(spark, d, "documents").withColumn("f", F.when(F.col("lang") == "fr", 0.5).otherwise(0.0))
    return M.overlap_prefilter(docs, "doc_id", "text", spark.createDataFrame(PROFILES, PROFILE_SCHEMA), foreign=F.col("f"))


ROLE_SQL = "SELECT label AS l, CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS profile, embedding AS role FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1"


def _roles(spark, d):
    first = table(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("role"))
    return first.select("label", F.when(F.col("label") < 5, "low").otherwise("high").alias("profile"), "role")


@R.add(f"SELECT vec_id, profile, sim, CASE WHEN sim >= 0.5 THEN 'pass' WHEN sim < 0.35 THEN 'low_signal' ELSE 'uncertain' END AS decision FROM (SELECT vec_id, profile, greatest(sim, 0) AS sim FROM (SELECT vec_id, profile, round({COS_SQL.format('embedding', 'role')}, 6) AS sim FROM embeddings, ({ROLE_SQL})) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, profile DESC) = 1)")
def embedding_prefilter(spark, d):
    return M.embedding_prefilter(table(spark, d, "embeddings"), _roles(spark, d))


@R.add(f"WITH s AS (SELECT vec_id, profile, l, {COS_SQL.format('embedding', 'role')} AS sim FROM embeddings, ({ROLE_SQL})), c AS (SELECT vec_id, profile, 0.25 * coalesce(lag(sim) OVER w, sim) + 0.5 * sim + 0.25 * coalesce(lead(sim) OVER w, sim) AS c FROM s WINDOW w AS (PARTITION BY vec_id, profile ORDER BY l)), p AS (SELECT vec_id, max(CASE WHEN profile = 'low' THEN c END) AS pos, max(CASE WHEN profile = 'high' THEN c END) AS neg FROM c GROUP BY vec_id) SELECT vec_id, round(pos - neg, 6) AS margin, round(1 / (1 + exp(-20 * (pos - neg))), 4) AS fused FROM p")
def convolved_fusion(spark, d):
    """Similarities smoothed along the anchors, pooled, and fused from the margin of both sides."""
    from winnowline.operators.scoring import cosine, cross_small

    s = cross_small(table(spark, d, "embeddings").select("vec_id", "embedding"), _roles(spark, d)).select("vec_id", "profile", "label", cosine(F.col("embedding"), F.col("role")).alias("sim"))
    p = M.convolved(s, ["vec_id", "profile"], "label", "sim").groupBy("vec_id").agg(F.max(F.when(F.col("profile") == "low", F.col("pooled"))).alias("p"), F.max(F.when(F.col("profile") == "high", F.col("pooled"))).alias("n"))
    return p.select("vec_id", F.round(F.col("p") - F.col("n"), 6).alias("margin"), F.round(fuse(F.col("p") - F.col("n")), 4).alias("fused"))


@R.add(f"SELECT vec_id, profile, round(max(CASE WHEN up THEN sim END) - max(CASE WHEN NOT up THEN sim END), 6) AS margin FROM (SELECT vec_id, profile, l % 2 = 0 AS up, {COS_SQL.format('embedding', 'role')} AS sim FROM embeddings, ({ROLE_SQL})) GROUP BY vec_id, profile")
def semantic_margin(spark, d):
    """Of each profile the greatest likeness to its positive roles less that to its negative ones."""
    from winnowline.operators.scoring import cosine, cross_small

    s = cross_small(table(spark, d, "embeddings").select("vec_id", "embedding"), _roles(spark, d)).select("vec_id", "profile", (F.col("label") % 2 == 0).alias("up"), cosine(F.col("embedding"), F.col("role")).alias("sim"))
    side = lambda up: F.max(F.when(F.col("up") == up, F.col("sim")))
    return s.groupBy("vec_id", "profile").agg(F.round(side(True) - side(False), 6).alias("margin"))


@R.add(f"SELECT vec_id, margin >= 0.1 OR vec_id % 9 = 0 OR vec_id % 4 = 0 AS any_positive, margin >= 0.1 OR vec_id % 9 = 0 AS strong_signal, margin >= 0.1 AS none FROM (SELECT vec_id, round(max(CASE WHEN up THEN sim END) - max(CASE WHEN NOT up THEN sim END), 6) AS margin FROM (SELECT vec_id, l % 2 = 0 AS up, {COS_SQL.format('embedding', 'role')} AS sim FROM embeddings, ({ROLE_SQL})) GROUP BY vec_id)")
def anchor_prefilter(spark, d):
    """A margin gate with three rescue rules."""
    from winnowline.operators.scoring import cosine, cross_small

    s = cross_small(table(spark, d, "embeddings").select("vec_id", "embedding"), _roles(spark, d)).select("vec_id", (F.col("label") % 2 == 0).alias("up"), cosine(F.col("embedding"), F.col("role")).alias("sim"))
    side = lambda up: F.max(F.when(F.col("up") == up, F.col("sim")))
    m = s.groupBy("vec_id").agg(F.round(side(True) - side(False), 6).alias("margin"))
    return m.select("vec_id", *[M.rescue(F.col("margin"), 0.1, F.col("vec_id") % 9 == 0, F.col("vec_id") % 4 == 0, logic).alias(logic) for logic in ("any_positive", "strong_signal", "none")])


# Parts as postings: the type's last word is a skill, the size a level, the brand a company.
WANTED = [("metal", 0, ["promo", "small"], ["Brand#1"], "junior", "senior", ["small"], 0.35), ("any", 1, [], [], None, None, [], 0.5)]
WANTED_SCHEMA = "profile string, place int, languages array<string>, blocked array<string>, low string, high string, required array<string>, threshold double"
LEVEL = "CASE p_size % 7 WHEN 0 THEN 'intern' WHEN 1 THEN 'junior' WHEN 2 THEN 'middle' WHEN 3 THEN 'senior' WHEN 4 THEN 'lead' END"
POST_SQL = f"SELECT p_partkey, lower(regexp_extract(p_type, '(\\S+)$', 1)) AS word, CASE WHEN p_partkey % 6 > 0 THEN p_brand END AS company, {LEVEL} AS level, p_retailprice AS pay, p_size FROM part".replace("\\\\", "\\")
STATES_SQL = f"SELECT *, CASE WHEN p_partkey % 8 = 0 THEN 'unknown' WHEN word IN ('promo', 'small') THEN 'present' ELSE 'contradicted' END AS language, CASE WHEN company IS NULL THEN 'unknown' WHEN contains(lower(company), 'brand#1') THEN 'contradicted' ELSE 'present' END AS firm, CASE WHEN level IS NULL THEN 'unknown' WHEN level IN ('junior', 'middle', 'senior') THEN 'present' ELSE 'contradicted' END AS rank, CASE WHEN word = 'small' THEN 'present' ELSE 'unknown' END AS able FROM ({POST_SQL})"


def _posted(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    names = F.array(*map(F.lit, ("intern", "junior", "middle", "senior", "lead")))
    p = p.select("p_partkey", F.lower(F.regexp_extract("p_type", r"(\S+)$", 1)).alias("word"), F.when(k % 6 > 0, F.col("p_brand")).alias("company"), F.get(names, F.col("p_size") % 7).alias("level"), F.col("p_retailprice").alias("pay"), "p_size")
    x = M.cross_small(p, spark.createDataFrame(WANTED, WANTED_SCHEMA))
    language = F.when(k % 8 == 0, F.lit(None).cast("string")).otherwise(F.col("word"))
    return x.withColumn("states", M.constraint_states(language, F.col("languages"), F.col("company"), F.col("blocked"), F.col("level"), F.col("low"), F.col("high"), F.array("word"), F.col("required")))


@R.add(f"SELECT p_partkey, 'metal' AS profile, 'company=' || firm || ',language=' || language || ',required_skills=' || able || ',seniority=' || rank AS states FROM ({STATES_SQL}) UNION ALL SELECT p_partkey, 'any', '' FROM part")
def constraint_states(spark, d):
    s = F.array_join(F.array_sort(F.transform(F.map_entries("states"), lambda x: F.concat_ws("=", x["key"], x["value"]))), ",")
    return _posted(spark, d).select("p_partkey", "profile", s.alias("states"))


SCORE_SQL = f"""WITH s AS ({STATES_SQL}), x AS (SELECT p_partkey, 'metal' AS profile, 0 AS place, 0.35::DOUBLE AS threshold, NOT (language = 'contradicted' OR firm = 'contradicted' OR rank = 'contradicted') AS ok, CASE WHEN level IS NULL THEN 0.5 WHEN level IN ('junior', 'middle', 'senior') THEN 1.0 ELSE 0.0 END AS sen, CASE WHEN contains(lower(coalesce(company, '')), 'brand#2') THEN 1.0 ELSE 0.0 END AS reg, CASE WHEN pay >= 1200 THEN 1.0 ELSE 0.0 END AS sal, CASE WHEN word = 'small' THEN 1.0 ELSE 0.0 END AS cul, (word = 'small')::INTEGER AS skill, p_size FROM s
UNION ALL SELECT p_partkey, 'any', 1, 0.5, true, CASE WHEN level IS NULL THEN 0.5 ELSE 1.0 END, 1.0, 0.5, 0.5, 0, p_size FROM s)
SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(CASE WHEN p_size % 2 = 0 THEN 0.05::DOUBLE ELSE 0 END + 0.4::DOUBLE * skill + 0.2::DOUBLE * sen + 0.1::DOUBLE * reg + 0.1::DOUBLE * sal + 0.1::DOUBLE * cul - (0.15::DOUBLE * (p_size % 3 = 0)::INTEGER + CASE WHEN p_size > 48 THEN 0.6::DOUBLE WHEN p_size > 45 THEN 0.2::DOUBLE ELSE 0 END), 2))) AS score FROM x"""
BAND_SQL = f"SELECT p_partkey, profile, place, sen::DOUBLE AS seniority, reg::DOUBLE AS region, sal::DOUBLE AS salary, cul::DOUBLE AS culture, score, CASE WHEN NOT ok THEN 'reject' WHEN score >= threshold THEN 'accept' WHEN score >= greatest(0.2, 0.75 * threshold) THEN 'review' ELSE 'reject' END AS decision FROM ({SCORE_SQL})"


def _profile_scores(spark, d):
    p = _posted(spark, d)
    metal = F.col("profile") == "metal"
    none = F.array().cast("array<string>")
    subs = M.sub_scores(F.col("level"), F.col("low"), F.col("high"), F.col("company"), F.when(metal, F.array(F.lit("brand#2"))).otherwise(none), F.col("pay"), F.lit("USD"), F.when(metal, 1200.0), F.when(metal, "USD"), F.array("word"), F.col("required"))
    p = p.withColumns({k: v.cast("double") for k, v in subs.items()})
    weights = {"skills": 0.4, "seniority": 0.2, "region": 0.1, "salary": 0.1, "culture": 0.1}
    scores = {k: F.col(k) for k in subs} | {"skills": F.when((F.size("required") > 0) & F.array_contains(F.col("required"), F.col("word")), 1.0).otherwise(0.0)}
    worst = F.when(F.col("p_size") > 48, 0.9).when(F.col("p_size") > 45, 0.75).otherwise(0.1)
    risks = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("x"))).otherwise(none)
    p = p.withColumn("score", M.weighted_score(scores, F.col("p_size") % 2 == 0, risks, worst, weights))
    hard = ~F.exists(F.map_values("states"), lambda s: s == "contradicted")
    return p.withColumn("decision", M.band(F.col("score"), F.col("threshold"), hard))


@R.add(f"SELECT p_partkey, profile, seniority, region, salary, culture, score, decision FROM ({BAND_SQL})")
def multi_profile_score(spark, d):
    return _profile_scores(spark, d).select("p_partkey", "profile", "seniority", "region", "salary", "culture", "score", "decision")


@R.add(f"SELECT p_partkey, profile, score, decision FROM ({BAND_SQL}) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY CASE decision WHEN 'accept' THEN 2 WHEN 'review' THEN 1 ELSE 0 END DESC, score DESC, place) = 1")
def best_decision(spark, d):
    return M.best_of(_profile_scores(spark, d), "p_partkey")


@R.add("SELECT c_custkey, score FROM (SELECT c_custkey, round(c_acctbal / 10000, 4) AS score FROM (SELECT * FROM customer ORDER BY c_custkey DESC LIMIT 250)) WHERE score >= 0.2 ORDER BY score DESC, c_custkey LIMIT 10")
def latest_reranked(spark, d):
    """A pool of the newest rows, scored anew, those above a minimum: pool and page are the feature."""
    pool = table(spark, d, "customer").orderBy(F.desc("c_custkey")).limit(250).select("c_custkey", F.round(F.col("c_acctbal") / 10000, 4).alias("score"))
    return pool.where("score >= 0.2").orderBy(F.desc("score"), "c_custkey").limit(10)


@R.add("SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN ts END AS fetched FROM events) WHERE fetched IS NULL OR fetched >= TIMESTAMP '2024-01-25' ORDER BY coalesce(fetched, TIMESTAMP '1970-01-01'), event_id LIMIT 100")
def list_since(spark, d):
    """Rows since a time, undated ones first: the limit is the page."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 11 > 0, F.col("ts")).alias("fetched"))
    kept = S.fresh_enough(e, "fetched", F.lit("2024-01-25").cast("timestamp"))
    return kept.orderBy(F.coalesce("fetched", F.lit("1970-01-01").cast("timestamp")), "event_id").limit(100).select("event_id")


@R.add("SELECT tenant, run, n FROM (SELECT user_id % 3 AS tenant, CAST(ts AS DATE) AS run, count(*) AS n FROM events GROUP BY ALL) ORDER BY run DESC, tenant LIMIT 20")
def list_runs(spark, d):
    """The newest runs of all tenants: the limit is the page, held between 0 and 100."""
    runs = table(spark, d, "events").groupBy((F.col("user_id") % 3).alias("tenant"), F.to_date("ts").alias("run")).agg(F.count("*").alias("n"))
    return runs.orderBy(F.desc("run"), "tenant").limit(min(max(20, 0), 100))


@R.add("SELECT o_orderkey, lane, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM (SELECT o_orderkey, o_orderdate, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'review' ELSE 'rejected' END AS lane FROM orders)")
def lanes_resorted(spark, d):
    """The union of three lanes in one order; places are counted by day first."""
    from pyspark.sql import Window as W

    o = table(spark, d, "orders")
    lanes = [o.where(w).select("o_orderkey", "o_orderdate", F.lit(n).alias("lane")) for n, w in (("accepted", "o_orderstatus = 'F'"), ("review", "o_orderstatus = 'O'"), ("rejected", "o_orderstatus NOT IN ('F', 'O')"))]
    u = lanes[0].unionByName(lanes[1]).unionByName(lanes[2]).withColumn("day", F.to_date("o_orderdate"))
    before = u.groupBy("day").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy("day").orderBy("o_orderdate", "o_orderkey"))
    return u.withColumn("in_day", place).join(before, "day").select("o_orderkey", "lane", (F.col("before") + F.col("in_day")).alias("place"))


@R.add("WITH u AS (SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY lang, sha256(lower(text))), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM u) SELECT doc_id, lang FROM r ORDER BY n, lang <> 'en', lang LIMIT 12")
def balanced_examples(spark, d):
    """Distinct examples by turns from each bucket, the primary one first: the limit is the number of examples."""
    from pyspark.sql import Window as W

    u = table(spark, d, "documents").groupBy("lang", F.sha2(F.lower("text"), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    n = F.row_number().over(W.partitionBy("lang").orderBy("doc_id"))
    return u.withColumn("n", n).where("n <= 12").orderBy("n", F.col("lang") != "en", "lang").limit(12).select("doc_id", "lang")


@R.add(f"SELECT doc_id, CASE WHEN garbage IS NOT NULL THEN 'garbage' WHEN quality < 0.8 THEN 'quality' ELSE 'pass' END AS lane, coalesce(lang NOT IN ('en', 'de', 'fr'), false) AS shadow_language FROM ({GATED_SQL})")
def plan_presets(spark, d):
    """A preset that extends two others, with one gate overridden to report only and one taken out."""
    from winnowline.queries.records import gated_columns

    gates = C.override(C.resolve_plan("strict", C.PRESETS), {"language": {"shadow": True}, "long": {"enabled": False}})
    g = C.apply_gates(gated_columns(spark, d), gates)
    return g.select("doc_id", "lane", F.exists("drops", lambda x: x["gate"] == "language").alias("shadow_language"))


@R.add(f"SELECT source, gate, count(*) AS would_drop FROM (SELECT source, unnest(list_filter([CASE WHEN n_chars >= 4000 THEN 'long' END], lambda x: x IS NOT NULL)) AS gate FROM ({GATED_SQL}) WHERE garbage IS NULL AND lang IN ('en', 'de', 'fr') AND quality >= 0.8) GROUP BY ALL")
def shadow_gates(spark, d):
    from winnowline.queries.records import gated_columns

    return C.shadow_disagreements(C.apply_gates(gated_columns(spark, d), C.resolve_plan("strict", C.PRESETS)), ["source"])


QUERIES, ORACLE = R.queries, R.oracle
