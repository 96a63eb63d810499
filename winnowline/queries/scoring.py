"""Scoring queries: profiles, vectors, evidence, decisions, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnowline.operators import scoring as S
from winnowline.operators import inverted as X
from winnowline.operators import search as Q
from winnowline.operators import vectors as V
from winnowline.queries import Registry, table

R = Registry()

PROFILES = [("small", 1, 20, 0.6), ("middle", 15, 35, 0.5), ("large", 30, 50, 0.7)]
PROFILES_SQL = "(VALUES ('small', 1, 20, 0.6::DOUBLE), ('middle', 15, 35, 0.5::DOUBLE), ('large', 30, 50, 0.7::DOUBLE)) p(profile, low, high, threshold)"
MATCH_SQL = f"SELECT p_partkey, profile, threshold, CASE WHEN p_size BETWEEN low AND high THEN 'present' ELSE 'contradicted' END AS size_state, round(0.5::DOUBLE * (CASE WHEN p_size BETWEEN low AND high THEN 1 ELSE 0 END) + 0.3::DOUBLE * least(1.0::DOUBLE, p_retailprice / 2000) + 0.2::DOUBLE * (CASE WHEN contains(lower(p_type), 'steel') THEN 1 ELSE 0 END), 8) AS score FROM part, {PROFILES_SQL}"


def _matches(spark, d):
    profiles = spark.createDataFrame(PROFILES, "profile string, low int, high int, threshold double")
    p = S.cross_small(table(spark, d, "part"), profiles)
    fits = F.col("p_size").between(F.col("low"), F.col("high"))
    score = 0.5 * F.when(fits, 1).otherwise(0) + 0.3 * F.least(F.lit(1.0), F.col("p_retailprice") / 2000) + 0.2 * F.when(F.contains(F.lower("p_type"), F.lit("steel")), 1).otherwise(0)
    return p.select("p_partkey", "profile", "threshold", F.when(fits, "present").otherwise("contradicted").alias("size_state"), F.round(score, 8).alias("score"))


@R.add(f"SELECT p_partkey, profile, score, CASE WHEN score >= threshold THEN 'accept' WHEN score >= greatest(0.2, 0.75 * threshold) THEN 'review' ELSE 'reject' END AS decision FROM ({MATCH_SQL})")
def profile_match(spark, d):
    decision = F.when(F.col("score") >= F.col("threshold"), "accept").when(F.col("score") >= F.greatest(F.lit(0.2), 0.75 * F.col("threshold")), "review").otherwise("reject")
    return _matches(spark, d).select("p_partkey", "profile", "score", decision.alias("decision"))


@R.add(f"SELECT p_partkey, profile, size_state FROM ({MATCH_SQL})")
def hard_constraints(spark, d):
    return _matches(spark, d).select("p_partkey", "profile", "size_state")


@R.add(f"SELECT p_partkey, profile, score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, profile) AS n FROM ({MATCH_SQL})) WHERE n = 1")
def best_profile(spark, d):
    best = _matches(spark, d).groupBy("p_partkey").agg(F.min(F.struct((-F.col("score")).alias("s"), "profile")).alias("b"))
    return best.select("p_partkey", F.col("b.profile").alias("profile"), (-F.col("b.s")).alias("score"))


PHRASES = [("the", 1), ("und", 2), ("que", 2), ("idiot", -3), ("!!", -2)]


@R.add("SELECT doc_id, " + " + ".join(f"(CASE WHEN contains(lower(text), '{p}') THEN {w} ELSE 0 END)" for p, w in PHRASES) + " AS lexical FROM documents")
def lexical_evidence(spark, d):
    low = F.lower("text")
    total = F.lit(0)
    for p, w in PHRASES:
        total = total + F.when(F.contains(low, F.lit(p)), w).otherwise(0)
    return table(spark, d, "documents").select("doc_id", total.alias("lexical"))


COS_SQL = "list_inner_product({0}::DOUBLE[], {1}::DOUBLE[]) / sqrt(list_inner_product({0}::DOUBLE[], {0}::DOUBLE[]) * list_inner_product({1}::DOUBLE[], {1}::DOUBLE[]))"
ANCHORS_SQL = "SELECT embedding AS anchor, label < 2 AS positive FROM embeddings WHERE label < 2 OR label = 9"
SIMS_SQL = f"SELECT vec_id, positive, {COS_SQL.format('embedding', 'anchor')} AS sim FROM embeddings, ({ANCHORS_SQL})"
MARGIN_SQL = f"SELECT vec_id, round(max(CASE WHEN positive THEN m END) - max(CASE WHEN NOT positive THEN m END), 6) AS margin, round(max(CASE WHEN positive THEN x END) - max(CASE WHEN NOT positive THEN x END), 6) AS max_margin FROM (SELECT vec_id, positive, avg(sim) FILTER (r <= 5) AS m, max(sim) AS x FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, positive ORDER BY sim DESC) AS r FROM ({SIMS_SQL})) GROUP BY ALL) GROUP BY vec_id"


def _margins(spark, d):
    e = table(spark, d, "embeddings")
    anchors = e.where("label < 2 OR label = 9").select(F.col("embedding").alias("anchor"), (F.col("label") < 2).alias("positive"))
    return V.anchor_margin(e, anchors)


@R.add(MARGIN_SQL)
def anchor_margin_topk(spark, d):
    return _margins(spark, d)


@R.add(f"SELECT vec_id, round(1 / (1 + exp(-5 * (0.7 * margin + 0.3 * max_margin))), 4) AS fused FROM ({MARGIN_SQL})")
def parallel_fusion(spark, d):
    return _margins(spark, d).select("vec_id", F.round(S.fuse(0.7 * F.col("margin") + 0.3 * F.col("max_margin"), 5.0), 4).alias("fused"))


@R.add(f"SELECT query_id, vec_id, sim, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round({COS_SQL.format('e.embedding', 'q.embedding')}, 6) AS sim FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)) WHERE rank <= 10")
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return V.nearest(e, q, 10).select("query_id", "vec_id", "sim", "rank")


@R.add(f"SELECT query_id, vec_id, sim, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round({COS_SQL.format('e.embedding', 'q.embedding')}, 6) AS sim FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id AND e.label IN (1, 3, 5))) WHERE rank <= 5")
def filtered_topk(spark, d):
    """The nearest among the vectors with some labels: the payload filter goes before the search."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return V.nearest(e, q, 5, where=F.col("label").isin(1, 3, 5)).select("query_id", "vec_id", "sim", "rank")


PARAMS = [("active", 0.4, 3.0, 0.5, 0.5), ("risky", 0.2, 2.0, 1.0, 0.8)]
PARAMS_SQL = "(VALUES ('active', 0.4::DOUBLE, 3.0::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE), ('risky', 0.2::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE, 0.8::DOUBLE)) p(claim, prior, cap, rate, penalty)"
ATOMS_SQL = "SELECT user_id, CASE WHEN event_type IN ('view', 'click') THEN 'active' WHEN event_type = 'error' THEN 'risky' ELSE 'buyer' END AS claim, CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END AS polarity, event_type AS independence_key, least(1.0, value / 100) AS strength, 0.8::DOUBLE AS reliability FROM events"
EVIDENCE_SQL = f"""WITH a AS ({ATOMS_SQL}), m AS (SELECT user_id, claim, polarity, independence_key, coalesce(prior, 0.5) AS prior, coalesce(rate, 1.0) AS rate, coalesce(penalty, 0.5) AS penalty, max(least(coalesce(cap, 1.0), strength * reliability)) AS mass FROM a LEFT JOIN {PARAMS_SQL} USING (claim) GROUP BY ALL),
s AS (SELECT user_id, claim, prior, rate, penalty, sum(CASE WHEN polarity = 1 THEN mass ELSE 0 END) AS sup, sum(CASE WHEN polarity = -1 THEN mass ELSE 0 END) AS con FROM m GROUP BY ALL)
SELECT user_id, claim, round(sup, 6) AS support, round(con, 6) AS against, round(1 / (1 + exp(-(ln(prior / (1 - prior)) + sup - con))), 6) AS belief, round((1 - exp(-rate * (sup + con))) * (1 - penalty * CASE WHEN greatest(sup, con) > 0 THEN least(sup, con) / greatest(sup, con) ELSE 0 END), 6) AS certainty FROM s"""


def _evidence(spark, d):
    claim = F.when(F.col("event_type").isin("view", "click"), "active").when(F.col("event_type") == "error", "risky").otherwise("buyer")
    atoms = table(spark, d, "events").select("user_id", claim.alias("claim"), F.when(F.col("event_id") % 5 == 0, -1).otherwise(1).alias("polarity"), F.col("event_type").alias("independence_key"), F.least(F.lit(1.0), F.col("value") / 100).alias("strength"), F.lit(0.8).alias("reliability"))
    params = spark.createDataFrame(PARAMS, "claim string, prior double, cap double, rate double, penalty double")
    return S.evidence(atoms, params, ["user_id", "claim"])


@R.add(EVIDENCE_SQL)
def evidence_aggregate(spark, d):
    return _evidence(spark, d)


@R.add(f"SELECT user_id, CASE WHEN coalesce(max(CASE WHEN claim = 'risky' THEN belief END), 0) > 0.55 THEN 'reject' WHEN coalesce(max(CASE WHEN claim = 'active' THEN certainty END), 0) < 0.45 THEN 'deferred' WHEN coalesce(max(CASE WHEN claim = 'active' THEN belief END), 0) >= 0.7 THEN 'accept' WHEN coalesce(max(CASE WHEN claim = 'active' THEN belief END), 0) < 0.3 THEN 'reject' ELSE 'review' END AS decision FROM ({EVIDENCE_SQL}) GROUP BY user_id")
def decision_cascade(spark, d):
    at = lambda claim, c: F.coalesce(F.max(F.when(F.col("claim") == claim, F.col(c))), F.lit(0.0))
    p = _evidence(spark, d).groupBy("user_id").agg(at("active", "belief").alias("b"), at("active", "certainty").alias("c"), at("risky", "belief").alias("r"))
    return p.select("user_id", S.decide(F.col("b"), F.col("c"), F.col("r") > 0.55).alias("decision"))


SIGNALS_SQL = "SELECT o_custkey, o_orderpriority AS family, least(1.0, o_totalprice / 300000) AS value, (CASE WHEN o_orderstatus = 'F' THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight FROM orders"


@R.add(f"SELECT o_custkey, round(sum(b.value * b.weight) / sum(b.weight), 4) AS policy_score, count(*) AS families FROM (SELECT o_custkey, family, max(struct_pack(s := value * weight, value := value, weight := weight)) AS b FROM ({SIGNALS_SQL}) GROUP BY ALL) GROUP BY o_custkey")
def weighted_policy(spark, d):
    s = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("family"), F.least(F.lit(1.0), F.col("o_totalprice") / 300000).alias("value"), F.when(F.col("o_orderstatus") == "F", 2.0).otherwise(1.0).alias("weight"))
    return S.weighted_signals(s, "o_custkey")


BM25_SQL = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM documents), l AS (SELECT doc_id, words, len(words) AS length FROM w), st AS (SELECT count(*) AS n, avg(length) AS mean FROM l),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark),
t AS (SELECT doc_id, length, unnest(words) AS term FROM l), tf AS (SELECT doc_id, length, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s) """


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark, d, k):
    return X.top_documents(X.build_index(table(spark, d, "documents")), _queries(spark, d), k)


@R.add(BM25_SQL + "SELECT query_id, doc_id, round(score, 3) AS score FROM r WHERE rank <= 10")
def bm25_search(spark, d):
    return _bm25(spark, d, 10).select("query_id", "doc_id", F.round("score", 3).alias("score"))


@R.add(BM25_SQL + ", lists AS (SELECT query_id, doc_id, rank FROM r WHERE rank <= 30 UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY tfs DESC, doc_id)::INTEGER AS rank FROM (SELECT query_id, doc_id, count(*) AS tfs FROM tf JOIN q USING (term) GROUP BY ALL) QUALIFY rank <= 30) SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 8) AS rrf FROM lists GROUP BY ALL")
def rrf_fusion(spark, d):
    """Two text lists, by weight and by shared terms, fused by reciprocal rank."""
    index = X.build_index(table(spark, d, "documents"))
    return Q.fuse_ranks([X.top_documents(index, _queries(spark, d), 30, shared) for shared in (False, True)], "query_id", "doc_id")


VECTOR_SQL = f"SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id)::INTEGER AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round({COS_SQL.format('e.embedding', 'q.embedding')}, 6) AS sim FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND e.vec_id <> q.vec_id)"


@R.add(BM25_SQL + f", v AS ({VECTOR_SQL}), hl AS (SELECT 1 AS list, query_id, doc_id // 5 AS grp, min(rank) AS at_rank FROM r WHERE rank <= 30 GROUP BY ALL UNION ALL SELECT 2, query_id, doc_id // 5, min(rank) FROM v WHERE rank <= 30 GROUP BY ALL), g AS (SELECT query_id, grp, row_number() OVER (PARTITION BY list, query_id ORDER BY at_rank, grp) AS rank FROM hl), f AS (SELECT query_id, grp, round(sum(1 / (60 + rank)), 8) AS rrf FROM g WHERE rank <= 30 GROUP BY ALL) SELECT query_id, grp, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, grp)::INTEGER AS rank FROM f QUALIFY rank <= 10")
def hybrid_search(spark, d):
    """Text and vector lists of each query as groups of documents, fused by reciprocal rank."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = e.join(_queries(spark, d).select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    vectors = V.nearest(e, asked, 30).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    ids = table(spark, d, "documents").select("doc_id").union(e.select("vec_id")).distinct()
    groups = ids.select("doc_id", F.floor(F.col("doc_id") / 5).alias("grp"))
    return Q.hybrid(_bm25(spark, d, 30), vectors, "query_id", "doc_id", groups, "grp", 10)


@R.add(BM25_SQL + "SELECT query_id, rank, source, n_chars FROM r JOIN documents USING (doc_id) WHERE rank <= 5")
def ranked_payload(spark, d):
    """Payloads of a ranked list, ranks kept."""
    return Q.in_rank_order(_bm25(spark, d, 5), table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id").select("query_id", "rank", "source", "n_chars")


@R.add(BM25_SQL + ", hl AS (SELECT query_id, source AS grp, min(rank) AS best FROM r JOIN documents USING (doc_id) WHERE rank <= 25 GROUP BY ALL) SELECT query_id, grp, row_number() OVER (PARTITION BY query_id ORDER BY best, grp)::INTEGER AS rank FROM hl QUALIFY rank <= 5")
def grouped_search(spark, d):
    """Five groups of each query from five times as many documents."""
    groups = table(spark, d, "documents").select("doc_id", F.col("source").alias("grp"))
    return Q.overfetched(_bm25(spark, d, 25), "query_id", groups, "doc_id", "grp", 5)


@R.add("SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1995-06-01', 100) ORDER BY o_orderdate, o_orderkey LIMIT 26")
def keyset_page(spark, d):
    return Q.keyset_page(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], ("1995-06-01", 100), 25)


QUERIES, ORACLE = R.queries, R.oracle
