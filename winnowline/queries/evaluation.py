"""Evaluation and ontology queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnowline.operators import evaluation as E
from winnowline.operators import ontology as O
from winnowline.queries import Registry, table
from winnowline.queries.decisions import ATOMS_CTE, _atoms
from winnowline.queries.statistics import SCORED_SQL, _scored

R = Registry()

RUNS_SQL = f"SELECT doc_id, source, lang, gold, CASE WHEN score >= 0.8 THEN 'accept' WHEN score >= 0.6 THEN 'review' ELSE 'reject' END AS before, CASE WHEN score >= 0.7 THEN 'accept' WHEN score >= 0.5 AND doc_id % 7 > 0 THEN 'review' ELSE 'reject' END AS after FROM ({SCORED_SQL})"


def _runs(spark, d):
    s, c = _scored(spark, d), F.col("score")
    before = F.when(c >= 0.8, "accept").when(c >= 0.6, "review").otherwise("reject")
    after = F.when(c >= 0.7, "accept").when((c >= 0.5) & (F.col("doc_id") % 7 > 0), "review").otherwise("reject")
    return s.select("doc_id", "source", "lang", "gold", "score", before.alias("before"), after.alias("after"))


@R.add(f"SELECT source, CASE WHEN doc_id % 4 = 0 THEN 'unprofiled' ELSE lang END AS profile, count(*) AS compared, count(*) FILTER (before <> after) AS disagreements, coalesce(array_to_string(list_sort(list(DISTINCT before || '->' || after) FILTER (before <> after)), ','), '') AS changes FROM ({RUNS_SQL}) GROUP BY ALL")
def shadow_compare(spark, d):
    r = _runs(spark, d).withColumn("profile", F.when(F.col("doc_id") % 4 != 0, F.col("lang")))
    return E.shadow_compare(r.select("doc_id", "source", "profile", F.col("before").alias("decision")), r.select("doc_id", F.col("after").alias("decision")), "doc_id", ["source", "profile"])


@R.add("SELECT doc_id, CASE WHEN l IS NULL THEN 'candidate' ELSE 'baseline' END AS missing_from FROM (SELECT doc_id, l, doc_id % 10 > 0 AS k FROM documents FULL JOIN (SELECT doc_id, 1 AS l FROM labels) USING (doc_id)) WHERE (k AND l IS NULL) OR (NOT k AND l IS NOT NULL)")
def run_id_difference(spark, d):
    """Rows that only one of two runs has."""
    return E.id_differences(table(spark, d, "documents").where("doc_id % 10 > 0"), table(spark, d, "labels"), "doc_id")


@R.add("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 INTERSECT SELECT doc_id FROM labels")
def common_observations(spark, d):
    return table(spark, d, "documents").where("doc_id % 3 = 0").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@R.add(f"WITH r AS (SELECT CASE WHEN gold = 1 THEN 'accept' WHEN toxic = 1 THEN 'reject' ELSE 'review' END AS g, CASE WHEN score >= 0.8 THEN 'accept' WHEN score >= 0.6 THEN 'review' ELSE 'reject' END AS p FROM ({SCORED_SQL})), s AS (SELECT g AS class, count(*) AS support, count(*) FILTER (p = g) AS tp FROM r GROUP BY g), q AS (SELECT p AS class, count(*) AS predicted FROM r GROUP BY p) SELECT class, support, CASE WHEN coalesce(predicted, 0) > 0 THEN round(tp / predicted, 4) ELSE 0 END AS precision, round(tp / support, 4) AS recall, round(2 * tp / (coalesce(predicted, 0) + support), 4) AS f1 FROM s LEFT JOIN q USING (class)")
def per_class_prf(spark, d):
    s, c = _scored(spark, d), F.col("score")
    s = s.select(F.when(F.col("gold") == 1, "accept").when(F.col("toxic") == 1, "reject").otherwise("review").alias("g"), F.when(c >= 0.8, "accept").when(c >= 0.6, "review").otherwise("reject").alias("p"))
    return E.per_class(s, "p", "g")


NODES = ("sanitize", "type", "prefilter", "extract", "decide")
LOST_SQL = "SELECT user_id, min(CASE WHEN event_type = 'error' THEN {'p': event_id, 'n': ['sanitize', 'type', 'prefilter', 'extract', 'decide'][event_id % 5 + 1]} END) AS f FROM events GROUP BY user_id"


@R.add(f"SELECT user_id, f.p AS at, f.n AS node FROM ({LOST_SQL}) WHERE f IS NOT NULL".replace("AS at,", "AS \"at\","))
def first_loss(spark, d):
    node = F.element_at(F.array(*map(F.lit, NODES)), (F.col("event_id") % 5 + 1).cast("int"))
    e = table(spark, d, "events").withColumn("node", node)
    return E.first_loss(e, "user_id", "event_id", "node", F.col("event_type") == "error")


@R.add(f"SELECT coalesce(f.n, CASE WHEN seen THEN 'arrived' ELSE 'never_seen' END) AS node, count(*) AS n FROM (SELECT c_custkey AS user_id, c_custkey IN (SELECT user_id FROM events) AS seen FROM customer WHERE c_acctbal > 0) LEFT JOIN ({LOST_SQL}) USING (user_id) GROUP BY 1")
def loss_attribution(spark, d):
    e = table(spark, d, "events")
    node = F.element_at(F.array(*map(F.lit, NODES)), (F.col("event_id") % 5 + 1).cast("int"))
    lost = E.first_loss(e.withColumn("node", node), "user_id", "event_id", "node", F.col("event_type") == "error")
    seen = e.select("user_id").distinct().withColumn("hit", F.lit(True))
    gold = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id")).join(seen, "user_id", "left").select("user_id", F.coalesce("hit", F.lit(False)).alias("seen"))
    return E.loss_attribution(gold, lost, "user_id")


@R.add("WITH x AS (SELECT o_orderpriority AS grp, 'status' AS field, o_orderstatus AS want, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'X' ELSE ' ' || lower(o_orderstatus) END AS got FROM orders UNION ALL SELECT o_orderpriority, 'year', CAST(year(o_orderdate) AS VARCHAR), CASE WHEN o_orderkey % 3 = 0 THEN '1990' ELSE CAST(year(o_orderdate) AS VARCHAR) END FROM orders) SELECT grp, field, count(*) AS expected, count(got) AS found, count(*) FILTER (lower(trim(got)) = lower(want)) AS \"right\", round(count(*) FILTER (lower(trim(got)) = lower(want)) / count(*), 4) AS rate FROM x GROUP BY ALL")
def field_match(spark, d):
    o, k, year = table(spark, d, "orders"), F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    got = F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 5 == 0, "X").otherwise(F.concat(F.lit(" "), F.lower("o_orderstatus")))
    m = o.select(F.col("o_orderpriority").alias("grp"), F.create_map(F.lit("status"), "o_orderstatus", F.lit("year"), year).alias("e"), F.create_map(F.lit("status"), got, F.lit("year"), F.when(k % 3 == 0, "1990").otherwise(year)).alias("f"))
    return E.field_match(m, "e", "f", ["grp"])


PAIRS = [("PROFILE_RELEVANCE", "SUPPORTS"), ("PROFILE_RELEVANCE", "CONTRADICTS"), ("RISK", "SUPPORTS"), ("IS_JOB", "SUPPORTS")]
MATRIX_SQL = ", ".join(f"count(*) FILTER (claim = '{c}' AND polarity = '{p}') AS {c.lower()}_{p.lower()}_n, round(coalesce(max(m) FILTER (claim = '{c}' AND polarity = '{p}'), 0), 6) AS {c.lower()}_{p.lower()}_max, round(coalesce(sum(m) FILTER (claim = '{c}' AND polarity = '{p}'), 0), 6) AS {c.lower()}_{p.lower()}_sum" for c, p in PAIRS)


@R.add(f"{ATOMS_CTE}, o AS (SELECT item, claim, polarity, independence_key, max(strength * reliability) AS m FROM atoms GROUP BY ALL) SELECT item, {MATRIX_SQL} FROM o GROUP BY item")
def evidence_features(spark, d):
    return E.feature_matrix(_atoms(spark, d), "item", PAIRS)


@R.add("SELECT user_id, count(*) AS calls, sum(tokens)::BIGINT AS tokens, round(sum(tokens * price / 1000000), 8) AS cost, bool_and(price IS NOT NULL) AS complete FROM (SELECT user_id, event_type AS model, CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 AS tokens FROM events) LEFT JOIN (VALUES ('view', 0.5::DOUBLE), ('click', 2.0::DOUBLE), ('purchase', 4.0::DOUBLE), ('signup', 1.0::DOUBLE)) p(model, price) USING (model) GROUP BY user_id")
def usage_ledger(spark, d):
    calls = table(spark, d, "events").select("user_id", F.col("event_type").alias("model"), (F.get_json_object("props", "$.k").cast("long") * 100).alias("tokens"))
    prices = spark.createDataFrame([("view", 0.5), ("click", 2.0), ("purchase", 4.0), ("signup", 1.0)], "model string, price double")
    return E.usage_ledger(calls, prices, "user_id")


@R.add(f"SELECT lang, n, positive, share, array_to_string(list_filter([CASE WHEN n < 100 THEN 'rows' END, CASE WHEN positive < 20 THEN 'positives' END, CASE WHEN share NOT BETWEEN 0.02 AND 0.8 THEN 'share' END], lambda x: x IS NOT NULL), ',') AS missed FROM (SELECT lang, count(*) AS n, sum(gold)::BIGINT AS positive, round(avg(gold), 6) AS share FROM ({SCORED_SQL}) GROUP BY lang)")
def dataset_balance(spark, d):
    return E.balance(_scored(spark, d), ["lang"], "gold", 100, 20, 0.02, 0.8)


COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CORR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :])


@R.add(CORR_SQL)
def correlation_pairs(spark, d):
    return E.correlations(table(spark, d, "lineitem"), COLUMNS)


@R.add("SELECT round(corr((l_returnflag = 'R')::INTEGER::DOUBLE, l_extendedprice), 6) AS returned_price, round(corr((l_linestatus = 'O')::INTEGER::DOUBLE, l_quantity), 6) AS open_quantity FROM lineitem")
def point_biserial(spark, d):
    t = table(spark, d, "lineitem").withColumns({"returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O"})
    return t.agg(E.point_biserial(t, "returned", "l_extendedprice").alias("returned_price"), E.point_biserial(t, "open", "l_quantity").alias("open_quantity"))


@R.add("SELECT 1 AS grp, unnest(['l_extendedprice', 'net']) AS name WHERE (SELECT corr(l_extendedprice, l_extendedprice * (1 - l_discount)) FROM lineitem) >= 0.9")
def redundancy_groups(spark, d):
    t = table(spark, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    groups = E.redundancy_groups(E.correlations(t, [*COLUMNS, "net"]), 0.9)
    return spark.createDataFrame([(i + 1, n) for i, g in enumerate(groups) for n in g], "grp int, name string")


@R.add("""WITH p AS (SELECT doc_id, (quality = 1)::INTEGER::DOUBLE * (doc_id % 4 > 0)::INTEGER - quality * 0.5::DOUBLE AS delta FROM labels), h AS (SELECT delta, round, ('0x' || substr(sha256(concat_ws(':', doc_id, round)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM p, range(1000) r(round)),
w AS (SELECT delta, round, CASE WHEN u < 0.36787944 THEN 0 WHEN u < 0.73575888 THEN 1 WHEN u < 0.9196986 THEN 2 WHEN u < 0.98101184 THEN 3 WHEN u < 0.99634015 THEN 4 ELSE 5 END AS k FROM h), m AS (SELECT round, sum(k * delta) / sum(k) AS m FROM w GROUP BY round)
SELECT (SELECT count(*) FROM p) AS n, (SELECT round(avg(delta), 6) FROM p) AS delta, round(list_sort(list(m))[26], 6) AS low, round(list_sort(list(m))[975], 6) AS high FROM m""")
def paired_bootstrap(spark, d):
    q, k = F.col("quality"), F.col("doc_id") % 4 > 0
    p = table(spark, d, "labels").select("doc_id", (q * 0.5).alias("before"), F.when((q == 1) & k, 1.0).otherwise(0.0).alias("after"))
    return E.paired_bootstrap(p, "doc_id", "before", "after")


SIDE_SQL = "SELECT count(*) FILTER (gold = 1 AND {0} = 'accept') AS tp, count(*) FILTER (gold = 0 AND {0} = 'accept') AS fp, count(*) FILTER (gold = 1 AND {0} <> 'accept') AS fn FROM r"


@R.add(f"""WITH r AS ({RUNS_SQL}), b AS (SELECT tp / (tp + fn) AS recall, tp / (tp + fp) AS prec FROM ({SIDE_SQL.format('before')})), c AS (SELECT tp / (tp + fn) AS recall, tp / (tp + fp) AS prec FROM ({SIDE_SQL.format('after')})),
x AS (SELECT unnest([{{'check': 'recall_improves', 'ok': c.recall > b.recall}}, {{'check': 'precision_holds', 'ok': c.prec >= b.prec}}, {{'check': 'no_regressions', 'ok': (SELECT count(*) FROM r WHERE (gold = 1 AND before = 'accept' AND after <> 'accept') OR (gold = 0 AND before <> 'accept' AND after = 'accept')) = 0}}]) AS k FROM b, c)
SELECT k.check AS "check", k.ok, CASE WHEN (SELECT bool_and(k.ok) FROM x) THEN 'pass' ELSE 'inconclusive' END AS status FROM x""")
def promotion_gates(spark, d):
    r = _runs(spark, d)

    def side(c: str):
        n = r.agg(F.count_if((F.col("gold") == 1) & (F.col(c) == "accept")).alias("tp"), F.count_if((F.col("gold") == 0) & (F.col(c) == "accept")).alias("fp"), F.count_if((F.col("gold") == 1) & (F.col(c) != "accept")).alias("fn"))
        return n.select((F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))

    worse = r.where("(gold = 1 AND before = 'accept' AND after <> 'accept') OR (gold = 0 AND before <> 'accept' AND after = 'accept')")
    return E.promotion(side("before"), side("after"), worse)


@R.add()
def calibration(spark, d):
    """Weights of a logistic fit of the labels; held against a plain descent in the tests."""
    s = _scored(spark, d).select(F.round("score", 1).alias("score"), (F.col("lang") == "en").cast("double").alias("english"), "gold")
    w = E.logistic_fit(s, ["score", "english"], "gold")
    return spark.createDataFrame([(n, round(x, 6)) for n, x in zip(["intercept", "score", "english"], w)], "name string, weight double")


@R.add("SELECT id, v AS violation FROM (SELECT event_id AS id, unnest(list_filter([CASE WHEN a AND event_id % 50 = 0 THEN 'accepted_hard_constraint' END, CASE WHEN a AND event_id % 70 = 0 THEN 'accepted_high_risk' END, CASE WHEN event_id % 90 = 0 THEN 'overlapping_output_lanes' END, CASE WHEN event_id % 110 = 0 THEN 'incomplete_terminal_drop' END, CASE WHEN event_id % 130 = 0 THEN 'changed_content_skipped' END, CASE WHEN event_id % 170 = 0 THEN 'retryable_failure_duplicate' END, CASE WHEN event_id % 190 = 0 THEN 'one_to_many_candidate_loss' END, CASE WHEN event_id % 230 = 0 THEN 'synthetic_input_only_improvement' END, CASE WHEN NOT a AND event_id % 29 = 0 THEN 'reranker_silent_reject' END, CASE WHEN event_id % 31 = 0 AND event_id % 2 = 0 THEN 'unexplained_source_coverage_regression' END], lambda x: x IS NOT NULL)) AS v FROM (SELECT *, event_type = 'purchase' AS a FROM events))")
def release_violations(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select(
        i.alias("id"), F.when(F.col("event_type") == "purchase", "accept").otherwise("reject").alias("decision"), (i % 50 == 0).alias("hard_constraint"), F.when(i % 70 == 0, "high").otherwise("low").alias("risk_level"), F.when(i % 90 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("a"))).alias("lanes"),
        (i % 55 == 0).alias("terminal_drop"), F.array(F.lit("stage"), F.when(i % 110 == 0, "").otherwise("reason")).alias("drop_fields"), (i % 130 == 0).alias("changed_content_skipped"), (i % 170 == 0).alias("retryable_failure_duplicate"), (i % 190 == 0).alias("candidate_loss"), (i % 230 == 0).alias("synthetic_only"),
        (i % 29 == 0).alias("reranker_unavailable"), (i % 31 == 0).alias("coverage_regression"), F.when(i % 2 == 1, "known outage").alias("explanation"),
    )
    return E.violations(e)


# --- ontology ------------------------------------------------------------------------------------------

TERM_SQL = "SELECT p_partkey % 3 AS k, CASE p_partkey % 3 WHEN 0 THEN 'role' WHEN 1 THEN 'skill' ELSE 'keyword' END AS kind, lower(regexp_extract(p_type, '^(\\S+ ?\\S*)', 1)) AS canonical, CASE WHEN p_size % 4 = 0 THEN 'negative' WHEN p_size % 4 = 1 THEN 'neutral' ELSE 'positive' END AS polarity, p_size % 5 > 0 AND p_size % 7 > 0 AS accepted, p_size % 7 > 0 AS shown, (p_size % 10 + 1) / 10.0::DOUBLE AS weight, p_size AS support, p_partkey % 9 AS contrast, (p_size % 5 + 5) / 10.0::DOUBLE AS confidence FROM part".replace("\\\\", "\\")


def _terms(spark, d):
    p, k, s = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    return p.select(
        F.when(k % 3 == 0, "role").when(k % 3 == 1, "skill").otherwise("keyword").alias("kind"), F.concat(F.lit(" "), F.upper(F.regexp_extract("p_type", r"^(\S+ ?\S*)", 1)), F.lit("! ")).alias("canonical"), F.when(s % 4 == 0, "negative").when(s % 4 == 1, "neutral").otherwise("positive").alias("polarity"),
        (s % 5 > 0).alias("accepted"), F.when(s % 7 > 0, F.array(F.lit("shot"))).otherwise(F.array().cast("array<string>")).alias("evidence"), ((s % 10 + 1) / 10).alias("weight"), ((s % 5 + 5) / 10).alias("confidence"), s.cast("long").alias("support"), (k % 9).alias("contrast"),
    )


@R.add(f"SELECT kind, canonical, polarity, accepted, weight FROM (SELECT *, row_number() OVER (PARTITION BY kind, canonical ORDER BY accepted DESC, shown DESC, weight DESC, polarity DESC) AS n FROM ({TERM_SQL})) WHERE n = 1")
def ontology_dedupe(spark, d):
    return O.dedupe_terms(_terms(spark, d)).select("kind", "canonical", "polarity", "accepted", "weight")


@R.add(f"""SELECT kind, canonical, polarity, CASE WHEN polarity = 'positive' THEN support ELSE 0 END AS positive_count, CASE WHEN polarity = 'negative' THEN support ELSE 0 END AS negative_count, CASE WHEN polarity = 'neutral' THEN support ELSE 0 END AS contextual_count, CASE WHEN polarity = 'positive' THEN s ELSE 0 END AS positive_weight, CASE WHEN polarity = 'negative' THEN s ELSE 0 END AS negative_weight, CASE WHEN polarity = 'neutral' THEN s ELSE 0 END AS contextual_weight, support - contrast AS keyness, s AS score, CASE WHEN accepted THEN greatest(1, least(5, round_even(weight * 5, 0)::INTEGER)) END AS keyword_weight FROM (SELECT kind, canonical, polarity, max(accepted) AS accepted, max(weight) AS weight, sum(support)::BIGINT AS support, sum(contrast)::BIGINT AS contrast, round(max(weight) * max(confidence), 4) AS s FROM ({TERM_SQL}) GROUP BY ALL)""")
def ontology_statistics(spark, d):
    t = _terms(spark, d).withColumn("canonical", O.normal_term(F.col("canonical"))).withColumn("accepted", F.col("accepted") & (F.size("evidence") > 0))
    g = t.groupBy("kind", "canonical", "polarity").agg(F.max("accepted").alias("accepted"), F.max("weight").alias("weight"), F.sum("support").alias("support"), F.sum("contrast").alias("contrast"), F.max("confidence").alias("confidence"))
    return O.term_statistics(g)


@R.add("WITH a AS (SELECT DISTINCT lower(p_type) AS t, list_distinct(string_split(lower(p_type), ' ')) AS w FROM part WHERE p_size > 25), c AS (SELECT DISTINCT lower(regexp_extract(p_type, '(\\S+ ?\\S*)$', 1)) AS term FROM part UNION SELECT DISTINCT lower(regexp_extract(p_type, '^(\\S+)', 1)) FROM part) SELECT term FROM c WHERE NOT contains(term, ' ') OR EXISTS (SELECT 1 FROM a WHERE list_has_all(a.w, string_split(c.term, ' ')) AND len(a.w) > len(list_distinct(string_split(c.term, ' '))))".replace("\\\\", "\\"))
def broader_terms(spark, d):
    p = table(spark, d, "part")
    c = p.select(F.lower(F.regexp_extract("p_type", r"(\S+ ?\S*)$", 1)).alias("term")).union(p.select(F.lower(F.regexp_extract("p_type", r"^(\S+)", 1)))).distinct()
    return O.broader_terms(c, p.where("p_size > 25").select(F.col("p_type").alias("term")).distinct())


@R.add("WITH r AS (SELECT lower(p_brand) AS s, lower(p_type) AS o, max(p_size / 50.0::DOUBLE) AS confidence FROM part GROUP BY ALL), t AS (SELECT DISTINCT 'brand' AS kind, lower(p_brand) AS c FROM part UNION SELECT 'term', lower(p_type) FROM part), n AS (SELECT substr(sha256(kind || '|' || c), 1, 16) AS id, kind, c FROM t) SELECT substr(sha256(concat_ws('|', a.id, 'makes', b.id)), 1, 16) AS edge_id, a.id AS from_id, 'makes' AS predicate, b.id AS to_id, round(confidence, 4) AS confidence FROM r JOIN n a ON a.c = r.s JOIN n b ON b.c = replace(r.o, '#', '#')".replace("lower(p_brand)", "trim(regexp_replace(lower(p_brand), '[^a-z0-9+#]+', ' ', 'g'))").replace("lower(p_type)", "trim(regexp_replace(lower(p_type), '[^a-z0-9+#]+', ' ', 'g'))"))
def ontology_graph(spark, d):
    p = table(spark, d, "part")
    rel = O.dedupe_relations(p.select(F.col("p_brand").alias("subject"), F.lit("makes").alias("predicate"), F.col("p_type").alias("object"), (F.col("p_size") / 50).alias("confidence")))
    terms = p.select(F.lit("brand").alias("kind"), O.normal_term(F.col("p_brand")).alias("canonical")).distinct()
    return O.graph(terms, rel)[1].withColumn("confidence", F.round("confidence", 4))


@R.add("WITH b AS (SELECT user_id, event_type AS k, CAST(count(*) AS VARCHAR) AS v FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL), a AS (SELECT user_id, event_type AS k, CAST(count(*) AS VARCHAR) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL) SELECT coalesce(a.user_id, b.user_id) AS user_id, '/counts/' || coalesce(a.k, b.k) AS path, b.v AS before, a.v AS after FROM a FULL JOIN b ON a.user_id = b.user_id AND a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def snapshot_json_diff(spark, d):
    """Two versions of a JSON object for each user, compared leaf by leaf."""
    e = table(spark, d, "events")

    def version(where: str):
        counts = e.where(where).groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counts"))
        return O.json_leaves(counts.select("user_id", F.to_json(F.struct("counts")).alias("j")), "user_id", "j").select(F.struct("user_id", "path").alias("path"), "value")

    diff = O.snapshot_diff(version("ts < TIMESTAMP '2024-01-16'"), version("ts >= TIMESTAMP '2024-01-16'"))
    return diff.select("path.user_id", "path.path", "before", "after")


@R.add("SELECT p_partkey AS item, array_to_string(list_sort(list_filter(list_distinct(string_split(lower(p_type), ' ')), lambda t: t IN ('small', 'promo', 'large'))), ',') AS matched FROM part WHERE p_size % 2 = 0")
def ontology_affected(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.when(F.col("p_size") % 2 == 0, "v1").otherwise("v2").alias("version"), F.split("p_type", " ").alias("terms"))
    changes = spark.createDataFrame([("Small", "promo"), (None, "LARGE"), ('{"a":1}', "[2]")], "before string, after string")
    return O.affected_items(items, changes, "v1").select("item", F.array_join("matched", ",").alias("matched"))


@R.add("SELECT doc_id, kind, term, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}+#]+') AS w FROM documents)) JOIN (VALUES ('the', 'word'), ('of the', 'phrase'), ('und', 'word'), ('de la', 'phrase')) v(term, kind) USING (term) GROUP BY ALL".replace("\\\\", "\\"))
def ontology_enrichment(spark, d):
    words = spark.createDataFrame([("The", "word"), ("of  the!", "phrase"), ("und", "word"), ("de la", "phrase")], "term string, kind string")
    return O.enrich(table(spark, d, "documents"), "doc_id", "text", words)


@R.add("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'target' WHEN o_orderpriority = '3-MEDIUM' THEN 'adjacent' ELSE 'unknown' END AS role FROM orders")
def enum_coercion(spark, d):
    aliases = {"1_urgent": "target", "2_high": "target", "3_medium": "adjacent"}
    return table(spark, d, "orders").select("o_orderkey", O.coerce(F.concat(F.lit(" "), F.lower("o_orderpriority")), aliases, "unknown").alias("role"))


QUERIES, ORACLE = R.queries, R.oracle
