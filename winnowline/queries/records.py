"""Record queries: cleaning, reasons, deduplication, change capture, pages, normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnowline.functions import segments, unicode
from winnowline.functions import text as T
from winnowline.functions import urls as U
from winnowline.operators import dedup as D
from winnowline.operators.ranges import ranked
from winnowline.plans.conditions import apply_gates
from winnowline.queries import Registry, table

R = Registry()

CLEAN_SQL = r"""array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce(text,''), '[\x00-\x08\x0B-\x1F\x7F]', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), chr(10))"""
GARBAGE_SQL = r"""CASE WHEN length(text) < 30 THEN 'too_short' WHEN contains(text, '!!') THEN 'shouting' WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'symbol_noise' WHEN NOT contains(text, ' ') THEN 'no_words' END"""
RISKS_SQL = r"""list_sort(list_filter([CASE WHEN regexp_matches(text, '[A-Z]{6,}') THEN 'caps' END, CASE WHEN regexp_matches(text, '[$€]') THEN 'money' END, CASE WHEN regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]+') THEN 'mail' END, CASE WHEN regexp_matches(text, '[#%&*]{3}') THEN 'noise' END], lambda x: x IS NOT NULL))"""
QUALITY_SQL = rf"""round(least(1.0::DOUBLE, (CASE WHEN length(text) >= 200 THEN 0.2 ELSE 0 END)::DOUBLE + (CASE WHEN contains(text, chr(10)) THEN 0.2 ELSE 0 END)::DOUBLE + (CASE WHEN NOT contains(text, '!!') THEN 0.15 ELSE 0 END)::DOUBLE + (CASE WHEN length(text) >= 1000 THEN 0.15 ELSE 0 END)::DOUBLE + (CASE WHEN lang IS NOT NULL THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN source IS NOT NULL THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN regexp_matches(text, '\.$') THEN 0.05 ELSE 0 END)::DOUBLE - least(0.2::DOUBLE, len({RISKS_SQL}) * 0.05::DOUBLE)), 4)"""


@R.add(rf"SELECT doc_id, CASE WHEN length(c) <= 20000 THEN c WHEN contains(c[1:20000], ' ') THEN regexp_replace(c[1:20000], ' [^ ]*$', '') ELSE c[1:20000] END AS clean FROM (SELECT doc_id, {CLEAN_SQL} AS c FROM documents)")
def sanitize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sanitize(F.col("text")).alias("clean"))


@R.add("SELECT doc_id, sha256(concat_ws('|', lower(trim(source)), lower(trim(CAST(doc_id AS VARCHAR))))) AS stable_id FROM documents")
def stable_id_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.stable_id(F.col("source"), F.col("doc_id")).alias("stable_id"))


@R.add(r"SELECT doc_id, CASE WHEN l > 0 THEN round((l - a) / l, 6) ELSE 0.0 END AS ratio FROM (SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g'))::DOUBLE AS l, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::DOUBLE AS a FROM documents)")
def language_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", T.foreign_ratio(F.col("text")).alias("ratio"))


@R.add(f"SELECT doc_id, {GARBAGE_SQL} AS reason FROM documents")
def garbage_reason(spark, d):
    return table(spark, d, "documents").select("doc_id", T.garbage_reason(F.col("text")).alias("reason"))


STOP = {"de": " (?:und|der|die|das|in) ", "en": " (?:the|and|of|to|in) ", "es": " (?:el|la|de|que|y) ", "fr": " (?:le|la|les|et|des) "}
HITS_SQL = ", ".join(f"len(regexp_extract_all(lower(text), '{p}')) AS {k}" for k, p in STOP.items())


@R.add(f"SELECT doc_id, CASE WHEN greatest(de, en, es, fr) = 0 THEN 'und' WHEN en >= greatest(de, es, fr) THEN 'en' WHEN de >= greatest(es, fr) THEN 'de' WHEN fr >= es THEN 'fr' ELSE 'es' END AS lang_guess FROM (SELECT doc_id, {HITS_SQL} FROM documents)")
def language_detect(spark, d):
    hits = {k: F.regexp_count(F.lower("text"), F.lit(p)) for k, p in STOP.items()}
    t = table(spark, d, "documents").select("doc_id", *[v.alias(k) for k, v in hits.items()])
    top = F.when(F.greatest("de", "en", "es", "fr") == 0, "und").when(F.col("en") >= F.greatest("de", "es", "fr"), "en").when(F.col("de") >= F.greatest("es", "fr"), "de").when(F.col("fr") >= F.col("es"), "fr").otherwise("es")
    return t.select("doc_id", top.alias("lang_guess"))


@R.add(f"SELECT doc_id, risks, least(1.0, round(len(risks) * 0.2, 4))::DOUBLE AS score, CASE WHEN len(risks) * 0.2 >= 0.75 THEN 'high' WHEN len(risks) * 0.2 >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM (SELECT doc_id, {RISKS_SQL} AS risks FROM documents)".replace("SELECT doc_id, risks,", "SELECT doc_id, array_to_string(risks, ',') AS risks,"))
def risk_score(spark, d):
    r = table(spark, d, "documents").select("doc_id", T.risks(F.col("text")).alias("r"))
    s = T.risk_score(F.col("r"))
    return r.select("doc_id", F.array_join("r", ",").alias("risks"), s.alias("score"), T.risk_level(s).alias("level"))


@R.add(f"SELECT doc_id, {QUALITY_SQL} AS quality FROM documents")
def quality_score(spark, d):
    return table(spark, d, "documents").select("doc_id", T.quality(F.col("text"), F.col("lang"), F.col("source"), T.risks(F.col("text"))).alias("quality"))


@R.add("SELECT doc_id, round((CASE WHEN contains(text, chr(10)) THEN 0.25 ELSE 0 END)::DOUBLE + (CASE WHEN length(text) >= 100 THEN 0.30 ELSE 0 END)::DOUBLE + (CASE WHEN source IS NOT NULL THEN 0.15 ELSE 0 END)::DOUBLE + (CASE WHEN contains(text, '://') THEN 0.10 ELSE 0 END)::DOUBLE + (CASE WHEN lang IS NOT NULL THEN 0.10 ELSE 0 END)::DOUBLE + (CASE WHEN contains(text, '$') THEN 0.10 ELSE 0 END)::DOUBLE, 4) AS completeness FROM documents")
def completeness_score(spark, d):
    flag = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    t = F.col("text")
    s = flag(F.contains(t, F.lit("\n")), 0.25) + flag(F.length(t) >= 100, 0.3) + flag(F.col("source").isNotNull(), 0.15) + flag(F.contains(t, F.lit("://")), 0.1) + flag(F.col("lang").isNotNull(), 0.1) + flag(F.contains(t, F.lit("$")), 0.1)
    return table(spark, d, "documents").select("doc_id", F.round(s, 4).alias("completeness"))


GATES = [{"name": "garbage", "keep": {"field": "garbage", "exists": False}}, {"name": "language", "keep": {"field": "lang", "in": ["en", "de", "fr"]}}, {"name": "quality", "keep": {"field": "quality", "ge": 0.6}}, {"name": "long", "keep": {"field": "n_chars", "lt": 4000}, "shadow": True}]
GATED_SQL = f"SELECT doc_id, source, lang, n_chars, {GARBAGE_SQL} AS garbage, {QUALITY_SQL} AS quality FROM documents"
LANE_SQL = f"SELECT doc_id, source, CASE WHEN garbage IS NOT NULL THEN 'garbage' WHEN lang NOT IN ('en', 'de', 'fr') THEN 'language' WHEN quality < 0.6 THEN 'quality' ELSE 'pass' END AS lane, coalesce(n_chars >= 4000, false) AS shadowed FROM ({GATED_SQL})"


def gated_columns(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", "source", "lang", "n_chars", T.garbage_reason(F.col("text")).alias("garbage"), T.quality(F.col("text"), F.col("lang"), F.col("source"), T.risks(F.col("text"))).alias("quality"))


def _gated(spark, d):
    return apply_gates(gated_columns(spark, d), GATES)


@R.add(f"SELECT source, lane, count(*) AS n, count(*) FILTER (shadowed) AS shadow_n FROM ({LANE_SQL}) GROUP BY ALL")
def funnel_by_source(spark, d):
    return _gated(spark, d).groupBy("source", "lane").agg(F.count("*").alias("n"), F.count_if(F.exists("drops", lambda x: x["shadow"])).alias("shadow_n"))


@R.add(f"SELECT doc_id, lane, CAST(shadowed AS BOOLEAN) AS shadowed FROM ({LANE_SQL})")
def lane_routing(spark, d):
    return _gated(spark, d).select("doc_id", "lane", F.exists("drops", lambda x: x["shadow"]).alias("shadowed"))


@R.add("SELECT doc_id, quality, CASE WHEN (quality = 1 AND toxic = 0) THEN 'true' WHEN NOT (quality = 1 AND toxic = 0) THEN 'false' ELSE 'unknown' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)")
def condition_dsl(spark, d):
    from winnowline.plans.conditions import compile_condition

    t = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    c = compile_condition({"all": [{"field": "quality", "eq": 1}, {"field": "toxic", "eq": 0}]}, t.columns)
    return t.select("doc_id", "quality", F.when(c, "true").when(~c, "false").otherwise("unknown").alias("verdict"))


FIRST_SQL = "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(lower(text))) AS first_id FROM documents"


@R.add(f"SELECT doc_id FROM ({FIRST_SQL}) WHERE doc_id = first_id")
def exact_dedup_keep_first(spark, d):
    m = D.mark_duplicates(table(spark, d, "documents").select("doc_id", "text"), F.sha2(F.lower("text"), 256), ["doc_id"], "doc_id")
    return m.where("NOT is_duplicate").select("doc_id")


@R.add(f"SELECT doc_id, first_id FROM ({FIRST_SQL}) WHERE doc_id <> first_id")
def duplicate_report(spark, d):
    m = D.mark_duplicates(table(spark, d, "documents").select("doc_id", "text"), F.sha2(F.lower("text"), 256), ["doc_id"], "doc_id")
    return m.where("is_duplicate").select("doc_id", "first_id")


@R.add("SELECT user_id, event_type, first_seen, observations, row_number() OVER (PARTITION BY user_id ORDER BY first_seen, event_type)::INTEGER AS version FROM (SELECT user_id, event_type, min(ts) AS first_seen, count(*) AS observations FROM events GROUP BY ALL)")
def content_versions(spark, d):
    return D.content_versions(table(spark, d, "events"), ["user_id"], "event_type", "ts")


DAY_SQL = "SELECT user_id, sha256(string_agg(event_type, ',' ORDER BY event_id)) AS h FROM events WHERE CAST(ts AS DATE) = DATE '{}' GROUP BY user_id"


@R.add(f"SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'NEW' WHEN b.user_id IS NULL THEN 'GONE' WHEN a.h = b.h THEN 'UNCHANGED' ELSE 'CHANGED' END AS state FROM ({DAY_SQL.format('2024-01-02')}) a FULL JOIN ({DAY_SQL.format('2024-01-03')}) b ON a.user_id = b.user_id")
def snapshot_diff_cdc(spark, d):
    e = table(spark, d, "events")
    day = lambda s: e.where(F.to_date("ts") == s).groupBy("user_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), ","), 256).alias("h"))
    return D.snapshot_changes(day("2024-01-02"), day("2024-01-03"), ["user_id"], "h")


@R.add("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def processed_antijoin(spark, d):
    history = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return D.unseen(table(spark, d, "orders").select("o_orderkey", "o_custkey"), history, "o_orderkey")


@R.add("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'error' AND user_id = o_custkey AND ts + INTERVAL 5 DAY > TIMESTAMP '2024-01-20') AND o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def cooldown_claim(spark, d):
    h = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("o_custkey"), (F.col("ts") + F.expr("INTERVAL 5 DAY")).alias("until"))
    open_ = D.unseen(table(spark, d, "orders").where("o_orderstatus = 'O'"), h, "o_custkey", ("until", F.lit("2024-01-20").cast("timestamp")))
    return open_.orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey")  # a claim takes a batch


@R.add("SELECT doc_id, ordinal, segment FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS segment, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM documents) WHERE trim(segment) <> ''")
def segment_explode(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "segment"))
    return s.where(F.trim("segment") != "").select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "segment")


@R.add(r"""WITH d AS (SELECT doc_id, replace(text, '. ', chr(10) || '- ') AS t FROM documents), c AS (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(t, '\n[ \t]*([0-9]+[.)][ \t]|[-*•][ \t])', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS p FROM d),
s AS (SELECT doc_id, CASE WHEN len(list_filter(p, lambda x: regexp_matches(x, '(?i)(^|[^\p{L}\p{N}])(the|und|les|las)($|[^\p{L}\p{N}])'))) >= 2 THEN p ELSE [t] END AS p FROM c), e AS (SELECT doc_id, len(p) AS n, unnest(p) AS segment, generate_subscripts(p, 1) - 1 AS ordinal FROM s)
SELECT doc_id, ordinal::INTEGER AS ordinal, segment, CASE WHEN n > 1 THEN 'digest_boundary' ELSE 'whole_observation' END AS evidence, sha256(doc_id || '|' || ordinal || '|' || segment) AS segment_id FROM e""")
def digest_segments(spark, d):
    """Documents as digests, a bullet for each sentence: parts where two or more have a hint."""
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit("\n- ")).alias("text"))
    return segments.explode_segments(docs, "doc_id", "text", r"(?i)(^|[^\p{L}\p{N}])(the|und|les|las)($|[^\p{L}\p{N}])")


@R.add(rf"SELECT doc_id, CASE WHEN length(c) <= 20000 THEN c WHEN contains(c[1:20000], ' ') THEN regexp_replace(c[1:20000], ' [^ ]*$', '') ELSE c[1:20000] END AS clean FROM (SELECT doc_id, {CLEAN_SQL} AS c FROM (SELECT doc_id, nfc_normalize(replace(replace(text, chr(65279), ''), chr(8203), '')) AS text FROM documents))")
def sanitize_unicode(spark, d):
    """Sanitised normal forms; the documents have no compatibility characters, so NFC says the same. Those are tested."""
    return table(spark, d, "documents").select("doc_id", unicode.sanitize_unicode(F.col("text")).alias("clean"))


@R.add(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS n_links FROM pages".replace('\\"', '"'))
def html_title_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).cast("long").alias("n_links"))


@R.add("SELECT page_id, link FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS link FROM pages)")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1))).alias("link"))


@R.add(r"SELECT page_id, concat(lower(regexp_extract(b, '^([A-Za-z]+://[^/?]*)', 1)), regexp_replace(regexp_replace(b, '^[A-Za-z]+://[^/?]*', ''), '/+$', '')) AS url FROM (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS b FROM pages)")
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", U.normalize(F.col("url")).alias("url"))


@R.add("SELECT page_id FROM pages WHERE starts_with(url, 'http') AND NOT regexp_matches(url, '[13]$') AND (regexp_matches(url, '/p') OR regexp_matches(url, '[0-9]{2}'))")
def url_filter_chain(spark, d):
    return table(spark, d, "pages").where(U.passes(F.col("url"), include_any=["/p", "[0-9]{2}"], exclude=["[13]$"], prefix="http")).select("page_id")


RULES = [("^https:", 2), ("[0-9]+$", 3), ("/(?:page|p|a)", 5), (r"\?", -4), ("//[^/]*/[^/]*/", 1)]


@R.add("SELECT page_id, score, row_number() OVER (PARTITION BY host ORDER BY score DESC, url, page_id)::INTEGER AS rank FROM (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) AS host, " + " + ".join(f"(CASE WHEN regexp_matches(url, '{p}') THEN {w} ELSE 0 END)" for p, w in RULES) + " AS score FROM pages)")
def job_url_score(spark, d):
    t = table(spark, d, "pages").select("page_id", "url", U.host(F.col("url")).alias("host"), U.additive_score(F.col("url"), RULES).alias("score"))
    return ranked(t, [F.desc("score"), "url", "page_id"], ["host"]).select("page_id", "score", "rank")


@R.add("SELECT doc_id, 'Doc ' || doc_id AS title, source AS org, n_chars * 2 AS max_amount FROM documents")
def jsonld_extract(spark, d):
    page = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit("Posting").alias("@type"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.struct(F.col("source").alias("name")).alias("org"), F.struct((F.col("n_chars") * 2).alias("max")).alias("pay"))), F.lit("</script>"))
    t = table(spark, d, "documents").select("doc_id", page.alias("html"))
    island = F.regexp_extract("html", r'(?s)<script type="application/ld\+json">(.*?)</script>', 1)
    j = F.from_json(island, "title string, org struct<name:string>, pay struct<max:long>")
    return t.select("doc_id", j.alias("j")).select("doc_id", "j.title", F.col("j.org.name").alias("org"), F.col("j.pay.max").alias("max_amount"))


@R.add("SELECT p_partkey, coalesce(canonical, 'other') AS material FROM part LEFT JOIN (VALUES ('steel', 'metal'), ('copper', 'metal'), ('tin', 'metal'), ('brass', 'alloy'), ('nickel', 'metal')) a(alias, canonical) ON lower(regexp_extract(p_type, '([A-Za-z]+)$', 1)) = alias")
def alias_join_canonical(spark, d):
    a = spark.createDataFrame([("steel", "metal"), ("copper", "metal"), ("tin", "metal"), ("brass", "alloy"), ("nickel", "metal")], "alias string, canonical string")
    p = table(spark, d, "part").withColumn("alias", F.lower(F.regexp_extract("p_type", "([A-Za-z]+)$", 1)))
    return p.join(a, "alias", "left").select("p_partkey", F.coalesce("canonical", F.lit("other")).alias("material"))


GROUP_SQL = "SELECT *, CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 3 AS priority, sha256(lower(text)) AS g FROM documents"


@R.add(f"SELECT g, arg_min(source, struct_pack(a := priority, b := doc_id)) AS source, arg_min(lang, struct_pack(a := priority, b := doc_id)) AS lang, arg_max(text, struct_pack(a := length(text), b := -doc_id)) AS text, max(n_chars) AS n_chars, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS members FROM ({GROUP_SQL}) GROUP BY g")
def group_merge_priority(spark, d):
    t = table(spark, d, "documents").withColumn("priority", F.regexp_extract("source", "([0-9]+)", 1).cast("int") % 3).withColumn("g", F.sha2(F.lower("text"), 256)).withColumn("src", F.col("source"))
    m = D.merge_by_priority(t, "g", "priority", "doc_id", ["source", "lang"], "text", ["n_chars"], ["src"])
    return m.select("g", "source", "lang", "text", "n_chars", F.array_join("srcs", ",").alias("sources"), "members")


@R.add("SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id)::INTEGER AS turn FROM documents)")
def interleave_round_robin(spark, d):
    return D.interleave(table(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"]).select("doc_id", "source", "turn")


@R.add("SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_source(spark, d):
    return D.latest_per(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "ts")


@R.add("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS rank FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def latest_topk(spark, d):
    from pyspark.sql import Window as W

    top = table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(100)  # a top-k report
    return top.select("c_custkey", F.row_number().over(W.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("rank"))


QUERIES, ORACLE = R.queries, R.oracle
