"""Extraction and text-prefilter queries, and splits that keep related rows together."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnowline.operators import extraction as X
from winnowline.operators.identity import components
from winnowline.operators.prefilter import TextPrefilter
from winnowline.queries import Registry, table
from winnowline.sources.scratch import stored

R = Registry()


@R.add(r"""SELECT doc_id, nullif(trim(regexp_extract(text, '(?m)^([^\n]*\p{L}[^\n]*)$', 1))[1:120], '') AS title, CASE WHEN doc_id % 6 > 0 THEN source END AS company, CASE WHEN doc_id % 4 = 0 THEN lang WHEN doc_id % 4 = 1 THEN 'somewhere' END AS location, CASE WHEN length(trim(text)) < 30 THEN 'description_too_short' WHEN nullif(trim(regexp_extract(text, '(?m)^([^\n]*\p{L}[^\n]*)$', 1)), '') IS NULL AND doc_id % 6 = 0 THEN 'missing_core_fields' END AS drop_reason,
array_to_string(list_filter([CASE WHEN doc_id % 6 = 0 THEN 'missing_company' END, CASE WHEN doc_id % 4 > 1 THEN 'missing_location' END], lambda x: x IS NOT NULL), ',') AS review_reasons, CASE WHEN doc_id % 6 > 0 AND doc_id % 4 < 2 THEN 'complete' ELSE 'partial' END AS status FROM documents""")
def extraction_fallbacks(spark, d):
    i = F.col("doc_id")
    sources = {"title": [F.lit(" "), X.first_line(F.col("text"))], "company": [F.when(i % 6 > 0, F.col("source"))], "location": [F.when(i % 4 == 0, F.col("lang")), F.when(i % 4 == 1, "somewhere")]}
    x = X.extract(table(spark, d, "documents"), "text", sources, ("title", "company"), ("company", "location"))
    return x.select("doc_id", "title", "company", "location", "drop_reason", F.array_join("review_reasons", ",").alias("review_reasons"), "status")


SIGNAL_TEXT = "CASE user_id % 4 WHEN 0 THEN 'Senior or Lead, ' WHEN 1 THEN 'a senior, ' WHEN 2 THEN 'trainee ' ELSE '' END || CAST(json_extract_string(props, '$.k') AS BIGINT) || CASE WHEN event_id % 2 = 0 THEN '+ years' ELSE ' months' END || CASE WHEN event_id % 3 = 0 THEN ', Master''s or PhD' WHEN event_id % 3 = 1 THEN ', bachelor' ELSE '' END || CASE WHEN event_type = 'view' THEN ', no relocation, visa' WHEN event_type = 'click' THEN ', Relocation, no visa' ELSE '' END"


@R.add("SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'lead' WHEN 1 THEN 'senior' WHEN 2 THEN 'junior' END AS seniority, CASE WHEN event_id % 2 = 0 AND CAST(json_extract_string(props, '$.k') AS INTEGER) <= 50 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS years, CASE event_id % 3 WHEN 0 THEN 'doctorate' WHEN 1 THEN 'bachelor' END AS education, CASE event_type WHEN 'view' THEN false WHEN 'click' THEN true END AS relocation, CASE event_type WHEN 'view' THEN true WHEN 'click' THEN false END AS visa FROM events")
def text_signals(spark, d):
    """Signals read from sentences that are put together from each event."""
    i, kind = F.col("event_id"), F.col("event_type")
    head = F.when(F.col("user_id") % 4 == 0, "Senior or Lead, ").when(F.col("user_id") % 4 == 1, "a senior, ").when(F.col("user_id") % 4 == 2, "trainee ").otherwise("")
    text = F.concat(head, F.get_json_object("props", "$.k"), F.when(i % 2 == 0, "+ years").otherwise(" months"), F.when(i % 3 == 0, ", Master's or PhD").when(i % 3 == 1, ", bachelor").otherwise(""), F.when(kind == "view", ", no relocation, visa").when(kind == "click", ", Relocation, no visa").otherwise(""))
    return table(spark, d, "events").select("event_id", X.signals(text).alias("s")).select("event_id", "s.seniority", "s.years", "s.education", "s.relocation", "s.visa")


@R.add("SELECT doc_id, CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'scum') THEN 0.0 WHEN quality IS NOT NULL THEN quality * 0.8 ELSE least(1.0, round((contains(lower(text), 'the')::INTEGER + contains(lower(text), 'und')::INTEGER + contains(lower(text), 'tion')::INTEGER + contains(lower(text), '###')::INTEGER) / 3, 4)) END::DOUBLE AS relevance, CASE WHEN lang IN ('fr', 'es') AND (doc_id % 10) / 10 >= 0.8 THEN 'source_class:' || lang END AS reason FROM documents LEFT JOIN labels USING (doc_id)")
def keyword_relevance(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    score = X.relevance(F.col("text"), ("idiot", "scum"), ("the", "und", "tion", "###"), F.col("quality") * 0.8)
    return t.select("doc_id", score.alias("relevance"), X.classified_out(F.col("lang"), F.col("doc_id") % 10 / 10, ("fr", "es")).alias("reason"))


@R.add("SELECT p_partkey, CASE WHEN length(t) <= 40 THEN t ELSE regexp_replace(t[1:40], '\\s+\\S*$', '') END AS composed FROM (SELECT p_partkey, concat_ws('. ', 'title: ' || p_name, CASE WHEN p_partkey % 3 > 0 THEN 'company: ' || p_brand END, 'kind: ' || p_type) AS t FROM part)".replace("\\\\", "\\"))
def embedding_text(spark, d):
    parts = [("title", F.col("p_name")), ("company", F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).otherwise(" ")), ("kind", F.col("p_type"))]
    return table(spark, d, "part").select("p_partkey", X.embedding_text(parts, 40).alias("composed"))


@R.add(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents), g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
f AS (SELECT doc_id, term, 1 + ln(count(*)) AS tf FROM g GROUP BY ALL), v AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf, (length(term) % 7 - 3) / 2.0::DOUBLE AS coef FROM f GROUP BY term HAVING count(*) >= 2),
z AS (SELECT doc_id, sum(tf * idf * coef) / sqrt(sum((tf * idf) * (tf * idf))) AS z FROM f JOIN v USING (term) GROUP BY doc_id) SELECT doc_id, round(1 / (1 + exp(-(coalesce(z, 0) - 0.1))), 4) AS score, round(1 / (1 + exp(-(coalesce(z, 0) - 0.1))), 4) < 0.45 AS drop FROM documents LEFT JOIN z USING (doc_id)""")
def tfidf_logreg_score(spark, d):
    """One- and two-word grams with inverse frequencies over all documents; coefficients are a rule on the term."""
    docs = table(spark, d, "documents")
    blocks = X.TextBlocks(docs, "doc_id", "text")
    known = X.inverse_frequencies(blocks.terms(), docs.count()).withColumn("coef", (F.length("term") % 7 - 3) / 2)
    return X.linear_text_score(blocks.scores(known), "doc_id", -0.1, 0.45).select("doc_id", "score", "drop")


@R.add()
def prefilter_training(spark, d):
    """Held-out counts of a prefilter that is trained on four fifths of the labelled documents; tests hold its accuracy and weights."""
    docs = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    test = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = TextPrefilter(label="quality", least_retention=0.0).fit(docs.where(~test))
    scored = model.transform(docs.where(test))
    return scored.groupBy("quality").agg(F.count("*").alias("n"), F.count_if(~F.col("drop")).alias("kept"))


@R.add("""WITH RECURSIVE h AS (SELECT doc_id, doc_id // 4 AS author, sha256(lower(text)) AS h FROM documents), e AS (SELECT DISTINCT author AS a, min(author) OVER (PARTITION BY h) AS b FROM h), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(n, m) AS (SELECT a, a FROM s UNION SELECT r.n, s.b FROM r JOIN s ON r.m = s.a), c AS (SELECT n, min(m) AS label FROM r GROUP BY n), k AS (SELECT label, bool_or(doc_id % 97 = 0) AS locked FROM h JOIN c ON author = n GROUP BY label)
SELECT doc_id, CASE WHEN locked THEN 'regression' WHEN b < 60 THEN 'train' WHEN b < 80 THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, locked, ('0x' || substr(sha256(CAST(label AS VARCHAR)), 1, 8))::BIGINT % 100 AS b FROM h JOIN c ON author = n JOIN k USING (label))""")
def leakfree_split(spark, d):
    """Documents of one author, and authors with a text in common, stay on one side; a locked document locks its group."""
    t = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 4).alias("author"), F.sha2(F.lower("text"), 256).alias("h"))
    hub = t.groupBy("h").agg(F.min("author").alias("b"))
    edges = t.join(hub, "h").where("author <> b").select(F.col("author").alias("a"), "b").distinct()
    c = t.join(components(edges), F.col("author") == F.col("node"), "left").select("doc_id", F.coalesce("label", "author").alias("label"))
    k = c.groupBy("label").agg(F.bool_or(F.col("doc_id") % 97 == 0).alias("locked"))
    b = F.conv(F.substring(F.sha2(F.col("label").cast("string"), 256), 1, 8), 16, 10).cast("long") % 100
    return c.join(k, "label").select("doc_id", F.when(F.col("locked"), "regression").when(b < 60, "train").when(b < 80, "dev").otherwise("test").alias("split"))


QUERIES, ORACLE = R.queries, R.oracle
