"""Assessment queries: rules on records made of documents and pages, links, readers' votes, example stores, postings in pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnowline.functions import html as H
from winnowline.functions import link_score as L
from winnowline.functions import urls as U
from winnowline.operators import dedup as D
from winnowline.operators import examples as X
from winnowline.operators import feedback as V
from winnowline.operators import record_rules as P
from winnowline.operators import stats as A
from winnowline.queries import Registry, table

R = Registry()

RECORDS_SQL = r"""SELECT d.doc_id, trim(split_part(text, chr(10), 1)) AS title, source AS company, text AS description, url AS canonical_url, d.lang AS location,
CASE WHEN url LIKE 'https:%' THEN 'remote' WHEN url IS NOT NULL THEN 'onsite' END AS work_mode, nullif(regexp_extract(text, '[$€] ?[0-9]+'), '') AS compensation,
list_distinct(regexp_extract_all(text, '[A-Z]{2,}')) AS skills, CASE WHEN toxic = 1 THEN ['toxic'] ELSE []::VARCHAR[] END AS incoming
FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def _records(spark, d):
    """Documents as records: the first line as title, the source as company, the page of the same number as its link."""
    text, url = F.col("text"), F.col("url")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    t = docs.join(pages, "doc_id", "left").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    pay = F.regexp_extract(text, "[$€] ?[0-9]+", 0)
    return t.select(
        "doc_id",
        F.trim(F.substring_index(text, "\n", 1)).alias("title"),
        F.col("source").alias("company"),
        text.alias("description"),
        url.alias("canonical_url"),
        F.col("lang").alias("location"),
        F.when(url.startswith("https:"), "remote").when(url.isNotNull(), "onsite").alias("work_mode"),
        F.when(pay != "", pay).alias("compensation"),
        F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Z]{2,}"), 0)).alias("skills"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("risk_signals"),
        F.lit(None).cast("array<string>").alias("review_reasons"),
    )


RISK_SQL = f"""SELECT *, least(1.0, round(len(signals) * 0.2, 2))::DOUBLE AS risk_score FROM (SELECT *, list_sort(list_distinct(list_concat(incoming, list_filter([
CASE WHEN regexp_matches(low, 'idiot|scum|casino') THEN 'suspicious_domain' END, CASE WHEN contains(low, 'que') AND contains(low, 'des') AND canonical_url IS NULL THEN 'contact_only_apply_flow' END,
CASE WHEN length(description) < 80 THEN 'low_information_density' END], lambda x: x IS NOT NULL)))) AS signals FROM (SELECT *, lower(concat_ws(chr(10), nullif(title, ''), nullif(company, ''), nullif(description, ''))) AS low FROM ({RECORDS_SQL})))"""
LEVEL_SQL = "CASE WHEN risk_score >= 0.75 THEN 'high' WHEN risk_score >= 0.4 THEN 'medium' ELSE 'low' END"


def _risk(spark, d):
    return P.risk(_records(spark, d), ("idiot", "scum", "casino"), ("que", "des"))


@R.add(f"SELECT doc_id, array_to_string(signals, ',') AS signals, risk_score, {LEVEL_SQL} AS risk_level, CASE WHEN risk_score >= 0.45 THEN 'high_risk_signals' ELSE '' END AS reasons FROM ({RISK_SQL})")
def record_risk(spark, d):
    """Risk of records: given signals (the label) with those of their own texts."""
    return _risk(spark, d).select("doc_id", F.array_join("risk_signals", ",").alias("signals"), "risk_score", "risk_level", F.array_join("review_reasons", ",").alias("reasons"))


RECORD_QUALITY_SQL = f"""SELECT *, least(1.0::DOUBLE, round((CASE WHEN title <> '' THEN 20 ELSE 0 END + CASE WHEN company <> '' THEN 20 ELSE 0 END + CASE WHEN canonical_url IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN location <> '' THEN 10 ELSE 0 END
+ CASE WHEN work_mode <> 'unknown' THEN 10 ELSE 0 END + CASE WHEN compensation IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN length(description) >= 120 THEN 15 ELSE 5 END + CASE WHEN len(skills) > 0 THEN 5 ELSE 0 END - least(20, 5 * len(signals))) / 100.0::DOUBLE, 2)) AS quality_score FROM ({RISK_SQL})"""


@R.add(f"SELECT doc_id, quality_score, concat_ws(',', CASE WHEN risk_score >= 0.45 THEN 'high_risk_signals' END, CASE WHEN quality_score < 0.6 THEN 'low_quality_score' END) AS reasons FROM ({RECORD_QUALITY_SQL})")
def record_quality(spark, d):
    """Quality of records after their risk, with the review reasons of both in order."""
    return P.quality(_risk(spark, d)).select("doc_id", "quality_score", F.array_join("review_reasons", ",").alias("reasons"))


PAGE_RULES = [
    P.TextRule("generic page title", (("title", r"^(?:the|le|la|der|die|el)\b"),)),
    P.TextRule("navigation page", (("url", "/fr/|/es/"), ("path", r"\.html$|/[0-9]{2}$"))),
    P.TextRule("listing page", (("path", "[05]$"),)),
]
TEXT_RULES = [
    P.TextRule("service ad", (("head", r"\$\$\$|%%%|!!"),), (("scan", "responsib|require"),)),
    P.TextRule("project spec", (("head", r"(?:^|\n)idea:|\bles des\b"),)),
    P.TextRule("course ad", (("scan", "tion"), ("scan", "http|@"))),
    P.TextRule("short chatter", (("scan", r"^(?s:.{1,240})$"),), (("scan", r"\b(?:the|und)\b"),)),
]


@R.add(r"""SELECT doc_id, CASE WHEN career AND regexp_matches(title, '^(the|le|la|der|die|el)\b') THEN 'generic page title' WHEN career AND regexp_matches(link, '/fr/|/es/') AND regexp_matches(path, '\.html$|/[0-9]{2}$') THEN 'navigation page' WHEN career AND regexp_matches(path, '[05]$') THEN 'listing page'
WHEN regexp_matches(head, '\$\$\$|%%%|!!') AND NOT regexp_matches(scan, 'responsib|require') THEN 'service ad' WHEN regexp_matches(head, '(^|\n)idea:|\bles des\b') THEN 'project spec' WHEN contains(scan, 'tion') AND regexp_matches(scan, 'http|@') THEN 'course ad' WHEN length(scan) BETWEEN 1 AND 240 AND NOT regexp_matches(scan, '\b(the|und)\b') THEN 'short chatter' END AS reason
FROM (SELECT *, trim(split_part(low, chr(10), 1)) AS title, low[1:300] AS head, low[1:1500] AS scan, regexp_replace(split_part(link, '?', 1), '/+$', '') AS path FROM (SELECT d.doc_id, coalesce(url LIKE 'https:%', false) AS career, lower(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS low, lower(coalesce(url, '')) AS link FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id))""")
def garbage_evidence(spark, d):
    """The first garbage rule of each document; rules on pages hold for documents with a secure link."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url")
    t = table(spark, d, "documents").select("doc_id", "text").join(pages, "doc_id", "left")
    return t.select("doc_id", P.garbage_evidence(F.col("text"), F.col("url"), F.col("url").startswith("https:"), TEXT_RULES, PAGE_RULES).alias("reason"))


@R.add("""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[^ \\n]+') AS w FROM benchmark), raw AS (SELECT item_id, w[1] || ' ' || w[2] AS phrase, true AS positive FROM w UNION ALL SELECT item_id, w[3] || ' ' || w[4], false FROM w),
p AS (SELECT phrase, positive, min(item_id) AS place, list_distinct(list(item_id)) AS profiles FROM raw WHERE phrase <> '' GROUP BY ALL), hits AS (SELECT doc_id, phrase, positive, place, profiles FROM documents, p WHERE contains(lower(text), phrase)),
h AS (SELECT doc_id, list(phrase ORDER BY place, phrase) FILTER (positive) AS pos, list(phrase ORDER BY place, phrase) FILTER (NOT positive) AS neg, len(list_distinct(flatten(list(profiles)))) AS profiles FROM hits GROUP BY doc_id)
SELECT doc_id, array_to_string(coalesce(pos, []), ';') AS positive, array_to_string(coalesce(neg, []), ';') AS negative, coalesce(profiles, 0)::INTEGER AS profiles, (len(coalesce(pos, [])) - len(coalesce(neg, [])))::INTEGER AS lexical_score FROM documents LEFT JOIN h USING (doc_id)""".replace("\\\\", "\\"))
def profile_phrases(spark, d):
    """Phrases of profiles (the first words of each benchmark item) in all documents."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[^ \n]+"), 0)
    two = lambda k: F.concat_ws(" ", F.get("w", k), F.get("w", k + 1))
    b = table(spark, d, "benchmark").select("item_id", w.alias("w")).where("size(w) > 3")
    side = lambda k, s: b.select(F.col("item_id").alias("profile"), F.col("item_id").alias("place"), two(k).alias("phrase"), F.lit(s).alias("positive"))
    t = P.profile_phrases(table(spark, d, "documents"), "doc_id", F.col("text"), side(0, True).unionByName(side(2, False)))
    return t.select("doc_id", F.array_join("positive", ";").alias("positive"), F.array_join("negative", ";").alias("negative"), "profiles", "lexical_score")


LINK_WORDS = L.LinkWords(("fr", "the", "tion"), ("es", "blog", "search", "la"), ("spam", "/es/"), r"/(?:en|de)(?:/.*)?/[^/?#]*\d[^/?#]*$", ("ref",))
LINK_SQL = r"""WITH links AS (SELECT page_id, board, link, lower(trim(link)) AS low FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*') AS board, unnest(list_distinct(list_concat([url], list_transform(regexp_extract_all(html, '<a href="(/[^"]*)"', 1), lambda h: 'https://jobs.example.com' || h)))) AS link FROM pages)),
parts AS (SELECT *, regexp_extract(low, '//([^/:?#]*)', 1) AS host, regexp_extract(lower(board), '//([^/:?#]*)', 1) AS bhost, regexp_replace(regexp_extract(low, '^[^#?]*'), '^([a-z]+:)?(//[^/]*)?', '') AS path, regexp_extract(low, '^[^#?]*\?([^#]*)', 1) AS query FROM links),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg, list_filter(string_split_regex(path, '[/_.-]+'), lambda x: x <> '') AS words, list_transform(list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '=.')), lambda x: split_part(x, '=', 1)) AS keys, regexp_matches(path, '/(en|de)(/.*)?/[^/?#]*\d[^/?#]*$') AS detail FROM parts),
t AS (SELECT *, coalesce(seg[-1], '') AS last, coalesce(seg[1], '') AS head, len(seg) AS n, list_contains(keys, 'ref') AS keyed, list_filter(words, lambda x: x IN ('es', 'blog', 'search', 'la')) AS bad, list_filter(string_split_regex(coalesce(seg[-1], ''), '[/_.-]+'), lambda x: x <> '') AS lw FROM s),
u AS (SELECT *, CASE WHEN rtrim(low, '/') = rtrim(lower(board), '/') THEN -12 ELSE 0 END + CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') <> array_to_string(string_split(bhost, '.')[-2:], '.') THEN -12 ELSE 0 END + CASE WHEN contains(low, 'spam') OR contains(low, '/es/') THEN -8 ELSE 0 END
+ CASE WHEN len(bad) > 0 AND NOT (detail AND len(list_filter(bad, lambda x: x <> 'search')) = 0) THEN -15 ELSE 0 END + CASE WHEN last IN ('fr', 'the', 'tion') THEN -6 ELSE 0 END + CASE WHEN len(lw) > 0 AND len(list_filter(lw, lambda x: x NOT IN ('fr', 'the', 'tion'))) = 0 THEN -6 ELSE 0 END
+ CASE WHEN contains(path, 'viewjob') AND keyed THEN 9 ELSE 0 END + CASE WHEN regexp_matches(path, '/jobdesc/?$') AND regexp_matches(query, '(^|&)id=\d+(&|$)') THEN 16 ELSE 0 END + CASE WHEN detail THEN 8 ELSE 0 END + CASE WHEN regexp_matches(path, '[-/]\d{4,}(\.html)?$') THEN 7 ELSE 0 END + CASE WHEN keyed THEN 5 ELSE 0 END
+ CASE WHEN regexp_matches(path, '\d{3,}') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(last, '[a-zа-я].*\d|\d.*[a-zа-я]') THEN 3 ELSE 0 END + CASE WHEN contains(last, '-') AND length(last) >= 12 THEN 1 ELSE 0 END + CASE WHEN contains(last, 'jobs') AND NOT regexp_matches(last, '\d') AND contains(path, '/jobs/') THEN -6 ELSE 0 END
+ CASE WHEN n BETWEEN 1 AND 2 AND NOT regexp_matches(path, '\d') AND NOT contains(last, '-') THEN -5 ELSE 0 END + CASE WHEN n = 1 AND NOT regexp_matches(last, '\d') AND regexp_matches(last, 'fr|the|tion') THEN -5 ELSE 0 END + CASE WHEN n = 1 AND regexp_matches(last, '-(jobs|job|vacancies|vacancy)$') THEN -5 ELSE 0 END
+ CASE WHEN n = 2 AND head IN ('fr', 'the', 'tion') AND NOT regexp_matches(last, '\d') AND regexp_matches(last, '-(jobs|job|vacancies|vacancy)\b') THEN -12 ELSE 0 END + CASE WHEN head IN ('api', 'catalog', 'service', 'services', 'redirect') THEN -12 ELSE 0 END + CASE WHEN regexp_matches(path, 'fr|the|tion') THEN 2 ELSE 0 END + CASE WHEN n <= 1 AND NOT keyed THEN -2 ELSE 0 END
+ CASE WHEN list_has_any(keys, ['page', 'p', 'sort', 'filter']) THEN -3 ELSE 0 END + CASE WHEN regexp_matches(low, '#(job|vacancy|opening)[\w-]*$') THEN -3 ELSE 0 END + CASE WHEN regexp_matches(path, '\.(pdf|doc|docx)$') THEN -8 ELSE 0 END
+ CASE WHEN regexp_matches(path, '\.(css|eot|gif|ico|jpe?g|js|map|mp4|png|svg|ttf|webm|webp|woff2?)$') THEN -50 ELSE 0 END + CASE WHEN list_has_any(seg, ['static', 'assets', '_next', 'cdn-cgi']) THEN -20 ELSE 0 END AS score FROM t)
SELECT page_id, link, score::INTEGER AS score, n > 0 AND score <= 0 AND rtrim(low, '/') <> rtrim(lower(board), '/') AND regexp_matches(path, 'fr|the|tion') AS listing FROM u"""


@R.add(LINK_SQL)
def link_scores(spark, d):
    """Each page's own address and the links in it (as of another site), scored for the page's site as the board."""
    p = table(spark, d, "pages")
    board = F.regexp_extract("url", "^[a-z]+://[^/]*", 0)
    inner = F.transform(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), 1), lambda h: F.concat(F.lit("https://jobs.example.com"), h))
    t = p.select("page_id", board.alias("board"), F.explode(F.array_distinct(F.concat(F.array("url"), inner))).alias("link"))
    link, board = F.col("link"), F.col("board")
    return t.select("page_id", "link", L.link_score(link, board, LINK_WORDS).alias("score"), L.is_listing(link, board, LINK_WORDS).alias("listing"))


@R.add(r"SELECT page_id, CASE WHEN contains(url, 'utm_source') THEN regexp_replace(url, '\?utm_source=feed', '') ELSE url END AS url FROM pages")
def url_without_tracking(spark, d):
    return table(spark, d, "pages").select("page_id", L.without_tracking(F.col("url")).alias("url"))


# A vote: a click of a user; the document whose number the event names is the posting.
VOTES_SQL = """WITH votes AS (SELECT * FROM (SELECT json_extract_string(props, '$.k')::BIGINT AS job_id, user_id, min(ts) AS at FROM events WHERE event_type = 'click' GROUP BY ALL) JOIN (SELECT doc_id AS job_id, trim(split_part(text, chr(10), 1)) AS title, source AS source_name, trim(text[1:60]) AS excerpt FROM documents) USING (job_id)),
tallies AS (SELECT job_id, count(*) AS votes, any_value(title) AS title, any_value(source_name) AS source_name, any_value(excerpt) AS excerpt FROM votes GROUP BY job_id) """


def _votes(spark, d):
    e = table(spark, d, "events").where("event_type = 'click'")
    e = e.select(F.get_json_object("props", "$.k").try_cast("long").alias("job_id"), "user_id", F.col("ts").alias("at"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("job_id"), F.trim(F.substring_index("text", "\n", 1)).alias("title"), F.lit(None).cast("string").alias("url"), F.col("source").alias("source_name"), F.trim(F.substring("text", 1, 60)).alias("excerpt"))
    return V.distinct_votes(e).join(docs, "job_id")


@R.add(VOTES_SQL + "SELECT job_id, votes, title, source_name FROM tallies ORDER BY votes DESC, title, job_id LIMIT 10")
def feedback_top(spark, d):
    """The ten postings that most users have voted on."""
    return V.top_jobs(_votes(spark, d)).select("job_id", "votes", "title", "source_name")


@R.add(VOTES_SQL + "SELECT coalesce(nullif(source_name, ''), 'unknown') AS source_name, count(*) AS votes, count(DISTINCT job_id) AS jobs FROM votes GROUP BY 1")
def feedback_sources(spark, d):
    return V.source_tallies(_votes(spark, d))


@R.add(VOTES_SQL + "SELECT job_id, votes, excerpt FROM tallies WHERE votes >= 2 AND length(excerpt) >= 30")
def feedback_promotable(spark, d):
    """All postings whose excerpts may become negative examples."""
    return V.promotable(V.job_tallies(_votes(spark, d))).select("job_id", "votes", "excerpt")


@R.add(f"""WITH x AS (SELECT doc_id, lang, quality_score, quality = 1 AS g, row_number() OVER (PARTITION BY lower(description) ORDER BY doc_id) > 1 AS copy FROM (SELECT * FROM ({RECORD_QUALITY_SQL}) JOIN labels USING (doc_id) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id))),
y AS (SELECT lang, g, (NOT copy AND quality_score >= 0.6) OR (copy AND g) AS p FROM x), c AS (SELECT lang, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn, count(*) FILTER (NOT p AND NOT g) AS tn FROM y GROUP BY lang)
SELECT lang, tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 4) ELSE 0 END AS f1 FROM c""")
def confusion_adjusted(spark, d):
    """Confusion by language where gold documents that left as copies count as found."""
    gold = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("gold"))
    t = P.quality(_risk(spark, d)).join(gold, "doc_id").select("doc_id", F.col("location").alias("lang"), "description", "quality_score", "gold")
    t = D.mark_duplicates(t, F.sha2(F.lower("description"), 256), ["doc_id"], "doc_id")
    t = t.withColumn("exit_stage", F.when(F.col("is_duplicate"), "dedup"))
    return A.confusion_adjusted(t, ~F.col("is_duplicate") & (F.col("quality_score") >= 0.6), F.col("gold"), F.col("exit_stage"), "dedup", ["lang"])


# Profiles of ten users with two tenants; each vector is an example of one of the four categories, twice.
CATEGORY_SQL = "['resume:positive', 'resume:negative', 'vacancy:positive', 'vacancy:negative'][vec_id % 4 + 1]"
ROLE_SQL = f"'user:' || label || '@tenant:' || CASE WHEN vec_id % 3 = 0 THEN 'a' ELSE 'b' END || ':' || {CATEGORY_SQL}"


def _examples(spark, d):
    e, i = table(spark, d, "embeddings"), F.col("vec_id")
    category = F.when(i % 4 == 0, "resume:positive").when(i % 4 == 1, "resume:negative").when(i % 4 == 2, "vacancy:positive").otherwise("vacancy:negative")
    p = e.select(F.col("label").alias("user_id"), F.when(i % 3 == 0, "a").otherwise("b").alias("tenant_id"), category.alias("category"), F.concat(F.lit("text "), i.cast("string")).alias("text"), "embedding")
    return X.profile_examples(p)


@R.add(f"SELECT {ROLE_SQL} AS role, 'text ' || vec_id AS text, split_part({CATEGORY_SQL}, ':', 2) AS label FROM embeddings WHERE NOT starts_with({ROLE_SQL}, 'user:1@tenant:b:') AND NOT (vec_id % 7 = 0 AND label = 2)")
def example_store(spark, d):
    """Examples added twice, of one user cleared by role prefix, some of another removed by text."""
    new = _examples(spark, d)
    store = X.add(X.add(new.where(F.lit(False)), new), new.unionByName(new))
    gone = store.where("role LIKE 'user:2@%' AND CAST(substring(text, 6) AS BIGINT) % 7 = 0")
    return X.remove(X.clear(store, "user:1@tenant:b:"), gone).select("role", "text", "label")


COSINE_SQL = "list_inner_product({0}::DOUBLE[], {1}::DOUBLE[]) / sqrt(list_inner_product({0}::DOUBLE[], {0}::DOUBLE[]) * list_inner_product({1}::DOUBLE[], {1}::DOUBLE[]))"
EXAMPLE_SIMS_SQL = f"SELECT e.vec_id, positive, {COSINE_SQL.format('e.embedding', 's.anchor')} AS sim FROM embeddings e, (SELECT embedding AS anchor, vec_id % 2 = 0 AS positive FROM embeddings WHERE label = 4 AND vec_id % 3 > 0) s"


@R.add(f"""SELECT vec_id, round(max(CASE WHEN positive THEN m END) - max(CASE WHEN NOT positive THEN m END), 6) AS margin, round(max(CASE WHEN positive THEN x END) - max(CASE WHEN NOT positive THEN x END), 6) AS max_margin
FROM (SELECT vec_id, positive, avg(sim) FILTER (r <= 5) AS m, max(sim) AS x FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, positive ORDER BY sim DESC) AS r FROM ({EXAMPLE_SIMS_SQL})) GROUP BY ALL) GROUP BY vec_id""")
def example_margins(spark, d):
    """All vectors against the examples of one user with one tenant, found by role prefix."""
    return X.margins(table(spark, d, "embeddings"), _examples(spark, d), "user:4@tenant:b:")


@R.add(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url, regexp_extract(url, '//([^/]*)', 1) AS company, DATE '2024-01-01' + (page_id % 300)::INTEGER AS posted, regexp_extract(html, 'lang="([a-z]*)"', 1) AS location, length(html)::DOUBLE AS max_amount, 'month' AS period FROM pages""")
def page_postings(spark, d):
    """The posting of each page: its own facts as ld+json in three forms (alone, in a list, in a graph) after one of another address."""
    p, url = table(spark, d, "pages"), F.col("url")
    pick = lambda x: F.regexp_extract("html", x, 1)
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int")), "yyyy-MM-dd'T'00:00:00")

    def posting(address, title):
        pay = F.struct(F.lit("EUR").alias("currency"), F.struct(F.length("html").alias("maxValue"), F.lit("MONTH").alias("unitText")).alias("value"))
        place = F.struct(F.struct(pick('lang="([a-z]*)"').alias("addressLocality")).alias("address"))
        return F.struct(F.lit("JobPosting").alias("@type"), title.alias("title"), address.alias("url"), day.alias("datePosted"), F.struct(F.regexp_extract(url, "//([^/]*)", 1).alias("name")).alias("hiringOrganization"), place.alias("jobLocation"), pay.alias("baseSalary"))

    own, other = posting(url, pick("<title>([^<]*)</title>")), posting(F.lit("https://elsewhere.example.com/1"), F.lit("another"))
    script = lambda x: F.concat(F.lit('<script type="application/ld+json">'), F.to_json(x), F.lit("</script>"))
    kind = F.col("page_id") % 3
    body = F.when(kind == 0, F.concat(script(other), script(own))).when(kind == 1, script(F.array(other, own))).otherwise(script(F.struct(F.array(other, own).alias("@graph"))))
    pages = p.select("page_id", "url", F.concat("html", body).alias("html"))
    return H.postings(pages, "page_id", "url", "html").select("page_id", "title", "url", "company", "posted", "location", "max_amount", "period")


@R.add(r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'next' WHEN 1 THEN 'nuxt' WHEN 2 THEN 'inertia' ELSE 'pinia' END AS framework, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url FROM pages""")
def page_islands(spark, d):
    """State that four frameworks would leave in the page, made of the page's own title and address and found again."""
    p = table(spark, d, "pages")
    state = F.to_json(F.struct(F.struct(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("url").alias("url"), F.lit('brace } and "quote"').alias("note")).alias("job")))
    kind = F.col("page_id") % 4
    quoted = F.replace(F.replace(state, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    body = F.when(kind == 0, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), state, F.lit("</script>"))).when(kind == 1, F.concat(F.lit("<script>window.__NUXT__ = "), state, F.lit(";</script>")))
    body = body.when(kind == 2, F.concat(F.lit('<div id="app" data-page="'), quoted, F.lit('"></div>'))).otherwise(F.concat(F.lit("<script>window.__pinia = "), state, F.lit("</script>")))
    t = p.select("page_id", H.islands(F.concat("html", body)).alias("m")).select("page_id", F.explode("m").alias("framework", "state"))
    return t.select("page_id", "framework", F.get_json_object("state", "$.job.title").alias("title"), F.get_json_object("state", "$.job.url").alias("url"))


QUERIES, ORACLE = R.queries, R.oracle
