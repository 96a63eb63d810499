"""Page queries: discovery of links, elements and steps, main text, islands, postings, boards."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnowline.functions import html as H
from winnowline.functions import paths
from winnowline.functions import urls as U
from winnowline.queries import Registry, table
from winnowline.sources import feeds as feed_source
from winnowline.sources.scratch import shared_folder

R = Registry()


@R.add(r"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY min(ordinal)) - 1 AS ordinal, root || href AS link FROM (SELECT page_id, root, unnest(refs) AS href, generate_subscripts(refs, 1) - 1 AS ordinal FROM (SELECT page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS root, regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"''#]+)', 1) AS refs FROM pages)) GROUP BY page_id, root, href""")
def link_discovery(spark, d):
    """Absolute links in order of sight."""
    p = table(spark, d, "pages").select("page_id", F.posexplode(H.links(F.col("html"), F.col("url"))).alias("ordinal", "link"))
    return p.select("page_id", F.col("ordinal").cast("long").alias("ordinal"), "link")


@R.add("SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', '<\\1>', 'g'), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL")
def html_elements(spark, d):
    """Elements by tag, from the parser."""
    e = table(spark, d, "pages").select("page_id", F.explode(H.elements("html")).alias("e"))
    return e.groupBy("page_id", F.col("e.tag").alias("tag")).agg(F.count("*").alias("n"))


STEPS = [{"tag": "title", "field": "page_title"}, {"tag": "li", "text": "", "offset": 1, "field": "second_item"}, {"tag": "h1", "field": "title"}, {"tag": "b", "optional": True, "field": "lead"}, {"tag": "video", "optional": True, "field": "none"}, {"tag": "footer", "field": "host", "regex": r"© (\S+)"}]
TEXT_SQL = "trim(regexp_replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), '\\s+', ' ', 'g'))"


@R.add(f"""SELECT page_id, nullif({TEXT_SQL.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '') AS page_title, nullif({TEXT_SQL.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, '') AS title, nullif(regexp_extract(html, '<footer>&copy; (\\S+)', 1), '') AS host FROM pages""")
def dom_steps(spark, d):
    """Fields read by a cursor over the page's elements."""
    f = table(spark, d, "pages").select("page_id", H.step_fields(F.col("html"), STEPS).alias("f"))
    return f.select("page_id", *[F.col("f")[c].alias(c) for c in ("page_title", "title", "host")])


BLOCK = r"(?i)</?(?:p|div|br|li|h[1-6]|tr|ul|ol|table)\b[^>]*>"
UNESCAPE_SQL = "replace(replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"
MAIN_SQL = rf"""array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1), '{BLOCK}', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace({UNESCAPE_SQL.format("regexp_replace(x, '<[^>]*>', '', 'g')")}, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), chr(10))"""


@R.add(f"SELECT page_id, {MAIN_SQL} AS body FROM pages")
def main_text(spark, d):
    return table(spark, d, "pages").select("page_id", H.main_text(F.col("html")).alias("body"))


@R.add(f"SELECT page_id, source_kind, title, length(body) AS n_chars, body FROM (SELECT page_id, 'page' AS source_kind, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, {MAIN_SQL} AS body FROM pages)")
def document_parse(spark, d):
    """Pages as raw items with their text."""
    p = table(spark, d, "pages").select("page_id", F.lit("page").alias("source_kind"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), H.main_text(F.col("html")).alias("body"))
    return p.select("page_id", "source_kind", "title", F.length("body").cast("long").alias("n_chars"), "body")


@R.add(r"""SELECT page_id, len(hrefs) AS links, hrefs[1] AS first_href FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1) AS hrefs FROM pages)""")
def xpath_navigation(spark, d):
    """XPath rules on the well-formed navigation of a page."""
    nav = F.concat(F.lit("<nav>"), F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1), F.lit("</nav>"))
    p = table(spark, d, "pages").select("page_id", F.xpath(nav, F.lit("/nav/ul/li/a/@href")).alias("hrefs"))
    return p.select("page_id", F.size("hrefs").cast("long").alias("links"), F.get("hrefs", F.lit(0)).alias("first_href"))


@R.add("SELECT page_id, title, items FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, len(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>')) AS items FROM pages)")
def declarative_html(spark, d):
    """List and detail selectors from a specification: counts of list elements, text of a detail element."""
    spec = {"list": r"(?s)<article>(.*)</article>", "item": "<p>", "title": "<h1>([^<]*)</h1>"}
    p = table(spark, d, "pages")
    items = F.size(F.regexp_extract_all(F.regexp_extract("html", spec["list"], 1), F.lit(spec["item"]), 0)).cast("long")
    return p.select("page_id", F.regexp_extract("html", spec["title"], 1).alias("title"), items.alias("items"))


@R.add("SELECT page_id, CASE WHEN contains(html, '__NEXT_DATA__') THEN 'next' WHEN contains(html, 'application/ld+json') THEN 'json_ld' WHEN contains(html, '<urlset') THEN 'sitemap' WHEN contains(html, '<rss') THEN 'feed' WHEN contains(html, '<a ') THEN 'dom' ELSE 'none' END AS kind FROM pages")
def board_detection(spark, d):
    return table(spark, d, "pages").select("page_id", H.board_kind(F.col("url"), F.col("html")).alias("kind"))


SITE_RULES = [("^https:", 2), ("[0-9]+$", 3), ("/(?:page|p|a)", 5), (r"\?", -4)]
SITE_SCORE = " + ".join(f"(CASE WHEN regexp_matches(url, '{p}') THEN {w} ELSE 0 END)" for p, w in SITE_RULES)


@R.add(f"SELECT host, url, score FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score > 0 DESC, url) AS n FROM (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) AS host, url, {SITE_SCORE} AS score FROM pages)) WHERE n <= 3")
def sitemap_cap(spark, d):
    """Of each site so many URLs, those that look like postings first: the cap is the feature."""
    p = table(spark, d, "pages").select(U.host(F.col("url")).alias("host"), "url", U.additive_score(F.col("url"), SITE_RULES).alias("score")).distinct()
    return p.withColumn("n", F.row_number().over(W.partitionBy("host").orderBy(F.desc(F.col("score") > 0), "url"))).where("n <= 3").drop("n")


@R.add(f"SELECT page_id, score, CASE WHEN best > 0 THEN score > 0 ELSE true END AS chosen FROM (SELECT page_id, score, max(score) OVER (PARTITION BY host) AS best FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) AS host, {SITE_SCORE} AS score FROM pages))")
def listing_detection(spark, d):
    """Positive scores only; all pages of a site that has none."""
    p = table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("host"), U.additive_score(F.col("url"), SITE_RULES).alias("score"))
    best = p.groupBy("host").agg(F.max("score").alias("best"))
    return p.join(best, "host").select("page_id", "score", F.when(F.col("best") > 0, F.col("score") > 0).otherwise(True).alias("chosen"))


@R.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS amount, 'USD' AS currency, event_type || ' ' || json_extract_string(props, '$.k') AS title, CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'opened' END AS state FROM events")
def json_field_map(spark, d):
    """Rows of JSON by a field map: path, literal, concatenation, value map."""
    e = table(spark, d, "events")
    body = F.to_json(F.struct(F.from_json("props", "k long").alias("props"), F.col("event_type").alias("kind")))
    fields = {"amount": "$.props.k", "currency": "=USD", "title": {"concat": ["$.kind", "$.props.k"]}, "state": {"map": "$.kind", "values": {"view": "seen", "click": "opened"}}}
    return e.select("event_id", body.alias("b")).select("event_id", *H.map_fields(F.col("b"), fields)).withColumn("amount", F.col("amount").cast("long"))


@R.add("SELECT CAST(o_orderkey AS VARCHAR) AS board, l_linenumber AS place, CAST(l_partkey AS VARCHAR) AS job_id, l_shipmode AS office FROM (SELECT o_orderkey FROM orders) JOIN (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS l_shipmode FROM lineitem) ON o_orderkey = l_orderkey")
def json_board(spark, d):
    """A board's JSON page (an order with its lines), taken apart by from_json and explode."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.struct(F.col("l_partkey").cast("string").alias("id"), F.struct(F.col("l_returnflag").alias("name")).alias("office")).alias("job"))
    boards = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(line).alias("jobs"))).alias("page")).join(table(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    jobs = F.from_json("page", "jobs array<struct<n:int,job:struct<id:string,office:struct<name:string>>>>")["jobs"]
    return boards.select(F.col("o_orderkey").cast("string").alias("board"), F.explode(jobs).alias("j")).select("board", F.col("j.n").alias("place"), F.col("j.job.id").alias("job_id"), F.col("j.job.office.name").alias("office"))


#: Where three kinds of boards have their jobs, and what their fields are called.
BOARDS = {
    0: ("$.jobs[*]", {"job_id": "job.id", "office": "job.offices[*].name", "place": "n"}),
    1: ("data.sections[?kind=open].positions[*]", {"job_id": "key", "office": "where[?primary=true].label", "place": "meta[0]"}),
    2: ("[?type!=draft]", {"job_id": "attributes.ref", "office": "attributes.location", "place": "position"}),
}


@R.add("""SELECT o_orderkey AS board, CAST(l_partkey AS VARCHAR) AS job_id, CASE o_orderkey % 3 WHEN 0 THEN l_returnflag || CASE WHEN l_linestatus <> l_returnflag THEN ', ' || l_linestatus ELSE '' END WHEN 1 THEN l_returnflag ELSE l_linestatus END AS office, CAST(l_linenumber AS VARCHAR) AS place
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE CASE o_orderkey % 3 WHEN 1 THEN l_linenumber % 2 = 0 WHEN 2 THEN l_linenumber <> 3 ELSE true END""")
def json_boards(spark, d):
    """Orders as board pages of three shapes, read by paths with projections and filters from VARIANT."""
    line, c = table(spark, d, "lineitem"), F.col
    part, n = c("l_partkey"), c("l_linenumber")
    one = F.struct(n.alias("n"), F.struct(part.alias("id"), F.array(F.struct(c("l_returnflag").alias("name")), F.struct(c("l_linestatus").alias("name"))).alias("offices")).alias("job"))
    two = F.struct(F.when(n % 2 == 0, "open").otherwise("closed").alias("kind"), F.array(F.struct(part.alias("key"), F.array(n).alias("meta"), F.array(F.struct(F.lit(False).alias("primary"), F.lit("x").alias("label")), F.struct(F.lit(True).alias("primary"), c("l_returnflag").alias("label"))).alias("where"))).alias("positions"))
    three = F.struct(F.when(n == 3, "draft").when(n == 2, "job").alias("type"), n.alias("position"), F.struct(part.alias("ref"), c("l_linestatus").alias("location")).alias("attributes"))
    shape = c("l_orderkey") % 3
    # A line is written once, as its own board has it; a page is its lines in a frame.
    entry = F.when(shape == 0, F.to_json(one)).when(shape == 1, F.to_json(two)).otherwise(F.to_json(three))
    pages = line.groupBy("l_orderkey").agg(F.array_join(F.collect_list(entry), ",").alias("lines"))
    pages = pages.join(table(spark, d, "orders").select("o_orderkey"), c("l_orderkey") == c("o_orderkey")).withColumn("shape", c("o_orderkey") % 3)
    framed = lambda head, tail: F.concat(F.lit(head), c("lines"), F.lit(tail))
    body = F.when(c("shape") == 0, framed('{"jobs":[', "]}")).when(c("shape") == 1, framed('{"data":{"sections":[', "]}}")).otherwise(framed("[", "]"))
    read = pages.select(c("o_orderkey").alias("board"), "shape", F.try_parse_json(body).alias("page"))
    jobs = None
    for shape, (items, fields) in BOARDS.items():
        own = paths.records(c("page"), items, fields)
        jobs = F.when(c("shape") == shape, own) if jobs is None else jobs.when(c("shape") == shape, own)
    return read.select("board", F.explode(jobs).alias("j")).select("board", "j.job_id", "j.office", "j.place")


#: Pages whose entries land in one file of their feed.
FILED = 32_768


@R.add("""SELECT CASE WHEN page_id % 10 = 0 THEN 'apart' ELSE 'entry' END AS kind, 's' || CAST(page_id % 8 AS VARCHAR) AS source, CAST(page_id AS VARCHAR) AS id, CASE WHEN page_id % 10 > 0 THEN url END AS link, CASE WHEN page_id % 10 = 0 THEN 'undated' END AS reason FROM pages, range(0, 2) t(copy)
WHERE (page_id % 10 = 0 OR copy = 0) AND (page_id % 10 = 0 OR page_id % 60 >= 14)
UNION ALL SELECT 'apart', 's' || CAST(page_id % 8 AS VARCHAR), CAST(page_id AS VARCHAR), NULL, 'old' FROM pages, range(0, 2) t(copy) WHERE page_id % 10 > 0 AND page_id % 60 < 14""")
def feed_poll(spark, d):
    """Pages as two editions of eight landed feeds, polled twice: each entry once, undated and old ones set apart."""
    import uuid

    base = f"{shared_folder(spark)}/feeds-{uuid.uuid4().hex}"
    k = F.col("page_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int")), "d MMM yyyy")
    link = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    item = F.concat(F.lit("<item><guid>"), k.cast("string"), F.lit("</guid><link>"), link, F.lit("</link><title>t</title>"), F.when(k % 10 > 0, F.concat(F.lit("<pubDate>"), day, F.lit(" 00:00:00 +0000</pubDate>"))).otherwise(""), F.lit("</item>"))
    # A feed lands in files of a few thousand entries.
    feeds = table(spark, d, "pages").groupBy(F.concat(F.lit("s"), (k % 8).cast("string")).alias("source"), F.floor(k / FILED)).agg(F.array_join(F.collect_list(item), "").alias("items"))
    feeds = feeds.select("source", F.concat(F.lit("<rss><channel>"), F.col("items"), F.lit("</channel></rss>")).alias("value"))
    for _ in range(2):
        feeds.write.mode("append").option("maxRecordsPerFile", 1).partitionBy("source").text(f"{base}/in")
        rows = feed_source.unseen(feed_source.entries(feed_source.landed(spark, f"{base}/in"), feed_source.feed_items(F.col("value")), "2024-01-15"))
        good, apart = feed_source.poll(rows, f"{base}/out", f"{base}/cursor")
    none = F.lit(None).cast("string")
    return good.select(F.lit("entry").alias("kind"), "source", "id", "link", none.alias("reason")).unionByName(apart.select(F.lit("apart").alias("kind"), "source", "id", none.alias("link"), "reason"))


QUERIES, ORACLE = R.queries, R.oracle
