"""Keyed-state and publishing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnowline.operators import publishing as P
from winnowline.operators import state as S
from winnowline.queries import Registry, table

R = Registry()
DAY = "DATE '2024-01-02'"


def _day(e):
    return F.to_date("ts")


@R.add(f"WITH o AS (SELECT user_id, event_type AS state, value AS best, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN CAST(ts AS DATE) <= {DAY} THEN ts END DESC NULLS LAST, event_id DESC) = 1 AND CAST(ts AS DATE) <= {DAY}), n AS (SELECT user_id, event_type AS state, value AS best FROM events WHERE CAST(ts AS DATE) > {DAY} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.state, o.state) AS state, greatest(n.best, o.best) AS best FROM o FULL JOIN n USING (user_id)")
def kv_upsert(spark, d):
    """State of each user after an upsert of the later half of the events; the best value never falls."""
    e = table(spark, d, "events").withColumns({"state": F.col("event_type"), "best": F.col("value"), "late": F.to_date("ts") > F.lit("2024-01-02").cast("date")})
    old = S.newest(e.where("NOT late"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 1).select("user_id", "state", "best")
    new = e.where("late").select("user_id", "ts", "event_id", "state", "best")
    return S.upsert(old, new, ["user_id"], ["ts", "event_id"], ("best",)).select("user_id", "state", "best")


LEDGER_SQL = f"SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY seen, event_type) AS version, seen FROM (SELECT user_id, event_type, min(ts) AS seen FROM events WHERE CAST(ts AS DATE) <= {DAY} GROUP BY ALL)"


@R.add(f"WITH l AS ({LEDGER_SQL}), f AS (SELECT user_id, event_type, min(ts) AS seen FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM l) GROUP BY ALL) SELECT user_id, event_type, seen, coalesce(m, 0) + row_number() OVER (PARTITION BY user_id ORDER BY seen, event_type) AS version FROM f LEFT JOIN (SELECT user_id, max(version) AS m FROM l GROUP BY user_id) USING (user_id)")
def ledger_insert(spark, d):
    """What a second run adds to a ledger that the first run made."""
    e = table(spark, d, "events").select("user_id", "event_type", F.col("ts").alias("seen"))
    none = e.limit(0).select("user_id", "event_type", F.lit(0).cast("long").alias("version"))
    first = S.ledger_insert(none, e.where("to_date(seen) <= DATE '2024-01-02'"), ["user_id"], "event_type", "seen")
    return S.ledger_insert(first, e, ["user_id"], "event_type", "seen")


@R.add("SELECT user_id, event_id, CAST(ts AS DATE) AS run FROM (SELECT *, max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS m FROM events WHERE ts >= TIMESTAMP '2024-01-10') WHERE CAST(ts AS DATE) = m")
def latest_run_snapshot(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.to_date("ts").alias("run"))
    return S.latest_snapshot(e, "user_id", "run", F.lit("2024-01-10").cast("date"))


@R.add("SELECT c_custkey, coalesce(same, false) AS drop, c_nationkey <> 3 AS commit FROM customer LEFT JOIN (SELECT c_custkey AS k, c_custkey % 4 <> 0 AS same FROM customer WHERE c_custkey % 3 <> 0) ON k = c_custkey")
def snapshot_filter(spark, d):
    """Rows whose last run had the same content, and rows of sources that came in part."""
    now = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("source"), F.col("c_mktsegment").alias("h"))
    before = now.where("c_custkey % 3 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "changed").otherwise(F.col("h")).alias("h"))
    return S.unchanged_rows(before, now, ["c_custkey"], "h", now.where("source = 3"), "source").select("c_custkey", "drop", "commit")


@R.add("SELECT task_id, 'leased' AS state FROM (SELECT o_orderkey AS task_id, o_custkey AS source, o_orderdate AS available_at, o_orderkey % 5 AS k FROM orders) WHERE available_at <= TIMESTAMP '1996-01-01' AND (k < 3 OR k = 3) AND source NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND ts + INTERVAL 3 DAY > TIMESTAMP '2024-01-29') ORDER BY available_at, task_id LIMIT 40")
def task_queue_claim(spark, d):
    """A batch of tasks that are due and ready, or whose lease ran out, from sources that aren't cooling down."""
    k = F.col("o_orderkey") % 5
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("source"), F.col("o_orderdate").alias("available_at"), F.col("o_orderdate").alias("created_at"), F.when(k < 3, "ready").when(k == 3, "leased").otherwise("done").alias("state"), F.col("o_orderdate").alias("lease_until"))
    cooling = table(spark, d, "events").where("event_type = 'error' AND ts + INTERVAL 3 DAY > TIMESTAMP '2024-01-29'").select(F.col("user_id").alias("source"), F.lit("2030-01-01").cast("timestamp").alias("until"))
    now = F.lit("1996-01-01").cast("timestamp")
    return S.claim(tasks, cooling, now, 40, now + F.expr("INTERVAL 5 MINUTES")).select("task_id", "state")


@R.add("SELECT o_orderkey, CASE WHEN ok THEN 'delivered' WHEN unknown THEN 'uncertain' WHEN n > 0 THEN 'deferred' ELSE 'pending' END AS state, coalesce(n, 0) AS attempts FROM orders LEFT JOIN (SELECT l_orderkey, bool_or(l_linenumber = 4) AS ok, bool_or(l_returnflag = 'R') AS unknown, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def outbox_states(spark, d):
    a = table(spark, d, "lineitem").where("l_linenumber > 2").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linenumber") == 4, "ok").when(F.col("l_returnflag") == "R", "unknown").otherwise("failed").alias("result"))
    a = a.unionByName(table(spark, d, "lineitem").where("l_linenumber = 4 AND l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("unknown").alias("result")))
    s = S.outbox_states(table(spark, d, "orders").select("o_orderkey"), a, "o_orderkey")
    extra = table(spark, d, "lineitem").where("l_linenumber = 4 AND l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("x"))
    return s.join(extra, "o_orderkey", "left").select("o_orderkey", "state", (F.col("attempts") - F.coalesce("x", F.lit(0))).alias("attempts"))


@R.add("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def bounded_ledger(spark, d):
    return S.newest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@R.add("SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3 THEN 'now' ELSE 'deferred' END AS work FROM events")
def call_budget(spark, d):
    return S.spread_budget(table(spark, d, "events"), "user_id", ["ts", "event_id"], 3).select("event_id", "work")


@R.add("WITH r AS (SELECT CAST(ts AS DATE) AS run, count(*) AS fetched FROM events GROUP BY 1), o AS (SELECT CAST(ts AS DATE) AS run, count(*) AS emitted FROM events WHERE event_type = 'purchase' GROUP BY 1), q AS (SELECT CAST(ts AS DATE) AS run, round(avg(value), 4) AS quality FROM events WHERE event_type = 'view' GROUP BY 1), f AS (SELECT CAST(ts AS DATE) AS run, true AS flagged FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 10) SELECT run, fetched, emitted, quality, flagged FROM r LEFT JOIN o USING (run) LEFT JOIN q USING (run) LEFT JOIN f USING (run)")
def run_report(spark, d):
    e = table(spark, d, "events").withColumn("run", F.to_date("ts"))
    runs = e.groupBy("run").agg(F.count("*").alias("fetched"))
    parts = {
        "outcomes": e.where("event_type = 'purchase'").groupBy("run").agg(F.count("*").alias("emitted")),
        "quality": e.where("event_type = 'view'").groupBy("run").agg(F.round(F.avg("value"), 4).alias("quality")),
        "flags": e.where("event_type = 'error'").groupBy("run").agg(F.count("*").alias("n")).where("n > 10").select("run", F.lit(True).alias("flagged")),
    }
    return S.run_report(runs, parts, ["run"])


@R.add("SELECT 'documents' AS source_id, 'ok' AS status, (SELECT count(*) FROM documents) AS n, NULL AS error UNION ALL SELECT 'pages', 'ok', (SELECT count(*) FROM pages), NULL UNION ALL SELECT 'none', 'empty', 0, NULL UNION ALL SELECT 'broken', 'failed', 0, 'AnalysisException'")
def source_fan_in(spark, d):
    """A result row for each source: one that can't be opened doesn't stop the others."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("external_id"), "text")
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("external_id"), "url", F.col("html").alias("text"))
    try:
        broken = docs.select("no_such_column")
    except Exception as e:
        broken = e
    return S.fan_in({"documents": docs, "pages": pages, "none": docs.limit(0), "broken": broken})[1]


@R.add("SELECT source_kind, source_name, external_id, length(text) AS n FROM (SELECT 'document' AS source_kind, source AS source_name, CAST(doc_id AS VARCHAR) AS external_id, text FROM documents UNION ALL SELECT 'chat', role, conv_id || '-' || turn, text FROM conversations)")
def union_of_sources(spark, d):
    docs = table(spark, d, "documents").select(F.lit("document").alias("source_kind"), F.col("source").alias("source_name"), F.col("doc_id").cast("string").alias("external_id"), "text")
    chat = table(spark, d, "conversations").select(F.lit("chat").alias("source_kind"), F.col("role").alias("source_name"), F.concat_ws("-", "conv_id", "turn").alias("external_id"), "text")
    return docs.unionByName(chat).select("source_kind", "source_name", "external_id", F.length("text").cast("long").alias("n"))


@R.add("SELECT conv_id, turn, role, opener FROM (SELECT *, first_value(text[1:40]) OVER (PARTITION BY conv_id ORDER BY turn) AS opener, 2 AS cursor FROM conversations) WHERE turn > cursor")
def channel_messages(spark, d):
    """Messages behind each channel's cursor, with the post they answer to."""
    c = table(spark, d, "conversations")
    parent = c.groupBy("conv_id").agg(F.min_by(F.substring("text", 1, 40), "turn").alias("opener"))
    return c.where("turn > 2").join(parent, "conv_id").select("conv_id", "turn", "role", "opener")


@R.add("SELECT user_id, event_id, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def observation_replay(spark, d):
    """The newest envelope of each observation as a raw item."""
    e = table(spark, d, "events").withColumn("observation", F.concat_ws(":", "user_id", "event_type"))
    return S.replay(e, "observation", [F.desc("ts"), F.desc("event_id")], ["user_id", "event_id", "props"])


@R.add("SELECT event_type, n, ts_share, late_share, CASE WHEN late_share >= 0.8 THEN 'late' WHEN ts_share >= 0.8 THEN 'ts' END AS freshness_field, ts_from, ts_to FROM (SELECT event_type, count(*) AS n, round(count(late) / count(*), 4) AS late_share, round(count(ts) / count(*), 4) AS ts_share, min(ts) AS ts_from, max(ts) AS ts_to FROM (SELECT *, CASE WHEN value > 10 THEN ts END AS late FROM events) GROUP BY event_type)")
def source_assessment(spark, d):
    e = table(spark, d, "events").withColumn("late", F.when(F.col("value") > 10, F.col("ts")))
    return S.date_coverage(e, "event_type", ["late", "ts"]).select("event_type", "n", "ts_share", "late_share", "freshness_field", "ts_from", "ts_to")


@R.add("SELECT n_name AS source, term, 'https://search.example/' || n_name || '?q=' || replace(term, ' ', '+') AS url FROM nation, (VALUES ('data engineer'), ('ml lead')) t(term)")
def search_expansion(spark, d):
    terms = spark.createDataFrame([(0, "data engineer"), (1, "ml lead"), (2, "one too many")], "place int, term string")
    return S.expand_search(table(spark, d, "nation").select(F.col("n_name").alias("source")), terms, "https://search.example/{source}?q={term}", 2)


@R.add("SELECT event_id FROM events WHERE event_id % 10 = 0 OR ts >= TIMESTAMP '2024-01-20'")
def freshness_cutoff(spark, d):
    e = table(spark, d, "events").withColumn("at", F.when(F.col("event_id") % 10 != 0, F.col("ts")))
    return S.fresh_enough(e, "at", F.lit("2024-01-20").cast("timestamp")).select("event_id")


@R.add("SELECT doc_id, description, metadata, posted FROM (SELECT doc_id, text || chr(10) || chr(10) || 'lang: ' || lang AS description, 'lang=' || lang || ';source=' || source AS metadata, CASE WHEN doc_id % 3 < 2 THEN TIMESTAMP '2024-02-01 10:00:00' + to_days((doc_id % 20)::INTEGER) END AS posted FROM documents)")
def raw_item_factory(spark, d):
    """Payloads to raw items: extras behind the description, metadata as a map, dates in ISO or RFC 822."""
    at = F.lit("2024-02-01 10:00:00").cast("timestamp") + F.make_interval(days=(F.col("doc_id") % 20).cast("int"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("doc_id") % 3 == 1, F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss +0000")).otherwise("soon")
    posted = F.coalesce(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(F.regexp_replace(raw, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z")))
    extras = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")
    meta = F.array_join(F.transform(F.map_entries(extras), lambda x: F.concat_ws("=", x["key"], x["value"])), ";")
    return table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\n\nlang: "), "lang").alias("description"), meta.alias("metadata"), posted.alias("posted"))


@R.add("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'invalid_json' WHEN doc_id % 11 = 0 THEN 'blank_source' WHEN doc_id % 13 = 0 THEN 'bad_url' ELSE 'good' END AS outcome FROM documents")
def local_fixture(spark, d):
    """JSON lines, some of them broken: good rows and quarantined ones with their reason."""
    from winnowline.sources.files import parse_raw_lines

    i = F.col("doc_id")
    item = F.to_json(F.struct(F.lit("document").alias("source_kind"), F.when(i % 11 == 0, " ").otherwise(F.col("source")).alias("source_name"), i.cast("string").alias("external_id"), F.when(i % 13 == 0, "ftp:/x").otherwise("https://x.example/1").alias("url"), F.substring("text", 1, 50).alias("text")))
    lines = table(spark, d, "documents").select("doc_id", F.when(i % 7 == 0, F.substring(item, 1, 30)).otherwise(item).alias("value"))
    return parse_raw_lines(lines).select("doc_id", F.coalesce("reason", F.lit("good")).alias("outcome"))


@R.add("SELECT term, max(weight) AS weight, arg_max(polarity, made) AS polarity FROM (SELECT p_type AS term, p_size / 50.0::DOUBLE AS weight, CASE WHEN p_partkey % 2 = 0 THEN 'positive' ELSE 'negative' END AS polarity, p_partkey AS made FROM part) GROUP BY term")
def ontology_upsert(spark, d):
    """Terms of two versions: the later polarity counts, a weight never falls."""
    p = table(spark, d, "part").select(F.col("p_type").alias("term"), F.col("p_partkey").alias("made"), (F.col("p_size") / 50).alias("weight"), F.when(F.col("p_partkey") % 2 == 0, "positive").otherwise("negative").alias("polarity"))
    greatest = p.groupBy("term", F.col("made") % 2).agg(F.max("weight").alias("weight"), F.max("made").alias("made"), F.max_by("polarity", "made").alias("polarity"))
    old = greatest.where("polarity = 'positive'").select("term", "weight", "polarity", "made")
    new = greatest.where("polarity = 'negative'").select("term", "weight", "polarity", "made")
    late = S.upsert(old.select("term", "weight", "polarity"), new.select("term", "weight", "polarity", "made"), ["term"], ["made"], ("weight",))
    # Of a term in both versions the one made later decides.
    both = old.select("term", F.col("made").alias("m0"), F.col("polarity").alias("p0")).join(new.select("term", F.col("made").alias("m1")), "term", "full")
    return late.join(both, "term").select("term", "weight", F.when(F.coalesce("m0", F.lit(-1)) > F.coalesce("m1", F.lit(-1)), F.col("p0")).otherwise(F.col("polarity")).alias("polarity"))


@R.add("SELECT run, max(n) AS fetched FROM (SELECT CAST(ts AS DATE) AS run, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT CAST(ts AS DATE), count(*) FILTER (event_type <> 'error') FROM events GROUP BY 1) GROUP BY run")
def run_stats_upsert(spark, d):
    """Statistics of runs written twice, the second time complete."""
    e = table(spark, d, "events").withColumn("run", F.to_date("ts"))
    first = e.where("event_type <> 'error'").groupBy("run").agg(F.count("*").alias("fetched"))
    second = e.groupBy("run").agg(F.count("*").alias("fetched"))
    return S.upsert(first, second.withColumn("at", F.lit(2)), ["run"], ["at"], ("fetched",))


@R.add("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def group_replacement(spark, d):
    """Of each group and source the newest member replaces those before it."""
    from winnowline.operators.identity import latest_of_group

    return latest_of_group(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@R.add("SELECT event_id, CASE WHEN n <= 3 THEN 1 WHEN n <= 6 THEN 2 ELSE 3 END AS batch FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)")
def deferred_work(spark, d):
    """What a budget defers is read again by the next batch: three batches over the same rows."""
    rest, done = table(spark, d, "events").select("event_id", "user_id", "ts"), None
    for batch in (1, 2):
        marked = S.spread_budget(rest, "user_id", ["ts", "event_id"], 3)
        now = marked.where("work = 'now'").select("event_id", F.lit(batch).alias("batch"))
        done, rest = now if done is None else done.unionByName(now), marked.where("work = 'deferred'").drop("work")
    return done.unionByName(rest.select("event_id", F.lit(3).alias("batch")))


@R.add("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'structured' WHEN n <= 10 THEN 'model' ELSE 'deferred' END AS route FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, doc_id % 5 = 0 ORDER BY n_chars DESC, doc_id) AS n FROM documents)")
def extraction_routing(spark, d):
    """Structured rows take the fast path; of the others so many a source go to a model, the rest waits."""
    t = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    rest = S.spread_budget(t.where("doc_id % 5 > 0"), "source", [F.desc("n_chars"), "doc_id"], 10)
    fast = t.where("doc_id % 5 = 0").select("doc_id", F.lit("structured").alias("route"))
    return fast.unionByName(rest.select("doc_id", F.when(F.col("work") == "now", "model").otherwise("deferred").alias("route")))


# --- publishing -----------------------------------------------------------------------------------------


@R.add("WITH c AS (SELECT o_orderkey AS id, o_custkey AS likeness, o_orderpriority AS source, o_orderdate AS made, CASE WHEN o_orderkey % 2 = 0 THEN 'u' || (o_orderkey // 2) END AS url FROM orders), f AS (SELECT * FROM c WHERE id % 5 <> 0 AND (url IS NULL OR url NOT IN (SELECT 'u' || (o_orderkey // 3) FROM orders WHERE o_orderkey % 5 = 0)) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus = 'F' AND o.o_orderkey % 5 = 1 AND o.o_custkey = likeness AND o.o_orderpriority <> source)) SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY likeness ORDER BY made, id) AS n FROM f) WHERE n = 1 ORDER BY made, id LIMIT 30")
def channel_selection(spark, d):
    """What a channel posts next: the limit is a batch."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    cards = o.select(k.alias("id"), F.col("o_custkey").alias("likeness"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("at"), F.when(k % 2 == 0, F.concat(F.lit("u"), F.floor(k / 2).cast("string"))).alias("url"))
    published = o.where("o_orderkey % 5 = 0").select(k.alias("id"), F.concat(F.lit("u"), F.floor(k / 3).cast("string")).alias("url"))
    recent = cards.join(o.where("o_orderstatus = 'F' AND o_orderkey % 5 = 1").select(k.alias("id")), "id", "left_semi")
    return P.select_for_channel(cards, published, recent, ["at"], 30).select("id")


@R.add("WITH b AS (SELECT doc_id, source || '|' || lang AS b, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY source, lang) AS first FROM documents) SELECT doc_id, row_number() OVER (ORDER BY turn, first) AS position FROM b")
def interleave_order(spark, d):
    """The final round-robin order over buckets."""
    t = table(spark, d, "documents").select("doc_id", "source", "lang")
    return P.interleave_position(t, F.concat_ws("|", "source", "lang"), ["doc_id"]).select("doc_id", F.col("position").cast("long").alias("position"))


@R.add()
def pacing_plan(spark, d):
    """Bursts for the head of a queue; sizes, order and offsets are held against their laws in the tests."""
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    return P.pacing_plan(q, ["o_orderdate", "id"])


@R.add("""SELECT p_partkey, reason, array_to_string(CASE WHEN reason IS NULL THEN list_filter([CASE WHEN contains(lower(summary), 'steel') THEN 'banlist_in_summary:steel' END, CASE WHEN starts_with(trim(lower(summary)), lower(trim(role))) THEN 'title_echo_in_summary' END, CASE WHEN NOT regexp_matches(salary, '\\d') THEN 'salary_no_digits' END, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'unsafe_url_scheme' END], lambda x: x IS NOT NULL) ELSE [] END, ',') AS warnings FROM (SELECT *, CASE WHEN role = '' THEN 'missing_role' WHEN company = '' AND salary IS NULL THEN 'no_vacancy_substance' WHEN summary = '' THEN 'missing_job_details' END AS reason FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_name END AS role, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS company, CASE WHEN p_partkey % 3 = 0 THEN 'good pay' WHEN p_partkey % 3 = 1 THEN '100' END AS salary, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 = 1 THEN p_name || ' now' ELSE p_type END AS summary, CASE WHEN p_partkey % 6 = 0 THEN 'ftp://x' ELSE 'https://x' END AS url FROM part))""".replace("\\\\", "\\"))
def publication_validate(spark, d):
    k = F.col("p_partkey")
    salary = F.when(k % 3 == 0, "good pay").when(k % 3 == 1, "100")
    v = P.validation(F.when(k % 10 == 0, "").otherwise(F.col("p_name")), [F.when(k % 4 == 0, "").otherwise(F.col("p_brand")), salary], F.when(k % 7 == 0, "").when(k % 7 == 1, F.concat("p_name", F.lit(" now"))).otherwise(F.col("p_type")), salary, F.when(k % 6 == 0, "ftp://x").otherwise("https://x"), ("Steel",))
    return table(spark, d, "part").select("p_partkey", v.alias("v")).select("p_partkey", "v.reason", F.array_join("v.warnings", ",").alias("warnings"))


@R.add("SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE regexp_replace(t[1:119], '\\s+\\S*$', '') || '…' END AS card FROM (SELECT doc_id, concat_ws(chr(10), 'Source: ' || source, CASE WHEN doc_id % 2 = 0 THEN 'Language: ' || lang END, replace(text, chr(10), ' ')) AS t FROM documents)".replace("\\\\", "\\"))
def card_render(spark, d):
    blocks = [("Source: ", F.col("source")), ("Language: ", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(" ")), ("", F.replace("text", F.lit("\n"), F.lit(" ")))]
    return table(spark, d, "documents").select("doc_id", P.card(blocks, 120).alias("card"))


@R.add("SELECT doc_id, text[1:60] AS text, source FROM documents WHERE text <> ''")
def compact_projection(spark, d):
    return P.compact(table(spark, d, "documents").where("text <> ''"), {"doc_id": 0, "text": 60, "source": 60})


@R.add("SELECT event_id, CAST(ts AS DATE) AS run FROM events WHERE CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) AS r FROM events ORDER BY r DESC LIMIT 7)")
def outcome_store_purge(spark, d):
    return P.purge_runs(table(spark, d, "events").select("event_id", F.to_date("ts").alias("run")), "run", 7).select("event_id", "run")


@R.add("SELECT doc_id, text[1:360] || CASE WHEN length(text) > 360 THEN '' ELSE '' END AS description, source FROM documents ORDER BY doc_id DESC LIMIT 50")
def public_catalog(spark, d):
    """The newest documents as a public list shows them: the limit is the page."""
    return table(spark, d, "documents").orderBy(F.desc("doc_id")).limit(50).select("doc_id", F.substring("text", 1, 360).alias("description"), "source")


QUERIES, ORACLE = R.queries, R.oracle
