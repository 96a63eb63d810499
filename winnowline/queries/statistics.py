"""Statistics queries: runs, sources, classification metrics, thresholds, correlations, streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnowline.functions import text as T
from winnowline.operators import source_quality
from winnowline.operators import stats as A
from winnowline.plans.counters import NodeCounters
from winnowline.queries import Registry, table
from winnowline.queries.records import QUALITY_SQL
from winnowline.sources.scratch import shared_folder, stored
from winnowline.streaming import ingest, stateful

R = Registry()


@R.add("SELECT CAST(ts AS DATE) AS run, count(*) AS fetched, count(DISTINCT user_id) AS sources, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS emitted, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (event_type = 'purchase') / count(*), 4) ELSE 0 END AS conversion FROM events GROUP BY 1")
def run_stats(spark, d):
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("run"))
    n = e.agg(F.count("*").alias("fetched"), F.countDistinct("user_id").alias("sources"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "purchase").alias("emitted"))
    return n.withColumn("conversion", A.ratio(F.col("emitted"), F.col("fetched")))


@R.add("SELECT CAST(ts AS DATE) AS run, user_id, count(*) AS fetched, CASE WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'ok' END AS status FROM events GROUP BY ALL")
def source_run_stats(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("run"), "user_id").agg(F.count("*").alias("fetched"), F.when(F.bool_or(F.col("event_type") == "error"), "failed").otherwise("ok").alias("status"))


@R.add("SELECT user_id, count(*) AS attempted, count(*) FILTER (NOT bad) AS ok, round(avg(n), 4) AS mean_yield, count(*) >= 8 AND count(*) FILTER (bad) / count(*) <= 0.15 AS reliable FROM (SELECT user_id, CAST(ts AS DATE) AS run, count(*) AS n, bool_or(event_type = 'error') AS bad FROM events GROUP BY ALL) WHERE run IN (SELECT DISTINCT CAST(ts AS DATE) AS r FROM events ORDER BY r DESC LIMIT 20) GROUP BY user_id")
def source_quality_window(spark, d):
    per = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("run")).agg(F.count("*").alias("n"), F.bool_or(F.col("event_type") == "error").alias("bad"))
    newest = per.select("run").distinct().orderBy(F.desc("run")).limit(20)  # the window is 20 runs
    g = per.join(newest, "run", "left_semi").groupBy("user_id").agg(F.count("*").alias("attempted"), F.count_if(~F.col("bad")).alias("ok"), F.round(F.avg("n"), 4).alias("mean_yield"))
    return g.withColumn("reliable", (F.col("attempted") >= 8) & ((F.col("attempted") - F.col("ok")) / F.col("attempted") <= 0.15))


@R.add("SELECT CASE WHEN event_type = 'error' THEN 'other' WHEN event_type = 'view' THEN 'seen' ELSE 'low_relevance' END AS bucket, count(*) AS n, count(*) >= 0.8 * (SELECT count(*) FROM events) AS dominant FROM events GROUP BY 1")
def drop_buckets(spark, d):
    e = table(spark, d, "events")
    bucket = F.when(F.col("event_type") == "error", "other").when(F.col("event_type") == "view", "seen").otherwise("low_relevance")
    g = e.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("bucket", "n", (F.col("n") >= 0.8 * F.col("total")).alias("dominant"))  # one row


@R.add("SELECT event_type AS node, count(*) AS entered, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean_value FROM events GROUP BY event_type")
def node_stats(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("node")).agg(F.count("*").alias("entered"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("mean_value"))


@R.add("SELECT CAST(ts AS DATE) AS run, event_type, count(*) AS n FROM events GROUP BY ROLLUP (CAST(ts AS DATE), event_type)")
def rollup_run_totals(spark, d):
    return table(spark, d, "events").rollup(F.to_date("ts").alias("run"), "event_type").agg(F.count("*").alias("n"))


@R.add("SELECT event_id % 50 AS item, count(DISTINCT user_id) AS votes FROM events WHERE event_type = 'click' GROUP BY 1 HAVING count(DISTINCT user_id) >= 2")
def feedback_tally(spark, d):
    e = table(spark, d, "events").where("event_type = 'click'")
    return e.groupBy((F.col("event_id") % 50).alias("item")).agg(F.countDistinct("user_id").alias("votes")).where("votes >= 2")


SCORED_SQL = f"SELECT doc_id, source, lang, {QUALITY_SQL} AS score, quality AS gold, toxic FROM documents JOIN labels USING (doc_id)"


def _scored(spark, d):
    # Only labelled documents are scored.
    s = table(spark, d, "documents").select("doc_id", "source", "lang", "text").join(table(spark, d, "labels").withColumnRenamed("quality", "gold"), "doc_id")
    return s.select("doc_id", "source", "lang", T.quality(F.col("text"), F.col("lang"), F.col("source"), T.risks(F.col("text"))).alias("score"), "gold", "toxic")


CONFUSION_SQL = "SELECT {by} tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 4) ELSE 0 END AS f1 FROM (SELECT {by} count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn, count(*) FILTER (NOT p AND NOT g) AS tn FROM (SELECT *, score >= 0.6 AS p, gold = 1 AS g FROM ({scored})) {group})"


@R.add(CONFUSION_SQL.format(by="", group="", scored=SCORED_SQL))
def confusion_metrics(spark, d):
    return A.confusion(_scored(spark, d), F.col("score") >= 0.6, F.col("gold") == 1)


@R.add(CONFUSION_SQL.format(by="lang,", group="GROUP BY lang", scored=SCORED_SQL))
def slice_metrics(spark, d):
    return A.confusion(_scored(spark, d), F.col("score") >= 0.6, F.col("gold") == 1, ["lang"])


CURVE_SQL = f"SELECT threshold, tp::BIGINT AS tp, (n - tp)::BIGINT AS fp, CASE WHEN n > 0 THEN round(tp / n, 6) ELSE 0 END AS precision, CASE WHEN pos > 0 THEN round(tp / pos, 6) ELSE 0 END AS recall, CASE WHEN n + pos > 0 THEN round(2 * tp / (n + pos), 6) ELSE 0 END AS f1 FROM (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(c) OVER (ORDER BY threshold DESC) AS n, sum(p) OVER () AS pos FROM (SELECT score AS threshold, sum(gold) AS p, count(*) AS c FROM ({SCORED_SQL}) GROUP BY score))"


@R.add(CURVE_SQL)
def threshold_sweep(spark, d):
    return A.threshold_curve(_scored(spark, d), "score", "gold")


@R.add(f"SELECT threshold, f1 FROM ({CURVE_SQL}) ORDER BY f1 DESC, threshold DESC LIMIT 1")
def best_f1_threshold(spark, d):
    return A.threshold_curve(_scored(spark, d), "score", "gold").orderBy(F.desc("f1"), F.desc("threshold")).limit(1).select("threshold", "f1")


@R.add(f"SELECT threshold, precision, recall FROM ({CURVE_SQL}) WHERE precision >= 0.8 ORDER BY recall DESC, threshold DESC LIMIT 1")
def precision_floor_threshold(spark, d):
    return A.threshold_curve(_scored(spark, d), "score", "gold").where("precision >= 0.8").orderBy(F.desc("recall"), F.desc("threshold")).limit(1).select("threshold", "precision", "recall")


@R.add("SELECT l_returnflag, " + ", ".join(f"max(CASE WHEN i = round((n - 1) * {q / 100}::DOUBLE) THEN l_extendedprice END) AS q{q}" for q in (25, 50, 95)) + " FROM (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) GROUP BY l_returnflag")
def nearest_rank_quantiles(spark, d):
    return A.nearest_rank(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", [0.25, 0.5, 0.95])


PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_tax")]


@R.add("SELECT " + ", ".join(f"round(corr({a}, {b}), 6) AS c{i}" for i, (a, b) in enumerate(PAIRS)) + " FROM lineitem")
def corr_matrix(spark, d):
    return table(spark, d, "lineitem").agg(*[F.round(F.corr(a, b), 6).alias(f"c{i}") for i, (a, b) in enumerate(PAIRS)])


RANK_SQL = "SELECT {0}, coalesce(sum(t) OVER (ORDER BY {0} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS r{1} FROM (SELECT {0}, count(*) AS t FROM lineitem GROUP BY {0})"


@R.add(f"SELECT round(corr(r1::DOUBLE, r2::DOUBLE), 6) AS rho FROM lineitem JOIN ({RANK_SQL.format('l_quantity', 1)}) USING (l_quantity) JOIN ({RANK_SQL.format('l_discount', 2)}) USING (l_discount)")
def spearman(spark, d):
    t = table(spark, d, "lineitem").select("l_quantity", "l_discount")
    a, b = (A.average_ranks(t, c).withColumnRenamed("rank", r) for c, r in (("l_quantity", "r1"), ("l_discount", "r2")))
    return t.join(a, "l_quantity").join(b, "l_discount").agg(F.round(F.corr("r1", "r2"), 6).alias("rho"))


@R.add("WITH h AS (SELECT quality, round, ('0x' || substr(sha256(concat_ws(':', doc_id, round)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM labels, range(100) r(round)), w AS (SELECT quality, round, CASE WHEN u < 0.36787944 THEN 0 WHEN u < 0.73575888 THEN 1 WHEN u < 0.91969860 THEN 2 WHEN u < 0.98101184 THEN 3 ELSE 4 END AS k FROM h) SELECT round::INTEGER AS round, sum(k)::BIGINT AS n, round(sum(k * quality)::DOUBLE / sum(k), 6) AS mean FROM w GROUP BY round")
def bootstrap_ci(spark, d):
    return A.bootstrap_means(table(spark, d, "labels"), "doc_id", "quality", 100)


@R.add(f"SELECT score >= 0.6 AS before, score >= 0.8 AS after, count(*) AS n, count(*) FILTER (gold = 1) AS positives FROM ({SCORED_SQL}) GROUP BY 1, 2")
def transition_matrix(spark, d):
    return _scored(spark, d).groupBy((F.col("score") >= 0.6).alias("before"), (F.col("score") >= 0.8).alias("after")).agg(F.count("*").alias("n"), F.count_if(F.col("gold") == 1).alias("positives"))


@R.add(f"SELECT unnest(list_filter([CASE WHEN n < 500 THEN 'too_few_rows' END, CASE WHEN pos < 100 THEN 'too_few_positives' END, CASE WHEN share > 0.5 THEN 'unbalanced' END, CASE WHEN toxic > 0.1 THEN 'toxic' END], lambda x: x IS NOT NULL)) AS violation FROM (SELECT count(*) AS n, sum(gold) AS pos, avg(gold) AS share, avg(toxic) AS toxic FROM ({SCORED_SQL}))")
def release_gates(spark, d):
    s = _scored(spark, d).agg(F.count("*").alias("n"), F.sum("gold").alias("pos"), F.avg("gold").alias("share"), F.avg("toxic").alias("toxic"))
    checks = [F.when(F.col("n") < 500, "too_few_rows"), F.when(F.col("pos") < 100, "too_few_positives"), F.when(F.col("share") > 0.5, "unbalanced"), F.when(F.col("toxic") > 0.1, "toxic")]
    return s.select(F.explode(F.array_compact(F.array(*checks))).alias("violation"))


@R.add(r"SELECT lang, term, n, rank::INTEGER AS rank FROM (SELECT lang, term, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM (SELECT lang, term, count(DISTINCT doc_id) AS n FROM (SELECT lang, doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents) GROUP BY ALL)) WHERE rank <= 20")
def term_stats(spark, d):
    from winnowline.operators.inverted import tokens

    t = table(spark, d, "documents").select("lang", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    return t.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "term"))).where("rank <= 20")  # a top-k report


@R.add("SELECT event_id, max_by(price, length(name)) AS price FROM (SELECT event_id, event_type || '-' || (user_id % 3) AS used FROM events) JOIN (VALUES ('view', 0.5::DOUBLE), ('view-1', 0.7::DOUBLE), ('click', 0.2::DOUBLE), ('purchase-2', 2.0::DOUBLE)) p(name, price) ON used = name OR starts_with(used, name || '-') GROUP BY event_id")
def cost_prefix_lookup(spark, d):
    prices = spark.createDataFrame([("view", 0.5), ("view-1", 0.7), ("click", 0.2), ("purchase-2", 2.0)], "name string, price double")
    e = table(spark, d, "events").select("event_id", F.concat_ws("-", "event_type", F.col("user_id") % 3).alias("used"))
    # Every prefix that ends before a dash, and the whole name: an equi-join instead of a range of prefixes.
    parts = F.split("used", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))
    j = e.select("event_id", F.explode(prefixes).alias("name")).join(F.broadcast(prices), "name")  # four constant rows
    return j.groupBy("event_id").agg(F.max_by("price", F.length("name")).alias("price"))


@R.add("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_health(spark, d):
    return ingest.windowed_health(table(spark, d, "events"))


@R.add("SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def session_health(spark, d):
    return ingest.sessions(table(spark, d, "events"))


@R.add("SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def stream_ingest_dedup(spark, d):
    """A file stream of the events, one row kept of each user, type and day, run over what is there."""
    import uuid

    e = table(spark, d, "events")
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = ingest.file_stream(spark, f"{d}/events*.parquet", e.schema).select("user_id", "event_type", "ts", F.concat_ws("|", "user_id", "event_type", F.to_date("ts")).alias("key"))
    stream = ingest.dedup_stream(stream, "key", "ts", "60 days")
    return ingest.run_available(stream.select("user_id", "event_type", F.to_date("ts").alias("day")), f"{base}/out", f"{base}/state")


@R.add("SELECT DISTINCT sha256(concat_ws('|', user_id, event_type)) AS idempotency_key FROM events WHERE event_type = 'purchase'")
def stream_outbox(spark, d):
    """Outbox rows appended batch by batch; a key that is there already isn't sent again."""
    import uuid

    e = table(spark, d, "events")
    base = f"{shared_folder(spark)}/outbox-{uuid.uuid4().hex}"
    s = ingest.file_stream(spark, f"{d}/events*.parquet", e.schema).where("event_type = 'purchase'").select(F.sha2(F.concat_ws("|", "user_id", "event_type"), 256).alias("idempotency_key"))
    for run in range(2):  # the second run reads everything again and adds nothing
        s.writeStream.foreachBatch(ingest.outbox_writer(f"{base}/out", "idempotency_key")).option("checkpointLocation", f"{base}/state{run}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("bucket")


CLAIMS_SQL = """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS row, CASE event_type WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'release' ELSE 'other' END AS action, CAST(CAST(ts AS DATE) AS VARCHAR) AS claim, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT key, 0::BIGINT AS n, NULL::BIGINT AS row, NULL::VARCHAR AS outcome, NULL::VARCHAR AS held, NULL::BIGINT AS since, NULL::BIGINT AS marked FROM (SELECT DISTINCT key FROM e)
UNION ALL SELECT key, n, row, outcome, CASE outcome WHEN 'granted' THEN claim WHEN 'committed' THEN NULL WHEN 'released' THEN NULL ELSE held END, CASE outcome WHEN 'granted' THEN ms WHEN 'committed' THEN NULL WHEN 'released' THEN NULL ELSE since END, CASE outcome WHEN 'committed' THEN ms ELSE marked END
FROM (SELECT e.key, e.n, e.row, e.claim, e.ms, r.held, r.since, r.marked, CASE WHEN e.action = 'claim' THEN CASE WHEN r.marked IS NOT NULL AND e.ms < r.marked + 432000000 THEN 'duplicate' WHEN r.held IS NOT NULL AND e.ms < r.since + 43200000 AND r.held <> e.claim THEN 'busy' ELSE 'granted' END
WHEN e.action = 'other' THEN 'ignored' WHEN r.held IS NOT NULL AND e.ms < r.since + 43200000 AND r.held = e.claim THEN CASE e.action WHEN 'commit' THEN 'committed' ELSE 'released' END ELSE 'stale' END AS outcome FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1))
SELECT key, row, outcome FROM r WHERE n > 0"""


def _claim_rows(events):
    action = F.when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "error", "release").otherwise("other")
    return events.select(F.col("user_id").alias("key"), F.col("event_id").alias("row"), action.alias("action"), F.to_date("ts").cast("string").alias("claim"), F.col("ts").cast("timestamp").alias("at"))


@R.add(CLAIMS_SQL)
def claim_settlement(spark, d):
    """Views claim a user's day for twelve hours, purchases commit it for five days, errors release it."""
    return stateful.claims_batch(_claim_rows(table(spark, d, "events")), "5 days", "12 hours")


@R.add(CLAIMS_SQL)
def stream_claims(spark, d):
    """The same as a stream over the file, with its state in a checkpoint."""
    import uuid

    base = f"{shared_folder(spark)}/claims-{uuid.uuid4().hex}"
    stream = _claim_rows(ingest.file_stream(stateful.with_state_store(spark), f"{d}/events*.parquet", table(spark, d, "events").schema))
    return ingest.run_available(stateful.claims_stream(stream, "5 days", "12 hours", "60 days"), f"{base}/out", f"{base}/state")


@R.add("SELECT o_custkey AS parent, count(*) AS children FROM orders GROUP BY o_custkey HAVING bool_and(o_orderstatus <> 'P')")
def stream_parents(spark, d):
    """Customers whose orders have all ended, each once, from a stream of orders."""
    import uuid

    orders = table(spark, d, "orders")
    base = f"{shared_folder(spark)}/parents-{uuid.uuid4().hex}"
    expected = orders.groupBy("o_custkey").agg(F.count("*").alias("expected"))
    stream = ingest.file_stream(stateful.with_state_store(spark), f"{d}/orders*.parquet", orders.schema).join(expected, "o_custkey")
    rows = stream.select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("child"), (F.col("o_orderstatus") != "P").alias("final"), "expected")
    return ingest.run_available(stateful.finished_parents(rows), f"{base}/out", f"{base}/state")


STATUS_SQL = "CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'Rate_Limited ' END WHEN 'signup' THEN 'skipped' WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'partial' ELSE '' END ELSE 'done' END"
ERROR_SQL = "CASE WHEN event_id % 11 = 0 THEN 'ConnectTimeout after 3 s' WHEN event_id % 13 = 0 THEN 'source_hard_deadline_exceeded' END"


def _outcome(events):
    k = F.col("event_id")
    status = F.when(F.col("event_type") == "error", F.when(k % 2 == 0, "failed").otherwise("Rate_Limited ")).when(F.col("event_type") == "signup", "skipped").when(F.col("event_type") == "click", F.when(k % 3 == 0, "partial").otherwise("")).otherwise("done")
    error = F.when(k % 11 == 0, "ConnectTimeout after 3 s").when(k % 13 == 0, "source_hard_deadline_exceeded")
    return events.withColumns({"status": status, "error": error})


@R.add(f"""SELECT category, count(*) AS n FROM (SELECT CASE WHEN s = 'partial' THEN 'partial' WHEN contains(e, 'connecttimeout') THEN 'transport_error' WHEN s IN ('failed', 'rate_limited') OR contains(e, 'source_hard_deadline_exceeded') THEN 'hard_failure' WHEN s = 'skipped' THEN 'skipped' WHEN s = '' THEN 'unknown' ELSE 'ok' END AS category
FROM (SELECT lower(trim({STATUS_SQL})) AS s, lower(coalesce({ERROR_SQL}, '')) AS e FROM events)) GROUP BY category""")
def status_categories(spark, d):
    """Events as source outcomes, by category."""
    e = _outcome(table(spark, d, "events"))
    return e.groupBy(source_quality.status_category(F.col("status"), F.col("error")).alias("category")).agg(F.count("*").alias("n"))


@R.add(f"""WITH o AS (SELECT CAST(ts AS DATE) AS run, CAST(user_id // 3 AS VARCHAR) AS key, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS sent, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS yielded, {STATUS_SQL} IN ('failed', 'Rate_Limited ') AND {STATUS_SQL} = 'failed' AS bad FROM events),
w AS (SELECT run FROM (SELECT run, count(*) AS n FROM o GROUP BY run) WHERE n >= 10 AND NOT day(run) IN (5, 15) ORDER BY run DESC LIMIT 20),
p AS (SELECT run, key, sum(yielded) AS y, sum(sent) AS m, bool_and(bad) AS failed FROM o WHERE run IN (SELECT run FROM w) GROUP BY ALL),
g AS (SELECT key, count(*) AS attempted, count(*) FILTER (failed) AS fail, count(*) FILTER (y > 0) AS yield_hits, count(*) FILTER (m > 0) AS relevant_hits, sum(y)::BIGINT AS yield_sum, sum(m)::BIGINT AS emitted_sum FROM p GROUP BY key)
SELECT g.*, (SELECT count(*) FROM w) AS window_runs, attempted - fail AS ok, attempted >= greatest(8, floor(0.8 * (SELECT count(*) FROM w))) AND fail / attempted <= 0.15 AND (attempted - fail) / attempted >= 0.8 AS reliable, attempted >= 4 AND yield_hits / attempted >= 0.5 AS rich, attempted >= 4 AND relevant_hits / attempted >= 0.5 AS high_relevance,
round((attempted - fail) / attempted, 4) AS ok_rate, round(yield_hits / attempted, 4) AS yield_rate, round(relevant_hits / attempted, 4) AS relevant_rate FROM g""")
def source_quality_rules(spark, d):
    """Days as runs (two of a month skipped), users as keyword clones of a third as many sources."""
    e = _outcome(table(spark, d, "events")).withColumn("run", F.to_date("ts"))
    clone = F.concat(F.lit("site:"), F.floor(F.col("user_id") / 3).cast("string"), F.lit("_kw"), (F.col("user_id") % 3).cast("string"))
    runs = e.groupBy("run").agg(F.max("ts").alias("at"), F.count("*").alias("fetched")).withColumn("skipped", F.dayofmonth("run").isin(5, 15))
    outcomes = e.select("run", clone.alias("source_id"), F.lit(None).cast("string").alias("source_name"), "status", F.when(F.col("event_type") == "view", 1).otherwise(0).alias("yielded"))
    emitted = e.where("event_type = 'purchase'").groupBy("run", clone.alias("source_id")).agg(F.count("*").alias("emitted"))
    return source_quality.rolling_quality(runs, outcomes, emitted).select("key", "attempted", "fail", "yield_hits", "relevant_hits", "yield_sum", "emitted_sum", "window_runs", "ok", "reliable", "rich", "high_relevance", "ok_rate", "yield_rate", "relevant_rate")


@R.add("""WITH a AS (SELECT *, CASE event_type WHEN 'error' THEN 'errors' WHEN 'signup' THEN 'skipped' ELSE 'passed' END AS o FROM events), b AS (SELECT *, CASE WHEN value < 20 THEN 'dropped' ELSE 'passed' END AS p FROM a WHERE o = 'passed'), n AS (SELECT 'parse' AS node, o, value FROM a UNION ALL SELECT 'relevance', p, value FROM b UNION ALL SELECT 'deliver', 'passed', value FROM b WHERE p = 'passed')
SELECT node, count(*) AS entered, count(*) FILTER (o = 'passed') AS passed, count(*) FILTER (o = 'dropped') AS dropped, count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o = 'errors') AS errors, round(count(*) FILTER (o = 'passed') / count(*), 4) AS conversion, round(avg(value), 4) AS mean_cost FROM n GROUP BY node""")
def node_counters(spark, d):
    """Three nodes counted while their result is written, in one pass."""
    c = NodeCounters()
    parsed = F.when(F.col("event_type") == "error", "errors").when(F.col("event_type") == "signup", "skipped").otherwise("passed")
    kept = c.watch(table(spark, d, "events"), "parse", parsed, F.col("value")).where(parsed == "passed")
    relevant = F.when(F.col("value") < 20, "dropped").otherwise("passed")
    kept = c.watch(kept, "relevance", relevant, F.col("value")).where(relevant == "passed")
    stored(c.watch(kept, "deliver", F.lit("passed"), F.col("value")))
    return c.rows(spark).withColumn("mean_cost", F.round("mean_cost", 4))


QUERIES, ORACLE = R.queries, R.oracle
