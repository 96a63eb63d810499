"""Rules on records, links, votes and example stores, case by case and against plain versions."""

import datetime as dt
from urllib.parse import parse_qsl, urlparse

from pyspark.sql import functions as F

from winnowline.functions import link_score as L
from winnowline.operators import examples as X
from winnowline.operators import feedback as V
from winnowline.operators import record_rules as P
from winnowline.operators import stats as A

RECORD = "id int, title string, company string, description string, canonical_url string, location string, work_mode string, compensation string, skills array<string>, risk_signals array<string>, review_reasons array<string>"


def record(i, **more):
    base = dict.fromkeys(["title", "company", "description", "canonical_url", "location", "work_mode", "compensation", "skills", "risk_signals", "review_reasons"])
    return (i, *(base | more).values())


def test_risk(spark):
    rows = [
        record(0),
        record(1, title="NFT desk", description="x" * 80, canonical_url="u"),
        record(2, company="c", description="Write to Telegram, DM me", risk_signals=["b", "a", "b"], review_reasons=["high_risk_signals"]),
        record(3, description="crypto telegram dm", risk_signals=["p", "q", "r"], review_reasons=["z"]),
    ]
    got = {r.id: r for r in P.risk(spark.createDataFrame(rows, RECORD)).collect()}
    assert got[0].risk_signals == ["low_information_density"] and (got[0].risk_score, got[0].risk_level) == (0.2, "low") and got[0].review_reasons == []
    assert got[1].risk_signals == ["suspicious_domain"]
    assert got[2].risk_signals == ["a", "b", "contact_only_apply_flow", "low_information_density"]
    assert (got[2].risk_score, got[2].risk_level, got[2].review_reasons) == (0.8, "high", ["high_risk_signals"])
    assert (got[3].risk_score, got[3].review_reasons) == (1.0, ["z", "high_risk_signals"])


def test_quality(spark):
    full = {"title": "t", "company": "c", "description": "x" * 120, "canonical_url": "u", "location": "l", "work_mode": "remote", "compensation": "1", "skills": ["s"]}
    rows = [
        record(0, **full),
        record(1, **full, risk_signals=list("abcdefgh")),
        record(2),
        record(3, title="", work_mode="unknown", risk_signals=list("ab"), description="x", skills=[]),
    ]
    got = {r.id: r for r in P.quality(spark.createDataFrame(rows, RECORD)).collect()}
    assert [got[i].quality_score for i in range(4)] == [1.0, 0.85, 0.05, -0.05]
    assert got[1].review_reasons == [] and got[2].review_reasons == ["low_quality_score"]


def test_empty_records(spark):
    assert P.quality(P.risk(spark.createDataFrame([], RECORD))).count() == 0


def test_garbage_order_and_scopes(spark):
    rules = [
        P.TextRule("first", (("head", "spam"),), (("scan", "vacancy"),)),
        P.TextRule("second", (("scan", "spam"),)),
        P.TextRule("short", (("scan", "^(?s:.{1,10})$"),)),
    ]
    pages = [P.TextRule("title", (("title", "^about$"),)), P.TextRule("list", (("path", "/jobs$"),))]
    far = "x" * 400
    rows = [
        (0, "  SPAM here", None, False, "first"),
        (1, "spam and a vacancy", None, False, "second"),
        (2, far + " spam", None, None, "second"),
        (3, "x" * 1600 + " spam", None, False, None),
        (4, None, None, True, None),
        (5, "short", None, False, "short"),
        (6, "\nAbout \nspam", "u", True, "title"),
        (7, "About\nspam", "u", False, "first"),
        (8, "spam", "http://h/JOBS/?q=1", True, "list"),
    ]
    df = spark.createDataFrame(rows, "id int, text string, url string, career boolean, want string")
    got = df.select("id", "want", P.garbage_evidence(F.col("text"), F.col("url"), F.col("career"), rules, pages).alias("got")).collect()
    assert [(r.id, r.got) for r in got] == [(r.id, r.want) for r in got]


def test_garbage_words_end_at_ascii_bounds(spark):
    """As in SQL, a letter with an accent ends a word; an escaped backslash before b is none."""
    rules = [P.TextRule("first", (("title", r"^(?:le|die)\b"),)), P.TextRule("whole", (("scan", r"\bles des\b"),)), P.TextRule("inside", (("scan", r"x\B\d|\\b"),))]
    rows = [(0, "leñ der", "first"), (1, "len", None), (2, "éles desü", "whole"), (3, "les dest", None), (4, "ax7", "inside"), (5, "x\\b", "inside"), (6, "die", "first"), (7, "x 7", None), (8, " die\u2028", "first")]
    got = spark.createDataFrame(rows, "id int, text string, want string").select("id", "want", P.garbage_evidence(F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("boolean"), rules).alias("got")).collect()
    assert [(r.id, r.got) for r in got] == [(r.id, r.want) for r in got]


def test_profile_phrases(spark):
    items = spark.createDataFrame([(0, "Data Engineer, remote"), (1, None), (2, "casino data")], "id int, text string")
    rows = [("b", 2, "data", True), ("a", 1, " Data ", True), ("a", 0, "remote", True), ("a", 3, "casino", False), ("b", 4, " ", True)]
    got = {r.id: r for r in P.profile_phrases(items, "id", F.col("text"), spark.createDataFrame(rows, "profile string, place int, phrase string, positive boolean")).collect()}
    assert (got[0].positive, got[0].negative, got[0].profiles, got[0].lexical_score) == (["remote", "data"], [], 2, 2)
    assert (got[1].positive, got[1].lexical_score) == ([], 0)
    assert (got[2].positive, got[2].negative, got[2].lexical_score) == (["data"], ["casino"], 0)


WORDS = L.LinkWords(("job", "jobs", "vacancies"), ("blog", "search", "about"), ("/news/",), r"/(?:job|jobs)(?:/.*)?/(?:[^/?#]*\d[^/?#]*)$", ("jk", "job_id"))


def test_links(spark):
    board = "https://www.acme.co.uk/jobs"
    cases = {
        "mailto:jobs@acme.co.uk": -100,
        # detail, four digits at the end, three digits, letter and digit, a long slug, a job word
        "https://acme.co.uk/jobs/data-engineer-12345": 8 + 7 + 3 + 3 + 1 + 2,
        # "search" in a numbered posting costs nothing
        "https://acme.co.uk/jobs/search-engineer-99": 8 + 3 + 1 + 2,
        # the board: same address, last word and all words are job words, jobs below jobs (for the closing slash), short without a digit, one segment with a job word, job in the path, one segment
        "https://www.acme.co.uk/jobs/": -12 - 6 - 6 - 6 - 5 - 5 + 2 - 2,
        "https://other.com/x/y/z-1": -12 + 3,
        "https://acme.co.uk/news/about/12": -8 - 15,
        "https://acme.co.uk/viewjob?jk=1&page=2": 9 + 5 - 5 - 5 + 2 - 3,
        "https://acme.co.uk/jobdesc?id=77": 16 - 5 - 5 + 2 - 2,
        "https://acme.co.uk/static/a/b.css": -50 - 20,
        "https://acme.co.uk/a/b/c.pdf#job-1": -8 - 3,
        "https://acme.co.uk/api/x/y": -12,
        # jobs below jobs, two segments that end in -jobs, job in the path
        "https://acme.co.uk/jobs/it-jobs": -6 - 12 + 2,
        "": -2,
    }
    df = spark.createDataFrame([(u, board) for u in [*cases, None]], "url string, board string")
    got = {r.url: r.score for r in df.select("url", L.link_score(F.col("url"), F.col("board"), WORDS).alias("score")).collect()}
    assert got.pop(None) is None and got == cases


def test_link_parts_against_urllib(spark):
    urls = ["https://u@A.example.com:80/p/q.html?x=1&y=&z=a=b#f", "http://h", "http://h?x=1", "/only/path?k=v", "HTTPS://H/a//b/", "https://h/%C3%A9?a=1#x?y=2"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    p = L.parts(F.col("url"))
    for r in df.select("url", *[v.alias(k) for k, v in p.items()]).collect():
        want = urlparse(r.url.lower())
        assert (r.scheme, r.host, r.path, r.query, r.fragment) == (want.scheme, want.hostname or "", want.path, want.query, want.fragment), r.url
        assert r["keys"] == [k for k, _ in parse_qsl(want.query)] and r.segments == [x for x in want.path.split("/") if x]


def test_site_families(spark):
    cases = [("jobs.acme.com", "www.acme.com", True), ("a.co.uk", "b.co.uk", False), ("x.a.co.uk", "a.co.uk", True), ("a.com", "b.com", False), ("", "b.com", True), (None, "b.com", True), ("localhost", "localhost", True)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert [r.got for r in df.select(L.same_family(F.col("a"), F.col("b")).alias("got")).collect()] == [c[2] for c in cases]


def test_listing_and_tracking(spark):
    df = spark.createDataFrame([("https://acme.com/jobs/",), ("https://acme.com/jobs/berlin",), ("https://acme.com/jobs/12345",), ("https://acme.com/",), (None,)], "url string")
    assert [r.x for r in df.select(L.is_listing(F.col("url"), F.lit("https://acme.com/jobs"), WORDS).alias("x")).collect()] == [False, True, False, False, False]
    cases = {"h?utm_source=a": "h", "h?utm_source=a&b=1": "h?b=1", "h?b=1&utm_x=2#f": "h?b=1#f", "h?b=1&UTM_x&c=2": "h?b=1&c=2", "h": "h", "h?utm_a=1&utm_b=2#x": "h#x", "h?xutm_a=1": "h?xutm_a=1"}
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.x for r in df.select("url", L.without_tracking(F.col("url")).alias("x")).collect()} == cases


VOTE = "job_id long, user_id long, at timestamp, title string, url string, source_name string, excerpt string"


def test_feedback(spark):
    day = lambda k: dt.datetime(2024, 1, k)
    rows = [(1, 1, day(2), "b", None, "s", "e" * 30), (1, 1, day(1), "a", None, "s", "e" * 30), (1, 2, day(3), "c", None, "s", "e" * 30), (2, 1, day(1), "z", None, None, "e" * 29), (2, 2, day(1), "z", None, "", "e" * 29), (3, 1, day(1), "y", None, "t", "e" * 40), (None, 1, day(1), "n", None, "t", "e"), (3, None, day(1), "n", None, "t", "e")]
    votes = V.distinct_votes(spark.createDataFrame(rows, VOTE))
    tallies = {r.job_id: (r.votes, r.title) for r in V.job_tallies(votes).collect()}
    assert tallies == {1: (2, "a"), 2: (2, "z"), 3: (1, "y")}
    assert [r.job_id for r in V.top_jobs(votes, 2).collect()] == [1, 2]
    assert {r.source_name: (r.votes, r.jobs) for r in V.source_tallies(votes).collect()} == {"s": (2, 1), "unknown": (2, 1), "t": (1, 1)}
    assert [r.job_id for r in V.promotable(V.job_tallies(votes)).collect()] == [1]
    assert V.top_jobs(votes.where("false")).count() == 0


def test_adjusted_confusion(spark):
    rows = [(True, True, None), (False, True, "dedup"), (False, True, "gate"), (False, False, "dedup"), (True, False, None), (False, True, None)]
    df = spark.createDataFrame(rows, "p boolean, g boolean, stage string")
    r = A.confusion_adjusted(df, F.col("p"), F.col("g"), F.col("stage"), "dedup").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 2, 1)


def test_example_store(spark):
    rows = [(1, "a", "vacancy:positive", "x", [1.0, 0.0]), (1, "a", "vacancy:positive", "x", [1.0, 0.0]), (1, "a", "resume:negative", "x", [0.0, 1.0]), (11, "a", "vacancy:positive", "x", [0.5, 0.5]), (1, "a", "other", "x", [1.0, 1.0]), (1, "a", "resume:positive", " ", [1.0, 1.0])]
    p = X.profile_examples(spark.createDataFrame(rows, "user_id int, tenant_id string, category string, text string, embedding array<double>"))
    store = X.add(p.where("false"), p)
    assert store.count() == 3 and X.add(store, p).count() == 3
    assert {r.role for r in X.clear(store, "user:1@tenant:a:").collect()} == {"user:11@tenant:a:vacancy:positive"}
    assert X.remove(store, store.where("label = 'negative'")).count() == 2
    items = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.margin for r in X.margins(items, store, "user:1@tenant:a:").collect()} == {0: 1.0, 1: -1.0}
    assert {r.margin for r in X.margins(items, store, "user:11@").collect()} == {None}
    near = X.nearest(items, store, "user:1@", 1).collect()
    assert {(r.query_id, r.role.split(":", 3)[3]) for r in near} == {("0", "vacancy:positive"), ("1", "resume:negative")}
    assert {r.role for r in X.nearest(items, store, "user:1", 5, "negative").collect()} == {"user:1@tenant:a:resume:negative"}


def test_phrases_are_found_in_one_pass_and_never_across_texts():
    import random

    import pyarrow as pa

    r = random.Random(5)
    texts = ["ab cd", "ef gh", "", "d", "é", "xyzzé cd"] + ["".join(r.choice("ab é") for _ in range(r.randrange(30))) for _ in range(300)]
    phrases = ["ab", "cd", "cdef", "b", "é", "b cd", "zzé cd", "aaaa", " a b", "abab", "absent"] + ["".join(r.choice("ab é") for _ in range(r.randrange(1, 7))) for _ in range(60)]
    column = pa.table({"t": pa.chunked_array([pa.array([*texts[:9], None]), pa.array(texts[9:])])}).column("t")
    assert P.phrases_in(column, [x.encode() for x in phrases]).to_pylist() == [[k for k, x in enumerate(phrases) if x in t] for t in [*texts[:9], "", *texts[9:]]]
    for few in ([], [""], ["abc"]):
        assert P.phrases_in(pa.chunked_array([pa.array(few, pa.string())]), [b"abcd", b"bc"]).to_pylist() == [[1] if t == "abc" else [] for t in few]
