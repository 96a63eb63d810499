"""Pages, files and plans on hand-made input."""

import json

import pytest
from pyspark.sql import functions as F

from winnowline.functions import html as H
from winnowline.functions import normalize as N
from winnowline.operators import evaluation as E
from winnowline.operators import publishing as P
from winnowline.operators import state as S
from winnowline.plans import conditions as C
from winnowline.sources import files

PAGE = """<html><head><title>A &amp; B</title><script>var x = "<p>no</p>";</script></head><body><header>Top</header>
<h1 class="big">Lead <b>Engineer</b></h1><ul><li data-k="pay">Pay: 10 - 20<li>Place: Bonn</ul><h2>Duties</h2><p>one<p>two</p><h2>More</h2><p>three</p><a class=x href='/next?a=1#f'>n</a><a href="//cdn.x/y">c</a><a href="sub/z">z</a><a href="mailto:x@y">m</a></body></html>"""


def test_steps():
    items = H.flat(PAGE)
    assert [e["tag"] for e in items][:6] == ["html", "head", "title", "script", "body", "header"] and items[3]["text"] == ""
    steps = [
        {"tag": "h1", "field": "title"}, {"tag": "li", "attr": "data-k=pay", "regex": r"(\d+ - \d+)", "field": "pay"}, {"tag": "table", "optional": True, "field": "none"}, {"tag": "li", "split": ":", "part": 1, "field": "place"},
        {"tag": "h2", "text": "duties", "offset": 1, "stop_tag": "h2", "field": "duties"}, {"tag": "a", "take": "href", "field": "next"}, {"tag": "video", "field": "end"}, {"tag": "a", "field": "never"},
    ]
    assert H.walk(items, steps) == {"title": "Lead", "pay": "10 - 20", "place": "Bonn", "duties": "one\ntwo", "next": "/next?a=1#f"}
    assert H.flat(None) == [] and H.walk([], steps) == {}


def test_open_references_stay():
    """Only a reference with its semicolon is one: a title cut inside of one keeps the rest as it is."""
    items = H.flat("<title>A&amp;&amp</title><b x='1&copy=2&gt;'>AT&T &notit; &lt;\u00a0&#233;&#23</b>")
    assert [(e["text"], e["attrs"]) for e in items] == [("A&&amp", {}), ("AT&T &notit; <\u00a0é&#23", {"x": "1&copy=2>"})]


def test_links_and_main_text(spark):
    d = spark.createDataFrame([(1, PAGE, "https://a.example/dir/page.html?q=1"), (2, None, None)], "id long, html string, url string")
    got = {r["id"]: r for r in d.select("id", H.links(F.col("html"), F.col("url")).alias("l"), H.main_text(F.col("html")).alias("t")).collect()}
    assert got[1]["l"] == ["https://a.example/next?a=1", "https://cdn.x/y", "https://a.example/dir/sub/z"]
    assert got[1]["t"].startswith("Lead Engineer\nPay: 10 - 20\nPlace: Bonn\nDuties\none") and "Top" not in got[1]["t"]


def test_postings(spark):
    one = {"@type": "JobPosting", "title": "Other", "url": "https://x/2"}
    graph = {"@context": "x", "@graph": [{"@type": "Organization", "title": "no"}, one, {"@type": "JobPosting", "title": "Mine", "url": "https://x/1", "datePosted": "2024-03-01T10:00", "hiringOrganization": {"name": "Acme"}, "jobLocation": {"address": {"addressLocality": "Bonn"}}, "baseSalary": {"currency": "EUR", "value": {"minValue": 1, "maxValue": 2.5, "unitText": "MONTH"}}}]}
    wrap = lambda *xs: "".join(f'<script type="application/ld+json">{json.dumps(x) if not isinstance(x, str) else x}</script>' for x in xs)
    pages = [(1, "https://x/1", wrap("{broken", graph)), (2, "https://x/9", wrap([one, {"@type": "JobPosting", "title": "No url"}])), (3, "https://x/3", wrap(one)), (4, "https://x/4", "<p>none</p>"), (5, None, None)]
    got = {r["id"]: r for r in H.postings(spark.createDataFrame(pages, "id long, url string, html string"), "id", "url", "html").collect()}
    assert {k: v["title"] for k, v in got.items()} == {1: "Mine", 2: "No url", 3: "Other"}
    assert (got[1]["company"], got[1]["location"], got[1]["min_amount"], got[1]["max_amount"], got[1]["period"], str(got[1]["posted"])) == ("Acme", "Bonn", 1.0, 2.5, "month", "2024-03-01")


def test_islands(spark):
    state = {"a": {"b": "x } y", "n": [1, 2]}, "k": "b"}
    html = f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(state)}</script><script>window.__NUXT__ = {{"z": "\\""}}; window.__pinia = {{broken</script><div data-page="{{&quot;p&quot;:1}}"></div>'
    got = H.found_islands(html)
    assert json.loads(got["next"]) == state and json.loads(got["nuxt"]) == {"z": '"'} and got["inertia"] == '{"p":1}' and "pinia" not in got
    d = spark.createDataFrame([(json.dumps(state),)], "j string")
    spec = {"lit": "=L", "path": "$.a.b", "both": {"concat": ["$.a.b", "=!"], "sep": ""}, "mapped": {"map": "$.k", "values": {"b": "B"}}, "looked": {"lookup": "$.k", "in": "$.a"}, "none": "$.q"}
    assert d.select(*H.map_fields(F.col("j"), spec)).first().asDict() == {"lit": "L", "path": "x } y", "both": "x } y!", "mapped": "B", "looked": "x } y", "none": None}


def test_raw_items_and_lanes(spark, tmp_path):
    good = {"source_kind": "site", "source_name": "s", "external_id": "1", "url": "https://a/b", "text": "t", "metadata": {"k": "v"}}
    lines = [good, {**good, "source_name": " "}, {**good, "external_id": "", "url": None}, {**good, "url": "ftp:x"}]
    (tmp_path / "in.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken", "", "  "]))
    ok, bad = files.read_raw_items(spark, f"file://{tmp_path}/in.jsonl")
    assert [r["metadata"] for r in ok.collect()] == [{"k": "v"}] and sorted(r["reason"] for r in bad.collect()) == ["bad_url", "blank_source", "invalid_json", "no_identity"]
    both = files.union_sources({"a": ok.select("text"), "b": ok.select("url")})
    assert sorted((r["source_id"], r["text"], r["url"]) for r in both.collect()) == [("a", "t", None), ("b", None, "https://a/b")]
    files.write_lanes(ok.withColumn("lane", F.lit("output")), f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/lane=output").count() == 1


def test_feed(spark, tmp_path):
    item = "<item><title>{0}</title><link>https://x/{0}</link><description>d</description><guid>{0}</guid><pubDate>{1}</pubDate></item>"
    dates = ["Mon, 01 Jan 2024 10:00:00 +0000", "Fri, 01 Mar 2024 10:00:00 +0100", "2024-03-02T00:00:00Z", "soon"]
    (tmp_path / "feed.xml").write_text("<rss><channel>" + "".join(item.format(i, x) for i, x in enumerate(dates)) + "</channel></rss>")
    path = f"file://{tmp_path}/feed.xml"
    assert files.read_feed(spark, path).count() == 4
    seen = spark.createDataFrame([("2",)], "guid string")
    assert [r["guid"] for r in files.read_feed(spark, path, cutoff="2024-02-01", seen=seen).collect()] == ["1"]


def test_plans(spark):
    gates = C.resolve_plan("strict", C.PRESETS)
    assert [g["name"] for g in gates] == ["garbage", "language", "quality", "long"] and gates[2]["keep"]["ge"] == 0.8
    assert [g["name"] for g in C.override(gates, {"long": {"enabled": False}, "quality": {"shadow": True}})] == ["garbage", "language", "quality"]
    with pytest.raises(ValueError):
        C.override(gates, {"typo": {}})
    with pytest.raises(ValueError):
        C.resolve_plan("a", {"a": {"extends": "b"}, "b": {"extends": "a"}})
    assert C.plan_hash({"a": 1, "b": 2}) == C.plan_hash({"b": 2, "a": 1}) != C.plan_hash({"a": 2, "b": 2})
    with pytest.raises(ValueError):
        C.compile_condition({"field": "nope", "eq": 1}, ["a"])


def test_shadow_runs_need_the_same_rows(spark):
    a, b = spark.range(5).withColumn("decision", F.lit("x")), spark.range(1, 6).withColumn("decision", F.lit("x"))
    E.require_same_ids(a, a, "id")
    with pytest.raises(ValueError):
        E.require_same_ids(a, b, "id")


def test_calibration_paths_agree(spark):
    d = spark.createDataFrame([(i / 10, float(i % 2), int(i > 4 + i % 3)) for i in range(10)] * 3, "x double, y double, gold int")
    a = E.logistic_fit(d, ["x", "y"], "gold", rounds=15)
    b = E.logistic_fit(d, ["x", "y"], "gold", rounds=15, in_memory=1)
    assert a == pytest.approx(b, abs=1e-9) and a[1] > 0
    assert E.logistic_fit(d.limit(0), ["x"], "gold") == [0.0, 0.0]


def test_pacing(spark):
    q = spark.range(100).withColumnRenamed("id", "id")
    rows = P.pacing_plan(q, ["id"], target=40, window=600.0).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(40))
    sizes = {}
    for r in rows:
        sizes.setdefault((r["burst"], r["offset"]), []).append(r["id"])
    bursts = sorted(sizes)
    assert all(2 <= len(sizes[b]) <= 4 for b in bursts[:-1]) and len(sizes[bursts[-1]]) <= 4
    offsets = [o for _, o in bursts]
    assert offsets[0] == 0 and offsets == sorted(offsets) and offsets[-1] <= 600
    assert rows == P.pacing_plan(q, ["id"], target=40, window=600.0).orderBy("id").collect()


def test_ledger_is_idempotent(spark):
    new = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (2, "a", 1)], "k long, c string, at int")
    first = S.ledger_insert(new.limit(0).select("k", "c", F.lit(0).cast("long").alias("version")), new, ["k"], "c", "at")
    assert sorted(tuple(r) for r in first.collect()) == [(1, "a", 1, 1), (1, "b", 2, 2), (2, "a", 1, 1)]
    assert S.ledger_insert(first, new, ["k"], "c", "at").count() == 0
    more = spark.createDataFrame([(1, "c", 9)], "k long, c string, at int")
    assert [tuple(r) for r in S.ledger_insert(first, more, ["k"], "c", "at").collect()] == [(1, "c", 9, 3)]


def test_pay_and_places(spark):
    cases = {"pay $5k - 3k a year gross": ("USD", 3000, 5000, "year", True), "€ 1.200 per month net": ("EUR", 1200, None, "month", False), "salary up to": (None,) * 5, "USD up to 90k": ("USD", None, 90000, None, None), "insurance $500": (None,) * 5, "insurance, and salary $500": ("USD", 500, None, None, None)}
    d = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: tuple(r["p"]) for r in d.select("t", N.pay(F.col("t")).alias("p")).collect()} == cases
    g = spark.createDataFrame([("Paris (HQ), germany; remote",), ("Lima | peru",), (None,), ("office, 123",)], "t string")
    got = [tuple(r["g"]) for r in g.select(N.geo(F.col("t"), {"germany": "Deutschland", "peru": "Peru", "france": "France"}, {"Paris": "France"}).alias("g")).collect()]
    assert got == [("Paris, France", "Paris", "France", "Deutschland->France"), ("Lima, Peru", "Lima", "Peru", None), (None, None, None, None), (None, None, None, None)]
