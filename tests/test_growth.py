"""Steps whose cost a row must stay small: what is read once, what is not shuffled, what is computed once."""

import contextlib
import io
import json

from pyspark.sql import functions as F

from winnowline.functions import paths as P

DIR = "/root/testdata/sf0.001"


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.select("*").explain()  # planned anew
    return out.getvalue()


def test_board_pages_are_read_once(spark):
    jobs = [{"id": 1, "at": [{"n": "a"}, {"n": "b"}, {"n": "a"}, 5, None], "k": "job"}, {"id": "x", "at": {"n": "z"}, "k": "ad"}, 7, None, {"id": [1], "at": [{"n": ""}]}]
    d = spark.createDataFrame([(0, json.dumps({"jobs": jobs})), (1, '{"jobs": {"id": 1}}'), (2, "{broken"), (3, None)], "i int, page string").withColumn("v", F.try_parse_json("page")).repartition(2)
    fields = {"a": "id", "b": "at[*].n", "c": "at[1].n"}
    r = d.select("i", P.records(F.col("v"), "jobs[?k!=ad]", fields).alias("r"))
    got = {x["i"]: [tuple(y) for y in x["r"]] for x in r.collect()}
    none = (None, None, None)
    assert got == {0: [("1", "a, b", "b"), none, none, ("[1]", None, None)], 1: [], 2: [], 3: []}
    assert plan(r).count("try_variant_get") == 1
    # One value in two types, or an absent value told from one without fields: from VARIANT path by path, as before.
    both = d.where("i = 0").select(P.records(F.col("v"), "jobs[*]", {"a": "at", "b": "at[*].n"}).alias("r")).first()["r"]
    assert [x["b"] for x in both] == ["a, b", None, None, None, None] and json.loads(both[1]["a"]) == {"n": "z"}
    assert [len(x["r"]) for x in d.orderBy("i").select(P.records(F.col("v"), "jobs", {"a": "id"}).alias("r")).collect()] == [1, 1, 0, 0]


def test_a_board_collects_its_own_lines_only(spark):
    from winnowline.catalog import QUERIES

    text = plan(QUERIES["json_boards"](spark, DIR))
    partial = next(line for line in text.splitlines() if "partial_collect_list" in line)
    assert partial.count("partial_collect_list") == 1


def test_a_small_dictionary_goes_to_the_words(spark):
    import re
    from collections import Counter

    from winnowline.operators import ontology as O

    texts = [(1, "The cat of the house; THE end of the"), (2, "of  the!the of-the"), (3, ""), (4, None), (5, "c++ the"), (6, "the"), (7, "une maison de la rue")]
    terms = [("The", "word"), ("of  the!", "phrase"), ("of the", "other"), ("of the", "other"), ("de la", "phrase"), ("C++", "word"), ("!!", "empty"), (None, "empty"), ("cat of the", "long"), ("absent", "word")]
    d = spark.createDataFrame(texts, "i int, t string")
    t = spark.createDataFrame(terms, "term string, kind string")
    words = lambda x: re.findall(r"[\w+#]+", (x or "").lower())
    known = {(" ".join(words(x)), k) for x, k in terms} - {("", "empty")}
    want = Counter()
    for i, x in texts:
        w = words(x)
        for g in w + [" ".join(p) for p in zip(w, w[1:])]:
            want.update((i, k, y) for y, k in known if y == g)
    for held in (O.HELD, 0):  # looked up in place, and shuffled to the terms
        got = O.enrich(d, "i", "t", t, held)
        assert {(r["i"], r["kind"], r["term"]): r["n"] for r in got.collect()} == dict(want)


def test_words_are_not_shuffled_to_a_small_dictionary(spark):
    from winnowline.catalog import QUERIES

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as on texts of any size
    try:
        text = plan(QUERIES["ontology_enrichment"](spark, DIR))
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_texts_are_gone_through_once_for_all_atoms(spark):
    from winnowline.catalog import QUERIES

    assert "text:string" not in plan(QUERIES["decision_terminal"](spark, DIR))


def test_post_rules_lower_a_text_once(spark):
    from winnowline.operators import decision as D

    tokens = {"candidate": ("looking",), "strong": ("hiring",), "spam": ("win",), "role": ("cook", "Baker"), "context": ("team",), "weak": ("apply",)}
    texts = ["I am LOOKING", "HIRING now", "COOK in our Team", "cooks in a team", "bAKER! team", "teammate cook", "Win", "Apply", "", None, "KÖCHIN team"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    rules = lambda words, **k: D.post_type(F.col("t"), F.lit(False), F.lit(True), words, **k)
    lowered = d.withColumn("low", F.lower("t")).select("i", rules(tokens, low=F.col("low")).alias("p"))
    want = ["candidate_seeking", "job_posting", "job_posting", "unknown", "job_posting", "unknown", "spam", "job_posting", "unknown", "unknown", "unknown"]
    for df in (lowered, d.select("i", rules(tokens).alias("p"))):
        assert [r["p"]["label"] for r in df.orderBy("i").collect()] == want
    assert plan(lowered).count("lower(") == 1
    # Beyond ASCII the pattern alone decides, which takes such letters as they are.
    other = d.select("i", rules({"role": ("köchin", "KÖCHIN"), "context": ("team",)}).alias("p"))
    assert [r["i"] for r in other.where("p.label = 'job_posting'").collect()] == [10]


def test_keys_of_titles_are_not_broadcast(spark):
    """A title has hundreds of keys, but Spark takes their table to be as small as that of the titles."""
    from winnowline.operators import fuzzy

    titles = spark.createDataFrame([(1, f"a title of some words, number {i}") for i in range(40)], "block int, title string")
    pairs = fuzzy.title_pairs(titles, 90)
    text = plan(pairs)
    assert "SortMergeJoin [key#" in text and "BroadcastHashJoin [key#" not in text
    names = [r["title"] for r in titles.collect()]
    want = {(a, b) for a in names for b in names if a < b and fuzzy.ratio(a, b) >= 90}
    assert {tuple(sorted((r["x"], r["y"]))) for r in pairs.collect()} == want and want
