"""The text prefilter: weights as defined, held-out accuracy, the gate, saved versions."""

import math
import random
import re
from collections import Counter

import pytest

from winnowline.operators import prefilter as P

GOOD, BAD = ["engineer", "senior", "python", "team", "salary", "remote"], ["sale", "crypto", "casino", "bonus", "click", "spam"]


def rows(n=300, noise=0.1, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        y = int(r.random() < 0.3)
        words = [r.choice((GOOD if (y == 1) != (r.random() < noise) else BAD)) if r.random() < 0.5 else f"w{r.randrange(60)}" for _ in range(r.randrange(4, 25))]
        out.append((i, " ".join(words), y))
    return out + [(n, None, 0), (n + 1, "", 1), (n + 2, "no label here", None)]


@pytest.fixture(scope="module")
def fitted(spark):
    d = spark.createDataFrame(rows(), "doc_id long, text string, label int")
    return d, P.TextPrefilter(least_retention=0.8).fit(d)


def grams(text):
    w = re.findall(r"\w{2,}", (text or "").lower())
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def test_scores_use_the_weights_of_the_fit(spark, fitted):
    d, model = fitted
    labelled = [(k, grams(t)) for k, t, y in rows() if y is not None]
    df = Counter(t for _, c in labelled for t in c)
    terms = {r["term"]: (r["idf"], r["coef"]) for r in model.vocabulary.collect()}
    assert set(terms) == {t for t, n in df.items() if n >= 2} and model.report["dropped_terms"] == 0
    for t, (idf, _) in terms.items():
        assert idf == pytest.approx(math.log((1 + len(labelled)) / (1 + df[t])) + 1)
    got = {r["doc_id"]: r["score"] for r in model.transform(d).collect()}
    assert len(got) == len(rows())
    gradient = Counter()
    n1 = sum(y == 1 for *_, y in rows())
    for k, t, y in rows():
        x = {g: (1 + math.log(n)) * terms[g][0] for g, n in grams(t).items() if g in terms}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
        p = 1 / (1 + math.exp(-(sum(v / norm * terms[g][1] for g, v in x.items()) + model.intercept)))
        assert got[k] == pytest.approx(p, abs=1e-9)
        if y is not None:
            for g, v in x.items():
                gradient[g] += (p - y) * v / norm * len(labelled) / (2 * (n1 if y else len(labelled) - n1))
    # At the optimum the penalty's slope is that of the losses: coef = -C times their sum.
    assert all(terms[g][1] == pytest.approx(-4.0 * gradient[g], abs=0.02) for g in terms)


def test_held_out_accuracy_and_report(spark, fitted):
    _, model = fitted
    fresh = spark.createDataFrame(rows(200, seed=2)[:200], "doc_id long, text string, label int")
    scored = model.transform(fresh).collect()
    assert sum((not r["drop"]) == (r["label"] == 1) for r in scored) > 0.9 * len(scored)
    sweep = model.report["sweep"]
    assert [s["threshold"] for s in sweep] == list(P.SWEEP) and all(a["kept"] >= b["kept"] and a["positive_retention"] >= b["positive_retention"] for a, b in zip(sweep, sweep[1:]))
    assert model.report["retention"] >= 0.8 and 0.1 < model.report["holdout"] / 302 < 0.3 and 0 < model.report["holdout_positives"] < model.report["holdout"]


def test_the_gate_and_one_class(spark):
    noise = [(i, "same words for all", i % 2) for i in range(60)]
    d = spark.createDataFrame(noise, "doc_id long, text string, label int")
    with pytest.raises(ValueError, match="held-out positives"):
        P.TextPrefilter(threshold=0.9).fit(d)
    with pytest.raises(ValueError, match="two classes"):
        P.TextPrefilter().fit(d.where("label = 1"))


def test_a_bounded_vocabulary_says_what_it_leaves_out(spark):
    d = spark.createDataFrame([(1, "aa aa aa bb"), (2, "aa bb cc"), (3, "cc dd")], "doc_id long, text string")
    counts = P.gram_counts(d, "doc_id", "text")
    chosen, left = P.vocabulary_of(counts, 3, 2)
    assert sorted(r["term"] for r in chosen.collect()) == ["aa", "aa bb"] and left == {"dropped_terms": 2, "dropped_share": 0.4}


def test_versions(spark, fitted, tmp_path):
    d, model = fitted
    registry = P.Registry(spark, f"file://{tmp_path}/models")
    assert registry.current() is None
    with pytest.raises(ValueError):
        registry.load()
    for version in ("one", "two"):
        registry.save(model, version)
        registry.promote(version)
    assert registry.current() == "two" and registry.rollback() == "one" and registry.current() == "one"
    again = registry.load()
    assert again.report == model.report
    want, got = ({r["doc_id"]: r["score"] for r in m.transform(d).collect()} for m in (model, again))
    assert got == pytest.approx(want)
    with pytest.raises(Exception):
        registry.promote("absent")


def test_blocks_send_a_term_once_and_get_known_terms_back(spark):
    from pyspark.sql import functions as F

    from winnowline.operators import extraction as X

    texts = [(i % 40, f"Alpha beta w{i % 7} alpha x{i}") for i in range(60)] + [(None, "alpha beta"), (99, None), (100, ""), (101, "only_here")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for block_bytes in (1, 16 << 20):
        blocks = X.TextBlocks(docs, "doc_id", "text", block_bytes)
        terms = blocks.terms().collect()
        assert len(terms) == len({(r["block"], r["term"]) for r in terms})
        counts = {}
        for k, t in texts:
            counts[k] = counts.get(k, Counter()) + grams(t)
        df = Counter(t for c in counts.values() for t in c)
        assert {t: sum(r["df"] for r in terms if r["term"] == t) for t in df} == df and (len({r["block"] for r in terms}) > 1) == (block_bytes == 1)
        known = X.inverse_frequencies(blocks.terms(), len(texts)).withColumn("coef", F.length("term") - 4.5)
        got = blocks.scores(known).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(k for k, _ in texts)
        for r in got:
            x = {t: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in counts[r["doc_id"]].items() if df[t] >= 2} if r["doc_id"] is not None else {}
            assert r["z"] == pytest.approx(sum(v * (len(t) - 4.5) for t, v in x.items()) / (math.sqrt(sum(v * v for v in x.values())) or 1))


def test_a_step_of_the_fit_has_as_many_gradients_as_cores(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    parts, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df, *a: (parts.append(df.rdd.getNumPartitions()), fit(self, df, *a))[1])
    d = spark.createDataFrame(rows(), "doc_id long, text string, label int").repartition(40)
    blocks = P.TextBlocks
    monkeypatch.setattr(P, "TextBlocks", lambda *a, **k: blocks(*a, **(k | {"block_bytes": 256})))
    size = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a partition for each file, as large files have
    try:
        P.TextPrefilter(least_retention=0.0).fit(d)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", size)
    assert len(parts) == 2 and max(parts) <= spark.sparkContext.defaultParallelism
