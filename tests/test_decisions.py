"""Exits of the decision rules, and the numbers that follow from evidence defaults."""

import pytest
from pyspark.sql import functions as F

from winnowline.operators import decision as D

TIME = "2024-01-02 00:00:00"


def atom(item, claim, polarity="SUPPORTS", strength=1.0, reliability=0.9, subject=None, profile=None, key=None, provenance="INFERRED", ref="x", expires=None):
    subject = subject or {"IS_JOB": "vacancy", "PROFILE_RELEVANCE": "profile_relevance", "FRESHNESS": "active_vacancy"}.get(claim, claim.lower())
    key = key or f"{item}:{claim}:{polarity}:{subject}:{profile}:{provenance}"
    return (item, key, claim, subject, profile, polarity, strength, reliability, provenance, "web", key, ref, expires)


def table(spark, rows):
    schema = D.ATOM.replace("expires_at timestamp", "expires_at string")
    return spark.createDataFrame(rows, schema).withColumn("expires_at", F.col("expires_at").cast("timestamp"))


def test_evidence_numbers(spark):
    two = [atom("two", "HARD_CONSTRAINT", "CONTRADICTS", key="k1"), atom("two", "HARD_CONSTRAINT", "CONTRADICTS", key="k2")]
    rows = [
        atom("one", "HARD_CONSTRAINT", "CONTRADICTS"), *two, atom("same", "HARD_CONSTRAINT", "CONTRADICTS", key="k"), (*atom("same", "HARD_CONSTRAINT", "CONTRADICTS", 0.5, key="k")[:1], "other", *atom("same", "HARD_CONSTRAINT", "CONTRADICTS", 0.5, key="k")[2:]),
        atom("risk", "RISK", strength=1.0, reliability=0.8), atom("stale", "FRESHNESS", strength=0.1, reliability=0.2), atom("filled", "FRESHNESS", "CONTRADICTS", 1.0, 0.9),
        atom("unknown", "IS_JOB", "UNKNOWN"), atom("gone", "IS_JOB", expires=TIME), atom("both", "IS_JOB", key="a"), atom("both", "IS_JOB", "CONTRADICTS", 0.5, 0.9, key="b"),
    ]
    got = {r["item"]: r for r in D.assess(table(spark, rows), now=F.lit(TIME).cast("timestamp")).collect()}
    assert got["one"]["belief"] == pytest.approx(0.28905, abs=1e-5) and got["two"]["belief"] == pytest.approx(0.14185, abs=1e-5)
    assert got["same"]["belief"] == got["one"]["belief"] and len(got["same"]["evidence_ids"]) == 2
    assert got["risk"]["belief"] == pytest.approx(0.68997, abs=1e-5)
    assert got["stale"]["certainty"] == pytest.approx(0.03149, abs=1e-5) and got["filled"]["certainty"] == pytest.approx(0.76307, abs=1e-5)
    assert got["unknown"]["certainty"] == got["gone"]["certainty"] == 0.0 and got["unknown"]["belief"] == 0.5
    assert got["both"]["conflict"] == pytest.approx(0.5, abs=1e-6) and got["both"]["certainty"] < got["one"]["certainty"] + 0.2


def test_parameters_follow_the_family_of_the_first_atom(spark):
    rows = [(*atom("a", "IS_JOB", key="k1")[:9], "ats", *atom("a", "IS_JOB", key="k1")[10:]), atom("a", "IS_JOB", key="k2"), atom("b", "IS_JOB", key="k3")]
    params = spark.createDataFrame([("IS_JOB", "ats", 0.7, 0.5)], "claim string, family string, prior double, max_mass double")
    got = {r["item"]: r for r in D.assess(table(spark, rows), params).collect()}
    assert got["a"]["support"] == 1.0 and got["a"]["belief"] == pytest.approx(1 / (1 + (3 / 7) * 2.718281828 ** -1.0), abs=1e-6)
    assert got["b"]["belief"] == pytest.approx(1 / (1 + 2.718281828**-0.9), abs=1e-6)


JOB, FRESH = dict(claim="IS_JOB"), dict(claim="FRESHNESS", strength=0.8, reliability=0.8)
REL = dict(claim="PROFILE_RELEVANCE", profile="p")
LLM = dict(claim="PROFILE_RELEVANCE", profile="p", provenance="LLM", strength=0.6, reliability=0.85)
SURE = [dict(REL, key=f"r{i}") for i in range(2)]
EXITS = {
    "degraded": ([JOB], None, "evidence_missing"),
    "constraint": ([JOB, dict(claim="HARD_CONSTRAINT", polarity="CONTRADICTS", key="a"), dict(claim="HARD_CONSTRAINT", polarity="CONTRADICTS", key="b")], "REJECT", "confirmed_hard_constraint"),
    "risk": ([JOB, dict(claim="RISK", key="a"), dict(claim="RISK", key="b")], "REJECT", "high_risk"),
    "no_jobness": ([FRESH], None, "jobness_unknown"),
    "not_job": ([dict(claim="IS_JOB", polarity="CONTRADICTS", key="a"), dict(claim="IS_JOB", polarity="CONTRADICTS", key="b")], "REJECT", "confirmed_not_job"),
    "weak_job": ([dict(claim="IS_JOB", strength=0.1)], None, "jobness_unknown"),
    "stale": ([JOB, dict(claim="FRESHNESS", strength=0.1, reliability=0.2)], None, "freshness_unknown"),
    "no_profiles": ([JOB, FRESH], "REVIEW", "profile_relevance_unconfigured"),
    "no_relevance": ([JOB, FRESH], None, "profile_relevance_unknown"),
    "cited": ([JOB, FRESH, dict(LLM, ref="llm:relevance_evidence:1")], "ACCEPT", "profile_relevance_confirmed_by_cited_llm"),
    "strong": ([JOB, FRESH, dict(LLM, strength=0.9)], "ACCEPT", "profile_relevance_confirmed_by_strong_llm"),
    "cited_but_contradicted": ([JOB, FRESH, *SURE, dict(LLM, ref="llm:relevance_evidence:1"), dict(LLM, polarity="CONTRADICTS", strength=0.1)], "ACCEPT", "profile_relevance_confirmed"),
    "supported": ([JOB, FRESH, *SURE, LLM], "ACCEPT", "profile_relevance_confirmed"),
    "conflict": ([JOB, FRESH, *SURE, dict(LLM, polarity="CONTRADICTS", strength=0.1)], "REVIEW", "profile_relevance_uncertain"),
    "needs_llm": ([JOB, FRESH, *SURE], None, "relevance_llm_required"),
    "all_negative": ([JOB, FRESH, dict(REL, polarity="CONTRADICTS", key="a"), dict(REL, polarity="CONTRADICTS", key="b")], "REJECT", "all_profiles_rejected"),
    "middling": ([JOB, FRESH, dict(REL, strength=0.3)], "REVIEW", "profile_relevance_uncertain"),
    "nothing": ([], None, "jobness_unknown"),
}


def test_decision_exits(spark):
    atoms = table(spark, [atom(name, **a) for name, (rows, _, _) in EXITS.items() for a in rows])
    items = spark.createDataFrame([(n, ["timeout"] if n == "degraded" else [], n != "no_profiles") for n in EXITS], "item string, degraded array<string>, has_profiles boolean")
    got = {r["item"]: r for r in D.decide_items(items, atoms, D.assess(atoms)).collect()}
    assert {n: (r["decision"], r["reasons"][-1]) for n, r in got.items()} == {n: (d, why) for n, (_, d, why) in EXITS.items()}
    assert got["degraded"]["reasons"] == ["timeout", "evidence_missing"]
    assert all((r["state"] == "DEFERRED") == (r["decision"] is None) for r in got.values())


def test_aggregator_exits(spark):
    rows = [
        (1, "accept", 0.9, 0.0, 0.0, True, False, "hard_constraint_reject"), (2, "accept", 0.9, 0.0, 0.0, False, False, "llm_accept"), (3, "accept", 0.9, 0.0, 0.0, False, True, "llm_accept_profile_conflict"),
        (4, None, None, 0.6, None, False, False, "missing_llm_evidence"), (5, "reject", 0.9, 0.6, 0.0, False, False, "llm_reject"), (6, "accept", 0.1, 0.2, 0.7, False, False, "independent_signal_rescue"), (7, "accept", 0.1, None, None, False, False, "conflicting_or_incomplete_evidence"),
    ]
    d = spark.createDataFrame(rows, "id int, llm string, c double, s double, m double, hard boolean, conflict boolean, want string")
    args = [F.col(c) for c in ("llm", "c", "s", "m", "hard", "conflict")]
    r = D.aggregate_decision(*args, rescue_missing=False, rescue_reject=False, no_conflict=True)
    assert all(x["want"] == x["r"]["reason"] for x in d.select("want", r.alias("r")).collect())
    low = d.where("id = 5").withColumn("s", F.lit(0.1)).select(D.aggregate_decision(*args).alias("r")).first()["r"]
    assert (low["decision"], low["reason"]) == ("REJECT", "llm_reject_low_independent_signal")


def test_fan_out_skips_what_says_nothing(spark):
    scores = spark.createDataFrame([("i", "web", "p", True, 0.0, 0.5, 0.45, 0.55, 1.0, 0.2, 0.44, 0.56)], "item string, family string, profile string, hard_pass boolean, " + ", ".join(f"{f} double" for f in D.FEATURES))
    matches = spark.createDataFrame([("i", "web", "p", "sales"), ("i", "web", "p", "sales"), ("i", "web", "p", " ")], "item string, family string, profile string, phrase string")
    items = spark.createDataFrame([("i", "web", "unknown", 0.5, ["caps"], None, "missing", None)], "item string, family string, post_label string, post_confidence double, risks array<string>, status string, freshness string, quality double")
    got = {r["evidence_id"]: (r["polarity"], r["strength"]) for r in D.fan_out(scores, matches, items).collect()}
    assert got == {
        "i:profile:p:domain": ("CONTRADICTS", pytest.approx(0.55)), "i:profile:p:seniority": ("SUPPORTS", pytest.approx(0.55)), "i:profile:p:region": ("SUPPORTS", 1.0), "i:profile:p:salary": ("CONTRADICTS", pytest.approx(0.8)),
        "i:profile:p:culture": ("CONTRADICTS", pytest.approx(0.56)), "i:profile:p:vector": ("SUPPORTS", pytest.approx(0.56)), "i:constraint:p": ("SUPPORTS", 1.0), "i:lexical-negative:p:sales": ("CONTRADICTS", 0.95), "i:risk:caps": ("SUPPORTS", 1.0), "i:freshness": ("SUPPORTS", 0.1),
    }
