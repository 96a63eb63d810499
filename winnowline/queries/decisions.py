"""Decision queries: post types, constraint reasons, evidence atoms, assessments, terminal decisions, lanes."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnowline.functions import text as T
from winnowline.operators import decision as D
from winnowline.queries import Registry, table
from winnowline.queries.records import QUALITY_SQL, RISKS_SQL
from winnowline.sources.scratch import stored

R = Registry()

TOKENS = {"candidate": ("scum", "moron"), "strong": ("and the the",), "spam": ("idiot", "***"), "announcement": (" und ", " les "), "weak": ("tion of", " el "), "role": ("oning", "their", "leau"), "context": ("ering", "las", "une")}


# Braces are doubled, for the SQL is halved below.
_WORDS = {k: D.worded(TOKENS[k]).replace('{', '{{').replace('}', '}}') for k in ('role', 'context')}


def _any_sql(name: str) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{t}')" for t in TOKENS[name]) + ")"


JOINED_SQL = "SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS item, d.text, d.lang, d.source AS family, d.source, d.n_chars, l.quality AS gold, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"
POST_SQL = f"""SELECT *, r.label, r.confidence, r.model_id FROM (SELECT *, CASE WHEN doc_id % 50 = 0 THEN {{{{'label': 'job_posting', 'confidence': 0.99::DOUBLE, 'model_id': 'source_contract'}}}}
WHEN {_any_sql('candidate')} THEN {{{{'label': 'candidate_seeking', 'confidence': 0.95::DOUBLE, 'model_id': 'rules'}}}} WHEN {_any_sql('strong')} THEN {{{{'label': 'job_posting', 'confidence': 0.9::DOUBLE, 'model_id': 'rules'}}}}
WHEN doc_id % 2 = 0 AND regexp_matches(text, '{_WORDS['role']}') AND regexp_matches(text, '{_WORDS['context']}') THEN {{{{'label': 'job_posting', 'confidence': 0.92::DOUBLE, 'model_id': 'shape'}}}}
WHEN {_any_sql('spam')} THEN {{{{'label': 'spam', 'confidence': 0.95::DOUBLE, 'model_id': 'rules'}}}} WHEN 0.5 + 0.4 * gold >= 0.8 THEN {{{{'label': 'job_posting', 'confidence': (0.5::DOUBLE + 0.4::DOUBLE * gold), 'model_id': 'model'}}}}
WHEN {_any_sql('announcement')} THEN {{{{'label': 'announcement', 'confidence': 0.9::DOUBLE, 'model_id': 'rules'}}}} WHEN {_any_sql('weak')} THEN {{{{'label': 'job_posting', 'confidence': 0.85::DOUBLE, 'model_id': 'rules'}}}}
ELSE {{{{'label': 'unknown', 'confidence': 0.5::DOUBLE, 'model_id': 'rules'}}}} END AS r FROM ({JOINED_SQL}))""".replace("{{", "{").replace("}}", "}")


def _joined(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("item"), "text", "lang", F.col("source").alias("family"), "n_chars")
    return docs.join(table(spark, d, "labels").withColumnRenamed("quality", "gold"), "doc_id", "left")


def _posts(spark, d):
    model = (F.lit("job_posting"), 0.5 + 0.4 * F.col("gold"))
    return _joined(spark, d).withColumn("low", F.lower("text")).withColumn("post", D.post_type(F.col("text"), F.col("doc_id") % 50 == 0, F.col("doc_id") % 2 == 0, TOKENS, model, low=F.col("low")))


@R.add(f"SELECT doc_id, label, round(confidence, 4) AS confidence, model_id FROM ({POST_SQL})")
def post_type_cascade(spark, d):
    return _posts(spark, d).select("doc_id", "post.label", F.round("post.confidence", 4).alias("confidence"), "post.model_id")


HARD_SQL = f"""SELECT doc_id, list_filter([CASE WHEN label IN ('candidate_seeking', 'announcement', 'spam') THEN CASE WHEN label = 'announcement' AND gold = 1 THEN 'announcement_overridden_by_job_signal' ELSE 'post_type:' || label END END,
CASE WHEN lang NOT IN ('en', 'de') AND lang <> 'unknown' THEN 'language_not_allowed:' || lang END, CASE WHEN contains(lower(text), 'thereing') THEN 'blocked_company:Thereing' END], lambda x: x IS NOT NULL) AS reasons FROM ({POST_SQL})"""


def _constraints(spark, d):
    p = _posts(spark, d)
    reasons = D.hard_filter_reasons(F.col("post.label"), F.col("text"), F.col("lang"), ("en", "de"), ("Thereing",), F.coalesce(F.col("gold") == 1, F.lit(False)))
    return p.select("*", reasons.alias("reasons"))


@R.add(f"SELECT doc_id, array_to_string(reasons, ',') AS reasons FROM ({HARD_SQL})")
def hard_filter(spark, d):
    return _constraints(spark, d).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


# Two profiles; their features are functions of the row, so both engines see the same numbers.
FEATURES = {
    "title": ("((doc_id + {k}) % 11) / 10.0", lambda k: (F.col("doc_id") + k) % 11 / 10),
    "skills": ("least(1.0, n_chars / 3000.0)", lambda k: F.least(F.lit(1.0), F.col("n_chars") / 3000)),
    "domain": ("CASE WHEN lang = 'en' THEN 0.9 ELSE 0.2 END", lambda k: F.when(F.col("lang") == "en", 0.9).otherwise(0.2)),
    "seniority": ("0.5", lambda k: F.lit(0.5)),
    "region": ("((doc_id + {k}) % 7) / 8.0", lambda k: (F.col("doc_id") + k) % 7 / 8),
    "salary": ("0.0", lambda k: F.lit(0.0)),
    "culture": ("CASE WHEN lang = 'fr' THEN 1.0 ELSE 0.0 END", lambda k: F.when(F.col("lang") == "fr", 1.0).otherwise(0.0)),
    "vector": ("CASE WHEN gold = 1 THEN 0.75 WHEN gold = 0 THEN 0.25 ELSE 0.5 END", lambda k: F.when(F.col("gold") == 1, 0.75).when(F.col("gold") == 0, 0.25).otherwise(0.5)),
}
PROFILES = {"p1": 0, "p2": 4}
PHRASES = ("idiot", "scum", "***")
PASS_SQL = {"p1": "lang <> 'fr'", "p2": "doc_id % 5 <> 0"}

ATOM_COLUMNS = "item, evidence_id, claim, subject, profile, polarity, strength::DOUBLE AS strength, reliability::DOUBLE AS reliability, provenance, family, evidence_id AS independence_key, evidence_ref"


def _feature_sql(profile: str, k: int) -> list[str]:
    out = []
    for f, (sql, _) in FEATURES.items():
        out.append(f"SELECT item, concat_ws(':', item, 'profile', '{profile}', '{f}') AS evidence_id, 'PROFILE_RELEVANCE' AS claim, 'profile_relevance' AS subject, '{profile}' AS profile, CASE WHEN v >= 0.5 THEN 'SUPPORTS' ELSE 'CONTRADICTS' END AS polarity, CASE WHEN v >= 0.5 THEN v ELSE 1 - v END AS strength, 0.65 AS reliability, 'INFERRED' AS provenance, family, 'profile_scores:{profile}:{f}' AS evidence_ref FROM (SELECT item, family, ({sql.format(k=k)})::DOUBLE AS v FROM post) WHERE v <> 0 AND NOT (v > 0.45 AND v < 0.55)")
    out.append(f"SELECT item, concat_ws(':', item, 'constraint', '{profile}'), 'HARD_CONSTRAINT', 'profile_constraints', '{profile}', CASE WHEN {PASS_SQL[profile]} THEN 'SUPPORTS' ELSE 'CONTRADICTS' END, 1.0, 0.9, 'INFERRED', family, 'profile_scores:{profile}:hard_pass' FROM post")
    return out


AGAINST = "label IN ('candidate_seeking', 'announcement', 'spam')"
ATOMS_CTE = f"""WITH post AS ({POST_SQL}), facts AS (SELECT *, {RISKS_SQL} AS risks, {QUALITY_SQL} AS quality, CASE WHEN doc_id % 13 = 0 THEN 'filled' WHEN doc_id % 3 = 0 THEN 'open' END AS status, CASE doc_id % 4 WHEN 0 THEN 'explicit_status' WHEN 1 THEN 'observed_at' WHEN 2 THEN 'locator_only' ELSE 'missing' END AS fresh FROM (SELECT * FROM post)),
atoms AS (SELECT {ATOM_COLUMNS} FROM ({' UNION ALL '.join(s for p, k in PROFILES.items() for s in _feature_sql(p, k))}
UNION ALL SELECT item, concat_ws(':', item, 'lexical-negative', 'p1', phrase), 'PROFILE_RELEVANCE', 'profile_relevance', 'p1', 'CONTRADICTS', 0.95, 0.9, 'INFERRED', family, 'profile:anti_preference:' || phrase FROM post, (VALUES {', '.join(f"('{p}')" for p in PHRASES)}) x(phrase) WHERE contains(lower(text), phrase)
UNION ALL SELECT item, item || ':jobness', 'IS_JOB', 'vacancy', NULL, CASE WHEN label = 'job_posting' AND confidence >= 0.5 THEN 'SUPPORTS' ELSE 'CONTRADICTS' END, confidence, 0.85, 'CLASSIFIER', family, 'post_type' FROM post WHERE {AGAINST} OR label = 'job_posting'
UNION ALL SELECT item, item || ':freshness', 'FRESHNESS', 'active_vacancy', NULL, CASE WHEN status = 'filled' THEN 'CONTRADICTS' ELSE 'SUPPORTS' END, CASE WHEN status = 'filled' THEN 1.0 WHEN status = 'open' OR fresh IN ('explicit_status', 'observed_at') THEN 0.8 ELSE 0.1 END, CASE WHEN status = 'filled' THEN 0.9 WHEN status = 'open' OR fresh IN ('explicit_status', 'observed_at') THEN 0.8 ELSE 0.2 END, 'INFERRED', family, 'freshness_state' FROM facts
UNION ALL SELECT item, item || ':quality', 'EVIDENCE_QUALITY', 'structured_quality', NULL, CASE WHEN quality >= 0.5 THEN 'SUPPORTS' ELSE 'CONTRADICTS' END, CASE WHEN quality >= 0.5 THEN quality ELSE 1 - quality END, 0.75, 'INFERRED', family, 'quality_score' FROM facts
UNION ALL SELECT item, concat_ws(':', item, 'risk', r), 'RISK', r, NULL, 'SUPPORTS', 1.0, 0.8, 'INFERRED', family, 'risk_signals:' || r FROM (SELECT item, family, unnest(risks) AS r FROM facts)
UNION ALL SELECT item, item || ':llm', 'PROFILE_RELEVANCE', 'profile_relevance', 'p1', CASE WHEN gold = 1 THEN 'SUPPORTS' ELSE 'CONTRADICTS' END, CASE WHEN doc_id % 3 = 0 THEN 0.9 ELSE 0.6 END, 0.85, 'LLM', family, CASE WHEN doc_id % 2 = 0 THEN 'llm:relevance_evidence:' ELSE 'llm:score:' END FROM post WHERE gold IS NOT NULL))"""


def _atoms(spark, d):
    # Texts are gone through once; every kind of atom is made, twice for a decision, from what they say.
    phrases = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(p)), F.lit(p)) for p in PHRASES]))
    facts = _posts(spark, d).withColumn("risks", T.risks(F.col("text")))
    facts = facts.select("doc_id", "item", "lang", "family", "n_chars", "gold", "post", "risks", T.quality(F.col("text"), F.col("lang"), F.col("family"), F.col("risks")).alias("quality"), phrases.alias("phrases"))
    posts = stored(facts)
    scores = None
    for p, k in PROFILES.items():
        hard = F.col("lang") != "fr" if p == "p1" else F.col("doc_id") % 5 != 0
        s = posts.select("item", "family", F.lit(p).alias("profile"), hard.alias("hard_pass"), *[f(k).cast("double").alias(n) for n, (_, f) in FEATURES.items()])
        scores = s if scores is None else scores.unionByName(s)
    matches = posts.select("item", "family", F.lit("p1").alias("profile"), F.explode("phrases").alias("phrase"))
    status = F.when(F.col("doc_id") % 13 == 0, "filled").when(F.col("doc_id") % 3 == 0, "open")
    fresh = F.element_at(F.array(*map(F.lit, ("explicit_status", "observed_at", "locator_only", "missing"))), (F.col("doc_id") % 4 + 1).cast("int"))
    items = posts.select("item", "family", F.col("post.label").alias("post_label"), F.col("post.confidence").alias("post_confidence"), "risks", status.alias("status"), fresh.alias("freshness"), "quality")
    judge = posts.where("gold IS NOT NULL").select(
        "item", F.concat("item", F.lit(":llm")).alias("evidence_id"), F.lit("PROFILE_RELEVANCE").alias("claim"), F.lit("profile_relevance").alias("subject"), F.lit("p1").alias("profile"), F.when(F.col("gold") == 1, "SUPPORTS").otherwise("CONTRADICTS").alias("polarity"),
        F.when(F.col("doc_id") % 3 == 0, 0.9).otherwise(0.6).alias("strength"), F.lit(0.85).alias("reliability"), F.lit("LLM").alias("provenance"), "family", F.concat("item", F.lit(":llm")).alias("independence_key"), F.when(F.col("doc_id") % 2 == 0, "llm:relevance_evidence:").otherwise("llm:score:").alias("evidence_ref"), F.lit(None).cast("timestamp").alias("expires_at"),
    )
    return D.fan_out(scores, matches, items, judge)


@R.add(ATOMS_CTE + " SELECT item, evidence_id, claim, subject, profile, polarity, round(strength, 6) AS strength, reliability FROM atoms")
def evidence_fanout(spark, d):
    return _atoms(spark, d).select("item", "evidence_id", "claim", "subject", "profile", "polarity", F.round("strength", 6).alias("strength"), "reliability")


# Parameters by claim and source family; other pairs have the defaults.
PARAMS = [("IS_JOB", "src0", 0.7), ("PROFILE_RELEVANCE", "src0", 0.4), ("FRESHNESS", "src3", 0.55), ("RISK", "src5", 0.15)]
PARAMS_SQL = "(VALUES " + ", ".join(f"('{c}', '{f}', {v}::DOUBLE)" for c, f, v in PARAMS) + ") p(claim, family, prior)"
ASSESS_SQL = f"""{ATOMS_CTE}, keyed AS (SELECT item, claim, subject, profile, polarity, independence_key, max(strength * reliability) AS raw, min(family) AS family FROM atoms GROUP BY ALL),
sums AS (SELECT item, claim, subject, profile, min(family) AS family, coalesce(sum(least(raw, 1.0)) FILTER (polarity = 'SUPPORTS'), 0) AS pro, coalesce(sum(least(raw, 1.0)) FILTER (polarity = 'CONTRADICTS'), 0) AS con FROM keyed GROUP BY ALL),
params AS (SELECT sums.*, coalesce(prior, 0.5) AS prior, pro + con AS mass FROM sums LEFT JOIN {PARAMS_SQL} USING (claim, family)),
claims AS (SELECT item, claim, subject, profile, 1 / (1 + exp(-(ln(prior / (1 - prior)) + pro - con))) AS belief, (1 - exp(-1.6 * mass)) * (1 - 0.75 * least(pro, con) / (greatest(pro, con) + 1e-9)) AS certainty, 1 - exp(-1.6 * mass) AS coverage, least(pro, con) / (greatest(pro, con) + 1e-9) AS conflict FROM params)"""


def _assessed(spark, d, atoms):
    return D.assess(atoms, spark.createDataFrame(PARAMS, "claim string, family string, prior double"), digits=12)


@R.add(ASSESS_SQL + " SELECT item, claim, subject, profile, round(belief, 5) AS belief, round(certainty, 5) AS certainty, round(coverage, 5) AS coverage, round(conflict, 5) AS conflict FROM claims")
def evidence_param_join(spark, d):
    a = _assessed(spark, d, _atoms(spark, d))
    return a.select("item", "claim", "subject", "profile", *[F.round(c, 5).alias(c) for c in ("belief", "certainty", "coverage", "conflict")])


REL = "claim = 'PROFILE_RELEVANCE' AND subject = 'profile_relevance'"
DECIDE_SQL = f"""{ASSESS_SQL}, f AS (SELECT item, bool_or(claim = 'HARD_CONSTRAINT' AND belief <= 0.25 AND certainty >= 0.75) AS constraint_veto, bool_or(claim = 'RISK' AND belief >= 0.75 AND certainty >= 0.65) AS risk_veto,
bool_or(claim = 'IS_JOB' AND belief >= 0.55 AND certainty >= 0.5) AS is_job, bool_or(claim = 'IS_JOB' AND belief <= 0.25 AND certainty >= 0.75) AS not_job, max(CASE WHEN claim = 'FRESHNESS' THEN certainty END) AS fresh, bool_or({REL}) AS has_relevance,
coalesce(list(profile) FILTER ({REL} AND belief >= 0.65 AND certainty >= 0.55), []) AS accepted, coalesce(bool_and(belief <= 0.25 AND certainty >= 0.75) FILTER ({REL}), false) AS all_rejected FROM claims GROUP BY item),
s AS (SELECT item, bool_or(llm AND polarity = 'SUPPORTS' AND starts_with(evidence_ref, 'llm:relevance_evidence:')) AS cited, bool_or(llm AND polarity = 'SUPPORTS' AND strength >= 0.8 AND reliability >= 0.8) AS strong, bool_or(llm AND polarity = 'CONTRADICTS') AS contradicted,
coalesce(list(DISTINCT profile) FILTER (llm), []) AS judged, coalesce(list(DISTINCT profile) FILTER (llm AND polarity = 'SUPPORTS'), []) AS supported FROM (SELECT *, claim = 'PROFILE_RELEVANCE' AND provenance = 'LLM' AS llm FROM atoms) GROUP BY item),
r AS (SELECT item, CASE WHEN doc_id % 40 = 7 THEN 'degraded' WHEN constraint_veto THEN 'confirmed_hard_constraint' WHEN risk_veto THEN 'high_risk' WHEN NOT is_job AND not_job THEN 'confirmed_not_job' WHEN NOT is_job THEN 'jobness_unknown' WHEN fresh < 0.45 THEN 'freshness_unknown'
WHEN NOT has_relevance AND doc_id % 2 = 0 THEN 'profile_relevance_unconfigured' WHEN NOT has_relevance THEN 'profile_relevance_unknown' WHEN NOT contradicted AND cited THEN 'profile_relevance_confirmed_by_cited_llm' WHEN NOT contradicted AND strong THEN 'profile_relevance_confirmed_by_strong_llm'
WHEN len(accepted) > 0 AND list_has_any(accepted, supported) THEN 'profile_relevance_confirmed' WHEN len(accepted) > 0 AND list_has_any(accepted, judged) THEN 'profile_relevance_uncertain' WHEN len(accepted) > 0 THEN 'relevance_llm_required' WHEN all_rejected THEN 'all_profiles_rejected' ELSE 'profile_relevance_uncertain' END AS reason FROM post JOIN f USING (item) JOIN s USING (item))
SELECT item, CASE WHEN reason LIKE 'profile_relevance_confirmed%' THEN 'ACCEPT' WHEN reason IN ('confirmed_hard_constraint', 'high_risk', 'confirmed_not_job', 'all_profiles_rejected') THEN 'REJECT' WHEN reason IN ('profile_relevance_unconfigured', 'profile_relevance_uncertain') THEN 'REVIEW' END AS decision,
CASE WHEN reason = 'degraded' THEN 'timeout,evidence_missing' ELSE reason END AS reasons FROM r"""


@R.add(DECIDE_SQL)
def decision_terminal(spark, d):
    atoms = _atoms(spark, d)
    items = _joined(spark, d).select("item", F.when(F.col("doc_id") % 40 == 7, F.array(F.lit("timeout"))).otherwise(F.array().cast("array<string>")).alias("degraded"), (F.col("doc_id") % 2 != 0).alias("has_profiles"))
    return D.decide_items(items, atoms, _assessed(spark, d, atoms)).select("item", "decision", F.array_join("reasons", ",").alias("reasons"))


@R.add(f"""{ASSESS_SQL}, o AS (SELECT item, claim, subject, certainty, coalesce(profile, '') AS profile, CASE claim WHEN 'IS_JOB' THEN 0 WHEN 'PROFILE_RELEVANCE' THEN 1 WHEN 'HARD_CONSTRAINT' THEN 2 WHEN 'FRESHNESS' THEN 3 WHEN 'RISK' THEN 4 END AS place FROM claims)
SELECT item, claim, subject FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY place, certainty, subject, profile) AS n FROM o WHERE place IS NOT NULL AND certainty < 0.65) WHERE n = 1""")
def need_more_evidence(spark, d):
    return D.missing_evidence(_assessed(spark, d, _atoms(spark, d)))


SIGNALS_SQL = f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN gold = 1 THEN 'accept' WHEN gold = 0 THEN 'reject' END AS llm, (doc_id % 10) / 10.0::DOUBLE AS confidence, (doc_id % 17) / 20.0::DOUBLE AS score, (doc_id % 5) / 8.0::DOUBLE AS margin, doc_id % 23 = 0 AS hard, coalesce(toxic = 1, false) AS conflict, {QUALITY_SQL} AS quality, {RISKS_SQL} AS risks, lang, text FROM ({JOINED_SQL})"


def _signals(spark, d):
    j, i = _joined(spark, d), F.col("doc_id")
    risks = T.risks(F.col("text"))
    llm = F.when(i % 3 == 0, F.lit(None).cast("string")).when(F.col("gold") == 1, "accept").when(F.col("gold") == 0, "reject")
    return j.select("doc_id", llm.alias("llm"), (i % 10 / 10).alias("confidence"), (i % 17 / 20).alias("score"), (i % 5 / 8).alias("margin"), (i % 23 == 0).alias("hard"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("conflict"), T.quality(F.col("text"), F.col("lang"), F.col("family"), risks).alias("quality"), risks.alias("risks"), "lang", "text")


@R.add(f"""SELECT doc_id, r.decision, r.reason FROM (SELECT doc_id, CASE WHEN hard THEN {{'decision': 'REJECT', 'reason': 'hard_constraint_reject'}} WHEN llm = 'accept' AND confidence >= 0.55 AND NOT conflict THEN {{'decision': 'ACCEPT', 'reason': 'llm_accept'}} WHEN llm = 'accept' AND conflict THEN {{'decision': 'REVIEW', 'reason': 'llm_accept_profile_conflict'}}
WHEN greatest(score, margin) >= 0.55 THEN {{'decision': 'ACCEPT', 'reason': 'independent_signal_rescue'}} WHEN llm = 'reject' AND greatest(score, margin) < 0.35 THEN {{'decision': 'REJECT', 'reason': 'llm_reject_low_independent_signal'}} ELSE {{'decision': 'REVIEW', 'reason': 'conflicting_or_incomplete_evidence'}} END AS r FROM ({SIGNALS_SQL}))""")
def decision_aggregator(spark, d):
    c = F.col
    r = D.aggregate_decision(c("llm"), c("confidence"), c("score"), c("margin"), c("hard"), c("conflict"), no_conflict=True)
    return _signals(spark, d).select("doc_id", r.alias("r")).select("doc_id", "r.decision", "r.reason")


@R.add(f"""SELECT doc_id, CASE WHEN llm = 'accept' THEN 'ACCEPT' WHEN llm IS NOT NULL THEN 'REJECT' WHEN score >= 0.6 AND quality >= 0.35 THEN 'ACCEPT' ELSE 'REJECT' END AS decision,
CASE WHEN llm IS NOT NULL THEN 'llm_relevance:' || llm WHEN score >= 0.6 AND quality >= 0.35 THEN 'profile_match' WHEN score >= 0.6 THEN 'profile_match,low_quality_score' WHEN score >= 0.4 THEN 'profile_review' ELSE 'profile_reject' END AS reasons FROM ({SIGNALS_SQL})""")
def legacy_routing(spark, d):
    r = D.route(F.col("llm"), F.lit(None).cast("string"), F.col("score"), F.col("quality"))
    return _signals(spark, d).select("doc_id", r.alias("r")).select("doc_id", "r.decision", F.array_join("r.reasons", ",").alias("reasons"))


@R.add(f"SELECT doc_id, CASE WHEN len(risks) >= 2 OR (score < 0.35 AND quality < 0.65) THEN 'consistent_negative' WHEN score >= 0.65 AND quality >= 0.35 THEN 'consistent_positive' ELSE 'disagreement' END AS zone, CASE WHEN len(risks) >= 2 OR (score < 0.35 AND quality < 0.65) THEN 'reject' WHEN score >= 0.65 AND quality >= 0.35 THEN 'accept' END AS recommendation FROM ({SIGNALS_SQL})")
def uncertainty_router(spark, d):
    z = D.uncertainty_zone(F.col("score"), F.col("quality"), F.when(F.size("risks") >= 2, "high").otherwise("low"))
    return _signals(spark, d).select("doc_id", z.alias("z")).select("doc_id", "z.zone", "z.recommendation")


@R.add(f"""WITH x AS (SELECT s.*, reasons, CASE WHEN score >= 0.4 THEN 'ACCEPT' ELSE 'REVIEW' END AS before, CASE WHEN s.doc_id % 31 = 0 THEN 'filled' ELSE 'open' END AS status FROM ({SIGNALS_SQL}) s JOIN ({HARD_SQL}) USING (doc_id)),
y AS (SELECT doc_id, before, CASE WHEN status = 'filled' THEN 'freshness_not_active' WHEN before = 'ACCEPT' AND doc_id % 4 = 3 THEN 'freshness_evidence_missing' WHEN len(risks) >= 3 THEN 'high_risk_veto' WHEN len(list_filter(reasons, lambda r: starts_with(r, 'blocked_company:'))) > 0 THEN 'hard_constraint_blocked_company' WHEN doc_id % 29 = 0 THEN 'budget_deferred'
WHEN before = 'ACCEPT' AND lang = 'es' THEN 'hard_constraint_contradicted' WHEN before = 'ACCEPT' AND lang = 'fr' AND doc_id % 2 = 0 THEN 'hard_constraint_unknown' WHEN before = 'ACCEPT' AND len(list_filter(reasons, lambda r: starts_with(r, 'language_not_allowed:'))) > 0 THEN 'hard_constraint_unknown_language' END AS veto FROM x)
SELECT doc_id, CASE WHEN veto IS NULL THEN before WHEN veto IN ('freshness_not_active', 'high_risk_veto', 'hard_constraint_blocked_company', 'hard_constraint_contradicted') THEN 'REJECT' ELSE 'REVIEW' END AS decision, veto FROM y""")
def terminal_veto(spark, d):
    s = _signals(spark, d).join(_constraints(spark, d).select("doc_id", "reasons"), "doc_id")
    states = F.array(F.when(F.col("lang") == "es", "contradicted").when((F.col("lang") == "fr") & (F.col("doc_id") % 2 == 0), "unknown").otherwise("present"))
    v = D.terminal_veto(F.when(F.col("score") >= 0.4, "ACCEPT").otherwise("REVIEW"), F.when(F.col("doc_id") % 31 == 0, "filled").otherwise("open"), F.when(F.col("doc_id") % 4 == 3, "missing").otherwise("observed_at"), F.when(F.size("risks") >= 3, "high").otherwise("low"), F.col("reasons"), F.when(F.col("doc_id") % 29 == 0, "deferred"), states)
    return s.select("doc_id", v.alias("v")).select("doc_id", "v.decision", "v.veto")


@R.add(f"SELECT doc_id, CASE WHEN lane = 'output' THEN 'output' WHEN lane = 'x' THEN 'review' ELSE 'rejected' END AS lane FROM (SELECT doc_id, CASE WHEN llm = 'accept' OR (llm IS NULL AND score >= 0.6 AND quality >= 0.35) THEN 'output' WHEN llm IS NULL AND score >= 0.4 AND score < 0.6 THEN 'x2' WHEN llm IS NULL AND score >= 0.6 THEN 'x' ELSE 'rejected' END AS lane FROM ({SIGNALS_SQL}))")
def lane_predicates(spark, d):
    s = _signals(spark, d)
    s = s.withColumn("r", D.route(F.col("llm"), F.lit(None).cast("string"), F.col("score"), F.col("quality")))
    reasons = F.transform("r.reasons", lambda x: F.when(x == "profile_review", "profile_reject").otherwise(x))  # a band that rejects is a hard reject here
    return s.select("doc_id", D.lane(F.col("r.decision"), reasons, F.col("quality"), 0.5).alias("lane"))


ANSWERS = ["yes", "no", "unsure"]
RELATIONS = ["target", "adjacent", "other"]
DUTIES = ["support", "unknown", "contradict"]
JUDGE_SQL = "SELECT event_id, (CASE event_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unsure' END) AS is_job0, CASE WHEN event_id % 5 < 3 THEN 'yes' ELSE (CASE event_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unsure' END) END AS is_job, CASE user_id % 3 WHEN 0 THEN 'target' WHEN 1 THEN 'adjacent' ELSE 'other' END AS relation, CASE (event_id // 7) % 3 WHEN 0 THEN 'support' WHEN 1 THEN 'unknown' ELSE 'contradict' END AS duties, (event_id // 3) % 3 AS pos, (event_id // 11) % 2 AS neg, event_type = 'click' AS title, event_type = 'view' AS signal FROM events"


@R.add(f"""SELECT event_id, CASE WHEN is_job = 'no' THEN CASE WHEN pos > 0 OR neg > 0 THEN 'reject' ELSE 'review' END WHEN (relation IN ('adjacent', 'other') AND NOT exact AND NOT adj) OR duties = 'contradict' THEN CASE WHEN neg > 0 THEN 'reject' ELSE 'review' END WHEN is_job <> 'yes' OR pos = 0 THEN 'review'
WHEN relation = 'target' AND (duties = 'support' OR (duties = 'unknown' AND exact)) THEN 'accept' WHEN adj THEN 'accept' ELSE 'review' END AS verdict FROM (SELECT *, is_job = 'yes' AND pos > 0 AND title AS exact, is_job = 'yes' AND relation = 'adjacent' AND pos > 0 AND neg = 0 AND (duties = 'support' OR (duties = 'unknown' AND signal)) AS adj FROM ({JUDGE_SQL}))""")
def compact_evidence_rules(spark, d):
    i = F.col("event_id")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % 3 + 1).cast("int"))
    e = table(spark, d, "events").select("event_id", F.when(i % 5 < 3, "yes").otherwise(pick(ANSWERS, i)).alias("is_job"), pick(RELATIONS, F.col("user_id")).alias("relation"), pick(DUTIES, F.floor(i / 7)).alias("duties"), (F.floor(i / 3) % 3).alias("pos"), (F.floor(i / 11) % 2).alias("neg"), (F.col("event_type") == "click").alias("title"), (F.col("event_type") == "view").alias("signal"))
    return e.select("event_id", D.compact_rules(*[F.col(c) for c in ("is_job", "relation", "duties", "pos", "neg", "title", "signal")]).alias("verdict"))


@R.add(f"""SELECT doc_id, CASE WHEN doc_id % 37 = 0 THEN 'missing_core_fields' WHEN margin >= 0.5 THEN NULL WHEN doc_id % 6 <> 0 AND score < 0.25 THEN 'relevance_below_minimum' WHEN doc_id % 19 = 0 THEN 'all_profiles_reject' WHEN quality < 0.25 THEN 'quality_below_minimum' END AS reason FROM ({SIGNALS_SQL})""")
def job_validation(spark, d):
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    core = F.when(i % 37 != 0, "x").otherwise(none)
    decisions = F.when(i % 19 == 0, F.array(F.lit("REJECT"), F.lit("REJECT"))).otherwise(F.array(F.lit("REJECT"), F.lit("REVIEW")))
    # A row with a low band score has been judged; where the score is absent the scorer was away.
    band = F.when((i % 6 != 0) | (F.col("margin") >= 0.5), F.col("margin"))
    return _signals(spark, d).select("doc_id", D.validation_reason(core, none, none, band, F.col("score"), decisions, F.col("quality"), 0.5).alias("reason"))


@R.add("SELECT doc_id, CASE WHEN source NOT IN ('src0', 'src1', 'src2', 'src3', 'src5', 'src8', 'src9') THEN 'source_kind' WHEN length(text) < 30 THEN 'too_short' WHEN len(string_split_regex(trim(text), '\\s+')) < 5 THEN 'too_few_words' WHEN NOT regexp_matches(lower(text), '(?:^|[^\\p{L}\\p{N}])the(?:[^\\p{L}\\p{N}]|$)|(?:^|[^\\p{L}\\p{N}])und(?:[^\\p{L}\\p{N}]|$)|ention') THEN 'no_keyword' END AS reason FROM documents".replace("\\\\", "\\"))
def heuristic_triage(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", D.triage_reason(F.col("text"), F.col("source"), ("src0", "src1", "src2", "src3", "src5", "src8", "src9"), ("the", "und", "ention")).alias("reason"))


@R.add("SELECT conv_id, count(*) AS children, count(*) FILTER (length(text) > 400) AS open, bool_and(length(text) <= 400) AS final FROM conversations GROUP BY conv_id")
def parent_finalization(spark, d):
    c = table(spark, d, "conversations").select("conv_id", (F.length("text") <= 400).alias("final"))
    return D.finalize_parents(c, "conv_id", "final")


QUERIES, ORACLE = R.queries, R.oracle
