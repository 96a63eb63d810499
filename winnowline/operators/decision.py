"""Classification cascades, evidence atoms and their assessment, terminal decisions and lanes.

Nothing here drops a row: each step adds a label, a reason or a lane, so a funnel is a grouping.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cases(rules: list[tuple], otherwise=None) -> Column:
    """The value of the first rule (condition, value) that holds; a null condition doesn't hold."""
    c = F.when(rules[0][0], rules[0][1])
    for condition, value in rules[1:]:
        c = c.when(condition, value)
    return c.otherwise(otherwise)


def any_of(text: Column, tokens: tuple[str, ...], low: Column | None = None) -> Column:
    """Whether the lower-cased text contains one of the tokens; ``low`` is that text, if the caller has it."""
    low = F.lower(text) if low is None else low
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in tokens], F.lit(False))


# --- what kind of post a row is -------------------------------------------------------------------------


def worded(tokens: tuple[str, ...]) -> str:
    """A pattern for one of the tokens as a whole word, in either case."""
    return r"(?i)(?:^|[^\p{L}\p{N}])(?:" + "|".join(re.escape(t) for t in tokens) + r")(?:$|[^\p{L}\p{N}])"


def post_type(text: Column, confirmed: Column, open_family: Column, tokens: dict[str, tuple[str, ...]], model: tuple[Column, Column] | None = None, least: float = 0.8, low: Column | None = None) -> Column:
    """label, confidence and model_id by the first rule that holds.

    A source's own word comes first, then candidates, strong vacancy tokens, a role in hiring context (on
    open channels and career pages only), spam, a confident model, announcements and weak tokens. The words
    of each kind, ``role`` and ``context`` among them, are the caller's; a kind without words never holds.
    ``low`` is a column with the lower-cased text: a text that isn't ASCII costs more to lower than to search,
    and each rule would lower it anew.
    """
    made = lambda label, confidence, model_id: F.struct(F.lit(label).alias("label"), F.lit(confidence).cast("double").alias("confidence"), F.lit(model_id).alias("model_id"))
    has = lambda name: any_of(text, tokens[name], low) if tokens.get(name) else F.lit(False)
    # A pattern is tried only on texts that hold one of its tokens (beyond ASCII, (?i) and lower case differ).
    near = lambda name: any_of(text, tuple(t.lower() for t in tokens[name]), low) if all(t.isascii() for t in tokens[name]) else F.lit(True)
    word = lambda name: near(name) & text.rlike(worded(tokens[name])) if tokens.get(name) else F.lit(False)
    # Labels and model ids, by which other tools know the rules.
    rules = [
        (confirmed, made("job_posting", 0.99, "source_contract")),
        (has("candidate"), made("candidate_seeking", 0.95, "rules")),
        (has("strong"), made("job_posting", 0.9, "rules")),
        (open_family & word("role") & word("context"), made("job_posting", 0.92, "shape")),
        (has("spam"), made("spam", 0.95, "rules")),
    ]
    if model is not None:
        rules.append((model[1] >= least, F.struct(model[0].alias("label"), model[1].cast("double").alias("confidence"), F.lit("model").alias("model_id"))))
    rules += [(has("announcement"), made("announcement", 0.9, "rules")), (has("weak"), made("job_posting", 0.85, "rules"))]
    return cases(rules, made("unknown", 0.5, "rules"))


def hard_filter_reasons(label: Column, text: Column, language: Column, allowed: tuple[str, ...], blocked: tuple[str, ...], override: Column) -> Column:
    """Constraint reasons in order; evidence only. An unknown or unlisted allow-list passes every language."""
    # Reason names.
    kinds = label.isin("candidate_seeking", "announcement", "spam")
    over = (label == "announcement") & override
    language_bad = F.lit(False) if not allowed else ~language.isin(*allowed) & (language != "unknown")
    parts = [F.when(kinds & over, "announcement_overridden_by_job_signal").when(kinds, F.concat(F.lit("post_type:"), label)), F.when(language_bad, F.concat(F.lit("language_not_allowed:"), language))]
    parts += [F.when(F.contains(F.lower(text), F.lit(b.lower())), f"blocked_company:{b}") for b in blocked]
    return F.array_compact(F.array(*parts))


def jobness_atom(label: Column, confidence: Column) -> tuple[Column, Column]:
    """(polarity, strength) of the claim that a row is a vacancy; null polarity where nothing is said."""
    against = label.isin("candidate_seeking", "announcement", "spam")
    supports = (label == "job_posting") & (confidence >= 0.5)
    polarity = F.when(supports, "SUPPORTS").when(against | (label == "job_posting"), "CONTRADICTS")
    return polarity, F.when(polarity.isNotNull(), confidence)


# --- evidence ----------------------------------------------------------------------------------------------

# Names of claims, polarities, provenances and features.
ATOM = "item string, evidence_id string, claim string, subject string, profile string, polarity string, strength double, reliability double, provenance string, family string, independence_key string, evidence_ref string, expires_at timestamp"
FEATURES = ("title", "skills", "domain", "seniority", "region", "salary", "culture", "vector")


def _atom(claim: str, subject: Column, profile: Column, polarity: Column, strength: Column, reliability: float, key: Column, ref: Column, provenance: str = "INFERRED") -> Column:
    evidence_id = F.concat_ws(":", F.col("item"), key)
    return F.struct(
        F.col("item").cast("string").alias("item"), evidence_id.alias("evidence_id"), F.lit(claim).alias("claim"), subject.alias("subject"), profile.cast("string").alias("profile"), polarity.alias("polarity"),
        strength.cast("double").alias("strength"), F.lit(reliability).alias("reliability"), F.lit(provenance).alias("provenance"), F.col("family").alias("family"), evidence_id.alias("independence_key"), ref.alias("evidence_ref"), F.lit(None).cast("timestamp").alias("expires_at"),
    )


def _rows(atoms: Column, df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.filter(atoms, lambda a: a["polarity"].isNotNull())).alias("a")).select("a.*")


def profile_atoms(scores: DataFrame) -> DataFrame:
    """Atoms of (item, family, profile, hard_pass, one column of each feature): features say nothing at 0 and between .45 and .55."""
    none = F.lit(None).cast("string")
    atoms = []
    for f in FEATURES:
        v = F.col(f)
        polarity = F.when((v == 0) | ((v > 0.45) & (v < 0.55)), none).when(v >= 0.5, "SUPPORTS").otherwise("CONTRADICTS")
        atoms.append(_atom("PROFILE_RELEVANCE", F.lit("profile_relevance"), F.col("profile"), polarity, F.when(v >= 0.5, v).otherwise(1 - v), 0.65, F.concat_ws(":", F.lit("profile"), "profile", F.lit(f)), F.concat(F.lit("profile_scores:"), F.col("profile"), F.lit(f":{f}"))))
    state = F.when(F.col("hard_pass"), "SUPPORTS").otherwise("CONTRADICTS")
    atoms.append(_atom("HARD_CONSTRAINT", F.lit("profile_constraints"), F.col("profile"), state, F.lit(1.0), 0.9, F.concat_ws(":", F.lit("constraint"), "profile"), F.concat(F.lit("profile_scores:"), F.col("profile"), F.lit(":hard_pass"))))
    return _rows(F.array(*atoms), scores)


def lexical_atoms(matches: DataFrame) -> DataFrame:
    """Atoms of (item, family, profile, phrase): an anti-preference contradicts, a keyword alone never supports."""
    return _rows(F.array(_atom("PROFILE_RELEVANCE", F.lit("profile_relevance"), F.col("profile"), F.lit("CONTRADICTS"), F.lit(0.95), 0.9, F.concat_ws(":", F.lit("lexical-negative"), "profile", "phrase"), F.concat(F.lit("profile:anti_preference:"), F.col("phrase")))), matches.where("trim(phrase) <> ''").distinct())


def record_atoms(items: DataFrame) -> DataFrame:
    """Atoms of (item, family, post_label, post_confidence, risks, status, freshness, quality): jobness, each risk, freshness, quality."""
    polarity, strength = jobness_atom(F.col("post_label"), F.col("post_confidence"))
    none = F.lit(None).cast("string")
    closed = (F.col("status") == "filled") | F.col("freshness").isin("closed", "filled", "expired")
    open_ = (F.col("status") == "open") | F.col("freshness").isin("explicit_status", "observed_at")
    fresh = [F.coalesce(x, F.lit(False)) for x in (closed, open_)]
    pick = lambda a, b, c: F.when(fresh[0], a).when(fresh[1], b).otherwise(c)
    q = F.col("quality")
    jobness = _atom("IS_JOB", F.lit("vacancy"), none, polarity, strength, 0.85, F.lit("jobness"), F.lit("post_type"), "CLASSIFIER")
    freshness = _atom("FRESHNESS", F.lit("active_vacancy"), none, pick(F.lit("CONTRADICTS"), F.lit("SUPPORTS"), F.lit("SUPPORTS")), pick(F.lit(1.0), F.lit(0.8), F.lit(0.1)), 0.0, F.lit("freshness"), F.lit("freshness_state")).withField("reliability", pick(F.lit(0.9), F.lit(0.8), F.lit(0.2)))
    quality = _atom("EVIDENCE_QUALITY", F.lit("structured_quality"), none, F.when(q >= 0.5, "SUPPORTS").when(q < 0.5, "CONTRADICTS"), F.when(q >= 0.5, q).otherwise(1 - q), 0.75, F.lit("quality"), F.lit("quality_score"))
    risks = F.transform("risks", lambda r: _atom("RISK", r, none, F.lit("SUPPORTS"), F.lit(1.0), 0.8, F.concat(F.lit("risk:"), r), F.concat(F.lit("risk_signals:"), r)))
    return _rows(F.concat(F.array(jobness, freshness, quality), risks), items)


def fan_out(scores: DataFrame, matches: DataFrame, items: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """All atoms of a batch: profile features, lexical conflicts, record facts and ready-made atoms (columns of ATOM)."""
    out = profile_atoms(scores).unionByName(lexical_atoms(matches)).unionByName(record_atoms(items))
    return out if given is None else out.unionByName(given)


DEFAULTS = {"prior": 0.5, "support_weight": 1.0, "contradiction_weight": 1.0, "coverage_rate": 1.6, "conflict_penalty": 0.75, "max_mass": 1.0}


def assess(atoms: DataFrame, params: DataFrame | None = None, now: Column | None = None, digits: int = 8) -> DataFrame:
    """One assessment for each (item, claim, subject, profile).

    mass = min(max_mass, strength * reliability), 0 once expired. Of one independence key and polarity only
    the heaviest atom counts, then masses add up. ``params`` has rows (claim, family, ...); the family is
    that of the first atom by evidence_id, and a pair without a row has the defaults. Unknown polarity
    adds no mass but keeps its claim in sight.
    """
    by = ["item", "claim", "subject", "profile"]
    a = atoms.withColumn("raw", F.col("strength") * F.col("reliability"))
    if now is not None:
        a = a.withColumn("raw", F.when(F.col("expires_at") <= now, 0.0).otherwise(F.col("raw")))
    heads = F.min(F.struct("evidence_id", "family"))
    per_key = a.groupBy(*by, "polarity", "independence_key").agg(F.max("raw").alias("raw"), heads.alias("head"), F.collect_set("evidence_id").alias("ids"))
    # The cap is a parameter of the claim, which the family decides: keep masses, cap them once it is known.
    side = lambda p: F.collect_list(F.when(F.col("polarity") == p, F.col("raw")))
    g = per_key.groupBy(*by).agg(side("SUPPORTS").alias("pro"), side("CONTRADICTS").alias("con"), F.min("head")["family"].alias("family"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("evidence_ids"))
    if params is not None:
        g = g.join(F.broadcast(params), ["claim", "family"], "left")  # claims x families
    for c, v in DEFAULTS.items():
        g = g.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if params is not None and c in params.columns else F.lit(v))
    total = lambda c: F.aggregate(F.array_sort(c), F.lit(0.0), lambda s, x: s + F.least(x, F.col("max_mass")))
    g = g.withColumns({"support": total("pro"), "against": total("con")})
    mass, most = F.col("support") + F.col("against"), F.greatest("support", "against")
    prior = F.least(F.greatest(F.col("prior"), F.lit(1e-6)), F.lit(1 - 1e-6))
    coverage = 1 - F.exp(-F.col("coverage_rate") * mass)
    conflict = F.when(mass > 0, F.least("support", "against") / (most + 1e-9)).otherwise(0.0)
    belief = 1 / (1 + F.exp(-(F.ln(prior / (1 - prior)) + F.col("support_weight") * F.col("support") - F.col("contradiction_weight") * F.col("against"))))
    unit = lambda c: F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), digits)
    return g.select(*by, F.round(belief, digits).alias("belief"), unit(coverage * (1 - F.col("conflict_penalty") * conflict)).alias("certainty"), unit(coverage).alias("coverage"), unit(conflict).alias("conflict"), F.round("support", digits).alias("support"), F.round("against", digits).alias("against"), "evidence_ids")


POLICY = {
    "job": (0.55, 0.50), "accept": (0.65, 0.55), "reject": (0.25, 0.75), "constraint_veto": (0.25, 0.75), "risk_veto": (0.75, 0.65), "fresh": 0.45,
}


def decide_items(items: DataFrame, atoms: DataFrame, assessments: DataFrame, policy: dict | None = None) -> DataFrame:
    """One terminal decision for each of ``items`` (item, degraded array, has_profiles boolean): decision, state and reason.

    A deferred item has no decision yet. The rules are one ordered cascade over facts of the item's
    assessments and of its language-model atoms; an item without any atom defers as well.
    """
    p = POLICY | (policy or {})
    sure = lambda k: (F.col("belief") >= p[k][0]) & (F.col("certainty") >= p[k][1])
    sure_not = lambda k: (F.col("belief") <= p[k][0]) & (F.col("certainty") >= p[k][1])
    claim, relevant = F.col("claim"), (F.col("claim") == "PROFILE_RELEVANCE") & (F.col("subject") == "profile_relevance")
    jobness = (claim == "IS_JOB") & (F.col("subject") == "vacancy")
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    facts = assessments.groupBy("item").agg(
        flag((claim == "HARD_CONSTRAINT") & sure_not("constraint_veto")).alias("constraint_veto"),
        flag((claim == "RISK") & sure("risk_veto")).alias("risk_veto"),
        flag(jobness & sure("job")).alias("is_job"),
        flag(jobness & sure_not("reject")).alias("not_job"),
        F.max(F.when(claim == "FRESHNESS", F.col("certainty"))).alias("fresh"),
        flag(relevant).alias("has_relevance"),
        F.collect_set(F.when(relevant & sure("accept"), F.coalesce("profile", F.lit("")))).alias("accepted"),
        F.coalesce(F.bool_and(F.when(relevant, sure_not("reject"))), F.lit(False)).alias("all_rejected"),
    )
    judged = (F.col("claim") == "PROFILE_RELEVANCE") & (F.col("provenance") == "LLM")
    pro = judged & (F.col("polarity") == "SUPPORTS")
    profiles = lambda c: F.collect_set(F.when(c, F.coalesce("profile", F.lit(""))))
    said = atoms.groupBy("item").agg(
        flag(pro & F.col("evidence_ref").startswith("llm:relevance_evidence:")).alias("cited"),
        flag(pro & (F.col("strength") >= 0.8) & (F.col("reliability") >= 0.8)).alias("strong"),
        flag(judged & (F.col("polarity") == "CONTRADICTS")).alias("contradicted"),
        profiles(judged).alias("judged_profiles"),
        profiles(pro).alias("supported_profiles"),
    )
    d = items.join(facts, "item", "left").join(said, "item", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    accepted = F.coalesce(F.size("accepted"), F.lit(0)) > 0
    exit_ = lambda decision, reason: F.struct(F.lit(decision).alias("decision"), F.lit("DEFERRED" if decision is None else "TERMINAL").alias("state"), F.lit(reason).alias("reason"))
    result = cases(
        [
            (F.size("degraded") > 0, exit_(None, "evidence_missing")),
            (no("constraint_veto"), exit_("REJECT", "confirmed_hard_constraint")),
            (no("risk_veto"), exit_("REJECT", "high_risk")),
            (~no("is_job") & no("not_job"), exit_("REJECT", "confirmed_not_job")),
            (~no("is_job"), exit_(None, "jobness_unknown")),
            (F.col("fresh") < p["fresh"], exit_(None, "freshness_unknown")),
            (~no("has_relevance") & ~F.col("has_profiles"), exit_("REVIEW", "profile_relevance_unconfigured")),
            (~no("has_relevance"), exit_(None, "profile_relevance_unknown")),
            (~no("contradicted") & no("cited"), exit_("ACCEPT", "profile_relevance_confirmed_by_cited_llm")),
            (~no("contradicted") & no("strong"), exit_("ACCEPT", "profile_relevance_confirmed_by_strong_llm")),
            (accepted & F.arrays_overlap("accepted", "supported_profiles"), exit_("ACCEPT", "profile_relevance_confirmed")),
            (accepted & F.arrays_overlap("accepted", "judged_profiles"), exit_("REVIEW", "profile_relevance_uncertain")),
            (accepted, exit_(None, "relevance_llm_required")),
            (no("all_rejected"), exit_("REJECT", "all_profiles_rejected")),
        ],
        exit_("REVIEW", "profile_relevance_uncertain"),
    )
    return d.select("item", result.alias("r"), "degraded").select("item", "r.decision", "r.state", F.concat("degraded", F.array("r.reason")).alias("reasons"))


def aggregate_decision(llm: Column, confidence: Column, profile_score: Column, margin: Column, hard_reject: Column, conflict: Column, accept: float = 0.55, review: float = 0.35, llm_accept: float = 0.55, rescue_missing: bool = True, rescue_reject: bool = True, no_conflict: bool = False) -> Column:
    """decision and reason from a model's word and independent scores; ``llm`` null counts as missing."""
    word = F.coalesce(llm, F.lit("missing"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    best = F.greatest(zero(profile_score), zero(margin))
    blocked = conflict & F.lit(no_conflict)
    out = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    return cases(
        [
            (hard_reject, out("REJECT", "hard_constraint_reject")),
            ((word == "accept") & (zero(confidence) >= llm_accept) & ~blocked, out("ACCEPT", "llm_accept")),
            ((word == "accept") & blocked, out("REVIEW", "llm_accept_profile_conflict")),
            ((word == "missing") & F.lit(not rescue_missing), out("REVIEW", "missing_llm_evidence")),
            ((word == "reject") & F.lit(not rescue_reject), out("REJECT", "llm_reject")),
            (best >= accept, out("ACCEPT", "independent_signal_rescue")),
            ((word == "reject") & (best < review), out("REJECT", "llm_reject_low_independent_signal")),
        ],
        out("REVIEW", "conflicting_or_incomplete_evidence"),
    )


def terminal_veto(decision: Column, status: Column, freshness: Column, risk_level: Column, constraints: Column, budget: Column, states: Column) -> Column:
    """The decision and the reason that changed it (null if none did), by policy axes that no score can outweigh.

    ``constraints`` are hard-filter reasons, ``states`` the constraint states of the chosen profile.
    """
    accepts = decision == "ACCEPT"
    out = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("veto"))
    has = lambda prefix: F.exists(constraints, lambda x: x.startswith(prefix))
    return cases(
        [
            (status.isin("filled", "expired", "delisted"), out("REJECT", "freshness_not_active")),
            (accepts & (freshness == "missing"), out("REVIEW", "freshness_evidence_missing")),
            (risk_level == "high", out("REJECT", "high_risk_veto")),
            (has("blocked_company:"), out("REJECT", "hard_constraint_blocked_company")),
            (budget == "deferred", out("REVIEW", "budget_deferred")),
            (accepts & F.array_contains(states, "contradicted"), out("REJECT", "hard_constraint_contradicted")),
            (accepts & F.array_contains(states, "unknown"), out("REVIEW", "hard_constraint_unknown")),
            (accepts & has("language_not_allowed:"), out("REVIEW", "hard_constraint_unknown_language")),
        ],
        F.struct(decision.alias("decision"), F.lit(None).cast("string").alias("veto")),
    )


def route(llm: Column, recommendation: Column, score: Column, quality: Column, accept: float = 0.6, review: float = 0.4, least_quality: float = 0.35) -> Column:
    """decision and reasons of the older routing: model, router, then score; its review band rejects."""
    low = F.coalesce(quality, F.lit(0.0)) < least_quality
    one = lambda d, *r: F.struct(F.lit(d).alias("decision"), F.array(*[x if isinstance(x, Column) else F.lit(x) for x in r]).alias("reasons"))
    word = lambda c: F.when(c == "accept", one("ACCEPT", F.lit("x"))).otherwise(one("REJECT", F.lit("x")))
    return cases(
        [
            (llm.isNotNull(), word(llm).withField("reasons", F.array(F.concat(F.lit("llm_relevance:"), llm)))),
            (recommendation.isin("accept", "reject"), word(recommendation).withField("reasons", F.array(F.concat(F.lit("uncertainty_router:"), recommendation)))),
            ((score >= accept) & ~low, one("ACCEPT", "profile_match")),
            (score >= accept, one("REJECT", "profile_match", "low_quality_score")),
            (score >= review, one("REJECT", "profile_review")),
        ],
        one("REJECT", "profile_reject"),
    )


def uncertainty_zone(score: Column, quality: Column, risk_level: Column, low: float = 0.35, high: float = 0.65) -> Column:
    """zone and recommendation; high risk is always negative, an absent quality holds nothing against either side."""
    s = F.coalesce(score, F.lit(0.0))
    out = lambda z, r: F.struct(F.lit(z).alias("zone"), F.lit(r).cast("string").alias("recommendation"))
    return cases([(risk_level.isin("high", "critical"), out("consistent_negative", "reject")), ((s < low) & (quality.isNull() | (quality < high)), out("consistent_negative", "reject")), ((s >= high) & (quality.isNull() | (quality >= low)), out("consistent_positive", "accept"))], out("disagreement", None))


PRIORITY = ("IS_JOB", "PROFILE_RELEVANCE", "HARD_CONSTRAINT", "FRESHNESS", "RISK")


def missing_evidence(assessments: DataFrame, least: float = 0.65) -> DataFrame:
    """(item, claim, subject): of the first claim by priority that is uncertain, the least certain assessment."""
    place = cases([(F.col("claim") == c, F.lit(i)) for i, c in enumerate(PRIORITY)])
    open_ = assessments.withColumn("place", place).where(F.col("place").isNotNull() & (F.col("certainty") < least))
    best = open_.groupBy("item").agg(F.min(F.struct("place", "certainty", "subject", F.coalesce("profile", F.lit("")).alias("profile"), "claim")).alias("b"))
    return best.select("item", "b.claim", "b.subject")


def compact_rules(is_job: Column, relation: Column, duties: Column, positive: Column, negative: Column, title_matches: Column, role_signal: Column) -> Column:
    """accept, review or reject from a judge's structured answer: responsibilities come before the title's relation.

    ``positive`` and ``negative`` count the evidence that the judge cites.
    """
    yes, clean = is_job == "yes", (positive > 0) & (negative == 0)
    exact = yes & (positive > 0) & title_matches
    adjacent = yes & (relation == "adjacent") & clean & ((duties == "support") | ((duties == "unknown") & role_signal))
    cited_reject = F.when(negative > 0, "reject").otherwise("review")
    return cases(
        [
            (is_job == "no", F.when((negative > 0) | (positive > 0), "reject").otherwise("review")),
            ((relation.isin("adjacent", "other") & ~exact & ~adjacent) | (duties == "contradict"), cited_reject),
            (~yes | (positive == 0), F.lit("review")),
            ((relation == "target") & ((duties == "support") | ((duties == "unknown") & exact)), F.lit("accept")),
            (adjacent, F.lit("accept")),
        ],
        F.lit("review"),
    )


def validation_reason(title: Column, company: Column, url: Column, band_score: Column, relevance: Column, decisions: Column, quality: Column, floor: float | None = None, least_relevance: float = 0.25, least_quality: float = 0.25) -> Column:
    """Why a record isn't useful, null if it is: no core field; then, unless its band score passes, relevance, profiles, quality.

    With a ``floor`` set, a missing band score means that the scorer was away and relevance isn't held against the record.
    """
    in_band = F.coalesce(band_score >= floor, F.lit(False)) if floor is not None else F.lit(False)
    judged = F.lit(True) if floor is None else band_score.isNotNull()
    return cases(
        [
            (title.isNull() & company.isNull() & url.isNull(), F.lit("missing_core_fields")),
            (in_band, F.lit(None).cast("string")),
            (judged & (F.coalesce(relevance, F.lit(0.0)) < least_relevance), F.lit("relevance_below_minimum")),
            ((F.size(decisions) > 0) & F.forall(decisions, lambda x: x == "REJECT"), F.lit("all_profiles_reject")),
            (F.coalesce(quality, F.lit(0.0)) < least_quality, F.lit("quality_below_minimum")),
        ],
        F.lit(None).cast("string"),
    )


HARD_REASONS = ("llm_relevance:reject", "profile_reject")


def lane(decision: Column, reasons: Column, quality: Column, below: float) -> Column:
    """output, review or rejected: accepted rows go out, undecided or weakly rejected ones are seen by a person."""
    hard = (decision == "REJECT") & F.exists(reasons, lambda r: (r == "no_profile_match") | r.startswith(HARD_REASONS[0]) | r.startswith(HARD_REASONS[1]))
    return cases([(decision == "ACCEPT", F.lit("output")), (decision == "REVIEW", F.lit("review")), (hard, F.lit("rejected")), ((F.size(reasons) > 0) | (F.coalesce(quality, F.lit(0.0)) < below), F.lit("review"))], F.lit("rejected"))


def triage_reason(text: Column, kind: Column, allowed: tuple[str, ...], keywords: tuple[str, ...], least_words: int = 5, least_chars: int = 30) -> Column:
    """The first cheap reason against a row; keywords of up to five characters must be whole words."""
    edge = r"[^\p{L}\p{N}]"
    pattern = "|".join(rf"(?:^|{edge}){k}(?:{edge}|$)" if len(k) <= 5 else k for k in keywords)
    return cases([(~kind.isin(*allowed), F.lit("source_kind")), (F.length(text) < least_chars, F.lit("too_short")), (F.size(F.split(F.trim(text), r"\s+")) < least_words, F.lit("too_few_words")), (~F.lower(text).rlike(pattern), F.lit("no_keyword"))], F.lit(None).cast("string"))


def finalize_parents(children: DataFrame, parent: str, final: str) -> DataFrame:
    """A parent is final once all its children are: (parent, children, open, final)."""
    return children.groupBy(parent).agg(F.count("*").alias("children"), F.count_if(~F.col(final)).alias("open"), F.bool_and(final).alias("final"))
