"""Column functions on noisy text: cleaning, ids, script ratios, reasons and additive scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 20000


def sanitize(text: Column) -> Column:
    """Drop control characters but line feeds and tabs, collapse blanks in lines, drop blank lines, cut at the last space before the limit."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B-\x1F\x7F]", "")
    lines = F.transform(F.split(bare, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    clean = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    head = F.substring(clean, 1, LIMIT)
    at_space = F.regexp_replace(head, " [^ ]*$", "")
    return F.when(F.length(clean) <= LIMIT, clean).when(F.instr(head, " ") > 0, at_space).otherwise(head)


def stable_id(*parts: Column) -> Column:
    """sha256 of the lowered, trimmed, non-blank parts."""
    kept = [F.when(F.trim(p.cast("string")) != "", F.lower(F.trim(p.cast("string")))) for p in parts]
    return F.sha2(F.concat_ws("|", *kept), 256)


def foreign_ratio(text: Column) -> Column:
    """Letters outside ASCII as a share of all letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    ascii_letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.when(letters > 0, F.round((letters - ascii_letters) / letters, 6)).otherwise(0.0)


def garbage_reason(text: Column) -> Column:
    """The first rule that holds, in order; null if none does."""
    return F.when(F.length(text) < 30, "too_short").when(F.contains(text, F.lit("!!")), "shouting").when(text.rlike(r"[#$%&*]{3}"), "symbol_noise").when(~F.contains(text, F.lit(" ")), "no_words")


def risks(text: Column) -> Column:
    """Distinct risk signals, sorted."""
    checks = {"caps": text.rlike("[A-Z]{6,}"), "money": text.rlike(r"[$€]"), "mail": F.contains(text, F.lit("@")) & text.rlike(r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]+"), "noise": text.rlike(r"[#%&*]{3}")}
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()])))


def risk_score(signals: Column) -> Column:
    return F.least(F.lit(1.0), F.round(F.size(signals) * 0.2, 4))


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.4, "medium").otherwise("low")


def quality(text: Column, lang: Column, source: Column, signals: Column) -> Column:
    """Additive score, less at most 0.2 for risks; only the upper end is clamped."""
    flag = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    total = flag(F.length(text) >= 200, 0.2) + flag(F.contains(text, F.lit("\n")), 0.2) + flag(~F.contains(text, F.lit("!!")), 0.15) + flag(F.length(text) >= 1000, 0.15) + flag(lang.isNotNull(), 0.1) + flag(source.isNotNull(), 0.1) + flag(text.rlike(r"\.$"), 0.05)
    return F.round(F.least(F.lit(1.0), total - F.least(F.lit(0.2), F.size(signals) * 0.05)), 4)


def money(text: Column) -> dict[str, Column]:
    """Currency, least and greatest amount (in order), unit k applied; all null without an amount."""
    pattern = r"([$€])\s?(\d+(?:\.\d+)?)(k?)(?:\s?-\s?[$€]?(\d+(?:\.\d+)?)(k?))?"
    part = lambda i: F.regexp_extract(text, pattern, i)
    amount = lambda i: F.round(part(i).try_cast("double") * F.when(part(i + 1) == "k", 1000).otherwise(1)).cast("long")
    low, high = amount(2), F.coalesce(amount(4), amount(2))
    return {"currency": F.when(part(1) == "$", "USD").when(part(1) == "€", "EUR"), "min_amount": F.least(low, high), "max_amount": F.greatest(low, high)}
