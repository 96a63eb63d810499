"""Column functions on URLs: normal form, filter chains, additive scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(url: Column) -> Column:
    """Lower scheme and host, no fragment, no trailing slash."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z]+://[^/?]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(bare, r"^[A-Za-z]+://[^/?]*", ""), "/+$", "")
    return F.concat(head, rest)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]*)", 1))


def passes(url: Column, include: list[str] = (), include_any: list[str] = (), exclude: list[str] = (), prefix: str = "", suffix: str = "") -> Column:
    """All conditions joined with and; ``include_any`` needs one of its patterns."""
    checks = [url.rlike(p) for p in include] + [~url.rlike(p) for p in exclude]
    checks += [reduce(lambda a, b: a | b, [url.rlike(p) for p in include_any])] if include_any else []
    checks += [url.startswith(prefix)] * bool(prefix) + [url.endswith(suffix)] * bool(suffix)
    return reduce(lambda a, b: a & b, checks, F.lit(True))


def additive_score(url: Column, rules: list[tuple[str, int]]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(url.rlike(p), w).otherwise(0) for p, w in rules], F.lit(0))
