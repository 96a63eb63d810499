"""A small condition language, compiled to three-valued columns, and ordered gates with reasons.

A condition is a nested dict: {"all": [...]}, {"any": [...]}, {"not": c}, or {"field": f, "op": value}
with the operators eq, ne, lt, le, gt, ge, in, exists. Null operands give unknown, as in SQL; unknown
counts as the gate's ``on_unknown``.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = {"eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v, "in": lambda c, v: c.isin(*v), "exists": lambda c, v: c.isNotNull() if v else c.isNull()}


def compile_condition(spec: dict, columns: list[str]) -> Column:
    """The column of a condition; unknown fields and operators raise at plan time."""
    if "all" in spec:
        return reduce(lambda a, b: a & b, [compile_condition(s, columns) for s in spec["all"]], F.lit(True))
    if "any" in spec:
        return reduce(lambda a, b: a | b, [compile_condition(s, columns) for s in spec["any"]], F.lit(False))
    if "not" in spec:
        return ~compile_condition(spec["not"], columns)
    field = spec.get("field")
    ops = [k for k in spec if k != "field"]
    if field not in columns or len(ops) != 1 or ops[0] not in OPS:
        raise ValueError(f"not a condition over {columns}: {spec}")
    return OPS[ops[0]](F.col(field), spec[ops[0]])


def plan_hash(spec: dict) -> str:
    """Equal plans have equal hashes, whatever the order of keys."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def apply_gates(df: DataFrame, gates: list[dict]) -> DataFrame:
    """Adds ``drops`` (all failed gates in order) and ``lane`` (the first that isn't a shadow gate, or 'pass').

    A gate is {"name", "keep": condition, "shadow": bool, "on_unknown": bool}. Rows are never filtered
    here, so funnels and shadow comparisons are plain groupings afterwards.
    """
    fails = []
    for g in gates:
        keep = F.coalesce(compile_condition(g["keep"], df.columns), F.lit(bool(g.get("on_unknown", True))))
        fails.append(F.when(~keep, F.struct(F.lit(g["name"]).alias("gate"), F.lit(bool(g.get("shadow"))).alias("shadow"))))
    out = df.withColumn("drops", F.array_compact(F.array(*fails)))
    hard = F.filter("drops", lambda x: ~x["shadow"])
    return out.withColumn("lane", F.when(F.size(hard) > 0, hard[0]["gate"]).otherwise("pass"))


# Three presets of gates; a plan may extend one.
PRESETS = {
    "lenient": {"gates": [{"name": "garbage", "keep": {"field": "garbage", "exists": False}}]},
    "standard": {"extends": "lenient", "gates": [{"name": "language", "keep": {"field": "lang", "in": ["en", "de", "fr"]}}, {"name": "quality", "keep": {"field": "quality", "ge": 0.6}}]},
    "strict": {"extends": "standard", "gates": [{"name": "quality", "keep": {"field": "quality", "ge": 0.8}}, {"name": "long", "keep": {"field": "n_chars", "lt": 4000}, "shadow": True}]},
}


def resolve_plan(name: str, plans: dict[str, dict], seen: tuple[str, ...] = ()) -> list[dict]:
    """The gates of a plan: those of the plan it extends, keys of gates with equal names overlaid, new ones behind."""
    if name in seen:
        raise ValueError(f"plans extend each other: {' -> '.join((*seen, name))}")
    if name not in plans:
        raise ValueError(f"no plan {name}")
    plan = plans[name]
    base = resolve_plan(plan["extends"], plans, (*seen, name)) if plan.get("extends") else []
    out = {g["name"]: dict(g) for g in base}
    for g in plan.get("gates", []):
        out[g["name"]] = {**out.get(g["name"], {}), **g}
    return list(out.values())


def override(gates: list[dict], changes: dict[str, dict]) -> list[dict]:
    """Gates with parts replaced by name; {"enabled": False} takes one out, "shadow" makes it report only. Unknown names are errors."""
    unknown = set(changes) - {g["name"] for g in gates}
    if unknown:
        raise ValueError(f"no gates {sorted(unknown)}")
    merged = [{**g, **changes.get(g["name"], {})} for g in gates]
    return [{k: v for k, v in g.items() if k != "enabled"} for g in merged if g.get("enabled", True)]


def shadow_disagreements(gated: DataFrame, by: list[str]) -> DataFrame:
    """Rows that a shadow gate would have dropped although they pass, by gate."""
    d = gated.where("lane = 'pass'").select(*by, F.explode(F.filter("drops", lambda x: x["shadow"])).alias("g"))
    return d.groupBy(*by, F.col("g.gate").alias("gate")).agg(F.count("*").alias("would_drop"))
