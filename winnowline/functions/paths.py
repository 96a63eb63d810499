"""Fields out of JSON of any shape: path expressions compiled to columns over VARIANT.

A path is a chain of names and steps: ``a.b`` goes into objects, ``[2]`` takes an element, ``[*]`` all of them,
``[?kind=job]`` those whose own path ``kind`` has that text (``!=``: has another or none). A leading ``$`` may
stand. What isn't there is no value; no path is an error at run time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = re.compile(r"\.?(?P<name>[^.\[\]]+)|\[(?P<at>\d+)\]|\[(?P<all>\*)\]|\[\?(?P<where>[^\]!=]+)(?P<no>!?)=(?P<value>[^\]]*)\]")


def steps(path: str) -> list[tuple]:
    """The steps of a path: ("get", a path into objects and elements), ("all",), ("where", path, whether equal, text)."""
    rest, out = path.strip().removeprefix("$"), []
    while rest:
        m = STEP.match(rest)
        if not m:
            raise ValueError(f"no step at {rest!r} in {path!r}")
        if m["all"]:
            out.append(("all",))
        elif m["where"]:
            out.append(("where", m["where"].strip(), not m["no"], m["value"].strip().strip("'\"")))
        else:
            own = f'["{m["name"]}"]' if m["name"] else f"[{m['at']}]"
            if out and out[-1][0] == "get":
                own = out.pop()[1] + own
            out.append(("get", own))
        rest = rest[m.end() :]
    return out


def _all(v: Column, chain: list[tuple]) -> Column:
    if not chain:
        return F.array(v)
    inner = v
    if chain[0][0] == "get":
        if len(chain) == 1:
            return F.array_compact(F.array(F.try_variant_get(v, "$" + chain[0][1], "variant")))
        return _all(F.try_variant_get(v, "$" + chain[0][1], "variant"), chain[1:])
    items = F.coalesce(F.try_variant_get(inner, "$", "array<variant>"), F.array().cast("array<variant>"))
    if chain[0][0] == "where":
        _, path, equal, value = chain[0]
        same = lambda x: F.coalesce(first(x, path) == value, F.lit(False))
        items = F.filter(items, (lambda x: same(x)) if equal else (lambda x: ~same(x)))
    return F.flatten(F.transform(items, lambda x: _all(x, chain[1:]))) if chain[1:] else items


def every(v: Column, path: str) -> Column:
    """All values of a path in a VARIANT column, in order, as an array of VARIANT; empty where there is none."""
    return F.coalesce(_all(v, steps(path)), F.array().cast("array<variant>"))


def texts(v: Column, path: str) -> Column:
    """All values of a path as strings; null values and objects left out."""
    return F.array_compact(F.transform(every(v, path), lambda x: F.try_variant_get(x, "$", "string")))


def first(v: Column, path: str) -> Column:
    """The first value of a path as a string, or null."""
    chain = steps(path)
    if all(s[0] == "get" for s in chain):
        return F.try_variant_get(v, "$" + "".join(s[1] for s in chain), "string")
    return F.get(texts(v, path), F.lit(0))


def _atoms(chain: list[tuple]) -> list[tuple]:
    """The steps one by one: ("name", key), ("at", index), ("all",), ("where", ...)."""
    out = []
    for step in chain:
        if step[0] == "get":
            out += [("name", name) if name else ("at", int(at)) for name, at in re.findall(r'\["([^\[\]]+)"\]|\[(\d+)\]', step[1])]
        else:
            out.append(step)
    return out


def _grown(node: dict, path: list[tuple]) -> dict:
    """The node of a tree of names (None: any element of an array) where a path ends; its steps are added to the tree."""
    for step in path:
        node = node.setdefault(step[1] if step[0] == "name" else None, {})
        if step[0] == "where":
            _grown(node, _atoms(steps(step[1])))[""] = {}
    return node


def _type(node: dict) -> str | None:
    """The type that holds all of a tree's paths; None where one value would have to be of two types."""
    if set(node) <= {""}:
        return "string"
    if "" in node or (None in node and len(node) > 1) or len({(k or "").lower() for k in node}) < len(node):
        return None
    inner = {k: _type(v) for k, v in node.items()}
    if None in inner.values():
        return None
    return f"array<{inner[None]}>" if None in inner else "struct<" + ", ".join("`" + k.replace("`", "``") + f"`: {v}" for k, v in inner.items()) + ">"


def _typed(x: Column, path: list[tuple]) -> tuple[Column, bool]:
    """What a path leads to in a value that has the type of its tree, and whether that is an array of several."""
    for i, (kind, *rest) in enumerate(path):
        if kind in ("name", "at"):
            x = x.getField(rest[0]) if kind == "name" else F.get(x, F.lit(rest[0]))
            continue
        if kind == "where":
            own, equal, value = _atoms(steps(rest[0])), rest[1], rest[2]
            same = lambda y: F.coalesce(_typed(y, own)[0] == value, F.lit(False))  # noqa: B023, E731  built at once
            x = F.filter(x, (lambda y: same(y)) if equal else (lambda y: ~same(y)))
        after = path[i + 1 :]
        if after:
            deeper = any(s[0] in ("all", "where") for s in after)
            x = F.transform(x, lambda y: _typed(y, after)[0])
            x = F.flatten(F.array_compact(x)) if deeper else x
        return x, True
    return x, False


def records(v: Column, items: str, fields: dict[str, str], joined: str = ", ") -> Column:
    """An array of structs: each value of ``items`` with its fields; a field's path with several values gives them joined, each once.

    Elements of an array are read at once, into the type that holds all these paths. If the paths ask for one
    value in two types (``a`` and ``a.b``), or ``items`` doesn't end in an array's elements (where what is absent
    must be told from what has no fields), each path is read from VARIANT on its own.
    """
    chain, own = _atoms(steps(items)), {k: _atoms(steps(p)) for k, p in fields.items()}
    tree: dict = {}
    item = _grown(tree, chain)
    for path in own.values():
        _grown(item, path)[""] = {}
    kind, one_type = _type(tree) if chain and chain[-1][0] in ("all", "where") else None, _type(item)

    def one(x: Column) -> Column:
        out = []
        for name, path in fields.items():
            if kind:
                found, several = _typed(x, own[name])
                found = F.array_compact(found) if several else found
            else:
                several = any(s[0] != "get" for s in steps(path))
                found = texts(x, path) if several else first(x, path)
            # Not by nullif, which would take the values twice.
            own_text = F.aggregate(F.array_distinct(found), F.lit(None).cast("string"), lambda s, y: F.coalesce(F.concat(s, F.lit(joined), y), y), lambda s: F.nullif(s, F.lit(""))) if several else found
            out.append(own_text.alias(name))
        return F.struct(*out)

    if not kind:
        return F.transform(every(v, items), one)
    found = _typed(F.try_variant_get(v, "$", kind), chain)[0]
    return F.transform(F.coalesce(found, F.array().cast(f"array<{one_type}>")), one)
