"""Path expressions over JSON against the same walk in plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from winnowline.functions import paths as P

PAGES = [
    {"jobs": [{"id": 1, "title": "a", "tags": ["x", "y"], "kind": "job"}, {"id": "two", "kind": "ad", "tags": []}, {"kind": None, "deep": {"a b": [{"v": 1.5}, {"v": None}, {}]}}]},
    [{"id": 3, "kind": "job"}, 7, "text", None],
    {"jobs": {"id": 9}}, {}, 5, None, [],
]
PATHS = ["$.jobs[*].id", "jobs[*].tags[*]", "jobs[?kind=job].id", "jobs[?kind!=job].id", "jobs[0].title", "jobs[2].deep.a b[*].v", "[*].id", "[?kind='job'].id", "jobs.id", "jobs[5].id"]


def walk(v, chain):
    if v is None:
        return []
    if not chain:
        return [v]
    kind, *rest = chain[0]
    if kind == "get":
        for name in rest[0].strip("[]").split("]["):
            name = json.loads(name)
            v = v.get(name) if isinstance(v, dict) and isinstance(name, str) else (v[name] if isinstance(v, list) and isinstance(name, int) and name < len(v) else None)
        return walk(v, chain[1:])
    items = v if isinstance(v, list) else []
    if kind == "where":
        path, equal, value = rest
        own = lambda x: [str(y) for y in walk(x, P.steps(path))] == [value]
        items = [x for x in items if own(x) == equal]
    return [y for x in items for y in walk(x, chain[1:])]


def shown(x):
    return x if isinstance(x, str) else json.dumps(x)


@pytest.mark.parametrize("path", PATHS)
def test_paths(spark, path):
    d = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(PAGES)] + [(90, "not json"), (91, None)], "i int, page string").withColumn("v", F.try_parse_json("page"))
    got = {r["i"]: (r["t"], r["f"]) for r in d.select("i", P.texts(F.col("v"), path).alias("t"), P.first(F.col("v"), path).alias("f")).collect()}
    for i, page in [*enumerate(PAGES), (90, None), (91, None)]:
        want = [shown(x) for x in walk(page, P.steps(path)) if not isinstance(x, (dict, list))]
        assert got[i] == (want, want[0] if want else None), (path, page)


def test_bad_paths():
    for path in ("a[", "a[x]", "[?a]"):
        with pytest.raises(ValueError):
            P.steps(path)
