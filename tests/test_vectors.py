"""The metric index and the batched products against plain similarities."""

import math
import random

import numpy as np
import pytest

from winnowline.operators import vectors as V


def cosine(x, y):
    return sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))


def clustered(n, centres=12, width=16, spread=0.05, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, width))
    return [(i, (c[i % centres] + rng.normal(size=width) * spread).tolist()) for i in range(n)]


def frames(spark, vectors, anchors):
    return spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), spark.createDataFrame(anchors, "anchor array<double>, positive boolean")


@pytest.mark.parametrize("slice_bytes", [32 << 20, 20_000])
def test_anchor_margin_is_exact_and_computes_few_similarities(spark, slice_bytes):
    vectors = clustered(400)
    anchors = [(x, i % 3 > 0) for i, x in clustered(600, seed=1)]
    v, a = frames(spark, vectors, anchors)
    got = {r["vec_id"]: (r["margin"], r["max_margin"]) for r in V.anchor_margin(v, a, 5, slice_bytes=slice_bytes).collect()}
    for i, x in vectors[::7]:
        above, below = (sorted((cosine(x, y) for y, p in anchors if p is side), reverse=True) for side in (True, False))
        assert got[i] == pytest.approx((sum(above[:5]) / 5 - sum(below[:5]) / 5, above[0] - below[0]), abs=2e-6)
    if slice_bytes > 1 << 20:
        computed = sum(r["compared"] for r in V.anchor_tops(v, a, 5).collect())
        assert computed < 0.25 * len(vectors) * len(anchors)


def test_anchor_margin_on_awkward_rows(spark):
    vectors = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [-1.0, 1e-9]), (1, [0.0, 2.0])]
    v, a = frames(spark, vectors, [([1.0, 0.0], True), ([1.0, 0.0], True), ([0.0, 0.0], False), (None, True), ([0.0, 1.0], False)])
    got = sorted(((r["vec_id"], r["margin"]) for r in V.anchor_margin(v, a, 3).collect()), key=str)
    assert got == [(1, -1.0), (1, 1.0), (2, None), (3, None), (4, -1.0)]
    v, a = frames(spark, vectors, [([1.0, 0.0], True)])
    assert {r["margin"] for r in V.anchor_margin(v, a).collect()} == {None}
    assert V.anchor_margin(v, a.limit(0)).count() == 5 and V.anchor_margin(v.limit(0), a).count() == 0


@pytest.mark.parametrize("slice_rows", [8192, 3])
def test_nearest(spark, slice_rows):
    rng = random.Random(3)
    vectors = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)], i % 4) for i in range(150)] + [(900, None, 1), (901, [0.0] * 4, 1)]
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").repartition(5)
    q = v.where("vec_id % 15 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["sim"]) for r in V.nearest(v, q, 6, where=v["label"] != 2, slice_rows=slice_rows).collect()}
    want = {}
    for i, x, _ in vectors[:150:15]:
        if x and any(x):
            near = sorted((-round(cosine(x, y), 6), j) for j, y, label in vectors if y and any(y) and j != i and label != 2)[:6]
            want |= {(i, at + 1): (j, -s) for at, (s, j) in enumerate(near)}
    assert got == want
