"""The inverted index against scores of all documents, and how little of it a query reads."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from winnowline.operators import inverted as X


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def texts(n=300, seed=7):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(150)]
    weights = [1 / (i + 1) for i in range(150)]
    out = [(i, "Common " + " ".join(rng.choices(vocabulary, weights, k=rng.randrange(3, 60)))) for i in range(n)]
    return out + [(n, None), (n + 1, ""), (n + 2, "!!"), (n + 3, "common"), (n + 4, "common"), (n + 5, "t90 T90, t91. " * 400)]


def scored(docs, query, shared):
    counts = [(d, Counter(words(t)), t is not None) for d, t in docs]
    mean = sum(sum(c.values()) for _, c, _ in counts) / sum(has for *_, has in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for d, c, _ in counts:
        own = [t for t in set(words(query)) if t in c]
        norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
        s = len(own) if shared else sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + norm) for t in own)
        if own:
            out.append((-round(s, 6), d))
    return [(d, -s) for s, d in sorted(out)]


QUERIES = [(1, "common t90"), (2, "t0 t1 t2 t3 t4"), (3, "t149 common T90 T90"), (4, "nothing here"), (5, None), (6, "common"), (7, "t5")]


@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("k,block_terms,slice_terms", [(10, 2_000_000, 500_000), (3, 500, 4)])
def test_top_documents(spark, shared, k, block_terms, slice_terms):
    docs = texts()
    index = X.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), block_terms=block_terms)
    got = X.top_documents(index, spark.createDataFrame(QUERIES, "query_id long, text string"), k, shared, slice_terms)
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in got.collect()}
    want = {(q, at + 1): x for q, t in QUERIES for at, x in enumerate(scored(docs, t, shared)[:k])}
    assert {x: y[0] for x, y in got.items()} == {x: y[0] for x, y in want.items()}
    assert all(got[x][1] == pytest.approx(want[x][1], abs=2e-6) for x in want)


def test_empty_tables(spark):
    index = X.build_index(spark.createDataFrame([], "doc_id long, text string"))
    assert X.top_documents(index, spark.createDataFrame(QUERIES, "query_id long, text string"), 5).count() == 0
    index = X.build_index(spark.createDataFrame(texts(5), "doc_id long, text string"))
    assert X.top_documents(index, spark.createDataFrame([], "query_id long, text string"), 5).count() == 0


def test_a_common_term_is_looked_up_and_not_scanned(spark):
    docs = texts(4000)
    index = X.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    row = index.blocks.collect()
    assert len(row) == 1
    block = X.Block(row[0].asDict(), (index.mean, index.k1, index.b), False)
    hashed = spark.createDataFrame([("common t0 t120",)], "text string").select(X.term_hashes("text").alias("t")).first()["t"]
    df = X._frequencies(index, np.array(sorted(hashed)))
    idf = np.array([math.log(1 + (index.n - df[t] + 0.5) / (df[t] + 0.5)) for t in hashed])
    found, score = block.best(np.array(hashed), idf, 10, 0.0)
    assert {d for d, _ in scored(docs, "common t0 t120", False)[:10]} <= set(found.tolist())
    assert block.read < 0.2 * sum(df.values()), (block.read, df)
