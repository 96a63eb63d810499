"""The quality and language models against their definitions, recomputed plainly."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from winnowline.llm import languages, quality_model

SMALL = "/root/testdata/sf0.001"


def test_discriminant_is_the_difference_of_log_densities(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marked = {r["doc_id"]: r["quality"] for r in labels.collect()}
    ids = sorted(texts)
    x = quality_model.statistics(pa.array([texts[i] for i in ids], pa.string()))
    y = np.array([marked.get(i, -1) for i in ids])
    means, covs, n = [x[y == k].mean(0) for k in (0, 1)], [np.cov(x[y == k].T, bias=True) for k in (0, 1)], [(y == k).sum() for k in (0, 1)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    logs = []
    for k in (0, 1):
        a = max(0.1, x.shape[1] / (x.shape[1] + n[k]))
        c = (1 - a) * covs[k] + a * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c))
        c = c / np.outer(scale, scale) + 1e-3 * np.eye(len(c))
        z = (x - means[k]) / scale
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z) - 0.5 * np.linalg.slogdet(c)[1])
    share = (n[1] + 1) / (sum(n) + 2)
    want = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + logs[1] - logs[0], -40, 40)))
    got = {r["doc_id"]: r["score"] for r in quality_model.classify(docs, labels).collect()}
    assert [got[i] for i in ids] == pytest.approx(list(want), abs=1e-6)


def test_quality_texts_of_any_length(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "word " * 200_000, 0), (4, "\n" * 5000, 1)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    assert len(quality_model.classify(docs, labels).collect()) == 4


def penalised(logs, counts, chosen, penalty=3.0):
    """Log likelihood of the best mixture of ``chosen``, less the penalty for each language after the first."""
    p, s = np.exp(logs[list(chosen)]), np.full(len(chosen), 1 / len(chosen))
    for _ in range(400):
        r = s[:, None] * p
        s = (r / r.sum(0)) @ counts / counts.sum()
    return np.log(s @ p) @ counts - penalty * np.log(counts.sum() + 1) * (len(chosen) - 1), s


def test_mixture_is_the_best_penalised_set(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang IS NOT NULL")
    names, logs = languages.train(docs)
    texts = {}
    for r in docs.where("length(text) > 1500").orderBy("doc_id").collect():
        texts.setdefault(r["lang"], r["text"])
    assert len(names) >= 3
    for size in (1, 2, 3):
        for chosen in itertools.combinations(sorted(texts), size):
            text = " ".join(texts[c][:1400] for c in chosen)
            bins, bounds, _ = languages.ngram_bins([text])
            u, c = np.unique(bins[bounds[0] : bounds[1]], return_counts=True)
            table, c = logs[:, u].astype(float), c.astype(float)
            got = languages.mixture_shares(table, c, 3.0)
            sets = [s for k in (1, 2, 3, 4) for s in itertools.combinations(range(len(names)), k)]
            best = max(sets, key=lambda s: penalised(table, c, s)[0])
            assert tuple(np.flatnonzero(got)) == best and {names[k] for k in best} >= set(chosen)
            assert got[list(best)] == pytest.approx(penalised(table, c, best)[1], abs=0.03)


def test_untrained_rows_and_too_many_languages(spark):
    docs = spark.createDataFrame([(None, "zug um zug", "xx"), (1, "the and of", "en"), (2, "der die das " * 100_000, "de")], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    out = languages.detect_languages(docs, trains=F.crc32(F.col("doc_id").cast("string")) % 4 != 99).collect()
    assert {r["lang_pred"] for r in out} <= {"en", "de"}
    with pytest.raises(ValueError):
        languages.train(docs, max_languages=2)
