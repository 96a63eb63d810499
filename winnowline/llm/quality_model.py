"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each text becomes a few dozen transformed statistics (logs and ratios of its characters, words and
lines). Class means and covariances come from sums over all labelled training rows; covariances are
shrunk towards the pooled covariance and its diagonal. The score is the logistic of the difference of
the two Mahalanobis log densities, computed with Cholesky factors that are made once.

Edge cases: null and empty texts have statistics like any text (all counts 0) and get a score; rows
without a label, with a label other than 0 and 1, or a null doc_id don't train; labels that repeat a
doc_id count once each; if a class has no training rows, its share is the score; an empty table gives
an empty result. Columns other than the key and the text are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowline.llm.common import cut
from winnowline.llm.kernel import utf8, word_hashes, word_spans

NAMES = ("chars", "words", "mean_word", "upper", "digits", "symbols", "marks", "lines", "line_repeat", "word_repeat", "triple_repeat", "top_word", "bangs", "word_spread")


def statistics(column) -> np.ndarray:
    """One row of transformed statistics for each text."""
    data, off = utf8(column)
    n = len(off) - 1

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (sums[off[1:]] - sums[off[:-1]]).astype(float)

    chars = per_text((data & 0xC0) != 0x80)
    upper, digits = per_text((data >= 65) & (data <= 90)), per_text((data >= 48) & (data <= 57))
    symbols, marks, bangs = (per_text(np.isin(data, np.frombuffer(s, np.uint8))) for s in (b"#*$%&|<>{}[]\\^~=+_@", b".,;:?'\"()-", b"!"))
    newlines = per_text(data == 10)
    starts, ends, doc = word_spans(data, off)
    lengths = (ends - starts).astype(float)
    words = np.bincount(doc, minlength=n).astype(float)
    some, letters = np.maximum(words, 1), np.maximum(chars, 1)
    mean = np.bincount(doc, lengths, minlength=n) / some
    spread = np.sqrt(np.maximum(np.bincount(doc, lengths * lengths, minlength=n) / some - mean * mean, 0))
    hashes, bounds = word_hashes(column)
    repeat, triple, top, line = (np.zeros(n) for _ in range(4))
    tri = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7) if len(hashes) > 2 else hashes[:0]
    for i in range(n):
        a, b = bounds[i], bounds[i + 1]
        if b > a:
            _, c = np.unique(hashes[a:b], return_counts=True)
            repeat[i], top[i] = 1 - len(c) / (b - a), c.max() / (b - a)
        if b - a > 3:
            triple[i] = 1 - len(np.unique(tri[a : b - 2])) / (b - a - 2)
        if newlines[i]:
            rows = bytes(data[off[i] : off[i + 1]]).split(b"\n")
            line[i] = 1 - len(set(rows)) / len(rows)
    root = np.sqrt
    return np.column_stack([np.log1p(chars), np.log1p(words), np.log1p(mean), root(upper / letters), root(digits / letters), root(symbols / letters), root(marks / letters), np.log1p(newlines / some * 20), root(line), root(repeat), root(triple), root(top), root(bangs / some), np.log1p(spread)])


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and x, the array of statistics, for every row."""
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = d.dtypes[0][1]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = statistics(part.column("text"))
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("key"), values], names=["key", "x"])

    return d.mapInArrow(run, f"key {kind}, x array<double>")


class Discriminant:
    """A fitted model: class shares, means and Cholesky factors of the inverse covariances."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: float, ridge: float):
        self.share = (counts[1] + 1) / (counts.sum() + 2)
        self.flat = bool((counts < 2).any())
        if self.flat:
            return
        means = sums / counts[:, None]
        within = products - counts[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = within.sum(0) / counts.sum()
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        self.means, self.factors, self.dets = means, [], []
        for k in (0, 1):
            own = within[k] / counts[k]
            # Fewer rows lean more on the pooled covariance; a part of the result goes to its diagonal.
            a = max(shrink, len(self.scale) / (len(self.scale) + counts[k]))
            cov = (1 - a) * own + a * pooled
            cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov))
            cov = cov / np.outer(self.scale, self.scale) + ridge * np.eye(len(cov))
            low = np.linalg.cholesky(cov)
            self.factors.append(np.linalg.inv(low).T)
            self.dets.append(2 * np.log(np.diag(low)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat or not len(x):
            return np.full(len(x), self.share)
        logs = []
        for k in (0, 1):
            z = ((x - self.means[k]) / self.scale) @ self.factors[k]
            logs.append(-0.5 * (z * z).sum(1) - 0.5 * self.dets[k])
        margin = np.log(self.share / (1 - self.share)) + logs[1] - logs[0]
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def fit(statistics_and_label: DataFrame, shrink: float = 0.1, ridge: float = 1e-3) -> Discriminant:
    """Fit on all rows of (x, label); what reaches the driver are a few hundred sums."""
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col("x")[i] for i in range(d)]
    rows = statistics_and_label.where("label IN (0, 1)").groupBy("label").agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("p")).collect()
    counts, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in rows:
        counts[r["label"]], sums[r["label"]] = r["n"], r["s"]
        for (i, j), v in zip(pairs, r["p"]):
            products[r["label"], i, j] = products[r["label"], j, i] = v
    return Discriminant(counts, sums, products, shrink, ridge)


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """key and score for every row of (key, x)."""
    kind = stats.select("key").dtypes[0][1]

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(model.score(x), pa.float64())], names=["key", "score"])

    return stats.select("key", "x").mapInArrow(run, f"key {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", trains=None, **options) -> DataFrame:
    """Score every document; ``trains`` is the condition on the key under which a label may be learnt."""
    stats = cut(document_statistics(docs, key, text))
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("label IS NOT NULL AND key IS NOT NULL")
    if trains is not None:
        marked = marked.where(trains(F.col("key")))
    model = fit(stats.join(marked, "key"), **options)
    return score(stats, model).withColumnRenamed("key", key)
