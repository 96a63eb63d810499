"""A text prefilter as a fitted model: one weighting of terms for training and scoring, a held-out gate, saved versions.

A term's weight is (1 + ln(count)) times its inverse document frequency, divided by the length of the
document's vector; ``TextBlocks`` makes it, for the fit and for scores alike. The vocabulary is the ``features``
terms that occur most often in ``min_docs`` documents or more; how many others there are, and which share of all
occurrences they have, is kept with the model (``dropped_terms``, ``dropped_share``).
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from winnowline.operators.extraction import TextBlocks, gram_counts  # noqa: F401  counts for vocabulary_of
from winnowline.sources.scratch import stored

#: The thresholds that a training report lists.
SWEEP = (0.1, 0.2, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def vocabulary_of(counts: DataFrame, documents: int, features: int, min_docs: int = 2) -> tuple[DataFrame, dict]:
    """((term, idf) of the ``features`` terms with the most occurrences, ties by term; what was left out)."""
    return most_frequent(counts.select("term", F.lit(1).alias("df"), F.round(F.exp(F.col("tf") - 1)).alias("times")), documents, features, min_docs)


def most_frequent(terms: DataFrame, documents: int, features: int, min_docs: int = 2) -> tuple[DataFrame, dict]:
    """The same from (term, df, times) in parts."""
    terms = stored(terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("times").alias("times")).where(F.col("df") >= min_docs))
    chosen = stored(terms.orderBy(F.desc("times"), "term").limit(features))
    (n, times), (own, own_times) = (d.agg(F.count("*"), F.coalesce(F.sum("times"), F.lit(0.0))).first() for d in (terms, chosen))
    left = {"dropped_terms": n - own, "dropped_share": round(1 - own_times / times, 6) if times else 0.0}
    return chosen.select("term", (F.ln((1 + F.lit(float(documents))) / (1 + F.col("df"))) + 1).alias("idf")), left


def held_out(df: DataFrame, key: str, label: Column, fraction: float, seed: int = 42) -> Column:
    """Whether a row is held out: the same share of either class, by hash of the key."""
    place = F.xxhash64(F.lit(seed), F.col(key))
    edges = {r["label"]: r["edge"] for r in df.groupBy(label.alias("label")).agg(F.percentile_approx(place, fraction, 100_000).alias("edge")).collect()}  # two classes
    out = F.lit(False)
    for value, edge in edges.items():
        out = F.when(label == value, place <= edge).otherwise(out)
    return out


class TextPrefilter(Estimator):
    """Logistic regression on one- and two-word grams with balanced classes; ``fit`` takes rows of key, text and a 0/1 label.

    ``fit`` holds out ``holdout`` of each class, fits on the rest, keeps the held-out sweep as the model's
    report, and refuses with ValueError if fewer than ``least_retention`` of the held-out positives stay at
    ``threshold``. Then it fits on all rows. Rows without a label are left out; null texts are empty.
    """

    def __init__(self, key: str = "doc_id", text: str = "text", label: str = "label", features: int = 200_000, inverse_penalty: float = 4.0, threshold: float = 0.5, holdout: float = 0.2, least_retention: float = 0.9):
        super().__init__()
        self.key, self.text, self.label, self.features, self.inverse_penalty = key, text, label, features, inverse_penalty
        self.threshold, self.holdout, self.least_retention = threshold, holdout, least_retention

    def _fit(self, dataset: DataFrame) -> TextPrefilterModel:
        d = stored(dataset.select(F.col(self.key).alias("key"), F.coalesce(F.col(self.text), F.lit("")).alias("text"), F.col(self.label).cast("int").alias("label")).where("label IS NOT NULL"))
        if d.select("label").distinct().count() != 2:
            raise ValueError("rows of two classes are needed")
        # A key's rows are on one side, whatever their labels.
        keys = stored(d.where(held_out(d, "key", F.col("label"), self.holdout)).select("key"))
        test, rest = stored(d.join(keys, "key", "left_semi")), stored(d.join(keys, "key", "left_anti"))
        trial = self._fitted(rest)
        scored = trial.scores(test, "key", "text").join(d.select("key", "label"), "key")
        sums = scored.agg(F.sum("label").alias("positives"), *[F.struct(F.count_if(F.col("score") >= t).alias("kept"), F.count_if((F.col("score") >= t) & (F.col("label") == 1)).alias("right")).alias(f"t{k}") for k, t in enumerate((*SWEEP, self.threshold))]).first()
        rate = lambda x: round(x["right"] / sums["positives"], 4) if sums["positives"] else 0.0
        report = {"sweep": [{"threshold": t, "kept": sums[f"t{k}"]["kept"], "positive_retention": rate(sums[f"t{k}"])} for k, t in enumerate(SWEEP)], "threshold": self.threshold, "retention": rate(sums[f"t{len(SWEEP)}"]), "holdout": keys.count(), "holdout_positives": sums["positives"]}
        if report["retention"] < self.least_retention:
            raise ValueError(f"{report['retention']} of held-out positives stay at {self.threshold}, fewer than {self.least_retention}")
        model = self._fitted(d)
        model.report |= report
        return model

    def _fitted(self, d: DataFrame) -> TextPrefilterModel:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.linalg import VectorUDT

        spark = d.sparkSession
        n = {r["label"]: r["count"] for r in d.groupBy("label").count().collect()}  # two classes
        total = sum(n.values())
        weight = F.when(F.col("label") == 1, total / (2 * max(1, n.get(1, 0)))).otherwise(total / (2 * max(1, n.get(0, 0))))
        blocks = TextBlocks(d.select("key", "text", F.col("label").cast("double").alias("label"), weight.alias("weight")), "key", "text", also=("label", "weight"))
        own = stored(blocks.terms())
        vocabulary, left = most_frequent(own, total, self.features)
        terms = vocabulary.orderBy("term").toPandas()  # ``features`` rows at most, as are the model's coefficients
        numbered = spark.createDataFrame(terms.assign(at=range(len(terms))), "term string, idf double, at int")
        x = blocks.vectors(own.select("block", "term").join(F.broadcast(numbered), "term"), max(1, len(terms)))
        rows = stored(x, StructType([StructField("features", VectorUDT()), *x.schema.fields[1:]]))
        # Each part of the rows sends a whole gradient in every step, so there are as many parts as cores, however many rows there are.
        rows = rows.coalesce(spark.sparkContext.defaultParallelism)
        fitted = LogisticRegression(weightCol="weight", regParam=1 / (self.inverse_penalty * max(1, total)), standardization=False, maxIter=200).fit(rows)
        coefficients = spark.createDataFrame(terms.assign(coef=fitted.coefficients.toArray()[: len(terms)]), "term string, idf double, coef double")
        return TextPrefilterModel(stored(coefficients), float(fitted.intercept), {"rows": total, "positives": n.get(1, 0), **left}, self.key, self.text, self.threshold)


class TextPrefilterModel(Model):
    """Terms with their inverse frequencies and coefficients, an intercept, and the training report."""

    def __init__(self, vocabulary: DataFrame, intercept: float, report: dict, key: str, text: str, threshold: float):
        super().__init__()
        self.vocabulary, self.intercept, self.report, self.key, self.text, self.threshold = vocabulary, intercept, report, key, text, threshold

    def scores(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """(key, score): a text without known terms has the intercept's score."""
        blocks = TextBlocks(docs.select(key, text), key, text)
        known = blocks.terms().select("block", "term").join(F.broadcast(self.vocabulary), "term")  # as many rows as the fit has held
        return blocks.scores(known).select(key, (1 / (1 + F.exp(-(F.col("z") + self.intercept)))).alias("score"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Adds score and drop, by key; keys must be unique."""
        s = self.scores(dataset.select(self.key, self.text), self.key, self.text).withColumnRenamed(self.key, "scored_key")
        return dataset.join(s, dataset[self.key].eqNullSafe(s["scored_key"])).drop("scored_key").withColumn("drop", F.col("score") < self.threshold)

    def save(self, path: str) -> None:
        """Terms as Parquet, the rest as one JSON row; an existing model is not replaced."""
        spark = self.vocabulary.sparkSession
        meta = {c: getattr(self, c) for c in ("intercept", "report", "key", "text", "threshold")}
        self.vocabulary.write.parquet(f"{path}/terms")
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextPrefilterModel:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return cls(spark.read.parquet(f"{path}/terms"), **meta)


class Registry:
    """Versions of a model in one folder, and which of them is in use: every promotion is a row, the newest one counts."""

    LOG = "at long, version string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> list[tuple[int, str]]:
        try:
            return sorted(tuple(r) for r in self.spark.read.schema(self.LOG).parquet(f"{self.path}/promotions").collect())  # a row for each promotion
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []

    def save(self, model: TextPrefilterModel, version: str) -> None:
        model.save(f"{self.path}/versions/{version}")

    def promote(self, version: str) -> None:
        """The version must have been saved and can be loaded."""
        TextPrefilterModel.load(self.spark, f"{self.path}/versions/{version}")
        log = self._log()
        self.spark.createDataFrame([(log[-1][0] + 1 if log else 0, version)], self.LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/promotions")

    def current(self) -> str | None:
        log = self._log()
        return log[-1][1] if log else None

    def rollback(self) -> str:
        """Promotes the version that was in use before the present one."""
        log = self._log()
        before = [v for _, v in log if v != log[-1][1]]
        if not before:
            raise ValueError("there is no version to go back to")
        self.promote(before[-1])
        return before[-1]

    def load(self) -> TextPrefilterModel:
        version = self.current()
        if version is None:
            raise ValueError("no version has been promoted")
        return TextPrefilterModel.load(self.spark, f"{self.path}/versions/{version}")
