"""Fields from raw text: fallbacks, drop rules, review reasons, signals; text prefilters with a trained vocabulary."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnowline.functions.normalize import blank_to_null, first_match, grams

#: Signals by pattern, the first that is found counts.
SENIORITY = [(r"(?i)\b(?:lead|principal|head)\b", "lead"), (r"(?i)\bsenior\b", "senior"), (r"(?i)\bjunior\b|\btrainee\b", "junior")]
EDUCATION = [(r"(?i)\bph\.?d\b", "doctorate"), (r"(?i)\bmaster'?s?\b", "master"), (r"(?i)\bbachelor'?s?\b", "bachelor")]


def first_line(text: Column, most: int = 120) -> Column:
    """The first line with a letter, cut to ``most`` characters."""
    return blank_to_null(F.substring(F.trim(F.regexp_extract(text, r"(?m)^([^\n]*\p{L}[^\n]*)$", 1)), 1, most))


def signals(text: Column) -> Column:
    """seniority, years of experience, education, relocation and visa as the text states them."""
    years = F.regexp_extract(text, r"(?i)(\d{1,2})\s*\+?\s*years", 1).try_cast("int")
    return F.struct(
        first_match(text, SENIORITY).alias("seniority"),
        F.when(years <= 50, years).alias("years"),
        first_match(text, EDUCATION).alias("education"),
        F.when(text.rlike(r"(?i)no relocation"), False).when(text.rlike(r"(?i)relocation"), True).alias("relocation"),
        F.when(text.rlike(r"(?i)no visa"), False).when(text.rlike(r"(?i)visa"), True).alias("visa"),
    )


def extract(df: DataFrame, text: str, fallbacks: dict[str, list[Column]], required_any: tuple[str, ...], wanted: tuple[str, ...], least_description: int = 30) -> DataFrame:
    """Adds each field (its first source that isn't blank), drop_reason, review_reasons and status.

    A row without any of ``required_any`` or with a short description has a drop reason; an absent ``wanted``
    field is a review reason; a row with all of them is complete, else partial.
    """
    fields = {name: F.coalesce(*[blank_to_null(c) for c in sources]) for name, sources in fallbacks.items()}
    d = df.withColumns(fields)
    nothing = F.lit(True)
    for c in required_any:
        nothing = nothing & F.col(c).isNull()
    drop = F.when(F.length(F.coalesce(F.trim(text), F.lit(""))) < least_description, "description_too_short").when(nothing, "missing_core_fields")
    reasons = F.array_compact(F.array(*[F.when(F.col(c).isNull(), f"missing_{c}") for c in wanted]))
    return d.withColumns({"drop_reason": drop, "review_reasons": reasons}).withColumn("status", F.when(F.size("review_reasons") == 0, "complete").otherwise("partial"))


def relevance(text: Column, negative: tuple[str, ...], positive: tuple[str, ...], model: Column) -> Column:
    """0 with a negative keyword, else the model's score, else a third for each positive keyword, 1 at most."""
    low = F.lower(text)
    hits = F.size(F.filter(F.array(*map(F.lit, positive)), lambda k: F.contains(low, k)))
    bad = F.exists(F.array(*map(F.lit, negative)), lambda k: F.contains(low, k))
    return F.when(bad, 0.0).otherwise(F.coalesce(model, F.least(F.lit(1.0), F.round(hits / 3, 4))))


def classified_out(label: Column, confidence: Column, reject: tuple[str, ...], least: float = 0.8) -> Column:
    """The reason against a row whose model label is in the reject set with enough confidence; null otherwise."""
    return F.when(label.isin(*reject) & (confidence >= least), F.concat(F.lit("source_class:"), label))


def embedding_text(parts: list[tuple[str, Column]], most: int = 400) -> Column:
    """Labelled parts that have a value, joined and cut at a word."""
    text = F.concat_ws(". ", *[F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"{n}: "), F.trim(c))) for n, c in parts])
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_replace(F.substring(text, 1, most), r"\s+\S*$", ""))


def gram_counts(docs: DataFrame, key: str, text: str, most: int = 2) -> DataFrame:
    """(key, term, tf) of words of two letters or more and their pairs; tf is 1 + ln(count)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    return docs.select(key, F.explode(grams(words, most)).alias("term")).groupBy(key, "term").agg((1 + F.ln(F.count("*"))).alias("tf"))


class _Grams:
    """Words and pairs of words of a block of rows: ``terms`` (distinct, ascending), and for each (key, term) how often."""

    def __init__(self, rows: pa.Table):
        words, keys = rows.column("words").combine_chunks(), rows.column("key").combine_chunks().dictionary_encode(null_encoding="encode")
        sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = words.flatten().dictionary_encode()
        order = pc.sort_indices(flat.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        own, at, n = rank[flat.indices.to_numpy()], np.repeat(np.arange(len(sizes)), sizes), max(1, len(order))
        self.keys, self.of = len(keys.dictionary), keys.indices.to_numpy().astype(np.int64)
        follows = np.flatnonzero(at[1:] == at[:-1])
        distinct, place = np.unique(np.concatenate((own, n + own[follows] * n + own[follows + 1])), return_inverse=True)
        pair, self.times = np.unique(self.of[np.concatenate((at, at[follows]))] * max(1, len(distinct)) + place, return_counts=True)
        self.key, self.term = pair // max(1, len(distinct)), pair % max(1, len(distinct))
        word, two = flat.dictionary.take(pa.array(order)), distinct[distinct >= n] - n
        self.terms = pa.concat_arrays([word, pc.binary_join_element_wise(word.take(pa.array(two // n)), word.take(pa.array(two % n)), " ")])


def _block_terms(rows: pa.Table) -> pa.Table:
    b = _Grams(rows)
    df, times = np.bincount(b.term, minlength=len(b.terms)), np.bincount(b.term, b.times, minlength=len(b.terms))
    return pa.table({"block": pa.array(np.full(len(df), rows.column("block")[0].as_py(), np.int32)), "term": b.terms, "df": df.astype(np.int64), "times": times.astype(np.int64)})


def _weighted(b: _Grams, known: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place in ``known``, weight by the known term's idf) of each (key, term) with a known term; a key's weights have length one."""
    found = pc.index_in(b.terms, value_set=known.column("term").combine_chunks())
    place = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[b.term]
    has = np.flatnonzero(place >= 0)
    key, place = b.key[has], place[has]
    x = (1 + np.log(b.times[has])) * known.column("idf").to_numpy()[place]
    return key, place, x / np.sqrt(np.bincount(key, x * x, minlength=b.keys))[key]


def _block_scores(rows: pa.Table, known: pa.Table) -> pa.Table:
    if not rows.num_rows:
        return pa.table({"key": rows.column("key"), "z": pa.array([], pa.float64())})
    b = _Grams(rows)
    key, place, x = _weighted(b, known)
    z = np.bincount(key, x * known.column("coef").to_numpy()[place], minlength=b.keys)
    return pa.table({"key": rows.column("key"), "z": pa.array(np.where(rows.column("key").is_null().to_numpy(), 0.0, z[b.of]))})


def _block_vectors(rows: pa.Table, known: pa.Table, size: int, names: list[str]) -> pa.Table:
    b = _Grams(rows)
    key, place, x = _weighted(b, known)
    at = known.column("at").to_numpy()[place]
    order = np.lexsort((at, key))
    at, x, ends = at[order], x[order], np.searchsorted(key[order], np.arange(b.keys + 1))
    sizes = np.diff(ends)[b.of]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    take = np.repeat(ends[b.of] - offsets[:-1], sizes) + np.arange(offsets[-1])
    lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v[take], t)) for v, t in ((at, pa.int32()), (x, pa.float64()))]
    n = rows.num_rows
    features = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *lists], names=["type", "size", "indices", "values"])
    return pa.table({"features": features} | {c: rows.column(c) for c in names})


class TextBlocks:
    """Rows of key and text, dealt by key to blocks of about ``block_bytes`` of text; a key's rows are one document.

    Terms are words of two letters or more and their pairs. Blocks send each of their distinct terms once, and only terms of the
    vocabulary come back, so that what is shuffled follows the distinct terms of a block and not those of every document.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, block_bytes: int = 16 << 20, also: tuple[str, ...] = ()):
        total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        cores = docs.sparkSession.sparkContext.defaultParallelism
        blocks = max(1, math.ceil(total / block_bytes), min(2 * cores, total >> 20))
        self.key, self.kind, self.also = key, docs.select(key).schema[0].dataType.simpleString(), {c: docs.schema[c].dataType.simpleString() for c in also}
        dealt = docs.select(*also, F.col(key).alias("key"), F.col(text).alias("text"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block")).repartition(blocks, "block")
        self.rows = dealt.select("block", "key", *also, F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), 0).alias("words")).groupBy("block")

    def terms(self) -> DataFrame:
        """(block, term, df, times): in how many of a block's documents a term is, and how often."""
        return self.rows.applyInArrow(_block_terms, "block int, term string, df long, times long")

    def scores(self, known: DataFrame) -> DataFrame:
        """(key, z) of every row: the product of a vector of length one over its block's (block, term, idf, coef) with the coefficients; 0 without known terms."""
        return self.rows.cogroup(known.groupBy("block")).applyInArrow(_block_scores, f"key {self.kind}, z double").withColumnRenamed("key", self.key)

    def vectors(self, known: DataFrame, size: int) -> DataFrame:
        """(features, columns of ``also``) of every row: its vector of length one over its block's (block, term, at, idf), in the form that Spark stores sparse vectors in."""
        names = list(self.also)
        shape = f"features struct<type: tinyint, size: int, indices: array<int>, values: array<double>>{''.join(f', {c} {t}' for c, t in self.also.items())}"
        return self.rows.cogroup(known.groupBy("block")).applyInArrow(lambda rows, terms: _block_vectors(rows, terms, size, names), shape)


def inverse_frequencies(terms: DataFrame, documents: int, least: int = 2) -> DataFrame:
    """(block, term, idf) of terms in ``least`` documents or more of all blocks together, smoothed; a term has one row for each block at most."""
    df = terms.select("block", "term", F.sum("df").over(Window.partitionBy("term")).alias("df")).where(F.col("df") >= least)
    return df.select("block", "term", (F.ln((1 + F.lit(float(documents))) / (1 + F.col("df"))) + 1).alias("idf"))


def linear_text_score(z: DataFrame, key: str, intercept: float, threshold: float, shadow: bool = False) -> DataFrame:
    """score and drop of every row of (key, z): a logistic score of ``z`` and the intercept.

    In shadow mode nothing is dropped, only marked.
    """
    d = z.select(key, F.round(1 / (1 + F.exp(-(F.col("z") + intercept))), 4).alias("score"))
    below = F.col("score") < threshold
    return d.withColumn("drop", F.lit(False) if shadow else below).withColumn("would_drop", below)
