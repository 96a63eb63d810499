"""Near copies by min-max hashing.

Every permutation of the n-gram hashes gives two values of a document's signature, the least and the
greatest hash, so a signature of v values takes v / 2 evaluations. Both are unbiased: each agrees
between two documents with the probability of their Jaccard similarity, and because an n-gram can't be
both, the pair's estimate varies less than that of two permutations. A band is the four values of two
permutations; as many bands are taken as keep the chance that two documents right at the threshold
share none below ``miss`` (31 bands of 62 permutations for 0.8 and 1e-7).

1. Signatures and set sums are made where the texts lie; equal sets are one class from there on.
2. Bands that only one class has end in a grouped count. In each other band the hub is the class whose
   bands hold most classes in all (the original of a family of edited copies meets more of them than a
   copy does); every class is paired with its bands' hubs, links are confirmed and contracted.
3. Bands that still hold several components are searched for links across them, so no link between
   classes is lost to the hubs. Families of copies that are a little too far apart to link would make
   pairs with the square of their number here, so pairs are first refuted where they meet: a class has a
   parity sketch, one bit for each value of its n-grams' hashes modulo a power of two above twice their
   number. N-grams that only one of two sets has flip one bit each at most, so sketches that differ in
   more bits than a link allows prove that there is none. A band of many classes is cut into slices that
   meet in pairs, so no task holds it whole.

Pairs with a hub first compare sizes and two-bit sketches of the signature (XOR and bit counts inside
the join), with a threshold that a linked pair misses with a chance below ``miss``. What is left is
confirmed on full n-gram sets, which are made again from the texts of the classes that share a band only.

Edge cases: null, empty and blank texts have no n-grams and link with nothing; a text with fewer words
than the width is one n-gram; rows that repeat a doc_id are rows of their own; a null doc_id stays null,
names no component unless all ids of it are null, and is kept only then; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowline.llm.blocks import text_blocks
from winnowline.llm.common import cut
from winnowline.llm.components import connected_components
from winnowline.llm.kernel import U64, mix, shingle_sets, trim
from winnowline.llm.ngram_join import overlaps

#: Permutations to a band; each gives two values.
ROWS = 2
#: n-gram hashes that one pass over the permutations takes at a time, so they stay in the cache.
CACHED = 1 << 15
#: Classes of a band that one task compares with one another or with as many others.
SLICE = 1024


def band_count(percent: int, miss: float) -> int:
    """Bands that two documents at the threshold share none of with a chance of at most ``miss``."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** (2 * ROWS))))) if percent < 100 else 1


def least_agreement(values: int, percent: int, miss: float) -> int:
    """Two-bit values that agree between documents at the threshold, but for a chance of at most ``miss``."""
    p, tail = (percent / 100) * 0.75 + 0.25, 0.0
    for k in range(values + 1):
        tail += math.comb(values, k) * p**k * (1 - p) ** (values - k)
        if tail > miss:
            return k
    return values


def min_max(grams: np.ndarray, sizes: np.ndarray, permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) hash of each set under each permutation; sets lie one behind the other and none is empty."""
    low, high = (np.empty((permutations, len(sizes)), U64) for _ in range(2))
    factors = mix(np.arange(1, permutations + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        begun = int(ends[at] - sizes[at])
        to = max(at + 1, int(np.searchsorted(ends, begun + CACHED, side="right")))
        part, heads = grams[begun : int(ends[to - 1])], ends[at:to] - sizes[at:to] - begun
        for k, factor in enumerate(factors):
            h = part * factor
            low[k, at:to] = np.minimum.reduceat(h, heads)
            high[k, at:to] = np.maximum.reduceat(h, heads)
        at = to
    return low, high


def packed_signatures(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A row of 64-bit words for each set: its bands' names, then two bits of each value."""
    permutations, n = low.shape
    bands, words = permutations // ROWS, -(-permutations // 16)
    out = np.zeros((n, bands + words), U64)
    with np.errstate(over="ignore"):
        for k in range(permutations):
            a, b = mix(low[k]), mix(high[k] + U64(0xC2B2AE3D27D4EB4F))
            out[:, k // ROWS] = mix(out[:, k // ROWS] * U64(0x9E3779B97F4A7C15) + a + U64(k)) + b
            out[:, bands + k // 16] |= ((a & U64(3)) | ((b & U64(3)) << U64(2))) << U64(4 * (k % 16))
    return out


def set_sums(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set's hashes that tell sets of one size apart."""
    grams, ends = np.concatenate([*sets, np.zeros(0, U64)]), np.cumsum([len(s) for s in sets])
    return tuple(np.array([x.sum(dtype=U64) for x in np.split(y, ends[:-1])], U64).view(np.int64) for y in (grams, mix(grams ^ U64(0xA0761D6478BD642F))))


def signed(docs: DataFrame, key: str, text: str, width: int, permutations: int) -> DataFrame:
    """A row for each document: doc, n, s1, s2 and its packed signature (null for an empty set)."""
    kind = docs.select(key).dtypes[0][1]

    def sign(batches):
        for rows in text_blocks(batches, "text", 4 << 20):
            sets = shingle_sets(rows.column("text"), width)
            full = [s for s in sets if len(s)]
            found = iter(packed_signatures(*min_max(np.concatenate([*full, np.zeros(0, U64)]), np.array([len(s) for s in full], np.int64), permutations)))
            s1, s2 = set_sums(sets)
            items = pa.array([next(found).tobytes() if len(s) else None for s in sets], pa.binary())
            yield from pa.table([rows.column("doc"), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1), pa.array(s2), items], names=["doc", "n", "s1", "s2", "items"]).to_batches()
        trim()

    return cut(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(sign, f"doc {kind}, n long, s1 long, s2 long, items binary"))


def with_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(rows with a set, with ``class``; the classes: class, low, n, s1, s2, items; the seed of their names). A class is named by a hash that no other class has."""
    some = rows.where("items IS NOT NULL")
    grouped = cut(some.groupBy("n", "s1", "s2").agg(F.min("doc").alias("low"), F.first("items").alias("items")))
    for seed in range(8):
        name = F.xxhash64(F.lit(seed), "n", "s1", "s2")
        if grouped.groupBy(name.alias("class")).count().where("count > 1").isEmpty():
            return some.withColumn("class", name), grouped.withColumn("class", name), seed
    raise RuntimeError("no seed tells the classes apart")


def unpacked(classes: DataFrame, first: int, count: int) -> DataFrame:
    """(class, word): words ``first`` to ``first + count`` of each class's signature, a row each."""

    def take(batches):
        for batch in batches:
            words = np.frombuffer(b"".join(batch.column("items").to_pylist()), np.int64).reshape(batch.num_rows, -1)[:, first : first + count]
            yield pa.record_batch([batch.column("class").take(pa.array(np.repeat(np.arange(batch.num_rows), count))), pa.array(words.reshape(-1))], names=["class", "word"])

    return classes.select("class", "items").mapInArrow(take, "class long, word long")


def sketches(classes: DataFrame, bands: int, words: int) -> DataFrame:
    """(class, n, k0, k1, ...): the two-bit sketch of each class."""

    def take(batches):
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column("items").to_pylist()), np.int64).reshape(batch.num_rows, -1)
            yield pa.record_batch([batch.column("class"), batch.column("n"), *(pa.array(np.ascontiguousarray(found[:, bands + k])) for k in range(words))], names=["class", "n", *(f"k{k}" for k in range(words))])

    return classes.select("class", "n", "items").mapInArrow(take, "class long, n long, " + ", ".join(f"k{k} long" for k in range(words)))


def _alike(left: str, right: str, words: int, values: int, percent: int, miss: float) -> Column:
    """Whether sizes and sketches let the two rows be linked."""
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    differ = sum((F.expr(f"bit_count(({left}.k{k} ^ {right}.k{k} | shiftrightunsigned({left}.k{k} ^ {right}.k{k}, 1)) & 6148914691236517205)") for k in range(words)), F.lit(0))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (differ <= values - least_agreement(values, percent, miss))


def parity_sketch(grams: np.ndarray) -> bytes:
    """Whether an odd number of the hashes falls on each place of a table with a power of two of places, at least twice as many as hashes."""
    places = max(64, 1 << (2 * len(grams) - 1).bit_length())
    return np.packbits((np.bincount((grams & U64(places - 1)).astype(np.int64), minlength=places) & 1).astype(np.uint8), bitorder="little").tobytes()


def unrefuted(n: np.ndarray, label: np.ndarray, sketch: list[bytes], part: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different labels whose sizes and parity sketches allow a link; of rows of two parts only pairs across them."""
    level, out = np.array([len(x) for x in sketch]), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    rows = {int(k): np.flatnonzero(level == k) for k in np.unique(level)}
    two_parts = len(np.unique(part)) > 1
    bits = {k: np.frombuffer(b"".join(sketch[i] for i in own), U64).reshape(len(own), -1) for k, own in rows.items()}
    for k, own in rows.items():
        for other in (k, 2 * k):
            if other in rows:
                x, y, with_ = bits[k], bits[other], rows[other]
                y = y if other == k else y[:, : k // 8] ^ y[:, k // 8 :]
                step = max(1, (1 << 22) // (len(with_) * (k // 8)))
                for at in range(0, len(own), step):
                    here = own[at : at + step]
                    differ = np.bitwise_count(x[at : at + step, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
                    both, small = n[here][:, None] + n[with_][None, :], np.minimum(n[here][:, None], n[with_][None, :])
                    may = ((100 + percent) * differ <= (100 - percent) * both) & ((100 + percent) * small >= percent * both) & (label[here][:, None] != label[with_][None, :])
                    may &= (here[:, None] < with_[None, :]) | (other != k)
                    if two_parts:
                        may &= part[here][:, None] != part[with_][None, :]
                    i, j = np.nonzero(may)
                    out.append((here[i], with_[j]))
    return tuple(np.concatenate(x) for x in zip(*out))


def across_components(still: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of classes of different components that share a band and that sketches do not refute."""

    def sketch(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("class"), pa.array([parity_sketch(np.frombuffer(x, U64)) for x in batch.column("items").to_pylist()], pa.binary())], names=["class", "sketch"])

    def compare(rows: pa.Table) -> pa.Table:
        name = rows.column("class").to_numpy()
        i, j = unrefuted(rows.column("n").to_numpy(), rows.column("label").to_numpy(), rows.column("sketch").to_pylist(), rows.column("part").to_numpy(), percent)
        trim()
        return pa.table([pa.array(np.minimum(name[i], name[j])), pa.array(np.maximum(name[i], name[j]))], names=["a", "b"])

    size = still.groupBy(F.col("band").alias("of")).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("parts"))
    dealt = still.join(size, F.col("band") == F.col("of")).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    met = dealt.select("band", "class", "n", "label", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    met = met.join(cut(sets.mapInArrow(sketch, "class long, sketch binary")).hint("merge"), "class")
    cells = met.groupBy("band", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"))
    return cells.applyInArrow(compare, "a long, b long").distinct()


def full_sets(docs: DataFrame, classes: DataFrame, seed: int, named: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(class, items): the packed n-gram sets of the classes named, made again from one text each; other classes whose texts have the same id may come with them."""
    kind = docs.select(key).dtypes[0][1]

    def make(batches):
        for rows in text_blocks(batches, "text", 4 << 20):
            sets = shingle_sets(rows.column("text"), width)
            s1, s2 = set_sums(sets)
            yield from pa.table([pa.array([len(s) for s in sets], pa.int64()), pa.array(s1), pa.array(s2), pa.array([s.tobytes() for s in sets], pa.binary())], names=["n", "s1", "s2", "items"]).to_batches()
        trim()

    # Merged at every size: what is broadcast for a small table would be shuffled for a large one.
    d = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    ids = classes.join(named, "class").select(F.col("low").cast(kind).alias("id")).distinct()
    sets = d.join(ids.hint("merge"), d["doc"].eqNullSafe(ids["id"]), "left_semi").select("text").mapInArrow(make, "n long, s1 long, s2 long, items binary")
    return cut(sets.groupBy(F.xxhash64(F.lit(seed), "n", "s1", "s2").alias("class")).agg(F.first("items").alias("items")))


def class_links(docs: DataFrame, classes: DataFrame, seed: int, key: str, text: str, width: int, percent: int, miss: float) -> DataFrame:
    """(node, label) over the classes that link."""
    bands = band_count(percent, miss)
    values, words = 2 * ROWS * bands, -(-ROWS * bands // 16)
    rows = cut(unpacked(classes, 0, bands).withColumnRenamed("word", "band"))
    shared = rows.groupBy(F.col("band").alias("of")).agg(F.count("*").alias("size")).where("size > 1")
    met = cut(rows.join(shared, F.col("band") == F.col("of")).select("band", "class", "size"))
    degree = met.groupBy("class").agg(F.sum("size").alias("degree"))
    sketch = [f"k{k}" for k in range(words)]
    known = cut(degree.join(sketches(classes, bands, words), "class"))
    met = cut(met.select("band", "class").join(known, "class"))
    alike = _alike("x", "y", words, values, percent, miss)
    pair = [F.least(F.col("x.class"), F.col("y.class")).alias("a"), F.greatest(F.col("x.class"), F.col("y.class")).alias("b")]
    hubs = met.groupBy("band").agg(F.max(F.struct("degree", "class", "n", *sketch)).alias("h")).select("band", "h.*")
    x, y = met.alias("x"), hubs.alias("y")
    first = cut(x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.class") != F.col("y.class")) & alike).select(*pair).distinct())
    sets = full_sets(docs, classes, seed, met.select("class").distinct(), key, text, width)
    links = cut(overlaps(first.hint("merge"), sets.hint("merge"), percent))
    labels = cut(connected_components(links))
    marked = met.join(labels, met["class"] == labels["node"], "left").select("band", "class", "n", F.coalesce("label", "class").alias("label"))
    split = marked.groupBy(F.col("band").alias("of")).agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("of")
    still = cut(marked.join(split, F.col("band") == F.col("of"), "left_semi"))
    second = cut(across_components(still, sets, percent).join(first, ["a", "b"], "left_anti"))
    if second.isEmpty():
        return labels
    more = cut(overlaps(second.hint("merge"), sets.hint("merge"), percent))
    return labels if more.isEmpty() else cut(connected_components(links.unionByName(more)))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """Per document: key, n_shingles, component_id (the smallest key reachable by links of Jaccard >= percent / 100) and kept (the key is its component's)."""
    rows = signed(docs, key, text, width, ROWS * band_count(percent, miss))
    some, classes, seed = with_classes(rows)
    labels = class_links(docs, classes, seed, key, text, width, percent, miss)
    named = classes.select("class", "low").join(labels, F.col("class") == F.col("node"), "left").select("class", "low", F.coalesce("label", "class").alias("label"))
    least = named.groupBy(F.col("label").alias("of")).agg(F.min("low").alias("component"))
    component = named.join(least, F.col("label") == F.col("of")).select(F.col("class").alias("c"), "component")
    linked = some.join(component, F.col("class") == F.col("c")).select("doc", "n", "component")
    alone = rows.where("items IS NULL").select("doc", "n", F.col("doc").alias("component"))
    out = linked.unionByName(alone)
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"), F.col("doc").eqNullSafe(F.coalesce("component", "doc")).alias("kept"))


def components_sql(percent: int) -> str:
    """SQL for the rows of ``near_copies`` over the table documents, with shingles of four words."""
    return r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, hash(unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END))) AS gram FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= PERCENT * (x.n + y.n - shared)),
step AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT DISTINCT a, a FROM step UNION SELECT reach.doc_id, step.b FROM reach JOIN step ON reach.other = step.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
""".replace("PERCENT", str(percent))


#: The rows of the query with 80 percent.
SQL = components_sql(80)
