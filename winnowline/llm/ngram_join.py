"""N-gram Jaccard self-join: a blocked sparse product of the document by n-gram incidence matrix.

The matrix is cut into row blocks (hash batches of documents) and column blocks (ranges of n-gram
hashes). A row block sends the n-grams of its documents to the column blocks once, as packed arrays;
column sums (document frequencies) come back in the same order, one byte each. Size-derived bounds
then discard most of the work before any product is taken:

* a document of n n-grams links to nothing unless ceil(t n) of them occur elsewhere as well;
* documents of n1 and n2 n-grams must overlap by o = ceil(t / (1 + t) (n1 + n2)), so they share an
  n-gram among the first n1 - o + 1 and n2 - o + 1 in order of frequency;
* from its places in both orders follows how much they can share before and behind it.

Equal rows are one class. Of the pairs that the remaining columns make, first those with each column's
hub (the row that has the fewest rarer n-grams) are multiplied out, overlap counts are compared with the
bound, and the links contracted to components; then every pair of *different* components that a column
still joins. So no link between components is lost, and a group of n near copies costs about n
products and not n^2.

N-grams are 64-bit hashes. Edge cases: null, empty and blank texts have no n-grams and are linked with
nothing; a text with fewer words than the width is one n-gram; rows that repeat a doc_id are rows of
their own (and equal texts one class); a null doc_id stays null and names no component unless all ids
of the component are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowline.llm.common import batches_for, cut, set_aside
from winnowline.llm.components import connected_components
from winnowline.llm.kernel import U64, mix, shingle_sets, trimmed

#: Of 16 n-gram hashes so many have their frequency taken in the first pass, which only discards rows.
FIRST_PASS = 6
REQUEST = "bucket int, g int, grams binary, counts binary"
REPLY = "g int, bucket int, freqs binary"


def _bounds(grams: np.ndarray, buckets: int) -> np.ndarray:
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], U64)
    return np.concatenate(([0], np.searchsorted(grams, edges), [len(grams)]))


def _requests(g: int, grams: np.ndarray, buckets: int) -> pa.Table:
    """Distinct n-grams of a row block and their counts in it, by column block."""
    u, c = np.unique(grams, return_counts=True)
    at, c = _bounds(u, buckets), np.minimum(c, 255).astype(np.uint8)
    full = np.flatnonzero(np.diff(at)).tolist()
    return pa.table([pa.array(full, pa.int32()), pa.array([g] * len(full), pa.int32()), pa.array([u[at[k] : at[k + 1]].tobytes() for k in full], pa.binary()), pa.array([c[at[k] : at[k + 1]].tobytes() for k in full], pa.binary())], names=["bucket", "g", "grams", "counts"])


def _column_sums(block: pa.Table) -> pa.Table:
    """Document frequencies (255: so many or more) for each row block's n-grams, in the order asked."""
    parts = [np.frombuffer(b, U64) for b in block.column("grams").to_pylist()]
    _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    counts = np.frombuffer(b"".join(block.column("counts").to_pylist()), np.uint8)
    freqs = np.minimum(np.bincount(inverse, counts), 255).astype(np.uint8)[inverse]
    ends = np.cumsum([len(p) for p in parts])
    return pa.table([block.column("g"), block.column("bucket"), pa.array([f.tobytes() for f in np.split(freqs, ends[:-1])], pa.binary())], names=["g", "bucket", "freqs"])


def _answers(reply: pa.Table) -> np.ndarray:
    """All answers to a row block in ascending order of its n-grams."""
    blobs, order = reply.column("freqs").to_pylist(), np.argsort(reply.column("bucket").to_numpy())
    return np.frombuffer(b"".join(blobs[k] for k in order), np.uint8)


def _needed(n, percent: int):
    return (percent * n + 99) // 100


def shingled(docs: DataFrame, key: str, text: str, width: int, percent: int, batch_bytes: int) -> DataFrame:
    """A row for each document: doc, n, s1 and s2 (sums of its n-grams' hashes), and items (its packed n-grams) if it may link at all."""
    count = batches_for(docs, text, batch_bytes)
    kind = docs.select(key).dtypes[0][1]
    d = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).withColumn("g", F.pmod(F.xxhash64("doc", F.length("text")), F.lit(count)).cast("int"))

    def ask(rows: pa.Table) -> pa.Table:
        sets = shingle_sets(rows.column("text"), width)
        grams = np.concatenate(sets)
        return _requests(rows.column("g")[0].as_py(), grams[(grams & U64(15)) < FIRST_PASS], count)

    def settle(rows: pa.Table, reply: pa.Table) -> pa.Table:
        sets = shingle_sets(rows.column("text"), width)
        sizes = np.array([len(s) for s in sets], np.int64)
        grams = np.concatenate(sets)
        asked = (grams & U64(15)) < FIRST_PASS
        _, inverse = np.unique(grams[asked], return_inverse=True)
        unique = np.zeros(len(grams), np.int64)
        unique[asked] = _answers(reply)[inverse] == 1
        sums = np.concatenate(([0], np.cumsum(unique)))
        ends = np.cumsum(sizes)
        own = sums[ends] - sums[ends - sizes]
        may = (sizes > 0) & (sizes - own >= _needed(sizes, percent))
        second = mix(grams ^ U64(0xA0761D6478BD642F))
        s1, s2 = ([int(part.sum(dtype=U64)) for part in np.split(x, ends[:-1])] for x in (grams, second))
        return pa.table([rows.column("doc"), pa.array(sizes), pa.array(np.array(s1, U64).view(np.int64)), pa.array(np.array(s2, U64).view(np.int64)), pa.array([s.tobytes() if m else None for s, m in zip(sets, may)], pa.binary())], names=["doc", "n", "s1", "s2", "items"])

    replies = d.groupBy("g").applyInArrow(lambda rows: trimmed(ask)(rows), REQUEST).groupBy("bucket").applyInArrow(lambda block: trimmed(_column_sums)(block), REPLY)
    rows = d.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(lambda rows, reply: trimmed(settle)(rows, reply), f"doc {kind}, n long, s1 long, s2 long, items binary")
    return cut(rows)


def with_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may link, with ``class``; the classes). Equal n-gram sets, told by their size and two sums, are one class.

    A class is named by a 64-bit hash. Names that two classes share are found and dealt anew with another seed.
    """
    may = rows.where("items IS NOT NULL")
    grouped = cut(may.groupBy("n", "s1", "s2").agg(F.min("doc").alias("low"), F.first("items").alias("items")))
    for seed in range(8):
        name = F.xxhash64(F.lit(seed), "n", "s1", "s2")
        if grouped.groupBy(name.alias("class")).count().where("count > 1").isEmpty():
            return may.withColumn("class", name), grouped.select(name.alias("class"), "low", "n", "items")
    raise RuntimeError("no seed tells the classes apart")


def postings(classes: DataFrame, percent: int, batch_bytes: int) -> DataFrame:
    """(gram, class, n, pos): the columns in which a row can meet a linked row first, and the gram's place in the row's order of frequency."""
    count = batches_for(classes, "items", batch_bytes)
    d = classes.select("class", "n", "items").withColumn("g", F.pmod(F.xxhash64("class"), F.lit(count)).cast("int"))

    def ask(rows: pa.Table) -> pa.Table:
        return _requests(rows.column("g")[0].as_py(), np.frombuffer(b"".join(rows.column("items").to_pylist()), U64), count)

    def settle(rows: pa.Table, reply: pa.Table) -> pa.Table:
        grams = np.frombuffer(b"".join(rows.column("items").to_pylist()), U64)
        _, inverse = np.unique(grams, return_inverse=True)
        freqs = _answers(reply)[inverse]
        out, at = [], 0
        for row, n in enumerate(rows.column("n").to_pylist()):
            own, f = grams[at : at + n], freqs[at : at + n]
            at += n
            shared = np.flatnonzero(f > 1)
            first = (n - _needed(n, percent) + 1) - (n - len(shared))
            if first > 0 and len(shared):
                order = shared[np.lexsort((own[shared], f[shared]))][:first]
                out.append((own[order], np.full(len(order), row), n - len(shared) + 1 + np.arange(len(order))))
        gram, row, pos = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))
        row = row.astype(np.int64)
        return pa.table([pa.array(gram.view(np.int64)), rows.column("class").take(pa.array(row)), rows.column("n").take(pa.array(row)), pa.array(pos.astype(np.int64))], names=["gram", "class", "n", "pos"])

    replies = d.groupBy("g").applyInArrow(lambda rows: trimmed(ask)(rows), REQUEST).groupBy("bucket").applyInArrow(lambda block: trimmed(_column_sums)(block), REPLY)
    return cut(d.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(lambda rows, reply: trimmed(settle)(rows, reply), "gram long, class long, n long, pos long"))


def overlaps(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact overlap reaches the bound: row products of packed n-grams."""

    def multiply(batches):
        for batch in batches:
            left, right = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            keep = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                z = np.concatenate((x, y))
                z.sort()
                keep.append((100 + percent) * int((z[1:] == z[:-1]).sum()) >= percent * len(z))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    c = classes.select("class", "items")
    d = pairs.join(c.select(F.col("class").alias("a"), F.col("items").alias("x")), "a").join(c.select(F.col("class").alias("b"), F.col("items").alias("y")), "b")
    return d.select("a", "b", "x", "y").mapInArrow(multiply, "a long, b long")


def _fits(percent: int, left: str, right: str):
    """Whether the overlap can reach the bound if the rows share this gram.

    Linked rows meet within the first n - bound + 1 grams of either; and of what lies before, at and
    behind the shared gram, the rows can have no more in common than the smaller part of each.
    """
    n, m, i, j = F.col(f"{left}.n"), F.col(f"{right}.n"), F.col(f"{left}.pos"), F.col(f"{right}.pos")
    room = F.least(n - i + 1, m - j + 1, F.least(i, j) + F.least(n - i, m - j))
    return (100 + percent) * room >= percent * (n + m)


def class_links(classes: DataFrame, percent: int, batch_bytes: int) -> DataFrame:
    """(node, label) over the classes that link: first hub pairs, then pairs of components that still meet."""
    p = postings(classes, percent, batch_bytes)
    least = F.least(F.col("p.class"), F.col("h.class"))
    hubs = p.groupBy("gram").agg(F.min(F.struct("pos", "class", "n")).alias("h"), F.count("*").alias("rows")).where("rows > 1").select(F.col("gram").alias("hub_gram"), "h.*")
    met = p.alias("p").join(hubs.alias("h"), F.col("p.gram") == F.col("h.hub_gram")).where((F.col("p.class") != F.col("h.class")) & _fits(percent, "p", "h"))
    first = cut(met.select(least.alias("a"), F.greatest(F.col("p.class"), F.col("h.class")).alias("b")).distinct())
    links = cut(overlaps(first, classes, percent))
    labels = cut(connected_components(links))
    marked = p.join(labels, p["class"] == labels["node"], "left").select("gram", "class", "n", "pos", F.coalesce("label", "class").alias("label"))
    split = marked.groupBy(F.col("gram").alias("split_gram")).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("split_gram")
    open_rows = cut(marked.join(split, F.col("gram") == F.col("split_gram"), "left_semi"))
    x, y = open_rows.alias("x"), open_rows.alias("y")
    across = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.label") < F.col("y.label")) & _fits(percent, "x", "y"))
    across = across.select(F.least(F.col("x.class"), F.col("y.class")).alias("a"), F.greatest(F.col("x.class"), F.col("y.class")).alias("b")).distinct()
    second = cut(across.join(first, ["a", "b"], "left_anti"))
    more = cut(overlaps(second, classes, percent))
    return labels if more.isEmpty() else cut(connected_components(links.unionByName(more)))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85, batch_bytes: int = 12 << 20) -> DataFrame:
    """Per document: key, n_shingles and component_id, the smallest key reachable by links of Jaccard >= percent / 100."""
    rows = shingled(docs, key, text, width, percent, batch_bytes)
    may, classes = with_classes(rows)
    labels = class_links(classes, percent, batch_bytes)
    named = classes.select("class", "low").join(labels, F.col("class") == F.col("node"), "left").select("class", "low", F.coalesce("label", "class").alias("label"))
    least = named.groupBy(F.col("label").alias("of")).agg(F.min("low").alias("component"))
    component = named.join(least, F.col("label") == F.col("of")).select(F.col("class").alias("c"), "component")
    linked = may.drop("items").join(component, F.col("class") == F.col("c")).select("doc", "n", "component")
    alone = rows.where("items IS NULL").select("doc", "n", F.col("doc").alias("component"))
    return linked.unionByName(alone).select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, **options) -> DataFrame:
    """The document with the smallest key of each component, with its columns as they came; of equal rows one."""
    docs, named = set_aside(docs, key, text)
    found = jaccard_components(docs, key, text, width, percent, **options)
    first = found.where(F.col(key).eqNullSafe(F.col("component_id")))
    ids = cut(first.groupBy(F.col(key).alias("__id")).agg(F.count("*").alias("__rows")))
    kept = docs.join(ids, docs[key].eqNullSafe(ids["__id"]))
    once = kept.where("__rows = 1").select(*docs.columns)
    again = kept.where("__rows > 1").select(*docs.columns).dropDuplicates([key, text])
    return named(once.unionByName(again))
