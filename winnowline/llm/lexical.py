"""Ranked lexical search on a two-level quantised index.

``build_index`` keeps every term of every document in blocks of consecutive documents. A block has its
terms (64-bit hashes, ascending), each with the ordinals of its documents and, as the exact level, the
occurrences there and the documents' lengths. The quantised level is one byte for each posting: its
share of a score divided by ``STEP`` and rounded up, so a byte bounds the exact share from above and the
byte before it bounds it from below; the greatest byte of a term in the block bounds the whole block.

``search`` reads bytes first: sums of weighted bytes give every document an upper and a lower bound, and
the k-th greatest lower bound over all blocks is a score that k documents reach. The second pass skips
blocks whose greatest bytes stay below it, and rescores with integers every document whose upper bound
reaches it, in its block. So the result is exact, ties by key included, and no (document, term) rows are
made: a block sends at most k rows for each query in either pass.

Queries are taken in slices of bounded text (``slice_bytes``), so what is sent to the tasks and collected
(terms, document frequencies, one threshold for each query) is bounded as well; a slice costs two passes.

Edge cases: null and empty texts have no terms, count in no statistic and are never found; queries
without terms, or whose terms no document has, give no rows; rows that repeat a query (id and text) are
one query, rows with the same id and other text are further queries under that id; rows that repeat a
doc_id are ranked each; a null doc_id comes behind equal scores; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnowline.llm.blocks import block_names, ended, spans_of, text_blocks
from winnowline.llm.common import cut
from winnowline.llm.kernel import U64, span_hashes, spread, tables, trim

#: Exact shares lie below 10^9 / 1000; a byte stands for so much of one.
STEP = -(-1_000_000 // 255)
#: 100, 25 and 12: the length normalisation of a share and its weight against the occurrences.
WHOLE, PART, SLOPE = 100, 25, 12


def _separators() -> np.ndarray:
    out = np.ones(256, bool)
    for first, last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        out[first : last + 1] = False
    return out


def terms(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start, end of each term; the texts' bytes with A-Z lowered)."""
    from winnowline.llm.kernel import utf8

    data, starts = ended(*utf8(column))
    data = tables()[1][data]
    begin, end = spans_of(data, _separators())
    return span_hashes(data, begin, end), np.searchsorted(starts, begin, side="right") - 1, begin, end, data


def exact_shares(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + SLOPE * m)


def length_factors(lens: np.ndarray, n: int, total: int) -> np.ndarray:
    return WHOLE - PART + (PART * lens.astype(np.int64) * n) // max(total, 1)


def raw_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(block, ids, terms, starts, ords, tfs, lens): the exact level of each block."""
    kind = docs.select(key).dtypes[0][1]

    def build(batches):
        for block, rows in zip(block_names(), text_blocks(batches, "text")):
            hashes, doc, *_ = terms(rows.column("text"))
            order = np.lexsort((doc, hashes))
            h, d = hashes[order], doc[order]
            head = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
            tfs = np.diff(np.append(head, len(h)))
            h, d = h[head], d[head]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
            lens = np.bincount(doc, minlength=rows.num_rows)
            columns = {"terms": h[first], "starts": np.append(first, len(h)).astype(np.uint32), "ords": d.astype(np.uint16), "tfs": tfs.astype(np.uint32), "lens": lens.astype(np.uint32)}
            ids = rows.column("doc").combine_chunks()
            yield pa.record_batch([pa.array([block]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x.tobytes()], pa.binary()) for x in columns.values()), pa.array([int((lens > 0).sum())]), pa.array([int(lens.sum())])], names=["block", "ids", *columns, "filled", "total"])
            trim()

    return cut(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(build, f"block long, ids array<{kind}>, terms binary, starts binary, ords binary, tfs binary, lens binary, filled long, total long"))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int, int]:
    """(the index, a row for each block; N, the documents with a term; L, their terms)."""
    raw = raw_blocks(docs, key, text)
    n, total = raw.agg(F.coalesce(F.sum("filled"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    def quantise(batches):
        for batch in batches:
            impacts, most = [], []
            for starts, ords, tfs, lens in zip(*(batch.column(c).to_pylist() for c in ("starts", "ords", "tfs", "lens"))):
                m = length_factors(np.frombuffer(lens, np.uint32), n, total)
                shares = exact_shares(np.frombuffer(tfs, np.uint32), m[np.frombuffer(ords, np.uint16)])
                q = (-(-shares // STEP)).astype(np.uint8)
                heads = np.frombuffer(starts, np.uint32)[:-1]
                impacts.append(q.tobytes())
                most.append((np.maximum.reduceat(q, heads) if len(heads) else q).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(impacts, pa.binary()), pa.array(most, pa.binary())], names=[*batch.schema.names, "impacts", "most"])
        trim()

    kept = raw.drop("filled", "total")
    shape = ", ".join(f"{c} {kind}" for c, kind in kept.dtypes)
    return cut(kept.mapInArrow(quantise, f"{shape}, impacts binary, most binary")), n, total


class _Slice:
    """The queries of a slice: for each its terms' places in the sorted term list and their weights."""

    def __init__(self, texts: list[str]):
        hashes, query, *_ = terms(pa.array(texts, pa.string()))
        self.terms, place = np.unique(hashes, return_inverse=True)
        self.places, self.repeats = [], []
        for k in range(len(texts)):
            p, r = np.unique(place[query == k], return_counts=True)
            self.places.append(p)
            self.repeats.append(r.astype(np.int64))

    def weigh(self, found: dict[int, int], n: int) -> None:
        """Weights from the document frequencies by term hash."""
        df = [found.get(int(h), 0) for h in self.terms.view(np.int64)]
        w = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for f in df], np.int64)
        self.weights = [w[p] * r for p, r in zip(self.places, self.repeats)]


def _lists(asked: _Slice, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether the block has the term, where its postings start and end) for the slice's terms."""
    own, starts = np.frombuffer(row["terms"], U64), np.frombuffer(row["starts"], np.uint32).astype(np.int64)
    if not len(own):
        z = np.zeros(len(asked.terms), np.int64)
        return z.astype(bool), z, z
    at = np.minimum(np.searchsorted(own, asked.terms), len(own) - 1)
    return own[at] == asked.terms, starts[at], starts[at + 1]


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def _document_frequencies(index: DataFrame, asked: _Slice) -> dict[int, int]:
    def count(batches):
        total = np.zeros(len(asked.terms), np.int64)
        for row in _rows(batches):
            has, begin, end = _lists(asked, row)
            total += np.where(has, end - begin, 0)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(asked.terms[some].view(np.int64)), pa.array(total[some])], names=["term", "df"])

    counts = index.select("terms", "starts").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in counts.collect()}


def _bounds(asked: _Slice, q: int, has, begin, end, ords, impacts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(upper, lower) bounds of query q for all documents of the block."""
    bytes_, weights = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for p, w in zip(asked.places[q], asked.weights[q]):
        if has[p]:
            at, x = ords[begin[p] : end[p]], impacts[begin[p] : end[p]]
            bytes_[at] += w * x
            weights[at] += np.where(x > 0, w, 0)
    return bytes_ * STEP, bytes_ * STEP - weights * (STEP - 1)


def thresholds(index: DataFrame, asked: _Slice, k: int) -> np.ndarray:
    """For each query the k-th greatest lower bound; 1 where fewer documents have one above 0."""

    def lower(batches):
        for row in _rows(batches):
            has, begin, end = _lists(asked, row)
            ords, impacts, size = np.frombuffer(row["ords"], np.uint16), np.frombuffer(row["impacts"], np.uint8).astype(np.int64), len(row["lens"]) // 4
            query, bound = [], []
            for q in range(len(asked.places)):
                low = _bounds(asked, q, has, begin, end, ords, impacts, size)[1]
                low = low[low > 0]
                low = np.partition(low, len(low) - k)[len(low) - k :] if len(low) > k else low
                query.append(np.full(len(low), q, np.int32))
                bound.append(low)
            yield pa.record_batch([pa.array(np.concatenate([*query, np.zeros(0, np.int32)])), pa.array(np.concatenate([*bound, np.zeros(0, np.int64)]))], names=["query", "low"])

    rows = index.select("terms", "starts", "ords", "impacts", "lens").mapInArrow(lower, "query int, low long")
    last = rows.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))).where(f"place <= {k}").groupBy("query").agg(F.min("low").alias("low"), F.count("*").alias("rows"))
    out = np.ones(len(asked.places), np.int64)
    for r in last.collect():
        if r["rows"] == k:
            out[r["query"]] = r["low"]
    return out


def _rescored(asked: _Slice, q: int, has, begin, end, ords, tfs, m, may: np.ndarray) -> np.ndarray:
    """Exact scores of query q for the documents that may; 0 for the others."""
    score = np.zeros(len(may), np.int64)
    for p, w in zip(asked.places[q], asked.weights[q]):
        if has[p]:
            at = ords[begin[p] : end[p]]
            own = np.flatnonzero(may[at])
            score[at[own]] += w * exact_shares(tfs[begin[p] : end[p]][own], m[at[own]])
    return score


def candidates(index: DataFrame, asked: _Slice, least: np.ndarray, k: int, n: int, total: int) -> DataFrame:
    """(query, doc, score): of each block the k best documents for each query, of those whose upper bound reaches the threshold."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def rescore(batches):
        for batch in batches:
            for ids, row in zip(batch.column("ids"), batch.drop_columns(["ids"]).to_pylist()):
                has, begin, end = _lists(asked, row)
                ords, impacts, most = np.frombuffer(row["ords"], np.uint16), np.frombuffer(row["impacts"], np.uint8).astype(np.int64), np.frombuffer(row["most"], np.uint8).astype(np.int64)
                tfs, lens = np.frombuffer(row["tfs"], np.uint32), np.frombuffer(row["lens"], np.uint32)
                m = length_factors(lens, n, total)
                heads = np.searchsorted(np.frombuffer(row["starts"], np.uint32)[:-1], begin) if len(most) else begin
                for q, (places, weights) in enumerate(zip(asked.places, asked.weights)):
                    there = has[places]
                    if STEP * int((weights[there] * most[heads[places[there]]]).sum()) < least[q]:
                        continue
                    may = _bounds(asked, q, has, begin, end, ords, impacts, len(lens))[0] >= least[q]
                    score = _rescored(asked, q, has, begin, end, ords, tfs, m, may)
                    some = np.flatnonzero(score > 0)
                    if len(some):
                        found = pa.table([pa.array(np.full(len(some), q, np.int32)), ids.values.take(pa.array(some)), pa.array(score[some])], names=["query", "doc", "score"])
                        best = pc.sort_indices(found, sort_keys=[("score", "descending"), ("doc", "ascending")], null_placement="at_end")[:k]
                        yield from found.take(best).to_batches()

    return index.mapInArrow(rescore, f"query int, doc {kind}, score long")


def search(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 20, slice_bytes: int = 4 << 20) -> DataFrame:
    """item, rank, key, score: the k documents with the highest scores above 0 for each query, equal scores by ascending key."""
    spark = docs.sparkSession
    index, n, total = build_index(docs, key, text)
    asked = queries.where(F.col(item_text).isNotNull()).select(F.col(item).alias("item"), F.col(item_text).alias("words")).distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("words") + 16), F.lit(0))).first()[0]
    slices = max(1, -(-size // slice_bytes))
    parts = []
    for s in range(slices):
        own = asked.where(F.pmod(F.xxhash64("item", "words"), F.lit(slices)) == s).collect()
        if own:
            part = _Slice([r["words"] for r in own])
            part.weigh(_document_frequencies(index, part), n)
            found = candidates(index, part, thresholds(index, part, k), k, n, total)
            best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc")))).where(f"rank <= {k}")
            names = spark.createDataFrame([(q, r["item"]) for q, r in enumerate(own)], f"query int, item {asked.dtypes[0][1]}")
            parts.append(cut(best.join(names, "query").select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")))
    if not parts:
        return asked.join(docs.select(F.col(key)).limit(0)).select(F.col("item").alias(item), F.lit(0).alias("rank"), key, F.lit(0).cast("long").alias("score")).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: The same rows for the tables documents and benchmark.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY ALL),
lens AS (SELECT doc_id, len(words)::BIGINT AS n FROM d WHERE len(words) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lens),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term),
share AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)) AS share FROM tf JOIN lens USING (doc_id), total),
score AS (SELECT item_id, doc_id, sum(qtf * w * share)::BIGINT AS score FROM asked JOIN w USING (term) JOIN share USING (term) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM score WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
