"""Rank-safe top-k text search on an inverted index in blocks of documents.

A block holds its terms (64-bit hashes, ascending); each term's postings in document order; of a list
longer than ``CHAMPIONS`` the places of its greatest impacts, greatest first; and the list's greatest
impact. A query reads a block in the order of what can still matter:

1. the champions of its terms are scored in full and give a score that k documents reach;
2. lists whose greatest impacts add up to less than that are not scanned: a document that is in none of
   the others can't be among the k best, so a term that every document has costs nothing but look-ups;
3. the other lists are scanned, and documents whose sum can't reach the k-th with the greatest impacts
   of the lists left out are dropped before these are looked up one after the other.

Each task carries the k-th score of a query from block to block, and a whole block is skipped if its
greatest impacts do not reach it. Scores within ``ROOM`` of the k-th are never dropped, so ties come out
as they would from a full scan. At most k rows for each query and block leave a task.

Edge cases: a null text is a document without terms that does not count in the mean length; queries
without terms, or with terms that no document has, give no rows; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnowline.sources.scratch import stored

CHAMPIONS = 64
#: Half a unit of the sixth digit, to which scores are rounded, and rounding errors.
ROOM = 1e-6


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def term_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda x: F.xxhash64(x))


class Index(NamedTuple):
    """Blocks, how many documents there are and their mean length."""

    blocks: DataFrame
    n: int
    mean: float
    k1: float
    b: float


def _rows(batch: pa.RecordBatch):
    """A batch's rows one after the other, binary columns as views of the batch: blocks are large, and copies of all of them are not made."""
    for at in range(batch.num_rows):
        yield {c: v[at].as_buffer() if pa.types.is_binary(v.type) else v[at] for c, v in zip(batch.schema.names, batch.columns)}


def _groups(batches, most_terms: int):
    """Batches cut where a block would hold more than ``most_terms`` terms or 65,535 documents."""
    for batch in batches:
        ends, at = np.cumsum(batch.column("terms").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), 0
        while at < batch.num_rows:
            to = min(max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_terms, side="right"))), at + 65_535, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def build_index(docs: DataFrame, k1: float = 1.2, b: float = 0.75, block_terms: int = 2_000_000) -> Index:
    """The index of documents (doc_id, text): texts are taken apart once, in JVM columns, and their hashes laid out in two passes."""
    kind = docs.select("doc_id").dtypes[0][1]

    def lay_out(batches):
        for rows in _groups(batches, block_terms):
            column = rows.column("terms")
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            missing, doc = column.null_count, np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
            terms = column.flatten().to_numpy()
            order = np.argsort(terms, kind="stable")  # documents ascend already
            t, d = terms[order], doc[order]
            del doc, terms, order, column
            head = np.flatnonzero(np.concatenate((np.ones(min(1, len(t)), bool), (t[1:] != t[:-1]) | (d[1:] != d[:-1]))))
            tfs = np.diff(np.append(head, len(t))).astype(np.uint32)
            t, d = t[head], d[head]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(t)), bool), t[1:] != t[:-1])))
            ids = rows.column("doc_id")
            blobs = {"terms": t[first], "starts": np.append(first, len(t)).astype(np.uint32), "ords": d, "tfs": tfs, "lens": sizes.astype(np.uint32)}
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x.tobytes()], pa.binary()) for x in blobs.values()), pa.array([len(ids)]), pa.array([len(ids) - missing]), pa.array([int(sizes.sum())])], names=["ids", *blobs, "docs", "texts", "total"])

    raw = stored(docs.select("doc_id", term_hashes(F.col("text")).alias("terms")).mapInArrow(lay_out, f"ids array<{kind}>, terms binary, starts binary, ords binary, tfs binary, lens binary, docs long, texts long, total long"))
    n, mean = raw.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("total") / F.nullif(F.sum("texts"), F.lit(0)), F.lit(0.0))).first()

    def order(batches):
        for batch in batches:
            for place, row in enumerate(_rows(batch.select(["starts", "ords", "tfs", "lens"]))):
                starts, impact = np.frombuffer(row["starts"], np.uint32).astype(np.int64), impacts(np.frombuffer(row["tfs"], np.uint32), np.frombuffer(row["lens"], np.uint32)[np.frombuffer(row["ords"], np.uint16)], mean, k1, b)
                most = np.maximum.reduceat(impact, starts[:-1]) if len(starts) > 1 else impact
                best = [s + np.argpartition(-impact[s:e], CHAMPIONS)[:CHAMPIONS] for s, e in zip(starts[:-1], starts[1:]) if e - s > CHAMPIONS]
                best = [x[np.argsort(-impact[x], kind="stable")] for x in best]
                has = np.diff(starts) > CHAMPIONS
                at = (np.cumsum(has) * has).astype(np.uint32)
                champions = np.concatenate([*best, np.zeros(0, np.int64)]).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([*batch.slice(place, 1).columns, *(pa.array([x.tobytes()], pa.binary()) for x in (most, at, champions))], names=[*batch.schema.names, "most", "at", "champions"])

    shape = ", ".join(f"{c} {t}" for c, t in raw.drop("docs", "texts", "total").dtypes)
    return Index(stored(raw.drop("docs", "texts", "total").mapInArrow(order, f"{shape}, most binary, at binary, champions binary")), n, mean, k1, b)


def impacts(tf: np.ndarray, length: np.ndarray, mean: float, k1: float, b: float) -> np.ndarray:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / (mean or 1.0)))


class Block:
    """A block's arrays, with the number of postings that queries have read."""

    def __init__(self, row: dict, index: tuple[float, float, float], shared: bool):
        kinds = {"terms": np.int64, "starts": np.uint32, "ords": np.uint16, "tfs": np.uint32, "lens": np.uint32, "most": np.float64, "at": np.uint32, "champions": np.uint32}
        self.__dict__.update({c: np.frombuffer(row[c], t) for c, t in kinds.items()})
        self.starts = self.starts.astype(np.int64)
        self.model, self.shared, self.read = index, shared, 0

    def parts(self, at: np.ndarray | slice) -> np.ndarray:
        """The impacts of the postings at these places."""
        self.read += at.stop - at.start if isinstance(at, slice) else len(at)
        return np.ones(len(self.tfs[at])) if self.shared else impacts(self.tfs[at], self.lens[self.ords[at]], *self.model)

    def looked_up(self, term: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the ascending docs have the term, its impacts there)."""
        s, e = self.starts[term], self.starts[term + 1]
        place = np.searchsorted(self.ords[s:e], docs)
        has = np.flatnonzero((place < e - s) & (self.ords[s:e][np.minimum(place, e - s - 1)] == docs))
        return has, self.parts(s + place[has])

    def best(self, asked: np.ndarray, idf: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ordinals, scores) of all documents that may be among the k best for the terms asked, scored in full; ``floor``: what k documents elsewhere reach."""
        none = np.zeros(0, np.int64), np.zeros(0)
        if not len(self.terms):
            return none
        place = np.minimum(np.searchsorted(self.terms, asked), len(self.terms) - 1)
        there = self.terms[place] == asked
        place, idf = place[there], idf[there]
        top = idf * (1.0 if self.shared else self.most[place])  # what each list can add at most
        order = np.argsort(top, kind="stable")
        place, idf, top = place[order], idf[order], top[order]
        if not len(place) or top.sum() < floor - ROOM:
            return none
        seeds = np.unique(np.concatenate([self.ords[self._first(p, k)] for p in place]))
        sums = np.zeros(len(seeds))
        for p, w in zip(place, idf):
            has, x = self.looked_up(p, seeds)
            sums[has] += w * x
        floor = max(floor, np.partition(sums, len(sums) - k)[len(sums) - k]) if len(sums) >= k else floor
        left = int(np.searchsorted(np.cumsum(top), floor - ROOM, side="left"))
        score = np.zeros(len(self.lens))
        for p, w in zip(place[left:], idf[left:]):
            own = slice(int(self.starts[p]), int(self.starts[p + 1]))
            score[self.ords[own]] += w * self.parts(own)
        docs = np.flatnonzero(score > 0)
        rest = np.cumsum(top[:left])
        for n in range(left - 1, -1, -1):
            docs = docs[score[docs] + rest[n] >= floor - ROOM]
            has, x = self.looked_up(place[n], docs)
            score[docs[has]] += idf[n] * x
        docs = docs[score[docs] >= floor - ROOM]
        return docs, score[docs]

    def _first(self, term: int, k: int) -> np.ndarray:
        """Places of a list's greatest impacts: all of a short list, else its champions."""
        s, e, at = self.starts[term], self.starts[term + 1], int(self.at[term])
        return self.champions[(at - 1) * CHAMPIONS : at * CHAMPIONS][: max(k, 8)].astype(np.int64) if at else np.arange(s, e)


def _frequencies(index: Index, terms: np.ndarray) -> dict[int, int]:
    def count(batches):
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in _rows(batch):
                own, starts = np.frombuffer(row["terms"], np.int64), np.frombuffer(row["starts"], np.uint32).astype(np.int64)
                if len(own):
                    at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                    total += np.where(own[at] == terms, starts[at + 1] - starts[at], 0)
        yield pa.record_batch([pa.array(terms[total > 0]), pa.array(total[total > 0])], names=["term", "df"])

    found = index.blocks.select("terms", "starts").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in found.collect()}


def top_documents(index: Index, queries: DataFrame, k: int, shared: bool = False, slice_terms: int = 500_000) -> DataFrame:
    """query_id, doc_id, score, rank: the k best of each query (query_id, text) by BM25, or by the number of its terms a document has; equal scores by doc_id.

    Queries are taken in slices of about ``slice_terms`` terms; a slice is one pass over the index.
    """
    spark = queries.sparkSession
    asked = stored(queries.select("query_id", F.array_distinct(term_hashes(F.col("text"))).alias("terms")).where(F.size("terms") > 0))
    slices = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // slice_terms)
    kind, key = index.blocks.schema["ids"].dataType.elementType.simpleString(), asked.dtypes[0][1]
    parts = []
    for s in range(slices):
        rows = asked.where(F.pmod(F.xxhash64("query_id", "terms"), F.lit(slices)) == s).collect()
        wanted = [np.array(r["terms"], np.int64) for r in rows]
        if not rows:
            continue
        df = {} if shared else _frequencies(index, np.unique(np.concatenate(wanted)))
        weights = [np.ones(len(w)) if shared else np.array([np.log(1 + (index.n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) for t in w.tolist()]) for w in wanted]

        def find(batches, wanted=wanted, weights=weights, model=(index.mean, index.k1, index.b)):
            best = [np.zeros(0) for _ in wanted]
            for batch in batches:
                for ids, row in zip(batch.column("ids"), _rows(batch.drop_columns(["ids"]))):
                    block = Block(row, model, shared)
                    for q, (terms, idf) in enumerate(zip(wanted, weights)):
                        docs, score = block.best(terms, idf, k, best[q].min() if len(best[q]) == k else 0.0)
                        if len(docs):
                            found = pa.table([pa.array(np.full(len(docs), q, np.int32)), ids.values.take(pa.array(docs)), pa.array(np.round(score, 6))], names=["query", "doc_id", "score"])
                            yield from found.take(pc.sort_indices(found, sort_keys=[("score", "descending"), ("doc_id", "ascending")])[:k]).to_batches()
                            best[q] = np.sort(np.concatenate((best[q], score)))[-k:]

        found = index.blocks.mapInArrow(find, f"query int, doc_id {kind}, score double")
        names = spark.createDataFrame([(q, r["query_id"]) for q, r in enumerate(rows)], f"query int, query_id {key}")
        parts.append(found.join(F.broadcast(names), "query").select("query_id", "doc_id", "score"))  # as many rows as the slice has queries
    if not parts:
        return spark.createDataFrame([], f"query_id {key}, doc_id {kind}, score double, rank int")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
