"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents are lower-cased runs of letters, digits and other non-punctuation.
Seeds are ``min_match``-token windows with a running Karp-Rabin hash; a document that shares seeds
with an item is a candidate if the seeds could cover enough of the item. For a candidate the longest
matches of unmarked tokens are marked again and again, longest first (of equally long ones that with
the first place in the item, then in the document), until none of ``min_match`` tokens is left. The
share of the item's tokens under tiles is its coverage, whatever order the tiles have in the document,
so reordered passages count.

A benchmark of up to ``chunk_bytes`` is sent to the tasks as one index, and documents are never
shuffled. A larger one stays a table: its seeds leave a bitmap of fixed size, the documents' seeds that
it lets through are joined with the items' seeds by hash, and candidate pairs meet after that join.
Seed pairs are made for one document and item at a time; where repeated tokens make very many of them,
matches are read off the diagonals in blocks instead.

Edge cases: null or empty texts match nothing, null or empty items match nothing; items shorter than
``min_match`` tokens must occur whole; equal items are reported each; rows that repeat a doc_id are
judged each by itself, also null ones; an empty table on either side gives no match. Other columns pass
through ``decontaminate`` untouched, whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowline.llm.common import cut
from winnowline.llm.kernel import U64, powers, span_hashes, spread, tables, utf8

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@functools.cache
def _breaks() -> np.ndarray:
    out = tables()[0].copy()
    out[list(PUNCTUATION)] = True
    return out


def token_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, bounds by text)."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data, offsets = utf8(pc.utf8_lower(a.cast(pa.large_string())))
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1 : n + 1] = ~_breaks()[data]
    begin, finish = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    some = np.diff(offsets) > 0
    firsts, lasts = offsets[:-1][some], offsets[1:][some] - 1
    begin[firsts], finish[lasts] = inside[firsts + 1], inside[lasts + 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def running_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all ``width``-token windows, from one running sum."""
    n = len(tokens)
    if n < width:
        return np.zeros(0, U64)
    up, down = powers(1 << max(16, int(n).bit_length()))
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(tokens * up[:n])))
    return (sums[width:] - sums[:-width]) * down[: n - width + 1]


#: More seed pairs than this are not listed for one document and item.
MANY_PAIRS = 1 << 20
#: Entries of candidate lists, and cells of a block of diagonals, that are held at once.
BLOCK = 1 << 21
#: Bits of the bitmap of a large benchmark's seeds.
FILTER_BITS = 26


def runs_from_pairs(d: np.ndarray, p: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, place in document, place in item) of the maximal matches, from the windows at which they agree."""
    order = np.lexsort((d, d - p))
    d, p = d[order], p[order]
    at = np.flatnonzero(np.concatenate(([True], (np.diff(d) != 1) | (np.diff(d - p) != 0))))
    return np.diff(np.append(at, len(d))) + width - 1, d[at], p[at]


def runs_from_diagonals(doc: np.ndarray, item: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from the tokens, a block of diagonals at a time."""
    n, m = len(doc), len(item)
    # Rows are diagonals: row r pairs item place j with document place r + j - (m - 1).
    padded = np.concatenate((np.zeros(m - 1, U64), doc, np.zeros(m - 1, U64)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, m)
    out = []
    for a in range(0, n + m - 1, max(1, BLOCK // m)):
        block = rows[a : a + max(1, BLOCK // m)]
        same = np.zeros((len(block), m + 2), np.int8)
        same[:, 1:-1] = block == item
        inside = np.arange(a, a + len(block))[:, None] + np.arange(m)[None, :] - (m - 1)
        same[:, 1:-1] &= (inside >= 0) & (inside < n)
        step = np.diff(same, axis=1)
        r, j = np.nonzero(step == 1)
        _, k = np.nonzero(step == -1)
        long = k - j >= width
        out.append((k[long] - j[long], r[long] + a + j[long] - (m - 1), j[long]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def greedy_tiles(length: np.ndarray, d: np.ndarray, p: np.ndarray, width: int, n_item: int) -> tuple[int, int]:
    """(tokens of the item under tiles, tiles) from all maximal matches of ``width`` tokens or more."""
    if not len(length):
        return 0, 0
    base = int(d.min())
    doc_free, item_free = np.ones(int((d + length).max()) - base, bool), np.ones(n_item, bool)
    waiting: dict[int, list] = {}
    order = np.lexsort((d, p))
    for n, i, j in zip(length[order].tolist(), (d[order] - base).tolist(), p[order].tolist()):
        waiting.setdefault(n, []).append((j, i))
    tiles = 0
    while waiting:
        n = max(waiting)
        for j, i in sorted(waiting.pop(n)):
            free = doc_free[i : i + n] & item_free[j : j + n]
            if free.all():
                doc_free[i : i + n] = item_free[j : j + n] = False
                tiles += 1
                continue
            # What earlier tiles left of this match may still be long enough.
            step = np.diff(free.astype(np.int8), prepend=0, append=0)
            for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
                if b - a >= width:
                    waiting.setdefault(b - a, []).append((j + a, i + a))
    return int((~item_free).sum()), tiles


def tile(doc: np.ndarray, item: np.ndarray, width: int) -> tuple[int, int]:
    """Greedy string tiling of two token sequences: (tokens of the item under tiles, tiles)."""
    left, right = running_hashes(doc, width), running_hashes(item, width)
    order = np.argsort(right, kind="stable")
    lo, hi = np.searchsorted(right[order], left), np.searchsorted(right[order], left, side="right")
    n = hi - lo
    if n.sum() > MANY_PAIRS:
        runs = runs_from_diagonals(doc, item, width)
    elif n.any():
        runs = runs_from_pairs(np.repeat(np.arange(len(left)), n), order[spread(lo, n)], width)
    else:
        return 0, 0
    return greedy_tiles(*runs, width, len(item))


class ItemIndex:
    """The seeds of items, for a benchmark of bounded size."""

    def __init__(self, ids: list, texts: list, min_match: int):
        words, bounds = token_hashes(pa.array(texts, pa.string()))
        self.ids, self.sizes = ids, np.diff(bounds)
        self.tokens = [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        self.widths = {}
        for w in sorted({int(min(min_match, n)) for n in self.sizes if n}):
            seeds, items, places = [], [], []
            for k, n in enumerate(self.sizes):
                if n and min(min_match, n) == w:
                    h = running_hashes(self.tokens[k], w)
                    seeds.append(h), items.append(np.full(len(h), k)), places.append(np.arange(len(h)))
            h = np.concatenate(seeds)
            order = np.argsort(h, kind="stable")
            filter_bits = np.zeros(1 << 20, bool)
            filter_bits[h >> U64(44)] = True
            self.widths[w] = (h[order], np.concatenate(items)[order], np.concatenate(places)[order], filter_bits)

    def _candidates(self, row: np.ndarray, seed: np.ndarray, w: int, threshold: float):
        """(row, item) whose common seeds could cover enough, from distinct (row, seed); BLOCK entries at a time."""
        seeds, items, places, _ = self.widths[w]
        left, right = np.searchsorted(seeds, seed), np.searchsorted(seeds, seed, side="right")
        sums = np.cumsum(right - left)
        at = 0
        while at < len(row):
            # Whole rows; one row has no more entries than the index.
            to = max(int(np.searchsorted(sums, (sums[at - 1] if at else 0) + BLOCK)), at + 1)
            to = int(np.searchsorted(row, row[to - 1], side="right"))
            n = right[at:to] - left[at:to]
            entry = spread(left[at:to], n)
            r, k, place = np.repeat(row[at:to], n), items[entry], places[entry]
            order = np.lexsort((place, k, r))
            r, k, place = r[order], k[order], place[order]
            new = np.concatenate(([True], (np.diff(r) != 0) | (np.diff(k) != 0)))
            # A window adds to the tokens under windows what the one before it leaves free.
            adds = np.where(new, w, np.minimum(np.diff(place, prepend=0), w))
            head = np.flatnonzero(new)
            under = np.add.reduceat(adds, head)
            good = head[under >= threshold * self.sizes[k[head]]]
            yield from zip(r[good].tolist(), k[good].tolist())
            at = to

    def matches(self, column, threshold: float) -> list[tuple[int, int, float, int]]:
        """(row, item, coverage, tiles) of those that reach the threshold."""
        words, bounds = token_hashes(column)
        out = []
        for w, (seeds, _, _, bits) in self.widths.items():
            h = running_hashes(words, w)
            hit = np.flatnonzero(bits[h >> U64(44)])
            row = np.searchsorted(bounds, hit, side="right") - 1
            known = np.minimum(np.searchsorted(seeds, h[hit]), len(seeds) - 1)
            good = (seeds[known] == h[hit]) & (hit + w <= bounds[row + 1])
            pairs = np.unique(np.stack([row[good].astype(U64), h[hit[good]]], 1), axis=0) if good.any() else np.zeros((0, 2), U64)
            for r, k in self._candidates(pairs[:, 0].astype(np.int64), pairs[:, 1], w, threshold):
                covered, tiles = tile(words[bounds[r] : bounds[r + 1]], self.tokens[k], w)
                if covered >= threshold * self.sizes[k]:
                    out.append((r, k, covered / int(self.sizes[k]), tiles))
        return out


def _small_index(benchmark: DataFrame, item: str, text: str, min_match: int, chunk_bytes: int):
    """The broadcast index of a benchmark of up to ``chunk_bytes``; None for a larger one."""
    b = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text IS NOT NULL")
    if (b.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) > chunk_bytes:
        return None
    rows = b.orderBy("item", "text").collect()
    return b.sparkSession.sparkContext.broadcast(ItemIndex([r["item"] for r in rows], [r["text"] for r in rows], min_match))


def _seed_rows(key: pa.Array, texts: pa.Array, widths: list[int], bits: np.ndarray | None) -> pa.RecordBatch:
    """(key, width, seed, places, size): the distinct seeds of each text, those only whose bit is set."""
    words, bounds = token_hashes(texts)
    sizes = np.diff(bounds)
    parts = []
    for w in widths:
        h = running_hashes(words, w)
        hit = np.arange(len(h)) if bits is None else np.flatnonzero(bits[h >> U64(64 - FILTER_BITS)])
        row = np.searchsorted(bounds, hit, side="right") - 1
        good = hit + w <= bounds[row + 1]
        if good.any():
            pairs, places = np.unique(np.stack([row[good].astype(U64), h[hit[good]]], 1), axis=0, return_counts=True)
            parts.append((pairs[:, 0].astype(np.int64), np.full(len(pairs), w), pairs[:, 1], places))
    row, w, seed, places = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, U64 if i == 2 else np.int64) for i in range(4))
    return pa.RecordBatch.from_arrays([key.take(pa.array(row)), pa.array(w.astype(np.int32)), pa.array(seed.view(np.int64)), pa.array(places.astype(np.int64)), pa.array(sizes[row].astype(np.int64))], names=["key", "width", "seed", "places", "size"])


def seed_joined(docs: DataFrame, items: DataFrame, min_match: int, threshold: float) -> DataFrame:
    """(key, item, coverage, tiles) from tables (key, text) and (item, text) of any size."""
    spark = docs.sparkSession
    identity = F.xxhash64("text")  # equal texts have equal matches
    items = cut(items.where("text IS NOT NULL").withColumn("rid", F.monotonically_increasing_id()))
    docs = docs.where("text IS NOT NULL").withColumn("did", identity)

    def item_seeds(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                n = int(np.diff(token_hashes(one.column("text"))[1])[0])
                if n:
                    yield _seed_rows(one.column("rid"), one.column("text"), [min(min_match, n)], None)

    names = "key long, width int, seed long, places long, size long"
    seeds = cut(items.select("rid", "text").mapInArrow(item_seeds, names))
    widths = [r[0] for r in seeds.select("width").distinct().collect()]  # min_match values at most

    def bitmap(block: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, np.uint8)
        bits[block.column("slot").to_numpy() & 0xFFFF] = 1
        return pa.table([block.column("part").slice(0, 1), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "bits"])

    slots = seeds.select(F.shiftrightunsigned("seed", 64 - FILTER_BITS).alias("slot")).distinct().withColumn("part", F.shiftright("slot", 16))
    bits = np.zeros((1 << FILTER_BITS - 16, 8192), np.uint8)
    for r in slots.groupBy("part").applyInArrow(bitmap, "part long, bits binary").collect():  # 8 MB at most
        bits[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits.reshape(-1))

    def doc_seeds(batches):
        own = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield _seed_rows(part.column("did"), part.column("text"), widths, own)

    asked = docs.select("did", "text").mapInArrow(doc_seeds, names).select(F.col("key").alias("did"), "width", "seed").distinct()
    met = asked.join(seeds.withColumnRenamed("key", "rid"), ["width", "seed"]).groupBy("did", "rid").agg(F.sum(F.col("places") * F.col("width")).alias("under"), F.first("size").alias("size"), F.first("width").alias("width"))
    pairs = cut(met.where(F.col("under") >= threshold * F.col("size")).select("did", "rid", "width"))
    kinds = docs.select("key").dtypes[0][1], items.select("item").dtypes[0][1]

    def tiled(batches):
        for batch in batches:
            keep, coverage, tiles = [], [], []
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                doc, item = (token_hashes(one.column(c))[0] for c in ("text", "item_text"))
                covered, n = tile(doc, item, one.column("width")[0].as_py())
                if covered >= threshold * len(item):
                    keep.append(k), coverage.append(covered / len(item)), tiles.append(n)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("item").take(at), pa.array(coverage, pa.float64()), pa.array(tiles, pa.int32())], names=["key", "item", "coverage", "tiles"])

    both = docs.join(pairs, "did").join(items.select("rid", "item", F.col("text").alias("item_text")), "rid")
    return both.select("key", "text", "width", "item", "item_text").mapInArrow(tiled, f"key {kinds[0]}, item {kinds[1]}, coverage double, tiles int")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", min_match: int = 5, threshold: float = 0.5, chunk_bytes: int = 8 << 20) -> DataFrame:
    """(key, item, coverage, tiles) for each document and item that it covers by ``threshold`` or more."""
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    index = _small_index(benchmark, item, item_text, min_match, chunk_bytes)
    if index is None:
        found = seed_joined(d, benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")), min_match, threshold)
        return found.withColumnsRenamed({"key": key, "item": item})
    kinds = d.dtypes[0][1], benchmark.select(item).dtypes[0][1]

    def search(batches):
        own = index.value
        item_type = pa.array(own.ids).type
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = own.matches(part.column("text"), threshold)
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array([f[0] for f in found], pa.int64())), pa.array([own.ids[f[1]] for f in found], item_type), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int32())], names=["key", "item", "coverage", "tiles"])

    return d.mapInArrow(search, f"key {kinds[0]}, item {kinds[1]}, coverage double, tiles int").withColumnsRenamed({"key": key, "item": item})


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", min_match: int = 5, threshold: float = 0.5, chunk_bytes: int = 8 << 20) -> DataFrame:
    """The documents that cover no item, with their columns as they came."""
    index = _small_index(benchmark, item, item_text, min_match, chunk_bytes)
    if index is None:
        d = docs.select(F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))
        found = cut(seed_joined(d, benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")), min_match, threshold).select(F.col("key").alias("__bad")).distinct())
        return docs.join(found, F.xxhash64(docs[text]) == found["__bad"], "left_anti")

    def clean(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for at in range(0, batch.num_rows, 1024):
                keep[[at + f[0] for f in index.value.matches(batch.column(text).slice(at, 1024), threshold)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)
