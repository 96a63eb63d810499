"""Unit vectors against anchors and queries: a metric index for exact anchor margins, batched products for nearest neighbours."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnowline.sources.scratch import stored

#: Angles are compared with this much room for rounding.
ROOM = 1e-9
#: Rows of a batch that are multiplied at once.
ROWS = 2048


class Cell(NamedTuple):
    """Anchors of one side near one pivot: the pivot's number, the least and greatest angle to it, and the unit vectors."""

    positive: bool
    pivot: int
    low: float
    high: float
    vectors: np.ndarray


def unit_rows(column, width: int | None = None) -> np.ndarray:
    """A list column as float64 rows of length one; rows of NaN for null and zero vectors and those of another width than the one given (or else the greatest)."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    width = width or max(1, int(sizes.max()) if len(sizes) else 1)
    out = np.full((len(a), width), np.nan)
    full = np.flatnonzero(sizes == width)
    values = a if len(full) == len(a) else a.take(pa.array(full))
    out[full] = values.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(norms > 0, out / norms, np.nan)


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def choose_pivots(anchors: DataFrame, most: int = 64, sample: int = 4096) -> np.ndarray:
    """Up to ``most`` anchors far from one another, of a bounded sample in hash order. Any pivots give exact results; these give tight cells."""
    rows = anchors.select(F.col("anchor")).where("anchor IS NOT NULL").orderBy(F.xxhash64("anchor")).limit(sample).toArrow()
    u = unit_rows(rows.column("anchor"))
    u = u[~np.isnan(u).any(axis=1)]
    if not len(u):
        return u
    chosen, best = [0], u @ u[0]
    while len(chosen) < min(most, max(1, int(len(u) ** 0.5))) and best.min() < 1 - ROOM:
        chosen.append(int(best.argmin()))
        best = np.maximum(best, u @ u[chosen[-1]])
    return u[chosen]


def pack_cells(anchors: DataFrame, pivots: np.ndarray, cell_rows: int = 4096) -> DataFrame:
    """(positive, pivot, low, high, width, vectors): anchors by side and nearest pivot, a large cell in parts of about ``cell_rows``."""

    def place(batches):
        for batch in batches:
            u = unit_rows(batch.column("anchor"), pivots.shape[1])
            good = np.flatnonzero(~np.isnan(u).any(axis=1))
            a = angles(u[good], pivots)
            near = a.argmin(axis=1)
            yield pa.record_batch([batch.column("positive").take(pa.array(good)), batch.column("part").take(pa.array(good)), pa.array(near.astype(np.int32)), pa.array(a[np.arange(len(good)), near]), pa.array([x.tobytes() for x in u[good]], pa.binary())], names=["positive", "part", "pivot", "angle", "unit"])

    def pack(rows: pa.Table) -> pa.Table:
        a, blob = rows.column("angle").to_numpy(), rows.column("unit").to_pylist()
        return pa.table([rows.column("positive").slice(0, 1), rows.column("pivot").slice(0, 1), pa.array([a.min()]), pa.array([a.max()]), pa.array([len(blob[0]) // 8], pa.int32()), pa.array([b"".join(blob)], pa.binary())], names=["positive", "pivot", "low", "high", "width", "vectors"])

    parts = max(1, -(-anchors.count() // cell_rows))
    rows = anchors.select("anchor", "positive", F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int").alias("part"))
    placed = rows.mapInArrow(place, "positive boolean, part int, pivot int, angle double, unit binary")
    return stored(placed.groupBy("positive", "pivot", "part").applyInArrow(pack, "positive boolean, pivot int, low double, high double, width int, vectors binary"))


def largest(u: np.ndarray, pivots: np.ndarray, cells: list[Cell], tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the greatest similarities of each row of u, ascending, of those in ``tops`` and all in the cells; similarities computed for each row).

    By the triangle inequality on the sphere no vector of a cell is nearer than the gap between the row's
    angle to the pivot and the cell's range of angles. Each row first meets the cell with the smallest gap;
    then only cells whose bound reaches its k-th similarity so far.
    """
    k, seen = tops.shape[1], np.zeros(len(u), np.int64)
    if not len(cells) or not len(u):
        return tops, seen
    at = angles(u, pivots)[:, [c.pivot for c in cells]]
    low, high = np.array([c.low for c in cells]), np.array([c.high for c in cells])
    bound = np.cos(np.maximum(np.maximum(low - at, at - high) - ROOM, 0.0)) + ROOM
    first = bound.argmax(axis=1)

    def meet(c: int, rows: np.ndarray) -> None:
        for s in range(0, len(rows), ROWS):
            own = rows[s : s + ROWS]
            found = np.concatenate((tops[own], u[own] @ cells[c].vectors.T), axis=1)
            tops[own] = np.sort(np.partition(found, found.shape[1] - k, axis=1)[:, found.shape[1] - k :], axis=1)
            seen[own] += len(cells[c].vectors)

    for c in range(len(cells)):
        meet(c, np.flatnonzero(first == c))
    for c in np.argsort(-bound.mean(axis=0)):
        meet(c, np.flatnonzero((first != c) & (bound[:, c] >= tops[:, 0])))
    return tops, seen


def anchor_tops(vectors: DataFrame, anchors: DataFrame, k: int = 5, slice_bytes: int = 32 << 20) -> DataFrame:
    """(vec_id, above, below, compared): the k greatest similarities to the positive and to the negative anchors, ascending, and how many were computed.

    Exact, with no product of rows. Anchors of more than ``slice_bytes`` are taken slice by slice, each a
    pass over the vectors that carries the best so far, so what a task holds is bounded. Null and zero
    vectors have null lists; null and zero anchors are left out.
    """
    kind = vectors.select("vec_id").dtypes[0][1]
    shape = f"vec_id {kind}, embedding array<double>, above array<double>, below array<double>, compared long"
    pivots = choose_pivots(anchors)
    cells = pack_cells(anchors, pivots) if len(pivots) else None
    total = cells.agg(F.coalesce(F.sum(F.octet_length("vectors")), F.lit(0))).first()[0] if cells else 0
    slices = -(-total // slice_bytes)
    none = F.lit(None).cast("array<double>")
    now = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), none.alias("above"), none.alias("below"), F.lit(0).cast("long").alias("compared"))
    for s in range(slices):
        own = cells.where(F.pmod(F.xxhash64("positive", "pivot", "low", "high"), F.lit(slices)) == s).collect()
        held = [Cell(r["positive"], r["pivot"], r["low"], r["high"], np.frombuffer(r["vectors"]).reshape(-1, r["width"])) for r in own]

        def meet(batches, held=held):
            for batch in batches:
                u = unit_rows(batch.column("embedding"), pivots.shape[1])
                good = np.flatnonzero(~np.isnan(u).any(axis=1))
                compared = batch.column("compared").to_numpy().copy()
                lists = []
                for side, name in ((True, "above"), (False, "below")):
                    before = batch.column(name).take(pa.array(good)).to_pylist()
                    tops = np.array([[-np.inf] * (k - len(x or ())) + (x or []) for x in before]).reshape(len(good), k)
                    tops, seen = largest(u[good], pivots, [c for c in held if c.positive is side], tops)
                    compared[good] += seen
                    found: list = [None] * batch.num_rows
                    for row, t in zip(good.tolist(), tops):
                        found[row] = t[np.isfinite(t)].tolist()
                    lists.append(pa.array(found, pa.list_(pa.float64())))
                yield pa.record_batch([batch.column("vec_id"), batch.column("embedding"), *lists, pa.array(compared)], names=["vec_id", "embedding", "above", "below", "compared"])

        now = now.mapInArrow(meet, shape)
        now = stored(now) if s + 1 < slices else now
    return now.drop("embedding")


def anchor_margin(vectors: DataFrame, anchors: DataFrame, k: int = 5, **options) -> DataFrame:
    """(vec_id, margin, max_margin): mean of the k largest similarities to positive anchors less the same for negative ones, and of the largest.

    Null where a side has no anchor or the vector is null or zero.
    """
    t = anchor_tops(vectors, anchors, k, **options)
    mean = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda x, y: x + y) / F.size(c))
    return t.select("vec_id", F.round(mean("above") - mean("below"), 6).alias("margin"), F.round(F.array_max("above") - F.array_max("below"), 6).alias("max_margin"))


def nearest(vectors: DataFrame, query: DataFrame, k: int, where: Column | None = None, slice_rows: int = 8192) -> DataFrame:
    """query_id, vec_id, sim, rank: the k nearest of each query vector by cosine (six digits), ties by id; never the query's own id.

    ``where`` is a condition on the vectors' other columns, applied before anything is compared. Queries are
    taken in slices of about ``slice_rows``; a slice is one matrix product with each batch of vectors, and of
    a batch only the k best of each query go on. Null and zero vectors are near to nothing.
    """
    kind, asked = (x.select(c).dtypes[0][1] for x, c in ((vectors, "vec_id"), (query, "query_id")))
    v = (vectors if where is None else vectors.where(where)).select("vec_id", "embedding")
    q = query.select("query_id", "query")
    slices, parts = max(1, -(-q.count() // slice_rows)), []
    for s in range(slices):
        own = q.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == s).toArrow()
        ids, units = own.column("query_id").combine_chunks(), unit_rows(own.column("query"))

        def meet(batches, ids=ids, units=units):
            for batch in batches:
                if not len(units):
                    continue
                vec_ids = batch.column("vec_id")
                sims = np.round(unit_rows(batch.column("embedding"), units.shape[1]) @ units.T, 6)
                sims[np.isnan(sims)] = -np.inf
                best = np.partition(sims, max(0, len(sims) - k - 1), axis=0)[max(0, len(sims) - k - 1)]
                row, col = np.nonzero((sims >= best) & np.isfinite(sims))
                t = pa.table([ids.take(pa.array(col)), vec_ids.take(pa.array(row)), pa.array(sims[row, col])], names=["query_id", "vec_id", "sim"])
                yield from t.filter(pc.fill_null(pc.not_equal(t["query_id"], t["vec_id"]), True)).to_batches()

        parts.append(v.mapInArrow(meet, f"query_id {asked}, vec_id {kind}, sim double"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # Spark limits each group before the shuffle, so k rows a query and task go on.
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id"))).where(F.col("rank") <= k)
