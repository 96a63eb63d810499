"""Exact repeats across documents, found with a run-length Burrows-Wheeler index.

Every byte under a ``length``-byte string that also starts in a document of a smaller id is removed.

1. Anchors. In each window of ``length`` bytes the 24-byte grams with the least hash are anchors; equal
   windows have equal anchors, so two documents that share a window share an anchor in it. An anchor's
   context is all that windows around it can reach: 26 bytes to either side.
2. Row blocks (hash batches of documents) send each distinct (gram, context) with the smallest document
   that has it to gram buckets. The answer is one byte: nothing repeats here; a smaller document has
   the same context, so all of it is covered; or the gram has several contexts and needs the index.
3. Only those contexts go, as bytes, to their bucket, where those that share a gram and the bytes to one
   side of it are indexed together: suffixes sorted by their first ``length``
   bytes with ties in document order, the transform run-length encoded, the document sampled at the
   head of each group of equal windows. Contexts are streamed through it from right to left: backward
   search over the runs keeps the row range of the last ``length`` bytes, which is the matching
   statistic capped at ``length``; its head names the smallest document with this window.
   A gram with more than ``HOT`` contexts (a passage that very many documents share) would make an index of
   its own size. Its windows are told apart by hash instead, each sent with the smallest document to window
   buckets, which any number of documents divide among.
4. The row blocks mark what the answers cover and cut it out.

Ids are integers, or text that casts to them. Edge cases: null counts as empty; texts shorter than ``length`` bytes lose nothing; rows that repeat a
doc_id are no repeats of each other, nor are repeats inside one document; a row with a null doc_id
counts as the largest id and null ids don't repeat each other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowline.llm.common import batches_for
from winnowline.llm.kernel import BASE, U64, byte_codes, mix, pack_six, span_hashes, spread, trimmed, unpack_six, utf8

#: Long enough that few grams repeat by chance: their contexts would all meet in one index.
GRAM = 24
TOP = U64(0xFFFFFFFFFFFFFFFF)
NO_ID = np.iinfo(np.int64).max
REQUEST = "bucket int, g int, grams binary, contexts binary, doc_ids binary, docs binary"
REPLY = "g int, bucket int, kind int, at binary, answers binary"
#: Kind 1: contexts for the index; kind 2: window hashes (in ``at``) of hot grams.
CONTEXT = "bucket int, g int, kind int, at binary, docs binary, sizes binary, lefts binary, body binary"
#: Text of one index; contexts of one gram that go to an index.
INDEX_BYTES = 1 << 20
HOT = 4096


def _slide(x: np.ndarray, width: int, fold) -> np.ndarray:
    """fold over x[i : i + width] for every i, by doubling."""
    done, out = 1, x
    while done * 2 <= width:
        out = fold(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return fold(out[: len(out) - rest], out[rest:]) if rest else out


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    h, width = byte_codes()[data], 1
    while width < 8:
        h = h[:-width] * U64(pow(BASE, width, 1 << 64)) + h[width:]
        width *= 2
    up = U64(pow(BASE, 8, 1 << 64))
    return mix((h[:-16] * up + h[8:-8]) * up + h[16:])


def anchors(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, gram hash) of the anchors of concatenated texts, in ascending order."""
    window = length - GRAM + 1
    at, grams, i, n = [], [], 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + (1 << 17), side="right")) - 1)
        a, b = int(off[i]), int(off[j])
        if b - a >= length:
            h = _gram_hashes(data[a:b])
            live = np.zeros(b - a, bool)
            own, size = off[i:j] - a, np.diff(off[i : j + 1])
            # Starts of whole windows, text by text.
            marks = np.zeros(b - a + 1, np.int32)
            long = size >= length
            np.add.at(marks, own[long], 1)
            np.add.at(marks, own[long] + size[long] - length + 1, -1)
            live = np.cumsum(marks[:-1]) > 0
            least = _slide(h, window, np.minimum)
            least[~live[: len(least)]] = 0
            padded = np.concatenate((np.zeros(window - 1, U64), least, np.zeros(window - 1, U64)))
            found = np.flatnonzero(_slide(padded, window, np.maximum) == h)
            at.append(found + a), grams.append(h[found])
        i = j
    return (np.concatenate(at), np.concatenate(grams)) if at else (np.zeros(0, np.int64), np.zeros(0, U64))


class Block:
    """A row block: its texts, anchors, contexts, and the distinct (gram, context) pairs."""

    def __init__(self, rows: pa.Table, length: int):
        ids = rows.column("doc").combine_chunks()
        self.ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        self.data, self.off = utf8(rows.column("text"))
        self.at, grams = anchors(self.data, self.off, length)
        self.doc = np.searchsorted(self.off, self.at, side="right") - 1
        reach = length - GRAM
        self.start = np.maximum(self.off[self.doc], self.at - reach)
        self.end = np.minimum(self.off[self.doc + 1], self.at + GRAM + reach)
        contexts = mix(span_hashes(self.data, self.start, self.end) + (self.at - self.start).astype(U64) * U64(0x9FB21C651E98DF25))
        # The top 48 bits of either hash travel; the distinct pairs have their smallest document first.
        k, c = grams >> U64(16), contexts >> U64(16)
        order = np.lexsort((self.ids[self.doc], c, k))
        ks, cs = k[order], c[order]
        new = np.ones(len(order), bool)
        new[1:] = (ks[1:] != ks[:-1]) | (cs[1:] != cs[:-1])
        self.pair = np.empty(len(order), np.int64)
        self.pair[order] = np.cumsum(new) - 1
        self.first = order[new]
        self.k, self.c = ks[new], cs[new]
        self.least = self.ids[self.doc[self.first]]

    def bounds(self, buckets: int) -> np.ndarray:
        edges = np.array([((b << 64) // buckets) >> 16 for b in range(1, buckets)], U64)
        return np.concatenate(([0], np.searchsorted(self.k, edges), [len(self.k)]))


def _ask(rows: pa.Table, length: int, buckets: int) -> pa.Table:
    b = Block(rows, length)
    at, out = b.bounds(buckets), []
    for n in np.flatnonzero(np.diff(at)).tolist():
        lo, hi = at[n], at[n + 1]
        ids, own = np.unique(b.least[lo:hi], return_inverse=True)
        out.append((n, pack_six(b.k[lo:hi]), pack_six(b.c[lo:hi]), ids.tobytes(), own.astype(np.uint16 if len(ids) < 65536 else np.uint32).tobytes()))
    g = rows.column("g")[0].as_py()
    column = lambda i, t: pa.array([o[i] for o in out], t)
    return pa.table([column(0, pa.int32()), pa.array([g] * len(out), pa.int32()), *[column(i, pa.binary()) for i in (1, 2, 3, 4)]], names=["bucket", "g", "grams", "contexts", "doc_ids", "docs"])


def _judge(block: pa.Table, hot: int) -> pa.Table:
    """For each asked pair: 0 nothing repeats, 1 a smaller document has the context, 2 it needs the index, 3 its gram is hot."""
    k = [unpack_six(x) for x in block.column("grams").to_pylist()]
    c = [unpack_six(x) for x in block.column("contexts").to_pylist()]
    ids = []
    for x, table, own in zip(k, block.column("doc_ids").to_pylist(), block.column("docs").to_pylist()):
        ids.append(np.frombuffer(table, np.int64)[np.frombuffer(own, np.uint16 if len(own) == 2 * len(x) else np.uint32)])
    sizes = [len(x) for x in k]
    k, c, ids = (np.concatenate(x) for x in (k, c, ids))
    order = np.lexsort((ids, c, k))
    ks, cs, d = k[order], c[order], ids[order]
    del k, c, ids
    new_gram = np.concatenate(([True], ks[1:] != ks[:-1]))
    new = new_gram.copy()
    new[1:] |= cs[1:] != cs[:-1]
    head = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    answer = np.where(d > d[head][which], 1, 0).astype(np.uint8)
    starts = np.flatnonzero(new_gram)
    gram = np.cumsum(new_gram) - 1
    contexts = np.add.reduceat(new, starts, dtype=np.int64)
    several = (contexts > 1) & (np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts))
    answer[head] = np.where(several[gram[head]], np.where(contexts[gram[head]] > hot, 3, 2), answer[head])
    # A pair in two blocks under one id (rows that repeat it) is judged alike in both.
    same = (answer == 0) & ~new
    answer[same] = answer[head][which][same]
    out = np.empty(len(order), np.uint8)
    out[order] = answer
    parts = np.split(out, np.cumsum(sizes)[:-1])
    n = len(parts)
    return pa.table([block.column("g"), block.column("bucket"), pa.array([0] * n, pa.int32()), pa.array([b""] * n, pa.binary()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["g", "bucket", "kind", "at", "answers"])


def _status(b: Block, reply: pa.Table, of: int = 0) -> np.ndarray:
    """The answers of kind ``of`` in the order asked: 0 for pairs, 2 for windows."""
    kind, bucket, blobs = (reply.column(c).to_pylist() for c in ("kind", "bucket", "answers"))
    order = sorted((bu, i) for i, (ki, bu) in enumerate(zip(kind, bucket)) if ki == of)
    return np.frombuffer(b"".join(blobs[i] for _, i in order), np.uint8)


class HotWindows:
    """The distinct windows of a block's anchors whose gram is hot, with the smallest document of each in the block."""

    def __init__(self, b: Block, status: np.ndarray, length: int):
        own = np.flatnonzero(status[b.pair] == 3) if len(b.pair) else np.zeros(0, np.int64)
        own = own[b.end[own] - b.start[own] >= length]
        n = b.end[own] - b.start[own] - length + 1
        at = spread(b.start[own], n)
        # Windows of neighbouring anchors are the same places.
        self.at, first = np.unique(at, return_index=True)
        doc = b.ids[np.repeat(b.doc[own], n)[first]]
        hashes, self.which = np.unique(span_hashes(b.data, self.at, self.at + length), return_inverse=True)
        self.doc, self.hashes = doc, hashes
        self.least = np.full(len(hashes), NO_ID)
        np.minimum.at(self.least, self.which, doc)

    def bounds(self, buckets: int) -> np.ndarray:
        edges = np.array([(k << 64) // buckets for k in range(1, buckets)], U64)
        return np.concatenate(([0], np.searchsorted(self.hashes, edges), [len(self.hashes)]))


def _contexts(rows: pa.Table, reply: pa.Table, length: int, buckets: int) -> pa.Table:
    """The contexts that need the index, and the windows of hot grams, by bucket."""
    b = Block(rows, length)
    status = _status(b, reply)
    need, out = np.flatnonzero(status == 2), []
    bounds = np.searchsorted(need, b.bounds(buckets))
    for n in np.flatnonzero(np.diff(bounds)).tolist():
        pairs = need[bounds[n] : bounds[n + 1]]
        a = b.first[pairs]
        size = b.end[a] - b.start[a]
        out.append((n, 1, pairs.astype(np.int32).tobytes(), b.least[pairs].tobytes(), size.astype(np.uint16).tobytes(), (b.at[a] - b.start[a]).astype(np.uint8).tobytes(), b.data[spread(b.start[a], size)].tobytes()))
    w = HotWindows(b, status, length)
    at = w.bounds(buckets)
    for n in np.flatnonzero(np.diff(at)).tolist():
        out.append((n, 2, w.hashes[at[n] : at[n + 1]].tobytes(), w.least[at[n] : at[n + 1]].tobytes(), b"", b"", b""))
    column = lambda i, t: pa.array([o[i] for o in out], t)
    g = pa.array([rows.column("g")[0].as_py()] * len(out), pa.int32())
    return pa.table([column(0, pa.int32()), g, column(1, pa.int32()), *[column(i, pa.binary()) for i in (2, 3, 4, 5, 6)]], names=["bucket", "g", "kind", "at", "docs", "sizes", "lefts", "body"])


def _judge_windows(block: pa.Table) -> pa.Table:
    """For each asked window whether a smaller document has it."""
    parts = [np.frombuffer(x, U64) for x in block.column("at").to_pylist()]
    docs = np.frombuffer(b"".join(block.column("docs").to_pylist()), np.int64)
    u, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    least = np.full(len(u), NO_ID)
    np.minimum.at(least, inverse, docs)
    answers = np.split((docs > least[inverse]).astype(np.uint8), np.cumsum([len(p) for p in parts])[:-1])
    n = len(parts)
    return pa.table([block.column("g"), block.column("bucket"), pa.array([2] * n, pa.int32()), pa.array([b""] * n, pa.binary()), pa.array([a.tobytes() for a in answers], pa.binary())], names=["g", "bucket", "kind", "at", "answers"])


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of texts, in ``length``-bounded suffix order.

    ``symbols`` are the texts, each with a 0 behind it. Kept are the runs (symbol, start, count so
    far), the symbol totals, the heads of the groups of suffixes that agree in length - 1 and in
    length symbols, and a text position for each head of the latter: the first in text order.
    """

    def __init__(self, symbols: np.ndarray, length: int):
        n = len(symbols)
        self.n = n
        padded = np.concatenate((symbols, np.zeros(length + 8, symbols.dtype))).astype(U64)
        key = np.zeros(n, U64)
        for i in range(7):
            key = (key << U64(9)) | padded[i : i + n]
        rank, depth = self._rank(key), 7
        while depth * 2 <= length:
            key = rank.astype(U64) * U64(n + 1)
            key[: n - depth] += rank[depth:].astype(U64)
            rank, depth = self._rank(key), depth * 2

        def at(shift: int) -> np.ndarray:
            out = np.zeros(n, np.int64)
            out[: n - shift] = rank[shift:]
            return out

        if length > depth:
            last, before = at(length - depth), at(length - 1 - depth)
            order = np.argsort(rank.astype(U64) * U64(n + 1) + last.astype(U64), kind="stable")
        else:
            order = np.argsort(rank, kind="stable")
            last = before = np.zeros(n, np.int64)
        r, x, y = rank[order], last[order], before[order]
        differs = lambda *cols: np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols])))
        self.heads = np.flatnonzero(differs(r, x))
        self.samples = order[self.heads]
        self.short_heads = np.flatnonzero(differs(r, y))
        previous = symbols[order - 1].astype(np.int64)
        runs = np.flatnonzero(np.concatenate(([True], previous[1:] != previous[:-1])))
        symbol, size = previous[runs], np.diff(np.append(runs, n))
        by = np.lexsort((runs, symbol))
        self.symbol, self.start, self.size = symbol[by], runs[by], size[by]
        self.keys = self.symbol * (n + 1) + self.start
        before_run = np.cumsum(self.size) - self.size
        first = np.concatenate(([True], self.symbol[1:] != self.symbol[:-1]))
        self.seen = before_run - before_run[np.flatnonzero(first)][np.cumsum(first) - 1]
        totals = np.bincount(previous, minlength=512)
        self.less = np.cumsum(totals) - totals

    @staticmethod
    def _rank(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        s = key[order]
        out = np.empty(len(key), np.int64)
        out[order] = np.cumsum(np.concatenate(([0], s[1:] != s[:-1]))) + 1
        return out

    def extend(self, rows: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The first row of symbol + P for the first row of P: backward search over runs."""
        j = np.searchsorted(self.keys, symbols * (self.n + 1) + rows) - 1
        own = (j >= 0) & (self.symbol[j] == symbols)
        seen = np.where(own, self.seen[j] + np.minimum(rows - self.start[j], self.size[j]), 0)
        return self.less[symbols] + seen

    def first_text_position(self, rows: np.ndarray) -> np.ndarray:
        return self.samples[np.searchsorted(self.heads, rows, side="right") - 1]

    def shorten(self, rows: np.ndarray) -> np.ndarray:
        """The first row of what remains without the last of ``length`` symbols."""
        return self.short_heads[np.searchsorted(self.short_heads, rows, side="right") - 1]


def _shared_windows(body: np.ndarray, begin: np.ndarray, size: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For each text body[begin : begin + size] a mask of the windows (bit: offset) that a smaller document has."""
    order = np.argsort(docs, kind="stable")
    begin, size, docs = begin[order], size[order], docs[order]
    flat = np.repeat(begin - np.concatenate(([0], np.cumsum(size + 1)[:-1])), size + 1) + np.arange((size + 1).sum())
    ends = np.cumsum(size + 1) - 1
    flat[ends] = 0
    symbols = body[flat].astype(np.uint16) + 1
    symbols[ends] = 0
    index = RunIndex(symbols, length)
    owner = np.repeat(docs, size + 1)
    rows, masks = np.zeros(len(size), np.int64), np.zeros(len(size), U64)
    alive = np.arange(len(size))
    for step in range(int(size.max())):
        alive = alive[size[alive] > step]
        r = index.extend(rows[alive], symbols[ends[alive] - 1 - step].astype(np.int64))
        if step >= length - 1:
            hit = owner[index.first_text_position(r)] < docs[alive]
            masks[alive] |= hit.astype(U64) << (size[alive] - 1 - step).astype(U64)
            r = index.shorten(r)
        rows[alive] = r
    out = np.empty(len(size), U64)
    out[order] = masks
    return out


def _settle(block: pa.Table, length: int) -> pa.Table:
    """Both kinds of a bucket."""
    kinds = np.array(block.column("kind").to_pylist())
    parts = [f(block.filter(pa.array(kinds == k))) for k, f in ((1, lambda x: _stream(x, length)), (2, _judge_windows)) if (kinds == k).any()]
    return pa.concat_tables(parts)


def _stream(block: pa.Table, length: int) -> pa.Table:
    """For each context a mask of the windows (bit: offset) that a smaller document has.

    A window that reaches ``half`` bytes or more to the left of its gram has the gram and those bytes in
    common with its like, any other window the gram and ``half`` bytes to the right. So contexts are
    taken twice, by the left and by the right of these keys: one whose key no other context has is done,
    the others are indexed key by key in indexes of bounded size. That also divides a hot gram.
    """
    half = (length - GRAM) // 2
    at = [np.frombuffer(x, np.int32) for x in block.column("at").to_pylist()]
    read = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in block.column(c).to_pylist()]).astype(np.int64)
    docs, sizes, lefts = read("docs", np.int64), read("sizes", np.uint16), read("lefts", np.uint8)
    body = np.frombuffer(b"".join(block.column("body").to_pylist()), np.uint8)
    begin = np.cumsum(sizes) - sizes
    masks = np.zeros(len(sizes), U64)
    for side in ("left", "right"):
        shift = np.zeros(len(sizes), np.int64) if side == "left" else np.maximum(0, lefts - half + 1)
        size = np.minimum(sizes, lefts + GRAM + half) if side == "left" else sizes - shift
        long = np.flatnonzero(((lefts >= half) if side == "left" else (sizes - lefts >= GRAM + half)) & (size >= length))
        first = begin[long] + lefts[long] - (half if side == "left" else 0)
        keys = span_hashes(body, first, first + GRAM + half)
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        several = counts[inverse] > 1
        long, inverse = long[several], inverse[several]
        order = np.argsort(inverse, kind="stable")
        long, key = long[order], inverse[order]
        last = np.flatnonzero(np.append(key[1:] != key[:-1], True)) if len(key) else key
        part = np.cumsum(size[long])[last] // INDEX_BYTES if len(key) else key
        ends = last[np.append(part[1:] != part[:-1], True)] + 1 if len(key) else key
        for a, b in zip(np.concatenate(([0], ends[:-1])) if len(key) else [], ends):
            own = long[a:b]
            masks[own] |= _shared_windows(body, begin[own] + shift[own], size[own], docs[own], length) << shift[own].astype(U64)
    parts = np.split(masks, np.cumsum([len(x) for x in at])[:-1])
    picked = [(x[p > 0].tobytes(), p[p > 0].tobytes()) for x, p in zip(at, parts)]
    n = len(picked)
    return pa.table([block.column("g"), block.column("bucket"), pa.array([1] * n, pa.int32()), pa.array([p[0] for p in picked], pa.binary()), pa.array([p[1] for p in picked], pa.binary())], names=["g", "bucket", "kind", "at", "answers"])


def _cover(rows: pa.Table, reply: pa.Table, length: int, with_text: bool) -> pa.Table:
    b = Block(rows, length)
    n = len(b.data)
    steps = np.zeros(n + 1, np.int64)

    def mark(start: np.ndarray, end: np.ndarray) -> None:
        np.add.at(steps, start, 1)
        np.add.at(steps, end, -1)

    whole = (b.ids[b.doc] > b.least[b.pair]) if len(b.pair) else np.zeros(0, bool)
    if len(b.pair):
        status = _status(b, reply)
        whole |= status[b.pair] == 1
        hot = HotWindows(b, status, length)
        answers = _status(b, reply, 2)
        if len(hot.at):
            seen = hot.at[(hot.doc > hot.least[hot.which]) | (answers[hot.which] == 1)]
            mark(seen, seen + length)
    whole &= b.end - b.start >= length
    mark(b.start[whole], b.end[whole])
    masks = np.zeros(len(b.k), U64)
    for kind, at, answers in zip(*(reply.column(c).to_pylist() for c in ("kind", "at", "answers"))):
        if kind == 1:
            masks[np.frombuffer(at, np.int32)] = np.frombuffer(answers, U64)
    own = np.flatnonzero(masks[b.pair] > 0) if len(b.pair) else np.zeros(0, np.int64)
    own = own[~whole[own]]
    for o in range(length - GRAM + 1):
        hit = own[(masks[b.pair[own]] >> U64(o)) & U64(1) > 0]
        mark(b.start[hit] + o, b.start[hit] + o + length)
    gone = np.cumsum(steps[:n]) > 0
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    heads = b.off[:-1][np.diff(b.off) > 0]
    first[heads] = gone[heads]
    total = lambda x: (lambda s: s[b.off[1:]] - s[b.off[:-1]])(np.concatenate(([0], np.cumsum(x, dtype=np.int64))))
    removed = total(gone)
    kept, at = b.data[~gone].tobytes(), np.concatenate(([0], np.cumsum(np.diff(b.off) - removed)))
    pieces = [kept[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
    columns = [rows.column("doc"), pa.array(np.diff(b.off)), pa.array(removed), pa.array(total(first)), pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string())]
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if with_text:
        columns, names = [*columns, pa.array(pieces, pa.binary())], [*names, "kept"]
    return pa.table(columns, names=names)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, with_text: bool = False, batch_bytes: int = 6 << 20, hot: int = HOT) -> DataFrame:
    """Per document: key, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, if ``with_text``).

    ``length`` may be 29 to 56: the suffix order needs at least 28 bytes and twice that at most. A gram with more
    than ``hot`` contexts is settled by window hashes.
    """
    buckets = batches_for(docs, text, batch_bytes)
    d = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).withColumn("g", F.pmod(F.xxhash64("doc", F.length("text")), F.lit(buckets)).cast("int"))
    by = d.groupBy("g")
    asked = by.applyInArrow(lambda rows: trimmed(_ask)(rows, length, buckets), REQUEST)
    replies = asked.groupBy("bucket").applyInArrow(lambda block: trimmed(_judge)(block, hot), REPLY)
    contexts = by.cogroup(replies.groupBy("g")).applyInArrow(lambda rows, reply: trimmed(_contexts)(rows, reply, length, 4 * buckets), CONTEXT)  # small indexes
    masks = contexts.groupBy("bucket").applyInArrow(lambda block: trimmed(_settle)(block, length), REPLY)
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    out = by.cogroup(replies.unionByName(masks).groupBy("g")).applyInArrow(lambda rows, reply: trimmed(_cover)(rows, reply, length, with_text), schema)
    return out.withColumnRenamed("doc", key)
