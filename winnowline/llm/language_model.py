"""N-gram language-model scoring with Elias-Fano tries.

Words and one end token follow each other; a token's context are the ``order`` - 1 words before it.
Probabilities are Dirichlet-smoothed level by level, Pn(w | h) = (c(h w) + m Pn-1(w | h')) / (c(h) + m)
with h' without the first word of h and add-one P1, so they sum to one.

Counts and models are spread over the cluster, none is ever whole in one place. Row blocks (hash
batches of documents) send their distinct words with training counts to word buckets and get the
global counts back in the order asked (longer contexts are counted the same way). Then they send their
distinct n-grams of each level, below their contexts, to trie shards. A shard sums the counts and builds its trie: vocabulary, contexts, pointers and
context-relative successors are monotone sequences in Elias-Fano code, the smoothed log probabilities
are quantised to one byte, and all levels lie in one memory-mapped file. Each n-gram asked for is found
by successor search inside its context's range; one byte goes back. The row blocks add up.

A context's successors spread over 16 shards by their hash, so a hot context (or hot pair, which is one
row from each block) does not gather in one task. Shards and blocks grow in number with the text.

Words are 64-bit hashes, successors 48-bit hashes inside a shard. Edge cases: null, empty and blank
texts consist of the end token; without training documents all counts are 0 and the base is 1 over 1;
rows that repeat a doc_id count and are scored each; null ids are not held out; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowline.llm.common import batches_for, cut
from winnowline.llm.kernel import U64, mix, pack_six, trimmed, unpack_six, word_hashes

END, BEGIN = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
SUB = 16
LOWEST = -9.0
REPLY = "g int, bucket int, kind int, answers binary, words long, total long"


class EliasFano:
    """An ascending sequence of integers below 2^63: low bits packed, high bits in unary with directories."""

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        self.n, self.low_bits = n, min(56, max(0, (universe // max(n, 1)).bit_length() - 1))
        v = values.astype(U64)
        low = v & U64((1 << self.low_bits) - 1)
        # 8192 values at a time: their bits fill whole bytes.
        parts = [low[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8) for i in range(0, n, 8192)]
        bits = [np.packbits(np.unpackbits(p, axis=1, bitorder="little")[:, : self.low_bits].reshape(-1), bitorder="little") for p in parts]
        self.low = np.concatenate((*bits, np.zeros(16, np.uint8)))
        high = (v >> U64(self.low_bits)).astype(np.int64)
        size = (int(high[-1]) if n else 0) + n + 2
        unary = np.zeros(-(-size // 64) * 64 + 64, np.uint8)
        unary[high + np.arange(n)] = 1
        self.words = np.packbits(unary, bitorder="little").view(U64)
        self.top = int(high[-1]) if n else -1
        self._count()

    def _count(self) -> None:
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.ones = np.concatenate(([0], np.cumsum(ones)))
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    def levels(self) -> list[str]:
        return ["low", "words", "ones", "zeros"]

    def _select(self, counts: np.ndarray, flip: bool, i: np.ndarray) -> np.ndarray:
        at = np.searchsorted(counts, i, side="right") - 1
        word = self.words[at]
        if flip:
            word = ~word
        rest, place = i - counts[at], np.zeros(len(i), np.int64)
        for b in (32, 16, 8, 4, 2, 1):
            inside = np.bitwise_count(word & U64((1 << b) - 1)).astype(np.int64)
            over = rest >= inside
            rest, place = np.where(over, rest - inside, rest), place + np.where(over, b, 0)
            word = np.where(over, word >> U64(b), word)
        return at * 64 + place

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        high = (self._select(self.ones, False, i) - i).astype(U64)
        bit = i * self.low_bits
        byte = bit >> 3
        raw = np.zeros(len(i), U64)
        for k in range(8):
            raw |= self.low[byte + k].astype(U64) << U64(8 * k)
        raw = raw >> (bit & 7).astype(U64)
        return (high << U64(self.low_bits)) | (raw & U64((1 << self.low_bits) - 1))

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value that isn't less than x (successor search), for each x."""
        if not self.n:
            return np.zeros(len(x), np.int64)
        x = x.astype(U64)
        high = np.minimum((x >> U64(self.low_bits)).astype(np.int64), self.top + 1)
        inside = high <= self.top
        h = np.minimum(high, self.top)
        lo = np.where(h > 0, self._select(self.zeros, True, np.maximum(h - 1, 0)) - np.maximum(h - 1, 0), 0)
        hi = self._select(self.zeros, True, h) - h
        lo, hi = np.where(inside, lo, self.n), np.where(inside, hi, self.n)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            middle = (lo[open_] + hi[open_]) >> 1
            less = self.get(middle) < x[open_]
            lo[open_] = np.where(less, middle + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], middle)
            open_ = open_[lo[open_] < hi[open_]]
        return lo


class Trie:
    """Contexts, their successors and quantised log probabilities of one shard."""

    def __init__(self, context: np.ndarray, word: np.ndarray, count: np.ndarray, context_count: np.ndarray, smooth: float):
        """Rows are distinct (context, word), sorted; 63-bit contexts, 48-bit words."""
        head = np.concatenate(([True], context[1:] != context[:-1])) if len(context) else np.zeros(0, bool)
        vocabulary, word_id = np.unique(word, return_inverse=True)
        rank = np.cumsum(head) - 1
        self.width = max(1, len(vocabulary))
        self.vocabulary = EliasFano(vocabulary, 1 << 48)
        self.contexts = EliasFano(context[head], 1 << 63)
        self.pointers = EliasFano(np.append(np.flatnonzero(head), len(context)), len(context) + 1)
        self.successors = EliasFano(rank.astype(np.int64) * self.width + word_id, max(1, int(head.sum())) * self.width)
        self.codes = quantise(np.log10(count / (context_count + smooth))) if len(count) else np.zeros(0, np.uint8)

    def mapped(self, file) -> Trie:
        """Move all levels to ``file`` and map them from there."""
        parts = [(level, name) for level in (self.vocabulary, self.contexts, self.pointers, self.successors) for name in level.levels()] + [(self, "codes")]
        spots = []
        for owner, name in parts:
            a = np.ascontiguousarray(getattr(owner, name))
            file.seek(-(-file.tell() // 8) * 8)
            spots.append((file.tell(), a.dtype, len(a)))
            file.write(a.tobytes())
        file.flush()
        for (owner, name), (at, kind, n) in zip(parts, spots):
            setattr(owner, name, np.memmap(file, kind, "r", at, (n,)) if n else np.zeros(0, kind))
        return self

    def code(self, context: np.ndarray, sizes: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes for each context's words: the context once, then successor search in its range; 0 if absent."""
        if not self.contexts.n:
            return np.zeros(len(word), np.uint8)
        place = self.contexts.find(context)
        known = place < self.contexts.n
        known[known] = self.contexts.get(place[known]) == context[known]
        row, ok = np.repeat(place, sizes), np.repeat(known, sizes)
        word_id = self.vocabulary.find(word)
        ok &= word_id < self.vocabulary.n
        ok[ok] = self.vocabulary.get(word_id[ok]) == word[ok]
        out, asked = np.zeros(len(word), np.uint8), np.flatnonzero(ok)
        target = (row[asked] * self.width + word_id[asked]).astype(U64)
        at = self.successors.find(target)
        hit = at < self.pointers.get(row[asked] + 1).astype(np.int64)
        hit[hit] = self.successors.get(at[hit]) == target[hit]
        out[asked[hit]] = self.codes[at[hit]]
        return out


def quantise(logs: np.ndarray) -> np.ndarray:
    return (1 + np.round(np.clip(1 - logs / LOWEST, 0, 1) * 254)).astype(np.uint8)


def restore(codes: np.ndarray) -> np.ndarray:
    """Probabilities; 0 for code 0."""
    table = 10 ** (LOWEST * (1 - (np.arange(256) - 1) / 254))
    table[0] = 0
    return table[codes]


class Block:
    """Tokens of a row block."""

    def __init__(self, rows: pa.Table):
        words, bounds = word_hashes(rows.column("text"))
        n = len(bounds) - 1
        self.ends = bounds[1:] + np.arange(1, n + 1)
        tokens = np.empty(len(words) + n, U64)
        is_end = np.zeros(len(tokens), bool)
        is_end[self.ends - 1] = True
        tokens[is_end], tokens[~is_end] = END, words
        self.sizes = np.diff(np.concatenate(([0], self.ends)))
        self.trains = np.repeat(~rows.column("held_out").combine_chunks().to_numpy(zero_copy_only=False), self.sizes)
        self.words, self.index = np.unique(tokens, return_inverse=True)

    def contexts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct contexts of n - 1 words, context of each token); those of one word are the words and, last, the beginning."""
        w = len(self.words)
        starts = np.concatenate(([0], self.ends[:-1]))
        if n == 2:
            previous = np.concatenate(([w], self.index[:-1]))
            previous[starts] = w
            return np.append(self.words, BEGIN), previous
        hashes, inside = np.append(self.words, BEGIN), np.arange(len(self.index)) - np.repeat(starts, self.sizes)
        key = np.zeros(len(self.index), U64)
        for k in range(1, n):
            before = np.concatenate((np.full(k, w), self.index[:-k]))[: len(self.index)]
            before[inside < k] = w
            key += hashes[before] * mix(np.array([k], U64) * U64(0x9E3779B97F4A7C15))[0]
        return np.unique(mix(key), return_inverse=True)

    def grams(self, n: int, shards: int):
        """(context hashes, word hashes, contexts, training counts of the distinct n-grams by shard, context and word; n-gram of each token; shard ends)."""
        w = len(self.words)
        keys, own = self.contexts(n)
        gram, inverse = np.unique(own * (w + 1) + self.index, return_inverse=True)
        counts = np.bincount(inverse[self.trains], minlength=len(gram))
        context, word = gram // (w + 1), gram % (w + 1)
        hc, hw = keys[context] >> U64(1), self.words[word] >> U64(16)
        spread = mix(hc + (hw >> U64(44)) * U64(0xD1342543DE82EF95)) >> U64(32)
        shard = ((spread * U64(shards)) >> U64(32)).astype(np.int64)
        order = np.lexsort((hw, hc, shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return hc[order], hw[order], context[order], counts[order], place[inverse], np.searchsorted(shard[order], np.arange(shards + 1))

    def context_counts(self, reply: pa.Table, n: int) -> np.ndarray:
        """How often each distinct context stands before a training token, over all blocks."""
        if n > 2:
            return _answers(reply, TOTALS + n, np.int64)
        known = _answers(reply, WORDS, np.int64)
        # A document begins as often as it ends.
        return np.append(known, known[np.searchsorted(self.words, END)])


#: Kinds of replies: counts of words, codes of level n (n), counts of the contexts of level n (TOTALS + n).
WORDS, TOTALS = 0, 100


def _narrow(x: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold them all: most are below 256."""
    return x.astype(np.min_scalar_type(int(x.max()))).tobytes()


def _wide(blobs: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    return [np.frombuffer(b, f"u{len(b) // n}") for b, n in zip(blobs, lengths)]


def _table(g: int, names: list[str], kinds: list, rows: list[tuple]) -> pa.Table:
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    return pa.table([columns[0], pa.array([g] * len(rows), pa.int32()), *columns[1:]], names=[names[0], "g", *names[1:]])


def _ask_counts(rows: pa.Table, n: int, buckets: int) -> pa.Table:
    """The distinct words of a row block (n = 1), or its contexts of level n, with their training counts."""
    b = Block(rows)
    keys, own = (b.words, b.index) if n == 1 else b.contexts(n)
    counts = np.bincount(own[b.trains], minlength=len(keys)).astype(np.int64)
    at = np.searchsorted(keys, np.array([(k << 64) // buckets for k in range(1, buckets)], U64))
    at = np.concatenate(([0], at, [len(keys)]))
    out = [(int(k), keys[at[k] : at[k + 1]].tobytes(), counts[at[k] : at[k + 1]].tobytes()) for k in np.flatnonzero(np.diff(at))]
    return _table(rows.column("g")[0].as_py(), ["bucket", "words", "counts"], [pa.int32(), pa.binary(), pa.binary()], out)


def _reply(block: pa.Table, kind: int, parts: list[bytes], words: int = 0, total: int = 0) -> pa.Table:
    n = len(parts)
    column = block.column("bucket" if "bucket" in block.column_names else "shard")
    return pa.table([block.column("g"), column, pa.array([kind] * n, pa.int32()), pa.array(parts, pa.binary()), pa.array([words] + [0] * (n - 1), pa.int64()), pa.array([total] + [0] * (n - 1), pa.int64())], names=["g", "bucket", "kind", "answers", "words", "total"])


def _count(block: pa.Table, kind: int) -> pa.Table:
    parts = [np.frombuffer(x, U64) for x in block.column("words").to_pylist()]
    u, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    counts = np.frombuffer(b"".join(block.column("counts").to_pylist()), np.int64)
    totals = np.zeros(len(u), np.int64)
    np.add.at(totals, inverse, counts)
    answers = np.split(totals[inverse], np.cumsum([len(p) for p in parts])[:-1])
    return _reply(block, kind, [a.tobytes() for a in answers], int((totals > 0).sum()), int(totals.sum()))


def _answers(reply: pa.Table, kind: int, dtype) -> np.ndarray:
    kinds, buckets, blobs = (reply.column(c).to_pylist() for c in ("kind", "bucket", "answers"))
    order = sorted((b, i) for i, (k, b) in enumerate(zip(kinds, buckets)) if k == kind)
    return np.frombuffer(b"".join(blobs[i] for _, i in order), dtype)


def _ask_grams(rows: pa.Table, reply: pa.Table, n: int, shards: int) -> pa.Table:
    b = Block(rows)
    context_counts = b.context_counts(reply, n)
    hc, hw, context, counts, _, at = b.grams(n, shards)
    out = []
    for k in np.flatnonzero(np.diff(at)).tolist():
        lo, hi = at[k], at[k + 1]
        head = np.flatnonzero(np.concatenate(([True], hc[lo + 1 : hi] != hc[lo : hi - 1])))
        sizes = np.diff(np.append(head, hi - lo))
        out.append((k, hc[lo:hi][head].tobytes(), _narrow(context_counts[context[lo:hi][head]]), _narrow(sizes), pack_six(hw[lo:hi]), _narrow(counts[lo:hi])))
    return _table(rows.column("g")[0].as_py(), ["shard", "contexts", "context_counts", "sizes", "words", "counts"], [pa.int32(), *[pa.binary()] * 5], out)


def _answer_grams(block: pa.Table, kind: int, smooth: float) -> pa.Table:
    contexts = [np.frombuffer(x, U64) for x in block.column("contexts").to_pylist()]
    words = [unpack_six(x) for x in block.column("words").to_pylist()]
    context_counts, sizes = (_wide(block.column(c).to_pylist(), [len(x) for x in contexts]) for c in ("context_counts", "sizes"))
    counts = _wide(block.column("counts").to_pylist(), [len(x) for x in words])
    c = np.concatenate([np.repeat(x, s) for x, s in zip(contexts, sizes)])
    m = np.concatenate([np.repeat(x, s) for x, s in zip(context_counts, sizes)])
    w, n = np.concatenate(words), np.concatenate(counts)
    used = np.flatnonzero(n)
    order = used[np.lexsort((w[used], c[used]))]
    c, w, m, n = c[order], w[order], m[order].astype(float), n[order]
    new = np.concatenate(([True], (c[1:] != c[:-1]) | (w[1:] != w[:-1]))) if len(c) else np.zeros(0, bool)
    total = np.add.reduceat(n.astype(np.int64), np.flatnonzero(new)) if len(c) else n
    with tempfile.TemporaryFile() as file:
        trie = Trie(c[new], w[new], total, m[new], smooth).mapped(file)
        parts = [trie.code(x, s, v).tobytes() for x, s, v in zip(contexts, sizes, words)]
    return _reply(block, kind, parts)


def _score(rows: pa.Table, reply: pa.Table, order: int, shards: int, smooth: float, words: int, total: int) -> pa.Table:
    b = Block(rows)
    c = _answers(reply, WORDS, np.int64)[b.index]
    base = (c + 1) / (total + words + 1)
    p = base
    for n in range(2, order + 1):
        _, _, context, _, place, _ = b.grams(n, shards)
        seen = restore(_answers(reply, n, np.uint8))[place]
        p = seen + p * (smooth / (b.context_counts(reply, n)[context[place]] + smooth))
    starts = b.ends - b.sizes
    add = lambda x: np.add.reduceat(x, starts)
    n = len(starts)
    return pa.table([rows.column("doc"), rows.column("held_out"), pa.array(b.sizes), pa.array(add((c > 0).astype(np.int64))), pa.array([total] * n, pa.int64()), pa.array(add(np.log10(base))), pa.array(add(np.log10(np.minimum(p, 1.0))))], names=["doc", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_documents(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", smooth: float = 50.0, batch_bytes: int = 16 << 20, order: int = 2) -> DataFrame:
    """Learn from the rows that aren't held out and score all: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``order`` is the length of the longest n-grams, 2 or more; each further level sends its own n-grams.
    """
    blocks = batches_for(docs, text, batch_bytes)
    shards = 2 * blocks
    kind = docs.select(key).dtypes[0][1]
    d = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), held_out.alias("held_out"))
    by = d.withColumn("g", F.pmod(F.xxhash64("doc", F.length("text")), F.lit(blocks)).cast("int")).groupBy("g")

    def counted(n: int, reply_kind: int) -> DataFrame:
        asked = by.applyInArrow(lambda rows: trimmed(_ask_counts)(rows, n, blocks), "bucket int, g int, words binary, counts binary")
        return cut(asked.groupBy("bucket").applyInArrow(lambda block: trimmed(_count)(block, reply_kind), REPLY))

    def level(n: int, counts: DataFrame) -> DataFrame:
        grams = by.cogroup(counts.groupBy("g")).applyInArrow(lambda rows, reply: trimmed(_ask_grams)(rows, reply, n, shards), "shard int, g int, contexts binary, context_counts binary, sizes binary, words binary, counts binary")
        return grams.groupBy("shard").applyInArrow(lambda block: trimmed(_answer_grams)(block, n, smooth), REPLY)

    known = counted(1, WORDS)
    words, total = known.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    replies = known.unionByName(level(2, known))
    for n in range(3, order + 1):
        contexts = counted(n, TOTALS + n)
        replies = replies.unionByName(contexts).unionByName(level(n, contexts))
    out = by.cogroup(replies.groupBy("g")).applyInArrow(lambda rows, reply: trimmed(_score)(rows, reply, order, shards, smooth, words, total), f"doc {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("doc", key)
