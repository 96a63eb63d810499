"""Token ids in Parquet list columns: delta-encoded pages, fixed row-group and page sizes, page indexes.

Documents are range-partitioned by id and sorted, so the files hold ascending ids; row-group and page
sizes are set, and Parquet's column and offset indexes (which the writer adds) let ``read_ids`` fetch a
few ids and ``read_metadata`` the lengths without any tokens. Ids are delta-packed (dictionary off)
because a vocabulary of 50,000 leaves a dictionary no gain. ``start`` counts all ids before a document:
sums of files in the order of their partition numbers come first, then the running sum inside each file.

Texts are encoded by the tokenizers library. In byte-level pre-tokenizers some places always begin a
pre-token (a space before a word, a mark behind a letter), so a text's ids are those of its pieces
between such places. Arrow's dictionary encoding finds a batch's distinct pieces, and a worker encodes
each once and remembers it; of a bounded number of pieces those used last stay. Other tokenizers encode
whole texts.

Edge cases: null text counts as empty and holds the end id only; rows that repeat a doc_id stand in
order of their text; a null doc_id sorts first; an empty table gives empty files and an empty result.
"""

from __future__ import annotations

import functools
import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnowline.llm.common import shared_dir
from winnowline.llm.kernel import spread, utf8, utf8_bytes

#: Pieces that a worker remembers at most, and bytes of text that are taken apart at once.
CACHE_PIECES = 700_000
PART_BYTES = 4 << 20


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By byte: can't begin white space (some of that in two or three bytes begins with C2, E1, E2, E3); letter; mark; no white space, all ASCII."""
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = False
    letter = np.array([chr(c).isascii() and chr(c).isalpha() for c in range(256)])
    mark = np.array([0x20 < c < 0x7F and not chr(c).isalnum() for c in range(256)])
    solid = np.array([0x20 < c < 0x7F for c in range(256)])
    return word, letter, mark, solid


def _after_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether an ASCII letter, or one of Latin-1 in two bytes, stands before each place."""
    _, letter, _, _ = _classes()
    last, before = data[at - 1], data[np.maximum(at - 2, 0)]
    return letter[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))


def piece_starts(data: np.ndarray, offsets: np.ndarray, unbroken: tuple[bytes, ...] = ()) -> np.ndarray:
    """Where pieces begin: at texts, and at some of the places where a pre-token begins whatever stands around it.

    These are a space that leads a word, a mark behind a letter, and both ends of a single line feed
    between a solid character and a letter; but no place inside one of the strings ``unbroken``.
    """
    word, letter, mark, solid = _classes()
    n = len(data)
    begin = np.zeros(n + 2, bool)
    if n > 1:
        begin[: n - 1] = (data[:-1] == 0x20) & word[data[1:]]
        marks = np.flatnonzero(mark[data[1:]]) + 1
        begin[marks[_after_letter(data, marks)]] = True
        feed = np.flatnonzero(data[1:-1] == 0x0A) + 1
        feed = feed[(solid[data[feed - 1]] | _after_letter(data, feed)) & letter[data[feed + 1]]]
        begin[feed] = begin[feed + 1] = True
    for token in unbroken:
        for found in re.finditer(re.escape(token), data):
            begin[found.start() + 1 : found.end()] = False
    # What these rules saw across the end of a text isn't so.
    some = np.diff(offsets) > 0
    begin[offsets[1:][some] - 1] = False
    begin[offsets[:-1][some]] = True
    return np.flatnonzero(begin[:n])


class Encoder:
    """A worker's tokenizer and the ids of the pieces that it met last."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        kind, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        loose = any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        self.by_piece = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not spec.get("normalizer") and not loose
        self.unbroken = tuple(t["content"].encode() for t in added)
        # In a byte-level vocabulary each character of a token stands for one byte.
        self.lengths = np.array([len((self.tokenizer.id_to_token(i) or "")) for i in range(self.tokenizer.get_vocab_size())])
        for t in added:
            self.lengths[t["id"]] = len(t["content"].encode())
        self.known = pa.array([], pa.large_binary())
        self.flat, self.sizes, self.used, self.clock = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: pa.Array, behind: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each piece has) of pieces that stay apart in one text, 256 to a call; the last ``behind`` bytes of each don't belong to it."""
        data, off = utf8_bytes(pieces)
        raw = data.tobytes()
        cuts = [*range(0, len(pieces), 256), len(pieces)]
        texts = [raw[off[i] : off[j]].decode() for i, j in zip(cuts[:-1], cuts[1:])]
        ids = np.concatenate([np.zeros(0, np.uint32), *self.whole(texts)])
        # The byte lengths of the ids tell the pieces apart again.
        ends = np.cumsum(self.lengths[ids])
        first, after = np.searchsorted(ends, off[:-1], side="right"), np.searchsorted(ends, off[1:] - behind, side="right")
        if behind:
            inside = np.zeros(len(ids) + 1, np.int64)
            np.add.at(inside, first, 1)
            np.add.at(inside, after, -1)
            ids = ids[np.cumsum(inside[:-1]) > 0]
        return ids, after - first

    def learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, how many each has)."""
        _, letter, _, solid = _classes()
        data, off = utf8_bytes(pieces)
        first, last = data[off[:-1]], data[off[1:] - 1]
        led = first == 0x20
        line = letter[first] & (solid[last] | _after_letter(data, off[1:])) & (np.diff(off) > 1)
        try:
            groups = [(np.flatnonzero(led), self._joined(pieces.filter(pa.array(led)), 0))]
            groups.append((np.flatnonzero(line), self._joined(pc.binary_join_element_wise(pieces.filter(pa.array(line)), *(pa.scalar(x, pa.large_binary()) for x in (b"\n", b""))), 1)))
            rest = np.flatnonzero(~led & ~line)
        except UnicodeDecodeError:
            groups, rest = [], np.arange(len(pieces))
        alone = self.whole([b.decode("utf-8", "replace") for b in pieces.take(pa.array(rest)).to_pylist()])
        groups.append((rest, (np.concatenate([np.zeros(0, np.uint32), *alone]), np.array([len(a) for a in alone], np.int64))))
        where, ids = np.concatenate([g[0] for g in groups]), np.concatenate([g[1][0] for g in groups])
        n = np.concatenate([g[1][1] for g in groups])
        back = np.argsort(where)
        return ids[spread((np.cumsum(n) - n)[back], n[back])], n[back]

    def ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each piece's begin, how many it has)."""
        found = pc.index_in(pieces, value_set=self.known)
        place = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = place < 0
        place[new] = len(self.known) + np.arange(new.sum())
        more = pieces.filter(pa.array(new))
        ids, sizes = self.learn(more) if len(more) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        self.known, self.flat = pa.concat_arrays([self.known, more]), np.concatenate((self.flat, ids))
        self.sizes, self.used = np.concatenate((self.sizes, sizes)), np.concatenate((self.used, np.zeros(len(sizes), np.int64)))
        self.clock += 1
        self.used[place] = self.clock
        flat, starts, sizes = self.flat, np.cumsum(self.sizes) - self.sizes, self.sizes
        if len(self.known) > CACHE_PIECES:
            # The half that was used last stays.
            stay = self.used > np.partition(self.used, CACHE_PIECES // 2)[CACHE_PIECES // 2]
            self.flat = flat[spread(starts[stay], sizes[stay])]
            self.known, self.sizes, self.used = self.known.filter(pa.array(stay)), sizes[stay], self.used[stay]
        return flat, starts[place], sizes[place]

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has), with the end id behind each text."""
        end = np.array([] if end_id is None else [end_id], np.uint32)
        if not self.by_piece:
            each = [np.concatenate((a, end)) for a in self.whole([t or "" for t in texts.to_pylist()])]
            return np.concatenate([end[:0], *each]), np.array([len(a) for a in each], np.int64)
        data, offsets = utf8(texts)
        starts = piece_starts(data, offsets, self.unbroken)
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        flat, begin, size = self.ids_of(pieces.dictionary)
        # The end id is one more piece behind each text's own.
        flat, begin, size = np.concatenate((flat, end)), np.append(begin, len(flat)), np.append(size, len(end))
        behind = np.searchsorted(starts, offsets[1:])
        order = np.insert(pieces.indices.to_numpy().astype(np.int64), behind, len(size) - 1)
        n = size[order]
        last = np.cumsum(n)[behind + np.arange(len(behind))]
        return flat[spread(begin[order], n)], np.diff(last, prepend=0)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _parts(texts: pa.Array):
    """Slices of about PART_BYTES (start, length); a longer text makes one of its own."""
    _, offsets = utf8(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_BYTES, side="right")) - 1)
        yield at, to - at
        at = to


def token_rows(docs: DataFrame, path: str, end_id: int | None = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, tokens in ascending order of key, range-partitioned."""
    kind = docs.select(key).dtypes[0][1]
    ordered = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).repartitionByRange("key").sortWithinPartitions("key", "text")

    def encode(batches):
        own = encoder(path)
        for batch in batches:
            for at, size in _parts(batch.column("text")):
                part = batch.slice(at, size)
                ids, counts = own.encode(part.column("text"), end_id)
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                values = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, values)], names=["key", "n_tokens", "tokens"])

    return ordered.mapInArrow(encode, f"key {kind}, n_tokens long, tokens array<int>")


def write_tokens(docs: DataFrame, path: str, out: str | None = None, end_id: int | None = 2, key: str = "doc_id", text: str = "text", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> str:
    """Write the token files and return their folder."""
    out = out or f"{shared_dir(docs.sparkSession)}/winnowline-tokens-{uuid.uuid4().hex}"
    rows = token_rows(docs, path, end_id, key, text)
    writer = rows.write.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(page_bytes)).option("compression", "zstd")
    writer.parquet(out)
    return out


def read_tokens(spark, out: str) -> DataFrame:
    return spark.read.parquet(out)


def read_ids(spark, out: str, low, high, key: str = "doc_id") -> DataFrame:
    """key, n_tokens and tokens of the ids from ``low`` to ``high``: row groups and pages beyond them are skipped by their statistics."""
    return read_tokens(spark, out).where(F.col("key").between(low, high)).withColumnRenamed("key", key)


def read_metadata(spark, out: str, key: str = "doc_id") -> DataFrame:
    """key and n_tokens, without reading any tokens."""
    return read_tokens(spark, out).select(F.col("key").alias(key), "n_tokens")


def token_index(spark, out: str, key: str = "doc_id") -> DataFrame:
    """Per document, read from the files: key, start, n_tokens, ids_crc32.

    Ties of a key follow the file and row order in which they were written.
    """
    name = F.element_at(F.split("_metadata.file_name", "/"), -1)
    # Range partitions hold ascending ids in the order of their numbers; a task that writes several files counts them behind "-c".
    number = F.regexp_extract(name, r"^part-(\d+)", 1).cast("long") * 1_000_000 + F.coalesce(F.regexp_extract(name, r"-c(\d+)\.", 1).try_cast("long"), F.lit(0))
    files = read_tokens(spark, out).select("key", "n_tokens", "tokens", number.alias("file"), F.col("_metadata.row_index").alias("at"))

    def digest(batches):
        for batch in batches:
            tokens = batch.column("tokens")
            flat, off = tokens.flatten(), tokens.offsets
            view = memoryview(flat.buffers()[1])[flat.offset * 4 : (flat.offset + len(flat)) * 4] if len(flat) else b""
            first = off[0].as_py() if len(off) else 0
            bounds = [o - first for o in off.to_pylist()]
            crc = [zlib.crc32(view[a * 4 : b * 4]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_tokens"), pa.array(crc, pa.int64()), batch.column("file"), batch.column("at")], names=["key", "n_tokens", "ids_crc32", "file", "at"])

    kind = files.select("key").dtypes[0][1]
    rows = files.mapInArrow(digest, f"key {kind}, n_tokens long, ids_crc32 long, file long, at long")
    sums = files.groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    shift = sums.select("file", F.coalesce(F.sum("in_file").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    inside = F.sum("n_tokens").over(W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    d = rows.withColumn("through", inside).join(shift, "file")
    return d.select(F.col("key").alias(key), (F.col("shift") + F.col("through") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
