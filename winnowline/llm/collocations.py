"""Phrase collocations from vertical positional inverted lists, one language at a time.

Documents lie in blocks. A block keeps its words as a sequence, broken where a piece or a document ends,
and for the present length the list of positions at which a frequent phrase starts. Level by level the
list of a phrase is extended: a position stays if the next position is in a list of the same length as
well (so both parts of the longer phrase are frequent), that is, the occurrence lists are merged with
the postings of the adjacent word. Blocks hold whole documents, so lists are merged inside a block; the
length of a phrase's list over all blocks, which is its exact frequency, is a grouped sum.

A block sends its distinct candidates and their counts, packed, to ranges of the key space and gets a bit
for each back in the order asked, so nothing of the corpus is sent to every task and a common phrase is
one entry for each block. One block is named the home of a phrase, and only the home hands its words on.

Phrases are told apart by 64-bit hashes of language and words; strings come from the home block of each
word. Scores are exact: products are 38-digit decimals.

Edge cases: null texts are empty; a null language is ``und`` (with any documents that say so); words
are split at spaces and tabs, pieces at ``.,;:!?`` and at line feeds, vertical tabs, form feeds and
carriage returns; languages without a frequent phrase give no rows; rows that repeat count each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnowline.llm.blocks import block_names, ended, spans_of, text_blocks
from winnowline.llm.common import cut
from winnowline.llm.kernel import U64, mix, span_hashes, spread, tables, trim, utf8

#: Bytes of text in a block, and in the parts that are taken apart at once.
BLOCK, PART = 8 << 20, 2 << 20
#: Blocks whose candidates one bucket takes on average.
BLOCKS_TO_A_BUCKET = 4
#: Bytes of a row group of the tables of blocks: one or two blocks, however many a task writes or reads.
GROUP = 8 << 20


@functools.cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """(ends a word, ends a piece)."""
    piece = np.zeros(256, bool)
    piece[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
    word = piece.copy()
    word[[0x20, 0x09]] = True
    return word, piece


@functools.cache
def _multipliers() -> np.ndarray:
    return mix(np.arange(101, 133, dtype=U64)) | U64(1)


def phrase_keys(words: list[np.ndarray]) -> np.ndarray:
    """The keys of phrases from the hashes of their first words, of their second words, ...; a word's own hash is its key."""
    if len(words) == 1:
        return words[0]
    out = np.full(len(words[0]), len(words), U64)
    for word, factor in zip(words, _multipliers()):
        out += word * factor
    return mix(out)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _words(rows: pa.Table) -> tuple:
    """(the words' hashes in order, 0 where a piece ends; the distinct hashes, their strings and languages; the languages and how many words each has)."""
    langs = rows.column("lang").combine_chunks().fill_null("und").dictionary_encode()
    names = langs.dictionary.cast(pa.string())
    data, starts = ended(*utf8(rows.column("text")))
    data = tables()[1][data]
    word, piece = _kinds()
    begin, end = spans_of(data, word)
    of = langs.indices.to_numpy().astype(np.int64)[np.searchsorted(starts, begin, side="right") - 1] if len(begin) else np.zeros(0, np.int64)
    lang_data, lang_at = utf8(names)
    hashes = mix(span_hashes(data, begin, end) ^ mix(span_hashes(lang_data, lang_at[:-1], lang_at[1:]))[of])
    keys, first = np.unique(hashes, return_index=True)
    sizes = end[first] - begin[first]
    strings = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)), pa.py_buffer(data[spread(begin[first], sizes)])]).cast(pa.string())
    gaps = np.flatnonzero(np.diff(np.cumsum(piece[data])[begin])) + 1 if len(begin) else begin
    sequence = np.append(np.insert(hashes, gaps, 0), np.zeros(1, U64))
    return sequence, keys, strings, names.take(pa.array(of[first])), names, pa.array(np.bincount(of, minlength=len(names)).astype(np.int64))


def _numbered(sequence: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each hash among the keys, from 1; 0 for a gap."""
    return np.where(sequence > 0, np.searchsorted(keys, sequence) + 1, 0).astype(np.uint32)


def sequences(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """A row for each block: ids (the words in order by number from 1, 0 where a piece ends), keys, counts, names and languages by number, and each language's words."""

    def read(batches):
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        for block, rows in zip(block_names(), text_blocks(batches, "text", BLOCK)):
            parts = [_words(part) for part in text_blocks(rows.to_batches(), "text", PART)]
            keys, first = np.unique(np.concatenate([p[1] for p in parts]), return_index=True)
            ids = np.concatenate([_numbered(p[0], keys) for p in parts])
            counts = np.bincount(ids, minlength=len(keys) + 1)[1:]
            names, langs = (pa.concat_arrays([p[c] for p in parts]).take(pa.array(first)) for c in (2, 3))
            spoken = [pa.concat_arrays([p[c] for p in parts]) for c in (4, 5)]
            yield pa.record_batch([pa.array([block]), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, keys, counts.astype(np.uint32))), *map(one, (names, langs, *spoken))], names=["block", "ids", "keys", "counts", "names", "langs", "spoken", "words"])
            trim()

    d = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return cut(d.mapInArrow(read, "block long, ids binary, keys binary, counts binary, names array<string>, langs array<string>, spoken array<string>, words array<long>"), "zstd", GROUP)


STATE = "block long, ids binary, keys binary, alive binary, own binary"


def _state(block: int, ids: np.ndarray, keys: np.ndarray, alive: np.ndarray, own: np.ndarray) -> pa.Table:
    return pa.table([pa.array([block]), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, keys, alive.astype(np.uint8), own))], names=["block", "ids", "keys", "alive", "own"])


def _compact(ids: np.ndarray, alive: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence without the positions that lie in no phrase of the lists; a break stays where words were taken out."""
    reach = np.convolve(alive, np.ones(length, np.int64))[: len(ids)] > 0 if len(ids) else alive
    ids = np.where(reach, ids, 0).astype(np.uint32)
    keep = (ids > 0) | np.concatenate(([False], ids[:-1] > 0)) if len(ids) else reach
    return ids[keep], alive[keep]


def _phrases(row: dict, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys) of the candidates of this length: both parts one word shorter are in the lists."""
    ids, dictionary, alive = np.frombuffer(row["ids"], np.uint32), np.frombuffer(row["keys"], U64), np.frombuffer(row["alive"], np.uint8) > 0
    at = np.flatnonzero(alive[:-1] & alive[1:]) if len(alive) > 1 else np.zeros(0, np.int64)
    return at, phrase_keys([dictionary[ids[at + k] - 1] for k in range(length)])


def _asked(row: dict, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(the sorted distinct candidates of a block, how often each occurs there)."""
    if length == 1:
        return np.frombuffer(row["keys"], U64), np.frombuffer(row["counts"], np.uint32)
    return np.unique(_phrases(row, length)[1], return_counts=True)


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the ranges of the buckets start among sorted keys, and where the last ends."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], U64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def _rows(batches):
    """The rows of the batches one by one: a block is megabytes."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _needed(length: int) -> list[str]:
    return ["block", "keys", "counts"] if length == 1 else ["block", "ids", "keys", "alive"]


def _settled(state: DataFrame, length: int, least: int, buckets: int) -> DataFrame:
    """Replies (block, bucket, often, home: bits in the order of the block's candidates) and, where block is null, the frequent phrases of a bucket (keys, sums)."""

    def ask(batches):
        for row in _rows(batches):
            keys, counts = _asked(row, length)
            counts = counts.astype(np.uint8 if not len(counts) or counts.max() < 256 else np.uint32)
            at = _bounds(keys, buckets)
            full = np.flatnonzero(np.diff(at)).tolist()
            yield pa.record_batch([pa.array(full, pa.int32()), pa.array([row["block"]] * len(full), pa.int64()), *(pa.array([x[at[k] : at[k + 1]].tobytes() for k in full], pa.binary()) for x in (keys, counts))], names=["bucket", "block", "keys", "counts"])
            del keys, counts
            trim()

    def settle(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(k, U64) for k in rows.column("keys").to_pylist()]
        counts = [np.frombuffer(c, np.uint8 if len(c) == len(k) else np.uint32) for c, k in zip(rows.column("counts").to_pylist(), parts)]
        keys, first, number = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        sums = np.bincount(number, np.concatenate(counts)).astype(np.int64)
        good = sums >= least
        often, home = good[number], np.zeros(len(number), bool)
        home[first[good]] = True
        ends = np.cumsum([len(p) for p in parts])[:-1]
        bits = [[np.packbits(x).tobytes() for x in np.split(y, ends)] + [None] for y in (often, home)]
        n = len(parts)
        found = [[None] * n + [x.tobytes()] for x in (keys[good], sums[good])]
        trim()
        return pa.table([pa.array(rows.column("block").to_pylist() + [None], pa.int64()), pa.array(rows.column("bucket").to_pylist() + [None], pa.int32()), *(pa.array(x, pa.binary()) for x in bits + found)], names=["block", "bucket", "often", "home", "keys", "sums"])

    requests = state.select(*_needed(length)).mapInArrow(ask, "bucket int, block long, keys binary, counts binary")
    return cut(requests.groupBy("bucket").applyInArrow(settle, "block long, bucket int, often binary, home binary, keys binary, sums binary"))


def _frequencies(settled: DataFrame) -> DataFrame:
    """(key, f) of the frequent phrases."""

    def take(batches):
        for batch in batches:
            for keys, sums in zip(batch.column("keys").to_pylist(), batch.column("sums").to_pylist()):
                yield pa.record_batch([pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(sums, np.int64))], names=["key", "f"])

    return settled.where("block IS NULL").select("keys", "sums").mapInArrow(take, "key long, f long")


def _answers(keys: np.ndarray, told: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the block's candidates are frequent, of which the block is the home)."""
    sizes = np.diff(_bounds(keys, buckets))
    told = told.select(["bucket", "often", "home"]).sort_by("bucket")
    sizes = sizes[sizes > 0].tolist()
    return tuple(np.concatenate([*(np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(told.column(c).to_pylist(), sizes)), np.zeros(0, np.uint8)]) > 0 for c in ("often", "home"))


def _first_lists(state: DataFrame, settled: DataFrame, buckets: int) -> DataFrame:
    """The lists of frequent words, with the strings and languages of those at home."""

    def settle(rows: pa.Table, told: pa.Table) -> pa.Table:
        row = rows.select(["block", "ids", "keys", "counts"]).to_pylist()[0]
        ids, keys = np.frombuffer(row["ids"], np.uint32), np.frombuffer(row["keys"], U64)
        often, own = _answers(keys, told, buckets)
        ids = np.concatenate(([0], np.where(often, np.cumsum(often), 0))).astype(np.uint32)[ids]
        ids, alive = _compact(ids, ids > 0, 1)
        home = pa.array(np.flatnonzero(own))
        out = _state(row["block"], ids, keys[often], alive, keys[own])
        for c in ("names", "langs"):
            a = rows.column(c).combine_chunks().flatten().take(home)
            out = out.append_column(c, pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a))
        trim()
        return out

    told = settled.where("block IS NOT NULL").select(F.col("block").alias("at"), "bucket", "often", "home")
    return cut(state.select("block", "ids", "keys", "counts", "names", "langs").groupBy("block").cogroup(told.groupBy("at")).applyInArrow(settle, STATE + ", names array<string>, langs array<string>"), "zstd", GROUP)


def _next_lists(state: DataFrame, settled: DataFrame, length: int, buckets: int) -> DataFrame:
    """The lists extended to ``length`` words: positions at which a frequent phrase starts."""

    def settle(rows: pa.Table, told: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        at, keys = _phrases(row, length)
        asked = np.unique(keys)
        often, own = _answers(asked, told, buckets)
        ids = np.frombuffer(row["ids"], np.uint32)
        alive = np.zeros(len(ids), bool)
        alive[at[_among(keys, asked[often])]] = True
        ids, alive = _compact(ids, alive, length)
        trim()
        return _state(row["block"], ids, np.frombuffer(row["keys"], U64), alive, asked[own])

    told = settled.where("block IS NOT NULL").select(F.col("block").alias("at"), "bucket", "often", "home")
    return cut(state.select("block", "ids", "keys", "alive").groupBy("block").cogroup(told.groupBy("at")).applyInArrow(settle, STATE), "zstd", GROUP)


def _cuts(state: DataFrame, length: int) -> DataFrame:
    """(key, words, lefts, rights): each frequent phrase once, from its home, with its word hashes and the keys of its parts at every cut."""

    def take(batches):
        for row in _rows(batches):
            ids, dictionary = np.frombuffer(row["ids"], np.uint32), np.frombuffer(row["keys"], U64)
            at = np.flatnonzero(np.frombuffer(row["alive"], np.uint8))
            keys, first = np.unique(phrase_keys([dictionary[ids[at + k] - 1] for k in range(length)]), return_index=True)
            own = _among(keys, np.frombuffer(row["own"], U64))
            keys, at = keys[own], at[first[own]]
            words = [dictionary[ids[at + k] - 1] for k in range(length)]
            lists = [np.stack(x, 1) for x in (words, [phrase_keys(words[:k]) for k in range(1, length)], [phrase_keys(words[k:]) for k in range(1, length)])]
            wide = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1).view(np.int64)))
            yield pa.record_batch([pa.array(keys.view(np.int64)), *map(wide, lists)], names=["key", "words", "lefts", "rights"])

    return cut(state.mapInArrow(take, "key long, words array<long>, lefts array<long>, rights array<long>"))


def mined(docs: DataFrame, text: str, lang: str, least: int, longest: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(frequencies of all frequent phrases: key, f; phrases of two words or more with their cuts; word, name and lang of the frequent words; words of each language)."""
    state = sequences(docs, text, lang)
    spoken = cut(state.select(F.explode(F.arrays_zip("spoken", "words")).alias("x")).groupBy(F.col("x.spoken").alias("lang")).agg(F.sum("x.words").alias("n")))
    buckets = max(1, -(-state.count() // BLOCKS_TO_A_BUCKET))
    settled = _settled(state, 1, least, buckets)
    counts, phrases = _frequencies(settled), None
    state = _first_lists(state, settled, buckets)
    names = cut(_names(state))
    for length in range(2, longest + 1):
        settled = _settled(state, length, least, buckets)
        state = _next_lists(state, settled, length, buckets)
        counts = counts.unionByName(_frequencies(settled))
        own = _cuts(state, length)
        phrases = own if phrases is None else phrases.unionByName(own)
    return counts, phrases, names, spoken


def _names(state: DataFrame) -> DataFrame:
    """(word, name, lang) of the words at home in each block."""

    def take(batches):
        for batch in batches:
            for k, row in enumerate(batch.select(["keys", "own"]).to_pylist()):
                keys = np.frombuffer(row["keys"], U64)
                home = keys[_among(keys, np.frombuffer(row["own"], U64))]
                strings = (pa.array(batch.column(c)[k].as_py(), pa.string()) for c in ("names", "langs"))
                yield pa.record_batch([pa.array(home.view(np.int64)), *strings], names=["word", "name", "lang"])

    return state.select("keys", "own", "names", "langs").mapInArrow(take, "word long, name string, lang string")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words by the score of their weakest cut.

    ``a`` is the phrase's frequency, ``l`` and ``r`` those of its parts, ``n`` the language's words and
    the score floor(1000 a n / (l r)). Phrases that only occur inside one longer phrase are left out.
    """
    counts, phrases, names, spoken = mined(docs, text, lang, least, longest)
    f = cut(counts)
    side = lambda name, count: f.select(F.col("key").alias(name), F.col("f").alias(count))
    parts = phrases.select("key", F.size("words").alias("size"), F.posexplode(F.arrays_zip("lefts", "rights")).alias("cut", "x")).select("key", "size", "cut", F.col("x.lefts").alias("left"), F.col("x.rights").alias("right"))
    parts = cut(parts.join(side("key", "a"), "key").join(side("left", "l"), "left").join(side("right", "r"), "right"))
    inside = parts.where("cut = size - 2 AND l = a").select(F.col("left").alias("gone")).union(parts.where("cut = 0 AND r = a").select("right")).distinct()
    kept = parts.join(inside, F.col("key") == F.col("gone"), "left_anti")
    first = phrases.select(F.col("key").alias("of"), F.col("words")[0].alias("word"))
    language = first.join(names, "word").join(spoken, "lang").select("of", "lang", "n")
    wide = "CAST({} AS DECIMAL(38, 0))".format
    scored = kept.join(language, F.col("key") == F.col("of")).withColumn("score", F.expr(f"({wide('1000')} * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})"))
    weakest = scored.groupBy("key", "lang").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("x")).select("key", "lang", "x.*")
    spelled = phrases.select("key", F.posexplode("words").alias("place", "word")).join(names.select("word", "name"), "word").groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = weakest.join(spelled, "key").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same rows for the table documents.
SQL = r"""
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, range(1, 6) t(k)),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.*, i, array_to_string(w[1:i], ' ') AS left_part, array_to_string(w[i + 1:], ' ') AS right_part FROM c, range(1, 5) t(i) WHERE i < k),
parts AS (SELECT cuts.*, x.f AS l, y.f AS r FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = left_part JOIN f y ON y.lang = cuts.lang AND y.phrase = right_part),
inside AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c t ON t.lang = s.lang AND t.a = s.a AND t.k > s.k AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ')),
scored AS (SELECT lang, phrase, a, l, r, n, i, (1000::HUGEINT * a * n) // (l::HUGEINT * r) AS score FROM parts JOIN n USING (lang) ANTI JOIN inside USING (lang, phrase)),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
