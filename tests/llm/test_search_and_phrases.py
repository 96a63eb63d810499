"""Min-max hashing, ranked search and phrase mining against plain computations on awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import plain
import pyarrow as pa
import pytest

from winnowline.llm import collocations, lexical, minhash

SCHEMA = "doc_id long, text string, lang string, source string, key string, band long, rank int, block long, item long, word long, n long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def rows():
    rng = random.Random(5)
    common = ["The", "of", "and", "to"] + [f"w{i}" for i in range(60)]
    texts = ["", None, " \t\n ", "one", "Two words", "a, b. c", "é ß É", "x\x00y " * 30, "deep learning model. " * 120, "z " * 3000]
    base = [rng.choice(common) for _ in range(120)]
    texts += [" ".join(base)] * 3
    for edits in (1, 2, 3, 4, 5, 6, 8, 12, 20):
        for _ in range(3):
            copy = list(base)
            for at in rng.sample(range(120), edits):
                copy[at] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [" ".join(rng.choice(common) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    texts += [f"{'new york city' if i % 3 else 'York new'} hall; the {'red' if i % 2 else 'RED'} house\nof new york city, {i}" for i in range(150)]
    out = [(i, t, ["en", "de", None][i % 3], "s", "k", 1, 2, 3, 4, 5, 6) for i, t in enumerate(texts)]
    return out + [out[12], (3, "other text under a known id", "en", None, None, None, None, None, None, None, None), (None, texts[10], "en", None, None, None, None, None, None, None, None), (None, "lonely null id", None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module", params=["awkward", "empty"])
def docs(request, awkward):
    return awkward if request.param == "awkward" else awkward.limit(0)


def items(docs):
    return [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]


def bag(rows):
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("width,percent", [(4, 80), (5, 80), (1, 60), (4, 100)])
def test_near_copies(docs, width, percent):
    found = items(docs)
    texts = [t for _, t, _ in found]
    sets, group = plain.shingle_sets(texts, width), plain.components(texts, width, percent)
    least = defaultdict(list)
    for (d, _, _), g in zip(found, group):
        least[g] += [d] if d is not None else []
    want = bag((d, len(s), min(least[g], default=None), d == min(least[g], default=None)) for (d, _, _), s, g in zip(found, sets, group))
    got = minhash.near_copies(docs, width=width, percent=percent).select("doc_id", "n_shingles", "component_id", "kept")
    assert bag(got.collect()) == want


def test_min_and_max_estimate_jaccard_without_bias():
    rng = np.random.default_rng(3)
    low_var, plain_var = [], []
    for _ in range(40):
        pool = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
        a, b = pool[:120], pool[30:]
        low, high = minhash.min_max(np.concatenate((a, b)), np.array([120, 120]), 128)
        same = (low[:, 0] == low[:, 1], high[:, 0] == high[:, 1])
        low_var.append(np.mean([same[0][:64], same[1][:64]]))
        plain_var.append(np.mean(same[0]))
    assert abs(np.mean(low_var) - 90 / 150) < 0.02
    assert np.var(low_var) < 1.6 * np.var(plain_var)


def test_bands_and_sketches_miss_less_than_asked():
    assert (1 - 0.8 ** (2 * minhash.ROWS)) ** minhash.band_count(80, 1e-7) <= 1e-7
    k = minhash.least_agreement(124, 80, 1e-7)
    assert sum(math.comb(124, i) * 0.85**i * 0.15 ** (124 - i) for i in range(k)) <= 1e-7 < sum(math.comb(124, i) * 0.85**i * 0.15 ** (124 - i) for i in range(k + 1))


def test_parity_sketches_refute_no_link():
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    sets = [np.unique(pool[at : at + size]) for size in (1, 3, 40, 60, 300, 330, 900) for at in rng.integers(0, 4000 - size, 12)]
    sets += [np.unique(np.concatenate((s[: len(s) - len(s) // cut], rng.integers(0, 1 << 63, len(s) // cut, dtype=np.uint64)))) for s in sets for cut in (9, 10, 12, 30)]
    n = np.array([len(s) for s in sets])
    i, j = minhash.unrefuted(n, np.arange(len(sets)), [minhash.parity_sketch(s) for s in sets], np.zeros(len(sets), np.int64), 80)
    may = {frozenset(x) for x in zip(i.tolist(), j.tolist())}
    assert len(may) == len(i)
    shared = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    links = {frozenset((a, b)) for a in range(len(sets)) for b in range(a) if 180 * shared(a, b) >= 80 * (n[a] + n[b])}
    assert len(links) > 50 and links <= may and len(may) < 2 * len(links)


def test_large_bands_are_compared_in_slices(awkward, monkeypatch):
    want = bag(minhash.near_copies(awkward, width=4).collect())
    monkeypatch.setattr(minhash, "SLICE", 3)
    assert bag(minhash.near_copies(awkward, width=4).collect()) == want


def test_a_family_of_copies_of_one_original_makes_few_pairs(spark):
    """Copies edited in other places are further apart than the threshold; the original links them all."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(base)]
    for _ in range(300):
        copy = list(base)
        for at in rng.sample(range(0, 200, 4), 4):
            copy[at] = f"n{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_copies(d, width=4).collect()} == {0}


def ranked(found, queries, k=20):
    docs = [(d, Counter(TERM.findall(plain.lower(t)))) for d, t, _ in found]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in sorted(set((i, t) for i, t in queries if t is not None), key=str):
        asked, scores = Counter(TERM.findall(plain.lower(text))), []
        for d, c, size in docs:
            m = 75 + (25 * size * n) // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, at + 1, d, -s) for at, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return bag(out)


QUERY_ROWS = [(1, "new york"), (2, "The of AND to w1 w2 w3 zzz"), (3, "nothing-of_it:known é"), (4, ""), (5, None), (6, "z"), (6, "w5 w5 w5"), (1, "new york"), (None, "hall")]


@pytest.mark.parametrize("k,slice_bytes", [(20, 1 << 20), (3, 30)])
def test_search(spark, docs, k, slice_bytes, monkeypatch):
    blocks = lexical.text_blocks
    monkeypatch.setattr(lexical, "text_blocks", lambda b, text: blocks(b, text, 900, 11))
    queries = spark.createDataFrame(QUERY_ROWS, "item_id long, text string")
    got = lexical.search(docs, queries, k=k, slice_bytes=slice_bytes).select("item_id", "rank", "doc_id", "score")
    assert bag(got.collect()) == ranked(items(docs), QUERY_ROWS, k)


def test_search_without_queries(spark, awkward):
    got = lexical.search(awkward, spark.createDataFrame([], "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_bytes_bound_exact_shares():
    tf, m = np.meshgrid(np.array([1, 2, 3, 10, 1000, 60000]), np.array([75, 76, 100, 500, 10**6]))
    shares = lexical.exact_shares(tf.ravel(), m.ravel())
    q = -(-shares // lexical.STEP)
    assert q.max() <= 255 and (q * lexical.STEP >= shares).all() and ((q - 1) * lexical.STEP < shares)[shares > 0].all()


def test_search_rescores_few_documents(spark):
    """The bounds leave most documents out of the exact pass."""
    rng = random.Random(4)
    words = [f"t{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(200)], k=rng.randrange(20, 120))) for _ in range(600)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    index, n, total = lexical.build_index(d)
    asked = lexical._Slice(["t50 t0 t1", "t120 t130 t2"])
    asked.weigh(lexical._document_frequencies(index, asked), n)
    least = lexical.thresholds(index, asked, 20)
    row = index.collect()[0].asDict()
    has, begin, end = lexical._lists(asked, row)
    for q in range(2):
        up, low = lexical._bounds(asked, q, has, begin, end, np.frombuffer(row["ords"], np.uint16), np.frombuffer(row["impacts"], np.uint8).astype(np.int64), 600)
        assert 20 <= (up >= least[q]).sum() < 120 and (low <= up).all()


def phrases(found, least, longest, top):
    f, n, out = defaultdict(Counter), Counter(), []
    for _, text, lang in found:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain.lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in often.items():
            if any(len(x) > len(p) and y >= a and any(x[i : i + len(p)] == p for i in range(len(x))) for x, y in often.items()):
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, at + 1, p.decode(), -a, lf, rt, n[lang], -s) for at, (s, a, p, lf, rt) in enumerate(sorted(scored)[:top])]
    return bag(out)


@pytest.mark.parametrize("least,longest,top", [(100, 5, 2000), (4, 5, 30), (2, 3, 2000)])
def test_collocations(docs, least, longest, top, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 2000)
    monkeypatch.setattr(collocations, "PART", 700)
    got = collocations.collocations(docs, least=least, longest=longest, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert bag(got.collect()) == phrases(items(docs), least, longest, top)


def test_a_task_holds_few_blocks_at_once(spark, monkeypatch):
    """Row groups of the tables of blocks are bounded by bytes, as many blocks as a task may have."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(collocations, "BLOCK", 4000)
    monkeypatch.setattr(collocations, "PART", 1000)
    monkeypatch.setattr(collocations, "GROUP", 20_000, raising=False)
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(500)) for _ in range(60)]
    d = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").coalesce(1)
    state = collocations.sequences(d, "text", "lang")
    settled = collocations._settled(state, 1, 2, 4)
    for table in (state, collocations._first_lists(state, settled, 4)):
        files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in table.inputFiles()]
        sizes = [m.row_group(g).num_rows for m in files for g in range(m.num_row_groups)]
        assert sum(sizes) >= 60 and max(sizes) <= 6


def test_scores_beyond_64_bits(spark):
    d = spark.range(1).selectExpr("CAST(1000 AS DECIMAL(38, 0)) * CAST(30000000000 AS DECIMAL(38, 0)) * CAST(900000000000 AS DECIMAL(38, 0)) AS x", "CAST(40000000000 AS DECIMAL(38, 0)) * CAST(70000000001 AS DECIMAL(38, 0)) AS y")
    assert d.selectExpr("x div y AS s").first()["s"] == 1000 * 30000000000 * 900000000000 // (40000000000 * 70000000001)


def test_blocks_keep_every_row_once():
    from winnowline.llm.blocks import text_blocks

    texts = ["a" * n for n in (5, 0, 3, 50, 1, 1, 1, 30, 2)] + [None]
    batches = [pa.record_batch([pa.array(texts[i : i + 4]), pa.array(range(i, min(i + 4, len(texts))))], names=["text", "at"]) for i in range(0, len(texts), 4)]
    for most_bytes, most_rows in ((10, 100), (1, 100), (1000, 3), (40, 2)):
        found = list(text_blocks(iter(batches), "text", most_bytes, most_rows))
        assert [x for t in found for x in t.column("at").to_pylist()] == list(range(len(texts)))
        assert all(t.num_rows <= most_rows and (t.num_rows == 1 or sum(len(x or "") for x in t.column("text").to_pylist()) <= most_bytes) for t in found)
