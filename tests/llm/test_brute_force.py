"""Each operator against a plain computation, on awkward rows and on the smallest table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from winnowline.llm import chat_format, decontamination, language_model, languages, mixing, ngram_join, quality_model, quality_rules, repeats, token_files
from winnowline.llm.common import held_out

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, g int"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows():
    base = " ".join(f"w{i} the of" for i in range(60))
    near = base.replace("w7 the", "w7 of").replace("w30", "v30")
    odd = ["", None, " \t\n ", "one", "Two words", base, base, base.upper(), near, near + " tail", "é ß  x " * 30, "a" * 400, "ab " * 300, "x\x00y " * 40, "line one\nline one\nline two\n" * 9]
    odd += [base[:200] + f" {i} " + base[200:600] for i in range(12)] + ["z " * 20000, "<|endoftext|> hi <|endoftext|>", "tail space ", "double  space\n\n x", "'s don't we'll\t\ttab"]
    odd += [f"common passage that many documents share word for word in the middle {i} " * 2 for i in range(8)]
    out = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], 0, "k", 1, 2) for i, t in enumerate(odd)]
    return out + [out[5], (3, "other text under a known id", "en", "a", 0, None, None, None), (None, base, "en", "a", 0, None, None, None), (None, "lonely null id", None, None, 0, None, None, None)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="module", params=["awkward", "small", "empty"])
def docs(request, awkward, small):
    return {"awkward": awkward, "small": small, "empty": awkward.limit(0)}[request.param]


def collected(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def bag(items):
    return Counter(map(tuple, items))


def test_jaccard_components(docs):
    items = collected(docs)
    sets = []
    for _, t in items:
        w = words(lower(t))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    parent = list(range(len(items)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(items)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 85 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(items):
        least[find(i)].append(d)
    want = bag((d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(items))
    got = ngram_join.jaccard_components(docs, batch_bytes=20_000).select("doc_id", "n_shingles", "component_id")
    assert bag(got.collect()) == want


def test_near_copies_keep_one(docs):
    kept = ngram_join.drop_near_copies(docs, batch_bytes=20_000)
    assert kept.columns == docs.columns
    found = ngram_join.jaccard_components(docs, width=5, percent=80)
    rows_ = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(set(rows_)) == len(rows_) and {d for d, _ in rows_} == {r["component_id"] for r in found.collect()}


def test_repeats(docs):
    items = [(d if d is not None else 1 << 62, d, (t or "").encode()) for d, t in collected(docs)]
    least = {}
    for o, _, b in items:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            least[w] = min(least.get(w, o), o)
    want = []
    for o, d, b in items:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < o:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        want.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    for size, hot in ((5_000, 4096), (10 << 20, 4096), (5_000, 0), (20_000, 3)):
        assert bag(repeats.remove_repeats(docs, batch_bytes=size, hot=hot).collect()) == bag(want)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(docs, order):
    test = held_out(F.col("doc_id"), 7, 2)
    items = [(d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, [*words(lower(t)), None]) for d, t in collected(docs)]
    count, gram, context = Counter(), Counter(), Counter()

    def grams(w, n):
        padded = ["<s>"] * (n - 1) + w
        return [tuple(padded[i : i + n]) for i in range(len(w))]

    for _, h, w in items:
        if not h:
            count.update(w)
            for n in range(2, order + 1):
                gram.update(grams(w, n))
                context.update(g[:-1] for g in grams(w, n))
    total, v = sum(count.values()), len(count)
    want = {}
    for d, h, w in items:
        base = [(count[x] + 1) / (total + v + 1) for x in w]
        full = base
        for n in range(2, order + 1):
            full = [(gram[g] + 50 * p) / (context[g[:-1]] + 50) for g, p in zip(grams(w, n), full)]
        want.setdefault((d, h, len(w), sum(count[x] > 0 for x in w), total), []).append((sum(map(math.log10, base)), sum(map(math.log10, full)), len(w)))
    got = defaultdict(list)
    for r in language_model.score_documents(docs, test, batch_bytes=20_000, order=order).collect():
        got[tuple(r[:5])].append((r["base_score"], r["score"]))
    assert got.keys() == want.keys()
    for k, pairs in got.items():
        for (base, score), (b, s, size) in zip(sorted(pairs), sorted(want[k])):
            assert base == pytest.approx(b, rel=1e-9)
            assert abs(score - s) <= 0.02 * (order - 1) * size  # one byte for nine decades, at each level


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    out = token_files.write_tokens(docs, path, f"file://{tmp_path}/ids")
    start, want = 0, []
    for d, text in sorted(collected(docs), key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode())):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert bag(token_files.token_index(spark, out).collect()) == bag(want)
    if want:
        import pyarrow.parquet as pq

        part = next(p for p in sorted((tmp_path / "ids").glob("*.parquet")) if pq.ParquetFile(p).metadata.num_rows)
        columns = [pq.ParquetFile(part).metadata.row_group(0).column(i) for i in range(3)]
        assert all("DELTA_BINARY_PACKED" in c.encodings for c in columns) and columns[0].has_offset_index and columns[0].has_column_index


def test_quality_rules(docs):
    def measure(t):
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        tri = Counter(zip(w, w[1:], w[2:]))
        spots = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(spots), len(w) < 50 or 100 * len(spots) > 50 * len(w)

    got = quality_rules.quality_verdicts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert bag(got.collect()) == bag((d, *measure(t)) for d, t in collected(docs))


def test_depleted_documents(spark):
    spell = lambda x: x.translate(str.maketrans("0123456789", "qrstuvwxyz"))  # noqa: E731  line rules take digits as equal
    foot = "\n".join(" ".join(f"{k}{j}" for j in range(11)) for k in "abcdef")
    unique = lambda i: " ".join(f"u{i}x{j}" for j in range(80))
    data = [(i, f"{unique(i)}\n{foot}", "h") for i in range(90)]  # keeps most of what it has
    data += [(100 + i, f"only v{i} w{i} is own\n{foot}", "h") for i in range(30)]  # loses nearly all
    copied = "\n".join(" ".join(f"c{k}x{j}" for j in range(12)) for k in range(10))
    data += [(200 + i, copied, "h") for i in range(60)] + [(300 + i, copied.replace("c3x4", f"edit{i}"), "h") for i in range(60)]
    data += [(400, f"only own\n{foot}", "another host")]
    d = spark.createDataFrame([(i, spell(t), h) for i, t, h in data], "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in quality_rules.quality_verdicts(d).where("kept").collect()}
    assert kept == {r[0] for r in data if not 100 <= r[0] < 200}
    assert {r["doc_id"] for r in quality_rules.apply_rules(d).collect()} == kept


@pytest.mark.parametrize("long_docs, depleted", [(40, 30), (90, 300), (0, 3000)])
def test_depleted_documents_do_not_hide_each_other(spark, long_docs, depleted):
    spell = lambda x: x.translate(str.maketrans("0123456789", "qrstuvwxyz"))
    foot = "\n".join(" ".join(f"{k}{j}" for j in range(11)) for k in "abcdef") + "\na notice " + "of many words " * 20
    data = [(i, " ".join(f"u{i}x{j}" for j in range(400)) + f"\n{foot}", "h") for i in range(long_docs)]
    data += [(10_000 + i, f"only v{i} is own\n{foot}", "h") for i in range(depleted)]
    copied = "\n".join(" ".join(f"c{k}x{j}" for j in range(12)) for k in range(10))
    data += [(20_000 + i, copied.replace(f"c{i % 10}x{i % 7}", f"edit{i}"), "h") for i in range(60)]  # near copies, edited all over
    d = spark.createDataFrame([(i, spell(t), h) for i, t, h in data], "doc_id long, text string, source string")
    gone = {r[0] for r in quality_rules.depleted_documents(d).collect()}
    assert gone == {r[0] for r in data if 10_000 <= r[0] < 20_000}


def test_frequent_lines_are_removed(spark, docs):
    """Lines and texts from the definition, with low limits."""

    def normal(x):
        return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", x.lower())).strip(" ")

    def loose(x):
        w = x.split(" ")
        q = (len(w) + 1) // 4
        return {(k, *w[: q * k], *w[len(w) - q * (3 - k) :]) for k in range(4)} if len(w) >= 12 else set()

    foot = "Follow 12 of us\n\n  the  notice of this host says in more than twelve words that all is reserved here "
    more = [(1000 + i, f"{foot}\nown line v{chr(97 + i)}\n" + " ".join(f"p{chr(97 + i)}x{j}" for j in range(90)) + f"\n Follow {i + 10} of us", "en", "h", 5, "k", 1, 2) for i in range(9)]
    d = docs.unionByName(spark.createDataFrame(more, SCHEMA).select(*docs.columns)) if docs.columns == [x.split()[0] for x in SCHEMA.split(", ")] else docs
    items = [(r["doc_id"], r["source"], r["text"]) for r in d.collect()]
    per = [{x for x in map(normal, (t or "").split("\n")) if x} for _, _, t in items]
    frequent = {}
    for host in {h for _, h, _ in items}:
        count = Counter(x for (_, h, _), s in zip(items, per) if h == host for x in s)
        texts = {frozenset(s) for (_, h, _), s in zip(items, per) if h == host and s}
        often = {x for x, n in count.items() if n > 3 and sum(x in s for s in texts) > 2}
        texts = [s for s in texts if s & often]
        varied = Counter(y for s in texts for y in set().union(*map(loose, s - often)))
        varied = {y for y, n in varied.items() if n > 2} | set().union(*map(loose, often))
        rest = {s: frozenset(x for x in s if not loose(x) or (x not in often and not loose(x) & varied)) for s in texts}
        frequent[host] = {x for x in often if len({rest[s] for s in texts if x in s}) > 2}
    want = bag((i, h, "\n".join(x for x in t.split("\n") if normal(x) not in frequent[h]) if t is not None else None) for i, h, t in items)
    found = quality_rules.lines_to_remove(d, max_docs=3, min_distinct=2)
    got = quality_rules.remove_lines(d, found)
    assert got.columns == d.columns
    assert bag((r["doc_id"], r["source"], r["text"]) for r in got.collect()) == want
    if d is not docs:
        assert frequent["h"] >= {"follow 00 of us", normal(foot.split("\n")[2])}
        kept = [r for r in quality_rules.apply_rules(d, max_docs=3, min_distinct=2).collect() if r["source"] == "h"]
        assert len(kept) == 9 and all(r["n_chars"] == len(r["text"]) and "ollow" not in r["text"] and r["text"].startswith("\nown line") for r in kept)


def test_mixing(docs):
    got = [r.asDict() for r in mixing.mix_report(docs).collect()]
    items = [(r["doc_id"], r["source"], len(words(r["text"]))) for r in docs.collect()]
    assert bag((r["doc_id"], r["size"]) for r in got) == bag((d, n) for d, _, n in items)
    size = Counter()
    for _, s, n in items:
        size[s] += n
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        for s in over or free:
            target[s] = 3.0 * size[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        free -= over or free
    by_size = defaultdict(float)
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        by_size[r["source_size"], round(r["target"], 6)] += r["taken"]
    for (n, t), taken in by_size.items():
        assert any(size[s] == n and target[s] == pytest.approx(t, abs=1e-5) for s in names)
        largest = max(x for _, s, x in items if size[s] == n)
        assert abs(taken - t) <= 2 * largest + 1
    again = [r.asDict() for r in mixing.mix_report(docs.repartition(5)).collect()]
    assert Counter(map(str, again)) == Counter(map(str, got))


def test_mix_rows(small):
    report = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.mix_report(small).collect()}
    mixed = mixing.apply_mix(small)
    assert mixed.columns == small.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in report.items() if v})


def test_preferences(spark):
    c = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 0, "user", "same"), (2, 1, "assistant", None), (3, 0, None, None), (None, 0, "user", "x")]
    r = [(1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, "user", "more"), (2, 0, "user", "same"), (2, 1, "assistant", None), (4, 0, "user", "alone")]
    schema = "pair_id long, turn long, role string, text string"
    a, b = spark.createDataFrame(c, schema), spark.createDataFrame(r, schema)
    got = {x["pair_id"]: x for x in chat_format.format_preferences(a.withColumn("pos", F.lit(9)).withColumn("prefix", F.lit(1)), b).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1]["prompt"] == "<|user|>\nq\n<|end|>\n" and got[1]["chosen"] == "<|assistant|>\ngood\n<|end|>\n"
    assert (got[1]["n_prompt_turns"], got[1]["chosen_mask"], got[1]["rejected_mask"]) == (1, "1", "10")
    assert (got[2]["n_prompt_turns"], got[2]["chosen"], got[2]["rejected"]) == (2, "", "")
    assert (got[3]["n_prompt_turns"], got[3]["chosen"]) == (0, "<||>\n\n<|end|>\n") and got[4]["chosen"] == ""
    assert chat_format.format_preferences(a.limit(0), b.limit(0)).count() == 0


def tiling(doc, item, m):
    """Greedy string tiling from its definition."""
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    m = min(m, len(item))
    while m:
        best, found = m, []
        for p in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while p + n < len(item) and d + n < len(doc) and doc[d + n] == item[p + n] and free_d[d + n] and free_i[p + n]:
                    n += 1
                if n > best:
                    best, found = n, [(p, d)]
                elif n == best:
                    found.append((p, d))
        if not found:
            return covered
        for p, d in found:
            if all(free_d[d : d + best]) and all(free_i[p : p + best]):
                free_d[d : d + best], free_i[p : p + best] = [False] * best, [False] * best
                covered += best
    return 0


def test_decontamination(spark):
    item = [f"t{i}" for i in range(40)]
    texts = {1: item, 2: ["x"] * 9 + item[20:] + ["y"] * 5 + item[:20], 3: item[:12], 4: ["T1,", "t2"], 5: item[:11] + ["z"] + item[12:] + item, 6: ["n"] * 30, 7: item[5:30], 8: ["go", "home"] * 4}
    d = [(k, " ".join(v), "keep") for k, v in texts.items()] + [(9, None, "n"), (10, "", "n")]
    docs = spark.createDataFrame(d, "doc_id long, text string, item string")
    items = {1: item, 2: ["go", "home"], 3: ["go", "home", "go", "home", "go", "home", "now"]}
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(8, None), (9, "")], "item_id long, text string")
    plain = lambda t: re.findall(r"\w+", (t or "").lower())
    want = {}
    for k, t, _ in d:
        for i, words_ in items.items():
            share = tiling(plain(t), words_, 5) / len(words_)
            if share >= 0.5:
                want[k, i] = share
    for chunk in (8 << 20, 60):
        got = {(r[0], r[1]): r[2] for r in decontamination.contaminated(docs, bench, chunk_bytes=chunk).collect()}
        assert got == pytest.approx(want)
        left = decontamination.decontaminate(docs, bench, chunk_bytes=chunk)
        assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(texts) - {k for k, _ in want} | {9, 10}
    twice = docs.where("doc_id IN (1, 6)").unionByName(docs.where("doc_id IN (1, 9)").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.where("doc_id = 2").withColumn("doc_id", F.lit(1).cast("long")))
    for chunk in (8 << 20, 60):
        got = Counter(r[0] for r in decontamination.contaminated(twice, bench.where("item_id = 1"), chunk_bytes=chunk).collect())
        assert got == {1: 2, None: 1}
        assert Counter(r[0] for r in decontamination.decontaminate(twice, bench, chunk_bytes=chunk).collect()) == {6: 1, None: 1}
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0 and decontamination.contaminated(docs.limit(0), bench).count() == 0


def test_tiling_on_random_tokens():
    r = random.Random(3)
    for k in range(400):
        alphabet = "ab" if k % 2 else "abc"
        doc, item = [r.choice(alphabet) for _ in range(r.randrange(40))], [r.choice(alphabet) for _ in range(r.randrange(1, 24))]
        index = decontamination.ItemIndex([0], [" ".join(item)], 3)
        found = index.matches(pa.array([" ".join(doc)]), 0.3)
        share = tiling(doc, item, 3) / len(item)
        assert [f[2] for f in found] == ([share] if share >= 0.3 else [])
        tokens = [decontamination.token_hashes(pa.array([" ".join(x)]))[0] for x in (doc, item)]
        width = min(3, len(item))
        runs = decontamination.runs_from_diagonals(*tokens, width) if doc else [np.zeros(0, int)] * 3
        assert decontamination.greedy_tiles(*runs, width, len(item))[0] == tiling(doc, item, 3)


def test_tiling_of_equal_tokens_is_bounded():
    import tracemalloc

    index = decontamination.ItemIndex([0, 1], ["the " * 5000, "the end"], 5)
    tracemalloc.start()
    found = index.matches(pa.array(["the " * 20_000, None, "x"]), 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 0, 1.0, 1)] and peak < 200 << 20


def test_quality_classifier(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality_model.classify(d, labels, trains=lambda key: ~held_out(key, 4, 2))
    assert scored.count() == d.count()
    rows_ = scored.join(labels, "doc_id").where(held_out(F.col("doc_id"), 4, 2)).collect()
    right = sum((r["score"] >= 0.7) == (r["quality"] == 1) for r in rows_)
    assert right >= 0.93 * len(rows_)


def test_quality_classifier_edges(awkward, spark):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (77, 0), (5, 3)], "doc_id long, quality int")
    for d in (awkward, awkward.limit(0)):
        out = quality_model.classify(d, labels).collect()
        assert len(out) == d.count() and all(0 <= r["score"] <= 1 for r in out)


def test_languages(spark, awkward):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    test = held_out(F.col("doc_id"), 4, 2)
    rows_ = languages.detect_languages(d, trains=~test).join(d.select("doc_id", "lang"), "doc_id").where(test).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows_) >= 0.98 * len(rows_)
    mixed = d.where("lang IN ('en', 'de') AND length(text) > 1500").groupBy("lang").agg(F.min(F.substring("text", 1, 1200)).alias("text"))
    both = " ".join(r["text"] for r in mixed.collect())
    found = languages.identify(spark.createDataFrame([(1, both), (2, None), (3, "123 -- !"), (4, "")], "doc_id long, text string"), languages.train(d)).collect()
    assert {k for k, v in found[0]["langs"].items() if v > 0.2} == {"en", "de"}
    assert [r["lang_pred"] for r in found[1:]] == ["und"] * 3
    for x in (awkward, awkward.limit(0)):
        assert languages.detect_languages(x).count() == x.count()


def test_queries_follow_their_sql(spark):
    import duckdb

    from winnowline.llm.queries import ORACLE, QUERIES

    for name, sql in ORACLE.items():
        duck = duckdb.connect()
        for t in ("documents", "conversations"):
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        got, cursor = QUERIES[name](spark, SMALL), duck.execute(sql)
        assert [x[0] for x in cursor.description] == got.columns
        assert bag(got.collect()) == bag(cursor.fetchall()), name
