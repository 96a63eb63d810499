"""The mix against one plain queue, also for repeated rows and other layouts."""

import re
from collections import Counter, defaultdict

import pytest

from winnowline.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, row int, h string, size int"


def rows():
    out = [(i, "w " * (i % 23), ["a", "b", None, "c"][i % 7 % 4], i, None, 1) for i in range(300)]
    out += [(5, "same text here", "b", -1, "x", None)] * 40  # equal rows
    out += [(6, f"one id, text {'and more ' * (k % 5)}", "b", k, None, None) for k in range(40)]  # equal id and source
    return out + [(None, None, "a", 0, None, 0), (None, "", None, 0, None, 0), (None, "x y", "a", 1, None, 0)]


@pytest.fixture(scope="module", params=["awkward", "empty", "one"])
def docs(request, spark):
    d = spark.createDataFrame(rows(), SCHEMA)
    return {"awkward": d, "empty": d.limit(0), "one": d.where("doc_id = 22")}[request.param]


def queue(docs, weights=(1, 2, 3), epochs=3):
    """[(key, source, text, epoch)] taken, from one sorted queue."""
    h, t = mixing.place_hashes(42, "doc_id", "source", "text")
    items = docs.select("doc_id", "source", "text", h, t).collect()
    low = lambda x: (x is None, x or 0 if not isinstance(x, str) else x)
    per = defaultdict(list)
    for key, source, text, a, b in items:
        per[source].append((a, low(key), b, len(WORD.findall(text or "")), key, text))
    names = sorted((s for s in per if s is not None)) + [None] * (None in per)
    size = {s: sum(x[3] for x in per[s]) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > epochs * size[s]}
        for s in over or free:
            target[s] = float(epochs * size[s]) if over else level * weight[s]
        left -= sum(target[s] for s in over)
        free -= over or free
    line = []
    for s in names:
        for epoch in range(epochs):
            through = epoch * size[s]
            for a, k, b, n, key, text in sorted(per[s], key=lambda x: x[:4]):
                through += n
                line.append((through / target[s] if target[s] else 0.0, low(s), a, k, b, n, epoch, (key, s, text)))
    out, used = Counter(), 0
    for *_, n, _, what in sorted(line, key=lambda x: x[:7]):
        used += n
        if used > sum(size.values()):
            break
        out[what] += 1
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_mix_is_the_head_of_one_queue(docs, parts):
    want = queue(docs)
    mixed = mixing.apply_mix(docs.repartition(parts))
    assert mixed.columns == docs.columns
    assert Counter((r["doc_id"], r["source"], r["text"]) for r in mixed.collect()) == want
    got = Counter()
    for r in mixing.mix_report(docs.repartition(parts)).collect():
        got[r["doc_id"], r["size"]] += r["taken"]
    words = Counter()
    for (key, _, text), n in want.items():
        words[key, len(WORD.findall(text or ""))] += n * len(WORD.findall(text or ""))
    assert +got == +words


def test_small_buckets_change_nothing(spark):
    d = spark.createDataFrame(rows(), SCHEMA)
    a, b = (Counter(map(str, mixing.mix_report(d, bucket_rows=n).collect())) for n in (1 << 20, 1))
    assert a == b


def test_sums_before(spark):
    rows = [(s, p, (p * 7 + len(s or "")) % 11) for s in ("a", "bb", None) for p in range(0, 900, 3)]
    d = spark.createDataFrame(rows, "s string, p long, v long")
    for by in (["s"], []):
        got = {(r["s"], r["p"]): r["before"] for r in mixing.sums_before(d.where("s = 'a'") if not by else d, by, "p", "v", 900).collect()}
        assert got == {(s, p): sum(v for t, q, v in rows if t == s and q < p) for s, p, _ in rows if by or s == "a"}
