"""Each stage of the pipeline, and its whole run, against plain versions."""

import zlib
from collections import Counter

import plain
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_mixing import queue
from tokenizers import Tokenizer

import corpus_pipeline
from winnowline.llm import quality_rules
from winnowline.llm.common import cut

SMALL = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def awkward(spark):
    foot = "\n".join(" ".join(f"{k}{j}" for j in "abcdefghijk") for k in "mnopqr")
    body = lambda i: " ".join(f"u{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(90))
    rows = [(1000 + i, f"{body(i)}\n{foot}", "en", "h", 0) for i in range(30)]
    rows += [(1100 + i, f"only own {chr(97 + i % 26)}{chr(97 + i // 26)}\n{foot}", "en", "h", 0) for i in range(30)]
    rows += [(1200, None, None, None, None), (1201, "", "en", "h", 0), (None, body(60), "en", None, 5), (1202, body(61), None, "g", 1), (1202, body(61), None, "g", 1), (1202, body(62) + "\n\n end", "de", "g", 1)]
    rows += [(1203, "very long " + " ".join(str(k) for k in range(30_000)), "en", "g", 9), (1204, body(61) + " tail", "en", "g", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module", params=["small", "awkward", "empty"])
def docs(request, spark):
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    if request.param == "small":
        return small
    return awkward(spark) if request.param == "awkward" else small.limit(0)


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages(spark, docs):
    columns = docs.columns
    # Quality rules.
    before = rows(docs)
    kept, texts = plain.quality_rules([(r[0], r[3], r[1]) for r in before])
    found = cut(STAGES["quality_rules"](spark, docs, SMALL))
    want = [(r[0], t, r[2], r[3], r[4] if t == r[1] else len(t)) for r, k, t in zip(before, kept, texts) if k]
    assert found.columns == columns and Counter(rows(found)) == Counter(want)
    verdicts = quality_rules.quality_verdicts(docs).select("doc_id", "kept").collect()
    assert Counter(map(tuple, verdicts)) == Counter((r[0], k) for r, k in zip(before, kept))
    # Near copies.
    before = rows(found)
    named = plain.components([r[1] for r in before], 5, 80)
    least = {}
    for r, c in zip(before, named):
        least[c] = min(least.get(c, (True, 0)), (r[0] is None, r[0] or 0))
    want = {(r[0], r[1]) for r, c in zip(before, named) if (r[0] is None, r[0] or 0) == least[c]}
    found = cut(STAGES["ngram_jaccard_join"](spark, found, SMALL))
    after = rows(found)
    assert found.columns == columns and {r[:2] for r in after} == want and len(after) == len(want) and not Counter(after) - Counter(before)
    # Benchmark passages.
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before = after
    found = cut(STAGES["decontamination"](spark, found, SMALL))
    assert found.columns == columns and Counter(rows(found)) == Counter(r for r in before if not plain.contaminated(r[1], items))
    # The mix.
    want = queue(found)
    found = cut(STAGES["mixing"](spark, found, SMALL))
    assert found.columns == columns and Counter((r[0], r[3], r[1]) for r in rows(found)) == want
    # Token ids.
    t, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for key, text in sorted(((r[0], r[1]) for r in rows(found)), key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode())):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((key, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert Counter(map(tuple, STAGES["token_files"](spark, found, SMALL).collect())) == Counter(want)
    if docs.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count():
        assert Counter(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == Counter(want)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_columns_with_names_of_an_operators_own(spark, name):
    """Further columns pass through unchanged, whatever they are called."""
    docs = awkward(spark)
    clashing = ["__h", "__t", "__rows", "__gone", "__id", "__row", "__depleted", "__finish", "__n", "key", "row", "line", "epoch", "target", "doc", "class", "text_", "budget"]
    wide = docs.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in clashing])
    got, want = (STAGES[name](spark, d, SMALL) for d in (wide, docs))
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect()))
    if name != "token_files":
        assert got.columns == wide.columns
        assert all(r[c] == c + str(r["doc_id"] if r["doc_id"] is not None else "-") for r in got.collect() for c in clashing)
