"""Pieces against whole texts, and selective reads."""

import random

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from winnowline.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "the", "Z", "9", "42", " ", "  ", "\n", "\n\n", "\t", " ", " ", " ", "　", "é", "ß", "×", "÷", "—", "'s", "'re", "don't", "!", "***", "<|endoftext|>", "<|", "\r", "\x1c", "\x85", "中文", "😀", " x", " \n", "ö***", "\n ", ".\n"]


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_PIECES", 500)  # many pieces are given up and met again
    plain, own, r = Tokenizer.from_file(PATH), token_files.Encoder(PATH), random.Random(1)
    assert own.by_piece
    for _ in range(150):
        texts = [None, "", *("".join(r.choice(PARTS) for _ in range(r.randrange(60))) for _ in range(r.randrange(1, 30)))]
        ids, counts = own.encode(pa.array(texts), 2)
        want = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), token_files.Encoder(path)
    texts = ["Two  words\n and more", "", "x"]
    ids, counts = own.encode(pa.array(texts), None)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert not own.by_piece and counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


@pytest.mark.parametrize("key", ["long", "string"])
def test_selective_reads(spark, tmp_path, key):
    docs = spark.range(4000).selectExpr(f"cast(lpad(cast(id as string), 6, '1') as {key}) AS doc_id", "concat('text of document ', id, repeat(' more words', 40)) AS text", "1 AS tokens")
    out = token_files.write_tokens(docs, PATH, f"file://{tmp_path}/ids", row_group_bytes=64 << 10, page_bytes=4 << 10)
    some = docs.orderBy("doc_id").offset(1000).limit(20).select("doc_id").collect()
    low, high = some[0][0], some[-1][0]
    got = token_files.read_ids(spark, out, low, high)
    assert [r["doc_id"] for r in got.orderBy("doc_id").collect()] == [r[0] for r in some]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThanOrEqual(key" in plan
    # Few of the row groups can hold these ids, and their pages are indexed.
    groups = [(f.metadata.row_group(k).column(0).statistics, f.metadata.row_group(k).column(2)) for p in (tmp_path / "ids").glob("*.parquet") for f in [pq.ParquetFile(p)] for k in range(f.metadata.num_row_groups)]
    assert sum(s.min <= high and s.max >= low for s, _ in groups) <= 2 < len(groups)
    assert all(c.has_offset_index and c.has_column_index for _, c in groups)
    lengths = token_files.read_metadata(spark, out)
    assert "tokens:array" not in lengths._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert lengths.count() == 4000
