"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, source mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` applies them to ``documents``, writing each stage's rows to the shared folder.

Edge cases, the same in all stages: an empty table stays empty (and makes empty token files); nulls in lang,
source and n_chars pass through, a null source is a source of its own; rows are kept and dropped as rows, those
that repeat a doc_id each by itself unless a stage says otherwise below; texts are taken whole, however long;
further columns are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from winnowline.llm import decontamination, mixing, ngram_join, quality_rules, token_files
from winnowline.llm.common import cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail the rules, and without their hosts' frequent lines; null and empty texts fail.

    Rows of one doc_id are judged together for depletion. n_chars is counted anew where a text loses lines.
    """
    return quality_rules.apply_rules(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id (null last); of rows with equal id and text one.

    Texts without words are like nothing and stay.
    """
    return ngram_join.drop_near_copies(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that cover half of a benchmark item or more; null and empty texts and items match nothing."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document once for each time that it is taken, up to three times, or not at all."""
    # The next stage sorts by doc_id, so the mix isn't put in order of its finish times here.
    return mixing.apply_mix(docs, ordered=False)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the token files: doc_id, start, n_tokens, ids_crc32 in ascending doc_id, null first; copies each."""
    import public_tokenizers

    out = token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.token_index(spark, out)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_copies_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near-duplicate components, tilings and token ids have no SQL; tests/llm/test_pipeline.py holds each stage and the run against plain versions.
ORACLE_SQL = None
