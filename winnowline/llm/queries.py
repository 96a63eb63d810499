"""One query for each operator, over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnowline.llm import chat_format, collocations, decontamination, language_model, languages, lexical, minhash, mixing, ngram_join, quality_model, quality_rules, repeats, token_files
from winnowline.llm.common import held_out, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_format_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_preferences(*chat_format.contrasted_conversations(table(spark, sf_dir, "conversations")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), trains=lambda key: F.crc32(key.cast("string")) % 4 != 2)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op5_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), length=50)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = languages.detect_languages(docs, trains=F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 7, 2))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.token_index(spark, out)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(table(spark, sf_dir, "documents"), width=4, percent=80)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_format_preferences, op3_quality_classifier, op4_ngram_jaccard_join, op5_remove_repeats, op6_benchmark_decontamination, op7_language_id, op8_lm_scoring, op9_token_files, op10_quality_rules, op11_minhash_near_dedup, op12_ranked_search, op13_phrase_mining)}

#: SQL that returns the same rows; the other queries are held against brute force in tests/llm.
ORACLE: dict[str, str] = {"op2_format_preferences": chat_format.SQL, "op4_ngram_jaccard_join": f"SELECT doc_id, n_shingles, component_id FROM ({minhash.components_sql(85)})", "op10_quality_rules": quality_rules.SQL, "op11_minhash_near_dedup": minhash.SQL, "op12_ranked_search": lexical.SQL, "op13_phrase_mining": collocations.SQL}
