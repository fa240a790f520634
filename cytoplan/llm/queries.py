"""The twelve operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontam, licenses, packing, quality, rans, secrets, simhash, suffix, tokens, toxicity, urls
from .common import read_table, work_dir


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(read_table(spark, sf_dir, "conversations"))


def op2_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op4_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "rans-files")
    rans.write_tokens(read_table(spark, sf_dir, "documents"), path, tokens.default_tokenizer(), end_id=2)
    return rans.read_tokens(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokens.default_tokenizer(), end_id=1, capacity=4096)


def op7_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.dedup(read_table(spark, sf_dir, "documents"), least=100))


def op9_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op10_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op11_url_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op12_segment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(read_table(spark, sf_dir, "documents")).drop("groups")


#: Every query, in the order of the operators' numbers.
QUERIES = (
    op1_chat_perspectives,
    op2_simhash_gray_index,
    op3_license_dice,
    op4_simhash_decontamination,
    op5_rans_token_files,
    op6_best_fit_packing,
    op7_ngram_quality,
    op8_suffix_repeats,
    op9_crf_secrets,
    op10_ordinal_toxicity,
    op11_url_patterns,
    op12_segment_alignment,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_perspectives": chat.PERSPECTIVES_SQL, "op3_license_dice": licenses.scan_sql(), "op11_url_patterns": urls.judge_sql()}
