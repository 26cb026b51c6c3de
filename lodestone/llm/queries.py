"""The registered queries of this subpackage and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import chat, langid, linededup, mixing, pieces, prefixtrie, resample, rules, simhash, spotsigs, tokencount, tokenfile, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), words=3, seed=42, budget=3)


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edit_probe(documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.examples(chat.with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), nbest=3)
    return coded.select("doc_id", "n_pieces", "scores", "ids_crc32", "round_trip", "nbest_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(documents(spark, sf_dir), power=0.5, epochs=1.0, seed=42)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(linededup.drop_shared_lines(documents(spark, sf_dir), least_docs=10, least_chars=1))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.family_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_sample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), buckets=10_000, longest=2, least_words=20, percent=25, seed=7)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_spotsigs": op2_spotsigs,
    "op3_language": op3_language,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_chat": op6_chat,
    "op7_toxicity": op7_toxicity,
    "op8_pieces": op8_pieces,
    "op9_token_files": op9_token_files,
    "op10_mixing": op10_mixing,
    "op11_line_dedup": op11_line_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_resampling": op13_resampling,
}

SQL: dict[str, str] = {"op6_chat": chat.SQL, "op10_mixing": mixing.SQL, "op11_line_dedup": linededup.SQL, "op12_prefix_trie": prefixtrie.SQL, "op13_resampling": resample.SQL}
