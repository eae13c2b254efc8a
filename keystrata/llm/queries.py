"""The queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keystrata.llm import base, chosen_path, html_diff, langid, mixture, pair_index_bpe, quality, shards, spotsigs, token_counts, url_filter


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.main_text(base.read(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(base.read(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(base.read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(base.read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(base.read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(base.read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(base.read(spark, sf_dir, "documents"), base.read(spark, sf_dir, "labels"))


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_index_bpe.encode_documents(base.read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(base.read(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(base.read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_sharding, op3_ngram_jaccard_join, op4_token_counts, op5_source_mix, op6_language_id,
        op7_quality_rules, op8_bpe_roundtrip, op9_fingerprints, op10_url_filter,
    )
}

#: None of the ten is wholly expressible in SQL; tests/llm holds them, and the pipeline, against brute force, round trips or held-out rows.
ORACLES: dict[str, str] = {}
