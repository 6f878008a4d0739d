"""The queries of this subpackage: each takes (spark, sf_dir) and reads its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.llm import decontaminate, divergence, language, media, mixing, near, packing, pages, suffixes, tokens, toxicity, urls


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The installed vocabulary's file, or one in the folder TIDEWATER_TOKENIZERS names."""
    if folder := os.environ.get("TIDEWATER_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: The contract's path rules (fixed values): verdict, then host and path.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MIX = {"weights": (5, 2, 1), "share": 1.5, "max_copies": 2}


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.near_duplicates(_read(spark, sf_dir, "documents"), words=5, least=0.8)
    return found.select("doc_id", "class_id", "representative")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), **MIX)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"), 4, 2)
    model = language.fit(docs.where(~out & F.col("doc_id").isNotNull()))
    return language.identify(docs, model).select(F.col("key").alias("doc_id"), language.held_out(F.col("key"), 4, 2).alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model, weights = toxicity.fit(docs, _read(spark, sf_dir, "labels").where(~language.held_out(F.col("doc_id"), 3, 1)))
    scored = toxicity.score(docs, model, weights, threshold=0.7)
    return scored.select("doc_id", language.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_main_text(_read(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_read(spark, sf_dir, "documents"), tokenizer_path(), limit=512)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.remove_repeats(_read(spark, sf_dir, "documents"), width=100))


def op9_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.to_media(_read(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), width=10)
    return decontaminate.digest(found)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(_read(spark, sf_dir, "documents"), least_docs=3, most=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_mixing": op3_mixing,
    "op4_language": op4_language,
    "op5_main_text": op5_main_text,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_transport_streams": op9_transport_streams,
    "op10_decontamination": op10_decontamination,
    "op11_packing": op11_packing,
    "op12_source_divergence": op12_source_divergence,
}

ORACLES: dict[str, str] = {
    "op3_mixing": mixing.oracle_sql(**MIX),
    "op10_decontamination": decontaminate.oracle_sql(10),
    "op12_source_divergence": divergence.oracle_sql(3, 200),
}
