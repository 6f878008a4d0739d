"""Corpus preparation in stages: each takes what the one before kept, as a written table.

Language ID drops documents without a letter and those that the classifier takes to be of none of the
languages it learned (a score under `language.LEAST`); near-dedup keeps one document of each class;
suffix-array dedup cuts passages that occur earlier; decontamination drops documents that hold a
benchmark window; mixing allocates copies to sources by weight. Null texts and ids, ties, repeated
rows and extra columns pass through as each operator's docstring defines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import decontaminate, language, mixing, near, suffixes
from tidewater.llm.queries import MIX
from tidewater.llm.storage import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_representatives(docs, words=5, least=0.8)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.keep_first_occurrences(docs, width=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, **MIX)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: SQL can express neither the language model nor the near-duplicate classes: see tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
