"""From raw documents to token counts: five stages, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from narrowmat.llm import bpe, exact_dedup, language, mixing, near_dedup
from narrowmat.llm.common import written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents whose language is not recognised go."""
    return language.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: one document of each group of equal texts stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: one document of each group of near-duplicates, similar by 0.8 or
    more, stays."""
    return near_dedup.keep_one(docs, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: every document of the mix as token ids, and decoded again."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("identify", identify), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

# Languages, signatures, duals and merges are beyond SQL; test_pipeline compares by brute force.

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
