"""A corpus pipeline: four operators one after the other over whole documents.

Each stage gets what its predecessor kept, reread from Parquet, and returns the
columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from entigraph.llm import language_id, packing, simhash_dedup, toxicity
from entigraph.llm.common import load
from entigraph.plans.workspace import saved


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, load(spark, sf_dir, "labels"))


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.deduplicated(docs, shingle=5, similarity=0.8)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("language_id", with_language),
    ("simhash_near_dedup", without_near_copies),
    ("best_fit_packing", into_sequences),
]

#: Classifiers and hashed near-duplicates can't be said in SQL; a brute-force version stands in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; every result but the last is written and reread."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
