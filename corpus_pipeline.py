"""A corpus pipeline of five stages; each works on all that the one before it kept.

Deleted with the ``llm`` folders; only ``__spark_entry__.py`` copes with its absence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm.common import settle, table
from kinweave.llm.decontaminate import decontaminate
from kinweave.llm.exact_dedup import exact_dedup
from kinweave.llm.jaccard_join import keep_one
from kinweave.llm.pieces import encode
from kinweave.llm.quality import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest doc_id stays."""
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its sampled segmentations into pieces."""
    return encode(docs)


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("benchmark", benchmark), ("tokens", tokens)]

#: SQL cannot fit the classifier or draw samples; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
