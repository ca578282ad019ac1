"""From raw documents to a training mixture in five stages, each written and read again.

Rows with a null text or doc_id are rows as any other: a null text is an empty one, which has no fingerprint bits, no hits
and no personal data, and of which the mixture takes no words. Rows that repeat a doc_id are one document after the second stage.
Columns of any name are kept. Without rows every stage, and the mixture, is empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import decontaminate, mixing, pii, quality, simhash
from tesserae.llm.common import table
from tesserae.sources.objects import scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps: as many as are expected to be good, and one in a hundred beyond them."""
    return quality.select(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id."""
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return pii.mask(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: pieces of documents with their shard and position."""
    return mixing.mixture(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]
#: Trained models, hashes and random draws: SQL cannot state the stages; tests/llm compares the operators that they call with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is Parquet in the shared folder."""
    folder = f"{scratch(spark, 'pipeline-')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
