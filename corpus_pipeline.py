"""A corpus in five stages: from raw documents to tokens.

Each stage reads what its predecessor kept, as written to Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termweave.llm import bpe, line_dedup, mixing, near_dedup, quality_classifier
from termweave.llm.common import fresh_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking model rejects go."""
    return quality_classifier.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; the first occurrence stays."""
    return line_dedup.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return near_dedup.dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights."""
    return mixing.mixed_documents(docs, weights=mixing.WEIGHTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole texts become byte-level BPE ids, checked by decoding."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("source mixing", mixture),
    ("byte-level BPE", tokens),
]

#: The ranking model and the signatures can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
