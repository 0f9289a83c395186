"""Text files and saved indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one row per file, the id is its path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def save_once(table: DataFrame, path: str) -> DataFrame:
    """Write a table unless it is there already, and read it."""
    table.write.mode("ignore").parquet(path)
    return table.sparkSession.read.parquet(path)
