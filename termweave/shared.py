"""The folder that all executors can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    known = getattr(context, "_termweave_plans", None)
    if known is None:
        known = context._termweave_plans = tempfile.mkdtemp(prefix="termweave-")
    return known


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/termweave-plans/{name}-{uuid.uuid4().hex}"


def materialise(table: DataFrame, name: str) -> DataFrame:
    """Write ``table`` to the shared folder and read it back: lineage ends there."""
    path = new_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """``table`` over all cores where its files have fewer splits than those.

    A small file with one row group would be one task's work. Input with more
    splits than cores is left as it is, without a shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
