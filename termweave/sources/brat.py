"""Sink for normalisation databases: a line per short id with all its names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_id


def lines(rows: DataFrame, remove_uris: bool = True) -> DataFrame:
    """(key, line) from (ord, concept_id, label); names stand in order.

    With ``remove_uris`` the key is the URI's short id; ids that have none are
    left out.
    """
    key = short_id(F.col("concept_id")) if remove_uris else F.col("concept_id")
    grouped = rows.select(key.alias("key"), "ord", "label").where("key is not null").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("_all"))
    names = F.transform("_all", lambda x: F.concat(F.lit("name:Name:"), x["label"]))
    return grouped.select("key", F.concat_ws("\t", "key", F.array_join(names, "\t")).alias("line"))


def write(rows: DataFrame, path: str, remove_uris: bool = True, mode: str = "overwrite") -> None:
    lines(rows, remove_uris).orderBy("key").select("line").coalesce(1).write.mode(mode).text(path)
