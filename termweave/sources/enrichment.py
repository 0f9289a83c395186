"""Enrichment of concepts from search replies."""

from __future__ import annotations

import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SEARCH_REPLY
from .web import fetch


def fetch_replies(concepts: DataFrame, url: str, key: str, most: int = 100, timeout: float = 60) -> DataFrame:
    """(concept_id, json): one search by label per concept, ``most`` results each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = []
            for label in batch.column(1).to_pylist():
                query = urllib.parse.urlencode({"q": label or "", "pagesize": most, "apikey": key, "include": "cui,semanticType,synonym"})
                replies.append(fetch(f"{url.rstrip('/')}/search?{query}", timeout))
            yield pa.record_batch({"concept_id": batch.column(0), "json": pa.array(replies, pa.string())})

    return concepts.select(F.col("id").alias("concept_id"), "label").mapInArrow(run, "concept_id string, json string")


def merged(replies: DataFrame, most: int | None = None) -> DataFrame:
    """(concept_id, mappings, cuis, tuis, synonyms) from (concept_id, json).

    ``mappings`` are all results' ids in order. The others are sets, sorted; a
    result without ``cui`` adds to none of them, one without ``semanticType`` to
    ``cuis`` only. What nothing was found for is null.
    """
    items = replies.select("concept_id", F.from_json("json", SEARCH_REPLY)["collection"].alias("items"))
    if most is not None:
        items = items.withColumn("items", F.slice("items", 1, most))
    rows = items.select("concept_id", F.posexplode("items").alias("pos", "item")).select("concept_id", "pos", "item.*")
    grouped = rows.groupBy("concept_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "`@id`"))).alias("_ids"),
        F.collect_list("cui").alias("_cuis"),
        F.collect_list(F.when(F.col("cui").isNotNull(), F.col("semanticType"))).alias("_tuis"),
        F.collect_list(F.when(F.col("cui").isNotNull() & F.col("semanticType").isNotNull(), F.col("synonym"))).alias("_synonyms"),
    )

    def united(name: str):
        values = F.array_sort(F.array_distinct(F.flatten(name)))
        return F.when(F.size(values) > 0, values)

    ids = F.transform("_ids", lambda x: x["@id"])
    return grouped.select("concept_id", F.when(F.size(ids) > 0, ids).alias("mappings"), united("_cuis").alias("cuis"), united("_tuis").alias("tuis"), united("_synonyms").alias("synonyms"))


def enrich(concepts: DataFrame, replies: DataFrame, most: int | None = None) -> DataFrame:
    """Concepts with what was found; where nothing was, old values stay."""
    found = merged(replies, most).withColumnRenamed("concept_id", "id")
    names = ("mappings", "cuis", "tuis", "synonyms")
    renamed = found.select("id", *[F.col(n).alias(f"_{n}") for n in names])
    joined = concepts.join(renamed, "id", "left")
    kept = [F.coalesce(F.col(f"_{n}"), F.col(n)).alias(n) if n in concepts.columns else F.col(f"_{n}").alias(n) for n in names]
    return joined.select(*[c for c in concepts.columns if c not in names], *kept)
