"""Embedding index of labels: vectors per token and pooled per concept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Builds a function from labels to each one's tokens and their vectors (tokens x dimensions).
MakeEmbedder = Callable[[], Callable[[list[str]], list[tuple[list[str], np.ndarray]]]]


def embed_labels(labels: DataFrame, make: MakeEmbedder, batch_size: int = 32) -> DataFrame:
    """(concept_id, label_index, tokens, vectors, pooled) of labels.

    ``make`` builds an embedder once per task, which is given ``batch_size``
    labels at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = make()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                found = embed(part.column(2).to_pylist())
                yield pa.record_batch(
                    {
                        "concept_id": part.column(0),
                        "label_index": part.column(1),
                        "tokens": pa.array([t for t, _ in found], pa.list_(pa.string())),
                        "vectors": pa.array([v.tolist() for _, v in found], pa.list_(pa.list_(pa.float32()))),
                        "pooled": pa.array([v.mean(0).tolist() if len(v) else [] for _, v in found], pa.list_(pa.float32())),
                    }
                )

    schema = "concept_id string, label_index int, tokens array<string>, vectors array<array<float>>, pooled array<float>"
    return labels.select("concept_id", F.col("label_index").cast("int"), "label").mapInArrow(run, schema)


def token_index(embedded: DataFrame) -> DataFrame:
    """(token, concept_id, vector): the vector of a token in a concept's first label."""
    pairs = embedded.select("concept_id", "label_index", F.posexplode(F.arrays_zip("tokens", "vectors")).alias("pos", "p"))
    first = pairs.groupBy(F.col("p.tokens").alias("token"), "concept_id").agg(F.min(F.struct("label_index", "pos", F.col("p.vectors").alias("v"))).alias("_f"))
    return first.select("token", "concept_id", F.col("_f.v").alias("vector"))


def concept_vectors(token_vectors: DataFrame) -> DataFrame:
    """(token, vectors map<concept_id, vector>) of a token index."""
    return token_vectors.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("concept_id", "vector"))).alias("vectors"))


def pooled(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, dim, value): the mean vector of each group, by dimension."""
    flat = vectors.select(group, F.posexplode(vector).alias("dim", "_v"))
    return flat.groupBy(group, "dim").agg(F.avg(F.col("_v").cast("double")).alias("value"))
