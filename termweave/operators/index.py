"""The inverted index of a dictionary: postings of normalised label roots."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import roots
from ..functions.text import is_stop, normalize_label
from ..functions.tokenizers import PATTERN, Tokenizer
from ..shared import materialise

#: Bytes up to which a dictionary table is broadcast to joins; beyond, they shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes of postings up to which every task holds them unpacked (some six times as much).
SCAN_BYTES = 24 << 20


def label_tokens(labels: DataFrame, tokenizer: Tokenizer = PATTERN) -> DataFrame:
    """Tokens of normalised labels: (concept_id, label_index, pos, start, end, token)."""
    normal = labels.select("concept_id", "label_index", normalize_label(F.col("label")).alias("text"))
    return tokenizer.explode(normal, ["concept_id", "label_index"])


def label_lengths(labels: DataFrame, stop: Sequence[str]) -> DataFrame:
    """(concept_id, label_index, n_tokens): tokens that aren't stop words; may be 0."""
    counted = label_tokens(labels).groupBy("concept_id", "label_index").agg(F.sum(F.when(is_stop(F.col("token"), stop), 0).otherwise(1)).cast("int").alias("n_tokens"))
    return labels.select("concept_id", "label_index").join(counted, ["concept_id", "label_index"], "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))


def postings(labels: DataFrame, stop: Sequence[str], root: roots.Root) -> DataFrame:
    """(root, concept_id, label_index, cnt): how often a label has a root."""
    content = label_tokens(labels).where(~is_stop(F.col("token"), stop))
    return content.select("concept_id", "label_index", root(F.col("token")).alias("root")).groupBy("root", "concept_id", "label_index").agg(F.count("*").cast("int").alias("cnt"))


@dataclass
class Index:
    """What matching needs of a dictionary.

    ``by_root`` has (root, keys): keys is an array of (concept_id, label_index,
    cnt, n_tokens), so a text's token meets a root once. ``longest`` is the
    number of tokens of the longest label; ``bytes`` and ``label_bytes`` are the
    sizes of the postings and of the labels.
    """

    labels: DataFrame
    postings: DataFrame
    by_root: DataFrame
    longest: int
    bytes: int
    label_bytes: int
    _rows: pa.Table | None = None
    _names: pa.Table | None = None

    def hint(self, table: DataFrame) -> DataFrame:
        """Broadcast a table made of the postings if they are small."""
        return F.broadcast(table) if self.bytes <= BROADCAST_BYTES else table

    def hint_labels(self, table: DataFrame) -> DataFrame:
        """Broadcast a table made of the labels if they are small."""
        return F.broadcast(table) if self.label_bytes <= BROADCAST_BYTES else table

    @property
    def fits_tasks(self) -> bool:
        return self.bytes <= SCAN_BYTES

    @property
    def labels_fit_tasks(self) -> bool:
        return self.label_bytes <= SCAN_BYTES

    def rows_in_memory(self) -> pa.Table:
        """The postings on the driver; their size was checked."""
        if self._rows is None:
            self._rows = self.postings.select("root", "concept_id", F.col("label_index").cast("int").alias("label_index"), "cnt", "n_tokens").toArrow()
        return self._rows

    def labels_in_memory(self) -> pa.Table:
        """(concept_id, label) on the driver; their size was checked."""
        if self._names is None:
            self._names = self.labels.select("concept_id", "label").toArrow()
        return self._names

    def save(self, path: str) -> None:
        self.labels.write.mode("overwrite").parquet(f"{path}/labels")
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")


def _finish(labels: DataFrame, sized: DataFrame) -> Index:
    wide = lambda *columns: sum((F.octet_length(c) for c in columns), F.lit(16)).cast("long")
    facts = sized.agg(F.max("n_tokens").alias("longest"), F.sum(wide("root", "concept_id")).alias("bytes")).first()
    named = labels.agg(F.sum(wide("label", "concept_id")).alias("bytes")).first()
    key = F.struct("concept_id", "label_index", "cnt", "n_tokens")
    by_root = sized.groupBy("root").agg(F.collect_list(key).alias("keys"))
    return Index(labels, sized, by_root, int(facts["longest"] or 0), int(facts["bytes"] or 0), int(named["bytes"] or 0))


def build(labels: DataFrame, stop: Sequence[str], root: roots.Root, tokenizer: Tokenizer = PATTERN) -> Index:
    """Index (concept_id, label_index, label). Labels without roots match nothing.

    The postings are written to the shared folder, as each match reads them.
    """
    content = label_tokens(labels, tokenizer).where(~is_stop(F.col("token"), stop))
    rooted = content.select("concept_id", "label_index", root(F.col("token")).alias("root"))
    counted = rooted.groupBy("root", "concept_id", "label_index").agg(F.count("*").cast("int").alias("cnt"))
    label = Window.partitionBy("concept_id", "label_index")
    return _finish(labels, materialise(counted.withColumn("n_tokens", F.sum("cnt").over(label).cast("int")), "postings"))


def load(spark: SparkSession, path: str) -> Index:
    return _finish(spark.read.parquet(f"{path}/labels"), spark.read.parquet(f"{path}/postings"))
