"""Dictionaries: (concept_id, label_index, label, ord) tables from files and rows.

Label 0 of a concept is its preferred label, the others are synonyms in order.
``ord`` is the place in the order of loading; operators that need no order take
labels without it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import LABEL_ROWS


def index_labels(rows: DataFrame) -> DataFrame:
    """(concept_id, label_index, label, ord) from (ord, concept_id, label)."""
    order = Window.partitionBy("concept_id").orderBy("ord")
    return rows.select("concept_id", (F.row_number().over(order) - 1).cast("int").alias("label_index"), "label", "ord")


def rank(labels: DataFrame) -> Column:
    """What orders labels by loading; ids decide where nothing else does."""
    return F.struct(*[c for c in ("ord", "concept_id", "label_index") if c in labels.columns])


def load_order(labels: DataFrame) -> DataFrame:
    """(concept_id, _first): concepts with the place of their first label."""
    return labels.groupBy("concept_id").agg(F.min("ord").alias("_first"))


def from_rows(spark: SparkSession, rows: Iterable[tuple[str, str]]) -> DataFrame:
    """A dictionary from (id, label) pairs in memory."""
    numbered = [(i, str(a), b) for i, (a, b) in enumerate(rows)]
    return index_labels(spark.createDataFrame(numbered, LABEL_ROWS))


def read_tsv(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """A dictionary from ID<TAB>LABEL lines; repeated ids add synonyms.

    Order is that of the lines: files by name, then lines by place, for which
    Spark's row ids within a file serve. ``header`` skips each file's first line.
    Neither quotes nor words such as NA mean anything.
    """
    raw = spark.read.schema("concept_id string, label string").option("sep", "\t").option("quote", "").option("header", str(header).lower()).option("nullValue", "\x00").csv(path)
    # a file is split in ascending order, so ids ascend within it
    placed = raw.select("concept_id", "label", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("ord"))
    return index_labels(placed.where("concept_id is not null and label is not null"))


def write_tsv(labels: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One ID<TAB>LABEL line per label, preferred label first, without header.

    A dictionary is written as one file, in order of loading: concepts as their
    first labels came (by id, if the labels carry no ``ord``), each with all its
    labels. ``mode='ignore'`` keeps what is there, so a build can be repeated for
    nothing.
    """
    placed = labels.join(load_order(labels), "concept_id").orderBy("_first", "concept_id", "label_index") if "ord" in labels.columns else labels.orderBy("concept_id", "label_index")
    lines = placed.select(F.concat_ws("\t", "concept_id", "label").alias("value"))
    lines.coalesce(1).write.mode(mode).text(path)


def concepts(labels: DataFrame) -> DataFrame:
    """One row per concept: id, preferred label, synonyms in order."""
    place = F.struct("label_index", "label")
    grouped = labels.groupBy(F.col("concept_id").alias("id")).agg(F.array_sort(F.collect_list(place)).alias("_all"))
    names = F.transform("_all", lambda x: x["label"])
    return grouped.select("id", F.element_at(names, 1).alias("label"), F.slice(names, F.lit(2), F.size(names)).alias("synonyms"))


def concept_index(labels: DataFrame) -> DataFrame:
    """(concept_id, labels): the distinct labels of each concept, sorted."""
    return labels.groupBy("concept_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def lookup(table: DataFrame, concept_id: str) -> DataFrame:
    """The entry with an id; a filter, so an unknown id gives no row."""
    return table.where(F.col("id") == concept_id)


def reverse_index(labels: DataFrame) -> DataFrame:
    """(label, concept_id) of preferred labels; of equal labels the concept loaded last wins."""
    preferred = labels.where("label_index = 0")
    return preferred.groupBy("label").agg(F.max_by("concept_id", rank(labels)).alias("concept_id"))


def size(labels: DataFrame) -> DataFrame:
    return labels.agg(F.countDistinct("concept_id").alias("n_concepts"))


def display_entry(concept_id: Column, label: Column) -> Column:
    return F.format_string("[%s] %s", concept_id, label)


def display_concept(labels: Column, definition: Column) -> Column:
    return F.concat(F.array_join(F.array_sort(labels), ", "), F.lit(" | "), F.coalesce(definition, F.lit("")))


def display_annotation(text: Column, start: Column, end: Column, length: Column, concept_id: Column) -> Column:
    return F.format_string("Annotation (%s)[%s-%s M%s] - %s", text, start, end, length, concept_id)


def add_labels(table: DataFrame, more: DataFrame) -> DataFrame:
    """A concept index with further (concept_id, label) rows."""
    rows = table.select("concept_id", F.explode("labels").alias("label")).unionByName(more.select("concept_id", "label"))
    return concept_index(rows)
