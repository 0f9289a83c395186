"""SKOS dictionaries from triples.

``triples`` is a table (s, p, o, o_lang). Predicates are full URIs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_W3 = "http://www.w3.org/"
TYPE = f"{_W3}1999/02/22-rdf-syntax-ns#type"
SKOS = f"{_W3}2004/02/skos/core#"
SKOS_XL = f"{_W3}2008/05/skos-xl#"
CONCEPT = SKOS + "Concept"
_TRIPLE = r"^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|\"((?:[^\"\\]|\\.)*)\"(?:@([A-Za-z0-9-]+)|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$"


def _unescape(column):
    """N-Triples escapes; \\u sequences are decoded through JSON."""
    return F.from_json(F.concat(F.lit('{"v":"'), column, F.lit('"}')), "v string")["v"]


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, o_lang) of an N-Triples file; other lines are left out."""
    lines = spark.read.text(path)
    part = lambda i: F.regexp_extract("value", _TRIPLE, i)
    literal = F.regexp_extract("value", _TRIPLE, 5)
    is_node = (part(3) != "") | (part(4) != "")
    return lines.where(F.col("value").rlike(_TRIPLE)).select(
        F.regexp_replace(part(1), "^<|>$", "").alias("s"),
        part(2).alias("p"),
        F.when(part(3) != "", part(3)).when(part(4) != "", part(4)).otherwise(_unescape(literal)).alias("o"),
        F.when(~is_node & (part(6) != ""), part(6)).alias("o_lang"),
    )


def _of_type(triples: DataFrame, concept_type: str) -> DataFrame:
    return triples.where((F.col("p") == TYPE) & (F.col("o") == concept_type)).select("s").distinct()


def plain_labels(triples: DataFrame, language: str, predicate: str = SKOS + "prefLabel", concept_type: str = CONCEPT) -> DataFrame:
    """(x, lf): concepts and their labels in a language."""
    named = triples.where((F.col("p") == predicate) & (F.col("o_lang") == language)).select("s", F.col("o").alias("lf"))
    return named.join(_of_type(triples, concept_type), "s", "left_semi").select(F.col("s").alias("x"), "lf")


def xl_labels(triples: DataFrame, language: str, predicate: str = SKOS_XL + "prefLabel", concept_type: str = CONCEPT) -> DataFrame:
    """(x, lf): concepts and the literal forms of their label nodes."""
    nodes = triples.where(F.col("p") == predicate).select("s", F.col("o").alias("node"))
    forms = triples.where((F.col("p") == SKOS_XL + "literalForm") & (F.col("o_lang") == language)).select(F.col("s").alias("node"), F.col("o").alias("lf"))
    return nodes.join(_of_type(triples, concept_type), "s", "left_semi").join(forms, "node").select(F.col("s").alias("x"), "lf")


def dictionary_rows(triples: DataFrame, language: str = "fr", xl: bool = True, same_alternatives: bool = False) -> DataFrame:
    """(ord, concept_id, label): preferred labels first, then alternatives.

    ``same_alternatives`` takes the preferred labels again for alternatives, as
    some converters do.
    """
    base, of = (SKOS_XL, xl_labels) if xl else (SKOS, plain_labels)
    preferred = of(triples, language, base + "prefLabel").select(F.lit(0).alias("kind"), "x", "lf")
    other = of(triples, language, base + ("prefLabel" if same_alternatives else "altLabel")).select(F.lit(1).alias("kind"), "x", "lf")
    both = preferred.unionByName(other)
    # order matters within a concept only, so no global sort is needed
    order = Window.partitionBy("x").orderBy("kind", "lf")
    return both.select(F.row_number().over(order).cast("long").alias("ord"), F.col("x").alias("concept_id"), F.col("lf").alias("label"))


def count_distinct(rows: DataFrame) -> DataFrame:
    return rows.distinct().agg(F.count("*").alias("count"))


def page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page in the order of all columns, so pages neither overlap nor skip."""
    return rows.distinct().orderBy(*rows.columns).offset(offset).limit(limit)
