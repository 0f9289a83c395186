"""Stop words and termination terms per language, and their loader.

Membership is case-sensitive. A termination term ends a match; a stop word is
passed over inside one. Where a term is both, termination wins inside a match.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_MARKS = "!\"#$%&()*+,./:;?[]^_|~¢§«¦"

STOP: dict[str, tuple[str, ...]] = {
    "en": tuple("- a at by he her his in it its my not of the their through while".split()),
    "fr": tuple("' - a c ce d d' dans de des du en l l' la le les par pas sa sai ses son un une à ’".split()),
}

TERMINATION: dict[str, tuple[str, ...]] = {
    "en": tuple(_MARKS) + tuple("and consequently he hence neither nor one or she that the these they those thus which who whom".split()),
    "fr": tuple(_MARKS)
    + tuple("' a afin ainsi c elle elles et il ils l l' la laquelle le lequel lesquelles lesquels me ne nous ou pas pour quel que qui un une vous à ’".split()),
}


def check_language(language: str) -> str:
    """The language, if there are lists for it; ValueError otherwise."""
    if language not in STOP:
        raise ValueError(f"no word lists for language {language!r}; known: {', '.join(sorted(STOP))}")
    return language


def load_word_list(spark: SparkSession, path: str) -> list[str]:
    """Terms of a text file, one per line, without the white space around them.

    The list goes into expressions as literals, so it comes to the driver.
    """
    rows = spark.read.text(path).select(F.trim("value").alias("term")).where("term <> ''").distinct().orderBy("term").collect()
    return [r["term"] for r in rows]
