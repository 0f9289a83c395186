"""Normalisation and tokens with exact character offsets, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space as Unicode has it, which is wider than Java's \s.
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{M}\p{N}"
#: What ``normalize_fuzzy`` leaves.
LETTER = r"\p{L}\p{N}"
#: Runs of white space, words, and single other characters: nothing is lost.
PIECE = rf"[{SPACE}]+|[{WORD}]+|[^{SPACE}{WORD}]"


def normalize_label(label: Column) -> Column:
    """Each run of control, mark, punctuation and symbol characters to a space; lower case.

    Spaces are neither collapsed nor trimmed.
    """
    return F.lower(F.regexp_replace(label, r"[\p{C}\p{M}\p{P}\p{S}]+", " "))


def normalize_fuzzy(text: Column) -> Column:
    """As ``normalize_label``, with separators in the runs too."""
    return F.lower(F.regexp_replace(text, r"[\p{C}\p{M}\p{P}\p{S}\p{Z}]+", " "))


def pieces(text: Column) -> Column:
    """The text cut into ``PIECE`` matches; joined they give it back."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def explode_tokens(texts: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """One row per token: ``key``, pos, start, end, token.

    Offsets are half-open and count code points. A run of white space is a token
    where a text begins with it; elsewhere one leading U+0020 belongs to the
    word before, and what remains of the run is a token. Null and empty texts
    have no tokens. ``texts`` should be hash partitioned by (a part of) ``key``:
    then the windows here need no exchange.
    """
    cut = texts.select(*key, F.posexplode(pieces(F.col(text))).alias("_i", "_piece"))
    run = Window.partitionBy(*key).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cut.withColumn("_end", F.sum(F.length("_piece")).over(run).cast("int"))
    absorbed = (F.col("_i") > 0) & F.col("_piece").startswith(" ")
    token = F.when(absorbed, F.expr("substring(_piece, 2)")).otherwise(F.col("_piece"))
    kept = placed.withColumn("token", token).where("token <> ''")
    order = Window.partitionBy(*key).orderBy("_i")
    return kept.select(
        *key,
        (F.row_number().over(order) - 1).alias("pos"),
        (F.col("_end") - F.length("token")).cast("int").alias("start"),
        F.col("_end").alias("end"),
        "token",
    )


def is_stop(token: Column, stop: Sequence[str]) -> Column:
    return token.isin(*stop) if stop else F.lit(False)


def is_termination(token: Column, terms: Sequence[str]) -> Column:
    """Inside a match the token is trimmed first."""
    return F.trim(token).isin(*terms) if terms else F.lit(False)


def blocks_start(token: Column, stop: Sequence[str], terms: Sequence[str]) -> Column:
    """A match can't start at a stop word or termination term (not trimmed)."""
    both = [*stop, *terms]
    return token.isin(*both) if both else F.lit(False)


def surface(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def last_piece(word_pieces: Column) -> Column:
    """The last word piece of each word of an array of arrays."""
    return F.transform(word_pieces, lambda p: F.element_at(p, -1))


def last_words(cut: Callable[[str], list[str]], terms: Sequence[str]) -> list[str]:
    """The last piece of each term; terms without pieces are left out."""
    return sorted({found[-1] for term in terms if (found := cut(term))})


def piece_spans(word_pieces: Column, text: Column, offset: int = 0) -> Column:
    """array<struct<start,end>> of word pieces in ``text``.

    A piece's leading continuation marks '#' don't count; spaces between pieces
    are stepped over; a span beyond the end of the text is cut there.
    """
    size = F.length(text)

    def step(state: Column, piece: Column) -> Column:
        rest = F.substring(text, state["at"] + 1, size)
        gap = F.length(rest) - F.length(F.ltrim(rest))
        start = state["at"] + gap
        end = F.least(start + F.length(F.regexp_replace(piece, "^#+", "")), size)
        return F.struct(end.cast("int").alias("at"), F.concat(state["spans"], F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))).alias("spans"))

    zero = F.struct(F.lit(offset).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(word_pieces, zero, step, lambda s: s["spans"])


def short_id(uri: Column) -> Column:
    """The second '_' part of a URI's last segment; null if there is none."""
    return F.try_element_at(F.split(F.element_at(F.split(uri, "/"), -1), "_"), F.lit(2))
