"""Approximate matching: token windows within an edit distance of labels.

Two strings within k edits share one of k + 1 segments of either, at a place
shifted by at most k. So labels are cut in k + 1 segments, and windows look their
substrings up by (label length, segment, substring): an equi-join. Candidates
are then verified. A dictionary that every task can hold is looked up in one pass
over each text (``near``), which asks for the same segments. Labels shorter than k + 1 characters have no such segments;
they meet windows of up to 2 k characters where deleting at most k characters
from either gives the same string, which is an equi-join too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import LETTER, normalize_fuzzy
from ..functions.tokenizers import PATTERN, Tokenizer, word_class
from ..sources.dictionary import rank
from . import near

DISTANCE = 2
#: Labels up to which texts are read in one pass; beyond, windows are joined with segments.
SCAN_LABELS = 5_000


def fuzzy_labels(labels: DataFrame) -> DataFrame:
    """(normalized, concept_id, label_index, n_tokens, n_chars): the last of equal ones.

    Last by the dictionary's order, where the labels carry one (``ord``); else by
    id and label number.
    """
    named = labels.select("concept_id", "label_index", rank(labels).alias("_rank"), F.trim(normalize_fuzzy(F.col("label"))).alias("normalized")).where("normalized <> ''")
    last = named.groupBy("normalized").agg(F.max_by(F.struct("concept_id", "label_index"), "_rank").alias("_k"))
    return last.select("normalized", "_k.concept_id", "_k.label_index", F.size(F.split("normalized", " +")).alias("n_tokens"), F.length("normalized").alias("n_chars"))


def _cut(k: int) -> Column:
    """Segments of ``normalized``: (number, first place, substring)."""
    number = F.sequence(F.lit(0), F.lit(k))
    place = lambda i: (i * F.col("n_chars") / F.lit(k + 1)).cast("int")
    return F.transform(number, lambda i: F.struct(i.alias("seg"), place(i).alias("at"), F.substring(F.col("normalized"), place(i) + 1, place(i + 1) - place(i)).alias("part")))


def windows(docs: DataFrame, longest: int, key: str = "doc_id", tokenizer: Tokenizer = PATTERN) -> DataFrame:
    """(key, start, end, surface, window, n): 1 to ``longest`` neighbouring words, normalised.

    Made within each row, so no text is shuffled.
    """
    cut = docs.select(key, F.col("text").alias("_text"), tokenizer.column(docs.sparkSession, F.col("text")).alias("_t"))
    named = F.transform("_t", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.trim(normalize_fuzzy(t["token"])).alias("w")))
    words = cut.select(key, "_text", F.filter(named, lambda t: t["w"] != "").alias("_ws"))
    each = words.select(key, "_text", F.posexplode(F.transform("_ws", lambda t, i: F.slice("_ws", i + 1, F.lit(max(1, longest))))).alias("_i", "_run"))
    sized = each.select(key, "_text", "_run", F.explode(F.sequence(F.lit(1), F.size("_run"))).alias("n"))
    start, end = F.element_at("_run", 1)["start"], F.element_at("_run", F.col("n"))["end"]
    window = F.array_join(F.transform(F.slice("_run", F.lit(1), F.col("n")), lambda x: x["w"]), " ")
    return sized.select(key, start.alias("start"), end.alias("end"), F.substring("_text", start + 1, end - start).alias("surface"), window.alias("window"), "n")


def _deletions(text: Column, k: int) -> Column:
    """What is left of ``text`` after deleting at most ``k`` characters."""
    found = F.array(text)
    for _ in range(k):
        less = F.flatten(F.transform(found, lambda s: F.transform(F.filter(F.sequence(F.lit(0), F.length(s)), lambda i: i > 0), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))))
        found = F.array_distinct(F.concat(found, less))
    return found


def similar(strings: DataFrame, labels: DataFrame, k: int = DISTANCE) -> DataFrame:
    """(window, normalized, concept_id, label_index, distance) within ``k`` edits.

    ``strings`` has distinct (window). Exact; Spark's ``levenshtein`` stops at k.
    """
    n = F.length("window")
    long = labels.where(F.col("n_chars") > k)
    blocks = long.select("*", F.explode(_cut(k)).alias("s")).select("normalized", "concept_id", "label_index", "n_chars", "s.seg", F.col("s.at").alias("at"), "s.part")
    # a window asks for each label length in reach that there is, and each segment
    sizes = sorted(r["n_chars"] for r in long.select("n_chars").distinct().toLocalIterator())
    asked = strings.withColumn("n_chars", F.explode(F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda m: F.abs(m - n) <= k))).withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(k))))
    # one segment stays whole with at most as many edits before it as its number, and
    # the rest of the k behind it: that bounds the shift from both sides
    gap = n - F.col("n_chars")
    lowest, highest = F.greatest(-F.col("seg"), gap - (F.lit(k) - F.col("seg"))), F.least(F.col("seg"), gap + (F.lit(k) - F.col("seg")))
    asked = asked.where(lowest <= highest).withColumn("shift", F.explode(F.sequence(lowest, highest)))
    first = (F.col("seg") * F.col("n_chars") / F.lit(k + 1)).cast("int")
    after = ((F.col("seg") + 1) * F.col("n_chars") / F.lit(k + 1)).cast("int")
    at = first + F.col("shift")
    asked = asked.where((at >= 0) & (at + after - first <= n)).select("window", "n_chars", "seg", F.substring("window", at + 1, after - first).alias("part"))
    met = asked.join(blocks.drop("at"), ["n_chars", "seg", "part"]).select("window", "normalized", "concept_id", "label_index").distinct()
    few = labels.where(F.col("n_chars") <= k).select("normalized", "concept_id", "label_index", F.explode(_deletions(F.col("normalized"), k)).alias("part"))
    short = strings.where(n <= 2 * k).select("window", F.explode(_deletions(F.col("window"), k)).alias("part"))
    near = short.join(few, "part").select("window", "normalized", "concept_id", "label_index").distinct()
    both = met.unionByName(near)
    return both.withColumn("distance", F.levenshtein("window", "normalized", k)).where("distance >= 0")


def _met(docs: DataFrame, known: DataFrame, k: int, key: str, tokenizer: Tokenizer, columns: Sequence[str]) -> DataFrame:
    """``columns`` of (key, start, end, surface, window, n, distance) and of the labels."""
    facts = known.agg(F.max("n_tokens").alias("longest"), F.count("*").alias("labels")).first()
    longest = int(facts["longest"] or 1)
    if facts["labels"] > SCAN_LABELS:
        places = windows(docs, longest, key, tokenizer)
        # a common word is looked up once
        return places.join(similar(places.select("window").distinct(), known, k), "window").select(*columns)
    spark = docs.sparkSession
    slim = docs.select(key, F.col("text").cast("string").alias("text"))
    labels = known.select("normalized", "concept_id", "label_index")
    shared = spark.sparkContext.broadcast(near.NearLabels(labels.toArrow(), k, longest, word_class(spark, LETTER)))
    kinds = {"start": IntegerType(), "end": IntegerType(), "surface": StringType(), "window": StringType(), "n": IntegerType(), "distance": IntegerType()}
    kinds |= {f.name: f.dataType for f in [slim.schema[key], *labels.schema.fields]}
    schema = StructType([StructField(c, kinds[c]) for c in columns])
    return slim.mapInArrow(near.runner(shared, tokenizer.cutter(spark), key, columns), schema)


def fuzzy_match(docs: DataFrame, labels: DataFrame, k: int = DISTANCE, key: str = "doc_id", tokenizer: Tokenizer = PATTERN) -> DataFrame:
    """(key, start, end, window, concept_id, label_index, normalized, distance).

    Every window of up to as many words as the longest label has is compared.
    Windows are made distinct before the join, so a common word is looked up once.
    """
    return _met(docs, fuzzy_labels(labels), k, key, tokenizer, (key, "start", "end", "window", "concept_id", "label_index", "normalized", "distance"))


def mentions(docs: DataFrame, known: DataFrame, k: int = DISTANCE, key: str = "doc_id", tokenizer: Tokenizer = PATTERN) -> DataFrame:
    """(key, concept_id, label_index, start, end, matched_text, matched_length) for ``fuzzy_labels``."""
    found = _met(docs, known, k, key, tokenizer, (key, "concept_id", "label_index", "start", "end", "surface", "n"))
    return found.select(key, "concept_id", "label_index", "start", "end", F.col("surface").alias("matched_text"), F.col("n").cast("int").alias("matched_length"))
