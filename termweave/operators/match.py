"""Dictionary matching as windows over token tables.

From every content token (neither stop word nor termination term) a match grows
to the right over content tokens while some label has all roots so far; stop
words are stepped over, termination terms end it. The labels that lasted longest
and have just that many tokens are found.

A dictionary that fits every task is matched in one pass over each text
(``scan``), without a shuffle. Beyond, ``match_windows`` does it without loops:
hits of one label on consecutive content tokens form islands;
``run`` is what is left of an island at a token. The longest run M1 over labels
is how far a match gets, unless a token repeats the first root at a step beyond
the longest run R2 of labels that have the root twice. One hash exchange on the
document id serves every window: of the tokens whose roots the dictionary has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions import roots
from ..functions.tokenizers import BATCH_ROWS, PATTERN, Texts, Tokenizer, slices
from ..schema import SEPARATOR
from ..shared import spread
from .index import Index
from .scan import Scan, scan_of


def content_tokens(texts: DataFrame, stop: Sequence[str], terms: Sequence[str], key: str = "doc_id", text: str = "text", tokenizer: Tokenizer = PATTERN) -> DataFrame:
    """Content tokens with ``seg`` (termination terms so far) and ``cpos``.

    Both are counted where the texts lie, so what follows shuffles the tokens that
    are left at the time.
    """
    cut = tokenizer.cutter(texts.sparkSession)
    ends, skipped = frozenset(terms), frozenset(stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column(1)):
                part = batch.slice(first, last - first)
                found = cut(Texts(part.column(1)), part.column(1))
                encoded = found.tokens.dictionary_encode()
                kind = np.array([2 if t.strip(" ") in ends else 1 if t in skipped else 0 for t in encoded.dictionary.to_pylist()], np.int8)[encoded.indices.to_numpy()]
                begins = np.searchsorted(found.rows, np.arange(part.num_rows))
                upto = lambda x: np.cumsum(x) - np.append(0, np.cumsum(x))[begins][found.rows]  # noqa: B023, E731
                kept = np.flatnonzero(kind == 0)
                seg, cpos = upto(kind == 2)[kept], upto(kind == 0)[kept]
                rows, starts, stops = found.rows[kept], found.starts[kept], found.ends[kept]
                for at in range(0, len(kept), BATCH_ROWS):
                    some = slice(at, at + BATCH_ROWS)
                    columns = {key: part.column(0).take(pa.array(rows[some])), "seg": pa.array(seg[some], pa.int64()), "cpos": pa.array(cpos[some], pa.int64()), "start": pa.array(starts[some], pa.int32()), "end": pa.array(stops[some], pa.int32()), "token": found.tokens.take(pa.array(kept[some]))}
                    yield pa.record_batch(columns)

    slim = texts.select(key, F.col(text).cast("string").alias("_text"))
    schema = StructType([slim.schema[key], *(StructField(n, LongType()) for n in ("seg", "cpos")), *(StructField(n, IntegerType()) for n in ("start", "end")), StructField("token", StringType())])
    return slim.mapInArrow(run, schema)


def root_hits(content: DataFrame, index: Index, root: roots.Root) -> DataFrame:
    """Content tokens whose root the dictionary has, with the root's keys."""
    rooted = content.withColumn("root", root(F.col("token"))).drop("token")
    return rooted.join(index.hint(index.by_root), "root")


def _repeats(hits: DataFrame, index: Index, key: str) -> DataFrame:
    """``rep``: at which steps (2 to the longest label's + 1) the root comes again."""
    ahead = Window.partitionBy(key, "seg", "root").orderBy("cpos").rangeBetween(1, max(1, index.longest))
    return hits.withColumn("rep", F.transform(F.collect_list("cpos").over(ahead), lambda c: (c - F.col("cpos") + 1).cast("long")))


def match(docs: DataFrame, index: Index, stop: Sequence[str], terms: Sequence[str], root: roots.Root, key: str = "doc_id", text: str = "text", tokenizer: Tokenizer = PATTERN) -> DataFrame:
    """(key, concept_id, label_index, start, end, matched_length) of (key, text).

    Annotations overlap, as a match starts at every content token. ``key`` must
    be unique. Null and empty texts have none.
    """
    plain = getattr(root, "plain", None)
    if index.fits_tasks and plain:
        return Scan(docs, index, stop, terms, plain, key, text, tokenizer).rows()
    return match_windows(docs, index, stop, terms, root, key, text, tokenizer)


def match_windows(docs: DataFrame, index: Index, stop: Sequence[str], terms: Sequence[str], root: roots.Root, key: str = "doc_id", text: str = "text", tokenizer: Tokenizer = PATTERN) -> DataFrame:
    """``match`` for a dictionary of any size, and root functions without a plain form.

    Texts are cut where they lie, unless that were the work of a few cores: Spark
    forgets how rows are partitioned where Python cuts them, so the windows
    shuffle hits in any case.
    """
    texts = docs.select(key, text)
    # to count the partitions of what is shuffled before would run that shuffle
    if "Exchange" not in texts._jdf.queryExecution().executedPlan().toString():
        texts = spread(texts)
    # or each window would ask for its own partitions
    hits = root_hits(content_tokens(texts, stop, terms, key, text, tokenizer), index, root).repartition(key)
    each = _repeats(hits, index, key).select(key, "seg", "cpos", "start", "end", "rep", F.explode("keys").alias("k"))
    flat = each.select(key, "seg", "cpos", "start", "end", "rep", "k.concept_id", "k.label_index", "k.cnt", "k.n_tokens")
    label = ["concept_id", "label_index"]
    row = Window.partitionBy(key, "seg", *label).orderBy("cpos")
    islands = flat.withColumn("g", F.col("cpos") - F.row_number().over(row))
    island = Window.partitionBy(key, "seg", *label, "g").orderBy("cpos")
    last = island.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ahead = island.rowsBetween(Window.currentRow, max(0, index.longest - 1))
    runs = islands.withColumn("run", F.last("cpos").over(last) - F.col("cpos") + 1).withColumn("ends", F.collect_list("end").over(ahead))
    start = Window.partitionBy(key, "cpos")
    reach = runs.withColumn("m1", F.max("run").over(start)).withColumn("r2", F.coalesce(F.max(F.when(F.col("cnt") >= 2, F.col("run"))).over(start), F.lit(0)))
    again = F.array_min(F.filter("rep", lambda z: (z > F.greatest(F.col("r2"), F.lit(1))) & (z <= F.col("m1"))))
    length = F.coalesce(again - 1, F.col("m1"))
    found = reach.withColumn("m", length).where("n_tokens = m and run >= m")
    return found.select(key, *label, "start", F.element_at("ends", F.col("n_tokens")).alias("end"), F.col("n_tokens").alias("matched_length"))


def described(annotations: DataFrame, key: str = "doc_id") -> DataFrame:
    """Annotations with matched_text get label_key and confidence_score."""
    label_key = F.concat_ws(SEPARATOR, "concept_id", F.col("label_index").cast("string")).alias("label_key")
    return annotations.select(key, "concept_id", "label_index", label_key, "start", "end", "matched_text", "matched_length", F.lit(1.0).alias("confidence_score"))


def annotations(docs: DataFrame, index: Index, stop: Sequence[str], terms: Sequence[str], root: roots.Root, key: str = "doc_id", text: str = "text", tokenizer: Tokenizer = PATTERN) -> DataFrame:
    """``match`` with matched_text, label_key and confidence_score.

    The one-pass matcher cuts mentions out as it goes; else the documents are
    joined, partitioned by the key as matches are.
    """
    plain = getattr(root, "plain", None)
    if index.fits_tasks and plain:
        return Scan(docs, index, stop, terms, plain, key, text, tokenizer, surface=True, shape=lambda rows: described(rows, key)).rows()
    found = match_windows(docs, index, stop, terms, root, key, text, tokenizer)
    joined = found.join(docs.select(key, F.col(text).alias("_text")).repartition(key), key)
    return described(joined.withColumn("matched_text", F.substring("_text", F.col("start") + 1, F.col("end") - F.col("start"))), key)


def with_concepts(annotations: DataFrame, concepts: DataFrame) -> DataFrame:
    """Annotations with the columns of their concepts (keyed by ``id``)."""
    return annotations.join(concepts.withColumnRenamed("id", "concept_id"), "concept_id", "left")


def by_length(annotations: DataFrame, key: str = "doc_id") -> DataFrame:
    """Longest first, then by place."""
    return annotations.orderBy(F.desc("matched_length"), key, "start", "end", "concept_id")


def longest(annotations: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each document's longest annotation: by characters, then tokens, then place."""
    made = scan_of(annotations)
    if made and made.key == key:
        # a document's other rows go where they are found
        annotations = made.but(longest=True)
    order = Window.partitionBy(key).orderBy(F.desc(F.col("end") - F.col("start")), F.desc("matched_length"), "start", "concept_id")
    return annotations.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
