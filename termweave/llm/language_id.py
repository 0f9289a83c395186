"""Language ID: multinomial naive Bayes over hashed character n-grams.

A text's n-grams (1 to ``MAX_N`` code points, lower case) are hashed to
``SLOTS`` columns; each language has a log probability per column. The matrix
is a constant few MB whatever the corpus, so it is broadcast. A batch is scored
by gathering matrix rows at the n-grams' columns and summing per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spread

BITS = 16
SLOTS = 1 << BITS
MAX_N = 3
CHUNK = 1 << 18
MAX_LABELLED = 8_000
_FACTOR = np.uint32(0x9E3779B1)
_LETTERS = re.compile(r"[^\W\d_]+").findall


def slots(text: str) -> Iterator[np.ndarray]:
    """Columns of the n-grams of ``text``, in pieces that together are whole.

    Runs of anything but letters count as one space, so n-grams don't see
    digits, marks or layout.
    """
    clean = " ".join(_LETTERS(text.lower()))
    code = np.frombuffer(f" {clean} ".encode("utf-32-le", "surrogatepass"), np.uint32) if clean else np.zeros(0, np.uint32)
    for start in range(0, len(code), CHUNK):
        # the overlap lets n-grams that cross a border count once
        part = code[start : start + CHUNK + MAX_N - 1]
        own = min(CHUNK, len(code) - start)
        h = np.zeros(len(part), np.uint32)
        for n in range(1, MAX_N + 1):
            if len(part) < n:
                break
            h = (h[: len(part) - n + 1] * _FACTOR) ^ (part[n - 1 :] + np.uint32(n))
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield (mixed >> np.uint32(32 - BITS))[:own].astype(np.int32)


class NaiveBayes:
    def __init__(self, languages: list[str], weights: np.ndarray, prior: np.ndarray):
        self.languages, self.weights, self.prior = languages, weights.astype(np.float32), prior.astype(np.float64)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log joint per language, n-grams per document)."""
        total, count = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
        held: list[np.ndarray] = []
        owners: list[int] = []
        size = 0

        def settle():
            nonlocal size
            if held:
                ends = np.concatenate([[0], np.cumsum([len(h) for h in held])[:-1]])
                picked = self.weights[np.concatenate(held)]
                np.add.at(total, owners, np.add.reduceat(picked, ends, axis=0, dtype=np.float64))
                held.clear()
                owners.clear()
                size = 0

        for i, text in enumerate(texts):
            for part in slots(text):
                if len(part):
                    held.append(part)
                    owners.append(i)
                    count[i] += len(part)
                    size += len(part)
            if size >= CHUNK:
                settle()
        settle()
        return total, count


def fit(texts: list[str], languages: list[str], smoothing: float = 0.5) -> NaiveBayes:
    """Counts per language with additive smoothing; priors are uniform.

    A corpus's share of a language says little about one text, hence no prior.
    """
    names = sorted(set(languages))
    counts = np.zeros((len(names), SLOTS))
    for text, language in zip(texts, languages):
        row = counts[names.index(language)]
        for part in slots(text):
            row += np.bincount(part, minlength=SLOTS)
    log = np.log(counts + smoothing) - np.log(counts.sum(1, keepdims=True) + smoothing * SLOTS) if names else counts
    return NaiveBayes(names, np.ascontiguousarray(log.T), np.zeros(len(names)))


def sample(docs: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 0, column: str = "lang") -> DataFrame:
    """(doc_id, label, text) of at most ``max_labelled`` labelled documents.

    Ids are drawn by a hash, in equal parts per language (each at least one).
    Rows that repeat an id and language are one document, its least text, so
    the bound holds on rows. Whole texts are taken.
    """
    rows = docs.where(F.col(column).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    named = rows.select(F.col("doc_id").cast("string").alias("_key"), F.col(column).alias("label"))
    # a row per language
    known = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.approx_count_distinct("_key").alias("n")).toLocalIterator()}
    part = max(1, max_labelled // max(1, len(known)))
    hashed = named.withColumn("_h", F.xxhash64(F.lit(seed), "_key"))
    # hashes under this bound hold twice as many ids as are wanted: others can't be drawn, so they needn't be sorted
    bounds = [(k, min(2**63 - 1, int(-(2**63) + 2**64 * (2 * part + 100) / max(1, n)))) for k, n in known.items()]
    limits = docs.sparkSession.createDataFrame(bounds, f"label {docs.schema[column].dataType.simpleString()}, _most long")
    near = hashed.join(F.broadcast(limits), "label").where("_h <= _most").select("label", "_h", "_key").distinct()
    each = Window.partitionBy("label").orderBy("_h", "_key")
    chosen = near.withColumn("_place", F.row_number().over(each)).where(F.col("_place") <= part).select("label", "_key")
    texts = rows.select("doc_id", F.col("doc_id").cast("string").alias("_key"), F.col(column).alias("label"), F.col("text").cast("string").alias("text"))
    # max_labelled rows of an id and a language, so they may be broadcast
    return texts.join(F.broadcast(chosen), ["label", "_key"], "left_semi").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit_on_table(docs: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 0, column: str = "lang") -> NaiveBayes:
    """Fit on ``sample``; counts don't depend on the order of rows."""
    rows = sample(docs, max_labelled, seed, column).toPandas()
    return fit(rows["text"].tolist(), rows["label"].tolist())


def identify(docs: DataFrame, model: NaiveBayes) -> DataFrame:
    """(doc_id, language, margin) for every row.

    margin is the mean log-likelihood lead over the second language per n-gram.
    Defined cases: null, empty and letterless texts have null language and
    margin, as have all texts where the model knows no language; with a single
    language the margin is 0; ties go to the lesser name; null ids and repeated
    rows pass row by row; whole texts are scored; an empty table gives an empty
    result; other columns are not read. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                if own.languages:
                    score, count = own.score(texts)
                    best = score.argmax(1)
                    ordered = np.sort(score, axis=1)
                    lead = (ordered[:, -1] - ordered[:, -2]) / np.maximum(count, 1) if len(own.languages) > 1 else np.zeros(len(texts))
                    live = count > 0
                    names = [own.languages[b] if ok else None for b, ok in zip(best, live)]
                    margin = pa.array(np.round(lead, 6), mask=~live)
                else:
                    names, margin = [None] * len(texts), pa.nulls(len(texts), pa.float64())
                yield pa.record_batch({"doc_id": part.column(0), "language": pa.array(names, pa.string()), "margin": margin})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, language string, margin double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return identify(docs, fit_on_table(docs))
