"""Substring dedup over a log-structured fingerprint index.

A repeat is a passage of ``PASSAGE`` words or more that also stands earlier
(in an earlier batch, or at a lesser id or place of the same batch).

The index has two kinds of immutable runs in the shared folder, each sorted by
hash and bucketed alike, so joins between runs and batches merge without a
shuffle of the runs:

* *anchors*: hashes of ``ANCHOR``-word windows, thinned by winnowing so that every
  passage of ``PASSAGE`` words holds one that is chosen wherever the passage
  stands. One row per hash: the document that had it first.
* *windows*: hashes of whole ``PASSAGE``-word windows, only around anchors that
  were met twice. One row per hash: its first place.

A batch is fingerprinted and merge-joined with the anchor runs. Around anchors
that repeat, the batch's documents, and documents whose anchor is met for the
second time, give windows; these are merge-joined with the window runs.
Equal windows in a row become spans, spans are verified against the words they
repeat, and the batch's new hashes are a new run of each kind. ``FANOUT`` runs of
a level are compacted to one of the next level, so a hash is rewritten once a
level. Texts are picked where they lie while the ids of those that are asked for
can be sent to them. An index is saved as a manifest of its runs, and opened by
a later session.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import claim, drop_path, drop_tables, few, fmix64, fresh_path, materialise, spread

PASSAGE = 50
ANCHOR = 25
BATCHES = 3
FANOUT = 2
#: Array elements up to which (id, array) rows are broadcast to texts (some 64 MB).
BROADCAST_ITEMS = 4_000_000
#: Words of documents that are hashed and searched for anchors at once.
WORDS = 1 << 15
_STEP = np.uint64(0xD1342543DE82EF95)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few documents: what a kernel holds grows with them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashed one by one: that takes less than to look them up in a memo."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words: doublings of shorter runs, joined."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    n = len(h) - size + 1
    total, done, power, run, width = None, 0, 1, h, 1
    while True:
        if size & width:
            part = run[done : done + n]
            total = part.copy() if total is None else total * np.uint64(pow(int(_STEP), width, 1 << 64)) + part
            done += width
        if width * 2 > size:
            break
        factor = np.uint64(pow(int(_STEP), width, 1 << 64))
        run = run[:-width] * factor + run[width:]
        width *= 2
    return fmix64(total)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    best, have = v, 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    return best


def anchors(h: np.ndarray, anchor: int = ANCHOR, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the windows that are least among their neighbours.

    Each run of ``passage - anchor + 1`` windows has its least hash chosen, every
    place where it stands included, so equal passages choose alike.
    """
    return anchors_of(h, np.zeros(len(h), np.int64), anchor, passage)


def anchors_of(h: np.ndarray, doc: np.ndarray, anchor: int, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """``anchors`` of documents one after another; ``doc`` has each word's document number."""
    v = window_hashes(h, anchor)
    span = passage - anchor + 1
    if len(v) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = sliding_min(v, span)
    low[doc[: len(low)] != doc[passage - 1 :]] = 0  # these runs leave their document
    # v[i] is chosen if it's the least of some run that holds it: the greatest of
    # the minima of the runs around it equals it
    padded = np.concatenate([np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)])
    at = np.flatnonzero(~sliding_min(~padded, span) == v)
    at = at[doc[at] == doc[at + anchor - 1]]
    return at, v[at]


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows, hashes of their texts' words one after another, and the words' row numbers.

    Small arrays cost more than what they hold, so there are about ``WORDS``
    words in a group, or one longer document.
    """
    for batch in parts(batches):
        hashes, words, first = [], 0, 0
        for row, text in enumerate(batch.column(1).to_pylist()):
            hashes.append(word_hashes(text.split()))
            words += len(hashes[-1])
            if words >= WORDS or row + 1 == batch.num_rows:
                yield batch.slice(first, row + 1 - first), np.concatenate(hashes), np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
                hashes, words, first = [], 0, row + 1


def _fingerprints(anchor: int, passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substring_dedup")
        for rows, h, doc in groups(batches):
            at, found = anchors_of(h, doc, anchor, passage)
            order = np.lexsort((found, doc[at]))
            found, own = found[order], doc[at][order]
            # a hash twice in one document is marked by a second row
            new = np.ones(len(found) + 1, bool)
            new[1:-1] = (found[1:] != found[:-1]) | (own[1:] != own[:-1])
            kept = np.flatnonzero(new[:-1] | np.concatenate([[False], new[:-2]])[: len(found)])
            yield pa.record_batch({"h": pa.array(found[kept].view(np.int64)), "doc_id": rows.column(0).take(pa.array(own[kept]))})

    return run


def _windows(anchor: int, passage: int):
    """Rows (doc_id, text, own, hs) to windows around the anchors in ``hs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substring_dedup")
        for rows, h, doc in groups(batches):
            at, found = anchors_of(h, doc, anchor, passage)
            wanted = rows.column(3)
            # hashes by number, so that a document's number fits beside it
            _, number = np.unique(np.concatenate([found, wanted.flatten().to_numpy().view(np.uint64)]), return_inverse=True)
            pair = number * rows.num_rows + np.concatenate([doc[at], np.repeat(np.arange(rows.num_rows), wanted.value_lengths().to_numpy())])
            at = at[np.isin(pair[: len(at)], pair[len(at) :])]
            whole = window_hashes(h, passage)
            size = np.bincount(doc, minlength=rows.num_rows)
            start = np.cumsum(size) - size
            first = np.maximum(at - (passage - anchor), start[doc[at]])
            beyond = np.minimum(at + 1, (start + size)[doc[at]] - passage + 1)
            cover = np.bincount(first, minlength=len(whole) + 1) - np.bincount(beyond, minlength=len(whole) + 1)
            near = np.flatnonzero(np.cumsum(cover) > 0)
            own = doc[near]
            yield pa.record_batch(
                {
                    "h": pa.array(whole[near].view(np.int64)),
                    "doc_id": rows.column(0).take(pa.array(own)),
                    "place": pa.array((near - start[own]).astype(np.int32)),
                    "own": rows.column(2).take(pa.array(own)),
                }
            )

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the words of each span (first, words) of a document."""
    for batch in parts(batches):
        ids, firsts, sizes, digests = [], [], [], []
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = text.split()
            for span in spans:
                first, size = span["first"], span["words"]
                ids.append(doc_id)
                firsts.append(first)
                sizes.append(size)
                digests.append(hashlib.blake2b(" ".join(words[first : first + size]).encode("utf-8", "surrogatepass"), digest_size=20).digest())
        yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "first": pa.array(firsts, pa.int32()), "words": pa.array(sizes, pa.int32()), "digest": pa.array(digests, pa.binary())})


def with_texts(texts: DataFrame, asked: DataFrame, items: str) -> DataFrame:
    """``texts`` joined with ``asked``, a written table (doc_id, ``items`` array).

    Texts stay where they lie while what is asked can be sent to them; beyond,
    those that nothing asks for are left out before the shuffle while their ids
    can be.
    """
    size = asked.agg(F.sum(F.size(items) + 3)).first()[0] or 0
    if size <= BROADCAST_ITEMS:
        return texts.join(F.broadcast(asked), "doc_id")
    return texts.join(few(asked.select("doc_id")), "doc_id", "left_semi").join(asked, "doc_id")


class Runs:
    """One kind of immutable runs: (h, doc_id[, place]), one row per hash."""

    def __init__(self, spark: SparkSession, kind: str, columns: list[str], buckets: int):
        self.spark, self.kind, self.columns, self.buckets = spark, kind, columns, buckets
        self.tables: list[tuple[str, str, int]] = []

    def write(self, rows: DataFrame, level: int) -> None:
        """Write rows as a sorted, bucketed table."""
        path = fresh_path(self.spark, self.kind)
        name = path.rpartition("/")[2].replace("-", "_")
        rows.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").option("path", path).saveAsTable(name)
        self.tables.append((name, path, level))

    def add(self, rows: DataFrame) -> None:
        self.write(rows.select(*self.columns), 0)
        level = 0
        while sum(t[2] == level for t in self.tables) >= FANOUT:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merge a level's runs into one of the next; their hashes are disjoint."""
        old = [t for t in self.tables if t[2] == level]
        merged = reduce(DataFrame.unionByName, [self.spark.table(name) for name, _, _ in old])
        self.tables = [t for t in self.tables if t[2] != level]
        self.write(merged.select(*self.columns), level + 1)
        for table in old:
            self.drop(table)

    def drop(self, table: tuple[str, str, int]) -> None:
        self.spark.sql(f"drop table if exists {table[0]}")
        drop_path(self.spark, table[1])

    def attach(self, path: str, level: int) -> None:
        """Take in a run that an earlier session wrote."""
        name = path.rpartition("/")[2].replace("-", "_")
        kinds = ", ".join(f"{c} {'int' if c == 'place' else 'bigint'}" for c in self.columns)
        self.spark.sql(f"create table if not exists {name} ({kinds}) using parquet clustered by (h) sorted by (h) into {self.buckets} buckets location '{path}'")
        self.tables.append((name, path, level))

    def known(self, rows: DataFrame, own: list[str]) -> list[DataFrame]:
        """For each run its rows that ``rows`` (bucketed alike) has too.

        The runs' columns besides h are renamed to ``own``.
        """
        result = []
        for name, _, _ in self.tables:
            run = self.spark.table(name).select("h", *[F.col(c).alias(o) for c, o in zip(self.columns[1:], own)])
            result.append(run.join(rows.select("h").distinct(), "h", "left_semi"))
        return result


class Index:
    """The fingerprint index; ``ingest`` a batch to get its repeats."""

    def __init__(self, spark: SparkSession, anchor: int = ANCHOR, passage: int = PASSAGE, buckets: int | None = None):
        self.spark, self.anchor, self.passage = spark, anchor, passage
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.anchor_runs = Runs(spark, "anchors", ["h", "doc_id"], buckets)
        self.window_runs = Runs(spark, "windows", ["h", "doc_id", "place"], buckets)

    def save(self, folder: str) -> None:
        """Write the manifest; the runs lie in the shared folder and stay there."""
        known = {runs.kind: [[path, level] for _, path, level in runs.tables] for runs in (self.anchor_runs, self.window_runs)}
        content = json.dumps({"anchor": self.anchor, "passage": self.passage, "buckets": self.anchor_runs.buckets, "runs": known})
        self.spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(folder)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        """The index of a manifest, to go on with new batches."""
        known = json.loads(spark.read.text(folder).first()["value"])
        found = cls(spark, known["anchor"], known["passage"], known["buckets"])
        for runs in (found.anchor_runs, found.window_runs):
            for path, level in known["runs"][runs.kind]:
                runs.attach(path, level)
        return found

    def ingest(self, batch: DataFrame, history: DataFrame | None) -> DataFrame:
        """Verified spans (doc_id, first, words, from_id, from_first) of ``batch``, a written table.

        Both tables have (doc_id, text). ``history`` holds what was ingested
        before: only documents whose anchor is met again are read from it.
        """
        whole = batch.withColumn("own", F.lit(True))
        if history is not None:
            whole = whole.unionByName(history.withColumn("own", F.lit(False)))
        prints = materialise(batch.mapInArrow(_fingerprints(self.anchor, self.passage), "h long, doc_id long"), "prints")
        once = prints.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("_n"))
        seen = self._union(self.anchor_runs.known(once, ["_old"]))
        if seen is None:
            merged = once.withColumn("_old", F.lit(None).cast("long"))
        else:
            merged = once.join(seen, "h", "left")
        merged = materialise(merged, "merged")
        again = merged.where("_n > 1 or _old is not null")
        wanted = prints.join(again.select("h"), "h").union(again.where("_old is not null").select("h", "_old")).distinct()
        wanted = materialise(wanted.groupBy("doc_id").agg(F.collect_list("h").alias("hs")), "wanted")
        texts = with_texts(whole, wanted, "hs").select("doc_id", "text", "own", "hs")
        windows = materialise(texts.mapInArrow(_windows(self.anchor, self.passage), "h long, doc_id long, place int, own boolean"), "places")
        self.anchor_runs.add(merged.where("_old is null"))
        drop_tables(prints, merged, wanted)
        # a run's place is earlier than history's, and that than the batch's
        place = F.struct("own", "doc_id", "place")
        firsts = windows.groupBy("h").agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
        old = self._union(self.window_runs.known(firsts, ["_od", "_op"]))
        if old is None:
            known = firsts.select("h", F.col("_first.doc_id").alias("from_id"), F.col("_first.place").alias("from_place"), "_n", F.lit(True).alias("_new"))
        else:
            both = firsts.join(old, "h", "left")
            known = both.select("h", F.coalesce("_od", "_first.doc_id").alias("from_id"), F.coalesce("_op", "_first.place").alias("from_place"), "_n", F.col("_od").isNull().alias("_new"))
        known = materialise(known, "known")
        new = known.where("_new").select("h", F.col("from_id").alias("doc_id"), F.col("from_place").alias("place"))
        self.window_runs.add(new)
        repeated = known.where("_n > 1 or not _new").select("h", "from_id", "from_place")
        hits = windows.where("own").join(repeated, "h").where("not (doc_id = from_id and place = from_place)")
        found = self._verified(self._spans(hits), whole)
        drop_tables(windows, known)
        return found

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame | None:
        found = None
        for part in parts:
            found = part if found is None else found.unionByName(part)
        return found

    def _spans(self, hits: DataFrame) -> DataFrame:
        """Windows in a row that repeat one passage are one span."""
        shift = F.col("place") - F.col("from_place")
        row = Window.partitionBy("doc_id", "from_id", "_shift").orderBy("place")
        islands = hits.select("doc_id", "place", "from_id", "from_place", shift.alias("_shift")).withColumn("_island", F.col("place") - F.row_number().over(row))
        spans = islands.groupBy("doc_id", "from_id", "_shift", "_island").agg(F.min("place").alias("first"), F.max("place").alias("_last"), F.min("from_place").alias("from_first"))
        return spans.select("doc_id", "first", (F.col("_last") - F.col("first") + self.passage).cast("int").alias("words"), "from_id", "from_first")

    def _verified(self, spans: DataFrame, texts: DataFrame) -> DataFrame:
        """Spans whose words are those of the passage they repeat."""
        spans = materialise(spans, "spans")
        sides = spans.select("doc_id", F.struct("first", "words").alias("s")).union(spans.select("from_id", F.struct("from_first", "words"))).distinct()
        sides = materialise(sides.groupBy("doc_id").agg(F.collect_list("s").alias("spans")), "sides")
        digests = with_texts(texts, sides, "spans").select("doc_id", "text", "spans")
        digests = materialise(digests.mapInArrow(_digests, "doc_id long, first int, words int, digest binary"), "digests")
        theirs = digests.select(F.col("doc_id").alias("from_id"), F.col("first").alias("from_first"), "words", F.col("digest").alias("_digest"))
        joined = spans.join(digests, ["doc_id", "first", "words"]).join(theirs, ["from_id", "from_first", "words"])
        found = materialise(joined.where("digest = _digest").select("doc_id", "first", "words", "from_id", "from_first"), "repeats")
        drop_tables(spans, sides, digests)
        return found

    def close(self) -> None:
        for runs in (self.anchor_runs, self.window_runs):
            for table in runs.tables:
                runs.drop(table)
            runs.tables = []


def repeats(docs: DataFrame, batches: int = BATCHES, anchor: int = ANCHOR, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, first, words, from_id, from_first): passages that stand earlier.

    ``first`` is the number of the span's first word (split at white space), and
    ``from_id``, ``from_first`` the earliest place of each of its windows. Every
    word of every repeat of ``passage`` words or more is in a span. ``docs`` is
    ingested in ``batches`` ranges of doc_id; the result doesn't depend on their
    number.

    Defined cases: null ids and null texts are left out; texts shorter than a
    passage have no repeats; rows that repeat an id count as one document, its
    least text; a passage twice in one document is a repeat; whole texts
    are read however long; an empty table gives an empty result; other columns
    are not read.
    """
    spark = docs.sparkSession
    slim = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if slim.groupBy("doc_id").count().where("count > 1").isEmpty():
        single = slim
    else:
        single = slim.groupBy("doc_id").agg(F.min("text").alias("text"))
    cuts = slim.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000).alias("q")).first()["q"] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    index = Index(spark, anchor, passage)
    found = None
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = single
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        spans = index.ingest(part, None if low is None else single.where(F.col("doc_id") <= low))
        found = spans if found is None else found.unionByName(spans)
    index.close()
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
