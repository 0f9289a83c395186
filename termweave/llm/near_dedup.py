"""Near-duplicate groups by BagMinHash (weighted Jaccard of shingle multisets).

A document is the multiset of its word 3-grams (lower case, ASCII punctuation
is space). For a shingle of weight w, independent Poisson processes run over
the weight intervals (0,1], (1,2], (2,4], (4,8] ...; a point of an interval
that w covers in part is split in halves again and again until it lies wholly
inside or outside w. Slot i of the signature is the earliest accepted point
among those sent to it, so two documents agree in a slot with probability
sum(min) / sum(max) of their weights: an unbiased estimate of weighted Jaccard.

Only the points before a document's stop time are made, (ln m + c) / weight:
m (ln m + c) of them on average whatever the length. Should a slot stay empty,
that document is drawn again with a later stop time, which changes nothing
about the points already seen.

Plan: signatures (no shuffle) -> exact copies collapse to one document -> bands
meet in buckets -> each document is verified against the first member of one of
its buckets -> what is still apart in a bucket is verified in rounds: some
members become hubs, four times as many as in the round before, and meet all
others of the bucket that they aren't joined with; a hub then leaves the bucket
-> connected components. No bucket, partner or candidate is capped: pairs that
are skipped are those whose ends a verified path already joins, which can't
change groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, claim, drop_tables, few, fmix64, free_names, materialise, spread

SHINGLE = 3
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
THRESHOLD = 0.55
MARGIN = 4.0
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SPACES = bytes(c if (c >= 128 or chr(c).isalnum()) else 32 for c in range(256))


_HASH = Memo(xxhash.xxh64_intdigest, 60_000, "near_dedup")


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes, ascending, and their counts.

    Fewer than ``SHINGLE`` words make one shingle of them all; none make none.
    """
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))
    span = min(SHINGLE, len(h))
    total = np.zeros(len(h) - span + 1, np.uint64)
    for i in range(span):
        total = total * np.uint64(0xD1342543DE82EF95) + h[i : len(h) - span + 1 + i]
    return np.unique(fmix64(total), return_counts=True)


def _intervals(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each weight the indexes of the intervals it reaches: (owner, interval)."""
    top = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64)
    owner = np.repeat(np.arange(len(weights)), top + 1)
    start = np.cumsum(top + 1) - (top + 1)
    return owner, np.arange(len(owner)) - start[owner]


def _inside(low: np.ndarray, high: np.ndarray, weight: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Halve (low, high] at random towards each point until weight decides it."""
    low, high = low.copy(), high.copy()
    accepted = np.zeros(len(low), bool)
    open_ = np.arange(len(low))
    coins, used = fmix64(seed ^ np.uint64(0xA0761D6478BD642F)), 0
    while len(open_):
        accepted[open_[high[open_] <= weight[open_]]] = True
        open_ = open_[(high[open_] > weight[open_]) & (low[open_] < weight[open_])]
        middle = (low[open_] + high[open_]) // 2
        upper = (coins[open_] >> np.uint64(used)) & np.uint64(1) == 1
        low[open_] = np.where(upper, middle, low[open_])
        high[open_] = np.where(upper, high[open_], middle)
        used += 1
    return accepted


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, slots: int = SLOTS) -> np.ndarray:
    """(docs, slots) signatures of documents given as rows (doc, element, weight).

    Rows of documents without elements are 0 throughout.
    """
    result = np.zeros((docs, slots), np.uint64)
    owner, interval = _intervals(weight)
    row_doc, row_weight = doc[owner], weight[owner]
    high = np.left_shift(1, interval)
    low = np.where(interval == 0, 0, high >> 1)
    rate = slots * (high - low).astype(np.float64)
    seed = fmix64(element[owner] + GOLDEN * (interval.astype(np.uint64) + np.uint64(1)))
    whole = np.bincount(doc, weight, docs)
    live = whole > 0
    stop = np.where(live, (np.log(slots) + MARGIN) / np.maximum(whole, 1), 0.0)
    while live.any():
        best = np.full(docs * slots, np.inf)
        winner = np.zeros(docs * slots, np.uint64)
        rows = np.flatnonzero(live[row_doc])
        clock = np.zeros(len(rows))
        turn = 0
        while len(rows):
            turn += 1
            draw = fmix64(seed[rows] + np.uint64(int(GOLDEN) * turn & 0xFFFFFFFFFFFFFFFF))
            clock = clock - np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate[rows]
            early = clock <= stop[row_doc[rows]]
            rows, clock, draw = rows[early], clock[early], draw[early]
            partly = high[rows] > row_weight[rows]
            counted = ~partly
            if partly.any():
                p = rows[partly]
                counted[partly] = _inside(low[p], high[p], row_weight[p], draw[partly])
            at = row_doc[rows] * slots + (draw % np.uint64(slots)).astype(np.int64)
            at, when, what = at[counted], clock[counted], draw[counted]
            np.minimum.at(best, at, when)
            won = best[at] == when
            winner[at[won]] = what[won]
        full = np.isfinite(best.reshape(docs, slots)).all(1) & live
        result[full] = winner.reshape(docs, slots)[full]
        live = live & ~full
        stop = stop * 3
    return result


def bands(signature: np.ndarray) -> np.ndarray:
    """(docs, BANDS) 64-bit keys; the band's number is part of the key."""
    folded = np.zeros((len(signature), BANDS), np.uint64)
    for r in range(ROWS):
        folded = folded * np.uint64(0xD1342543DE82EF95) + signature[:, r::ROWS]
    return fmix64(folded + GOLDEN * np.arange(1, BANDS + 1, dtype=np.uint64))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("near_dedup")
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            ids, same, docs, elements, counts = [], [], [], [], []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                element, count = shingles(text)
                if len(element):
                    docs.append(np.full(len(element), len(ids)))
                    elements.append(element)
                    counts.append(count)
                    ids.append(doc_id)
                    same.append(xxhash.xxh3_128_digest(element.tobytes() + count.tobytes()))
            if not ids:
                continue
            keys = bands(signatures(np.concatenate(docs), np.concatenate(elements), np.concatenate(counts), len(ids)))
            flat = pa.array(keys.view(np.int64).ravel())
            yield pa.record_batch(
                {"doc_id": pa.array(ids, pa.int64()), "same": pa.array(same, pa.binary()), "bands": pa.ListArray.from_arrays(np.arange(0, len(ids) * BANDS + 1, BANDS, dtype=np.int32), flat)}
            )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("near_dedup")
    for batch in batches:
        packed = []
        for text in batch.column(1).to_pylist():
            element, count = shingles(text)
            packed.append(element.tobytes() + count.astype(np.uint32).tobytes())
        yield pa.record_batch({"doc_id": batch.column(0), "packed": pa.array(packed, pa.binary())})


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard of two packed multisets."""
    n, k = len(a) // 12, len(b) // 12
    ea, eb = np.frombuffer(a, np.uint64, n), np.frombuffer(b, np.uint64, k)
    ca, cb = np.frombuffer(a, np.uint32, n, 8 * n).astype(np.int64), np.frombuffer(b, np.uint32, k, 8 * k).astype(np.int64)
    at = np.searchsorted(eb, ea)
    at[at == k] = 0
    hit = eb[at] == ea if k else np.zeros(n, bool)
    common = int(np.minimum(ca[hit], cb[at[hit]]).sum())
    total = int(ca.sum() + cb.sum()) - common
    return common / total if total else 0.0


def _overlap(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array([overlap(a, b) for a, b in zip(left.to_pylist(), right.to_pylist())], pa.float64())


def verified(pairs: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap by ``threshold`` at least."""
    left = packed.select(F.col("doc_id").alias("a"), F.col("packed").alias("pa"))
    right = packed.select(F.col("doc_id").alias("b"), F.col("packed").alias("pb"))
    measure = F.arrow_udf(_overlap, "double")
    # by a first: a hub meets all its partners there
    return pairs.join(left, "a").join(right, "b").where(measure("pa", "pb") >= threshold).select("a", "b").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return materialise(edges.union(edges.select("b", "a")).distinct(), "edges")


def components(both: DataFrame) -> DataFrame:
    """(doc, label): label is the least id of the component. Isolated ids are absent.

    ``both`` has each edge (a, b) both ways. Labels fall to the least among
    neighbours, then jump along labels; rounds grow with the logarithm of a
    component's diameter. The result is a written table.
    """
    labels = materialise(both.groupBy(F.col("a").alias("doc")).agg(F.least(F.col("doc"), F.min("b")).alias("label"), F.lit(True).alias("moved")), "labels")
    while True:
        known = labels.select("doc", "label")
        near = both.join(known.select(F.col("doc").alias("b"), F.col("label").alias("lb")), "b").groupBy("a").agg(F.min("lb").alias("lb"))
        lower = known.join(near.withColumnRenamed("a", "doc"), "doc").select("doc", F.least("label", "lb").alias("next"), "label")
        jump = known.select(F.col("doc").alias("next"), F.col("label").alias("far"))
        moved = materialise(lower.join(jump, "next").select("doc", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")), "labels")
        drop_tables(labels)
        labels = moved
        if moved.where("moved").isEmpty():
            return labels


def shared_keys(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` whose bucket ``key`` has two values or more; counted before rows meet."""
    key = rows.groupBy("key").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).where("_lo < _hi").select("key")
    return rows.join(key, "key", "left_semi")


def relabelled(rows: DataFrame, label: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` set to its label in ``label`` (doc, label), if it has one."""
    named = label.select(F.col("doc").alias(column), "label")
    return rows.join(few(named), column, "left").withColumn(column, F.coalesce("label", column)).drop("label")


def apart_pairs(apart: DataFrame, slots: int) -> tuple[DataFrame, DataFrame]:
    """Hubs (key, hub, hub_team) of this round, and their pairs (a, b, ta, tb).

    A bucket has up to ``slots`` hubs, the least document in each slot that
    documents are hashed to.
    """
    slot = F.pmod(F.xxhash64("doc", F.lit(slots)), F.lit(slots))
    hubs = apart.groupBy("key", slot.alias("slot")).agg(F.min(F.struct("doc", "team")).alias("h"))
    hubs = materialise(hubs.select("key", F.col("h.doc").alias("hub"), F.col("h.team").alias("hub_team")), "hubs")
    met = apart.join(hubs, "key").where("team <> hub_team")
    first = F.col("doc") < F.col("hub")
    ends = F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")
    met = met.select(*ends, F.when(first, F.col("team")).otherwise(F.col("hub_team")).alias("ta"), F.when(first, F.col("hub_team")).otherwise(F.col("team")).alias("tb"))
    return hubs, met


def verified_links(met: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """(a, b) verified pairs that join whatever pairs of a bucket would, a written table.

    ``met`` is a written table (key, doc) of buckets, ``packed`` one of multisets.
    """
    # one pair per document comes first; most others then join the same component
    star = met.join(met.groupBy("key").agg(F.min("doc").alias("first")), "key").where("doc <> first")
    tried = materialise(star.groupBy(F.col("doc").alias("b")).agg(F.min("first").alias("a")).select("a", "b"), "pairs")
    edges = materialise(verified(tried, packed, threshold), "verified")
    both = both_ways(edges)
    label = components(both)
    drop_tables(both)
    apart = materialise(shared_keys(relabelled(met.withColumn("team", F.col("doc")), label, "team"), "team"), "buckets")
    drop_tables(label)
    done, asked, slots = [edges], [tried], 1
    while not apart.isEmpty():
        hubs, met = apart_pairs(apart, slots)
        pairs = materialise(met.groupBy("a", "b").agg(F.min("ta").alias("ta"), F.min("tb").alias("tb")), "pairs")
        untried = pairs.select("a", "b").join(reduce(DataFrame.unionByName, [t.select("a", "b") for t in asked]), ["a", "b"], "left_anti")
        edges = materialise(verified(untried, packed, threshold), "verified")
        teams = both_ways(pairs.join(edges, ["a", "b"]).select(F.col("ta").alias("a"), F.col("tb").alias("b")))
        label = components(teams)
        rest = apart.join(hubs.select("key", F.col("hub").alias("doc")), ["key", "doc"], "left_anti")
        rest = materialise(shared_keys(relabelled(rest, label, "team"), "team"), "buckets")
        drop_tables(apart, hubs, teams, label)
        asked.append(pairs)
        done.append(edges)
        apart, slots = rest, slots * 4
    found = materialise(reduce(DataFrame.unionByName, done), "links")
    drop_tables(apart, *done, *asked)
    return found


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id, links) of all documents in groups of two or more.

    group_id is the least doc_id of the group. Groups are the connected
    components of verified pairs. links counts the verified pairs that hold the
    document; an exact copy is linked with the least of its copies alone, and
    pairs whose ends other links join already needn't be verified. Defined
    cases: null ids, null and wordless
    texts are in no group; rows that repeat an id are one document whose texts
    all count; texts of fewer than three words are one shingle; whole texts are
    taken however long; an empty table gives an empty result; only doc_id and
    text are read, so other columns can't clash.
    """
    slim = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialise(slim.mapInArrow(_sign, "doc_id long, same binary, bands array<long>"), "signatures")
    least = signed.groupBy("same").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").select("same", "rep")
    copies = materialise(signed.select("doc_id", "same").join(least, "same").where("doc_id <> rep").select("doc_id", "rep").distinct(), "copies")
    firsts = signed.groupBy("same").agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands"))
    met = materialise(shared_keys(firsts.select("doc", F.explode("bands").alias("key")), "doc"), "buckets")
    drop_tables(signed)
    wanted = materialise(met.select(F.col("doc").alias("doc_id")).distinct(), "wanted")
    # texts are picked where they lie while the ids can be sent to them
    packed = materialise(slim.join(few(wanted), "doc_id", "left_semi").mapInArrow(_pack, "doc_id long, packed binary"), "packed")
    edges = verified_links(met, packed, threshold)
    drop_tables(met, wanted, packed)
    both = both_ways(edges.unionByName(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))
    final = components(both)
    counted = both.groupBy(F.col("a").alias("doc")).agg(F.count("*").alias("links"))
    result = materialise(final.join(counted, "doc").select(F.col("doc").alias("doc_id"), F.col("label").alias("group_id"), "links"), "groups")
    drop_tables(copies, edges, both, final)
    return result


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the least doc_id.

    Rows with null ids or texts stay. Rows that repeat an id share its fate.
    """
    (name,) = free_names(docs, "_gone")
    gone = groups(docs, threshold).where("doc_id <> group_id").select(F.col("doc_id").alias(name))
    # texts stay where they lie while the ids can be sent to them
    return docs.join(few(gone), F.col("doc_id").cast("long") == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
