"""Line dedup with two Bloom filters.

1. Lines are hashed in the JVM. Each task packs its distinct hashes by *segment*
   (the hash's top bits) with a mark for those it met twice, so a line that
   occurs a billion times costs one record per task.
2. One reducer per segment inserts the hashes into its share of two Bloom
   filters: *once* and *twice* (a hash already in *once* goes to *twice*).
3. Texts are probed against *twice*. Only lines that hit are suspects, and only
   their contents shuffle: a group-by on the line itself confirms them exactly
   and picks the first occurrence.
4. Texts stay where they lie while the numbers of lost lines can be sent to them;
   beyond, texts and numbers meet by id.

The twice filter is broadcast while its size is under ``broadcast_limit``. Beyond
that, each line's hash and place (no content) travel to the segment's part of the
filter, and the places that hit come back to their documents as suspects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, drop_path, drop_tables, free_names, fresh_path, materialise, tasks_for

PROBES = 4
BITS_PER_HASH = 12
BROADCAST_LIMIT = 192 << 20
#: Bytes of lost-line numbers up to which they are sent to the texts.
LOST_LIMIT = 96 << 20
#: Bytes of texts per segment of the filters: a reducer holds 12 bytes per distinct line of them.
SEGMENT_BYTES = 64 << 20


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """``PROBES`` bit positions per hash by double hashing, shape (PROBES, n)."""
    low = hashes & np.uint64(0xFFFFFFFF)
    high = (hashes >> np.uint64(32)) | np.uint64(1)
    mixed = (low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    return np.stack([(mixed + np.uint64(i) * high) % np.uint64(bits) for i in range(PROBES)]).astype(np.int64)


class Bloom:
    """A bitmap over 64-bit hashes; ``bits`` is a multiple of 8."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.bits = max(64, (bits + 7) // 8 * 8)
        self.map = np.zeros(self.bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        hit = np.ones(len(hashes), bool)
        for at in positions(hashes, self.bits):
            hit &= (self.map[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return hit

    def add(self, hashes: np.ndarray) -> None:
        for at in positions(hashes, self.bits):
            np.bitwise_or.at(self.map, at >> 3, (1 << (at & 7)).astype(np.uint8))


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(segments)).astype(np.int64)


def pack(hashes: np.ndarray, twice: np.ndarray, segments: int) -> Iterator[pa.RecordBatch]:
    at = segment_of(hashes, segments)
    order = np.argsort(at, kind="stable")
    at, hashes, twice = at[order], hashes[order], twice[order]
    cut = np.flatnonzero(np.diff(at, prepend=-1))
    ends = np.append(cut[1:], len(at))
    yield pa.record_batch(
        {
            "seg": pa.array(at[cut].astype(np.int32)),
            "hashes": pa.array([hashes[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
            "twice": pa.array([hashes[a:b][twice[a:b]].tobytes() for a, b in zip(cut, ends)], pa.binary()),
        }
    )


def _packer(segments: int):
    # enough hashes at once that a segment's record is worth its overhead
    flush = max(1 << 20, 16 * segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("line_dedup")
        held: list[np.ndarray] = []
        size = 0

        def out():
            both = np.concatenate(held)
            distinct, counts = np.unique(both, return_counts=True)
            return pack(distinct, counts > 1, segments)

        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            held.append(found.copy())
            size += len(found)
            if size >= flush:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    return run


def build_segment(parts: list[bytes], marked: list[bytes]) -> tuple[int, bytes]:
    """Run a segment's hashes through *once* and *twice*; return *twice*.

    Each part holds distinct hashes, so within a part no hash meets itself.
    """
    arrays = [np.frombuffer(p, np.uint64) for p in parts]
    once = Bloom(BITS_PER_HASH * sum(map(len, arrays)))
    seen_twice: list[np.ndarray] = [np.frombuffer(p, np.uint64) for p in marked]
    for array in arrays:
        seen_twice.append(array[once.has(array)])
        once.add(array)
    again = np.unique(np.concatenate(seen_twice)) if seen_twice else np.zeros(0, np.uint64)
    twice = Bloom(BITS_PER_HASH * max(len(again), 1))
    if len(again):
        twice.add(again)
    return twice.bits, twice.map.tobytes()


def _reduce(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    bits, data = build_segment(table["hashes"].to_pylist(), table["twice"].to_pylist())
    return pa.table({"seg": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits], pa.int64()), "data": pa.array([data], pa.binary())})


def lines_of(docs: DataFrame) -> DataFrame:
    """One row per line with content: (_id, _row, _no, _line)."""
    split = docs.where("_text is not null").select("_id", "_row", F.posexplode(F.split("_text", "\n")).alias("_no", "_line"))
    return split.where(F.length(F.trim("_line")) > 0)


def twice_filter(docs: DataFrame, segments: int) -> DataFrame:
    hashes = docs.where("_text is not null").select(F.explode(F.split("_text", "\n")).alias("_line"))
    hashes = hashes.where(F.length(F.trim("_line")) > 0).select(F.xxhash64("_line").alias("h"))
    packed = hashes.mapInArrow(_packer(segments), "seg int, hashes binary, twice binary")
    return packed.groupBy("seg").applyInArrow(_reduce, "seg int, bits long, data binary")


def _probe_broadcast(spark: SparkSession, filters: DataFrame, segments: int):
    """A predicate column on hashes; the filters' total size was checked."""
    shared = spark.sparkContext.broadcast({r.seg: (r.bits, bytes(r.data)) for r in filters.toLocalIterator()})

    @F.arrow_udf("boolean")
    def suspect(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        claim("line_dedup")
        known = {s: Bloom(bits, data) for s, (bits, data) in shared.value.items()}
        for batch in batches:
            hashes = batch.to_numpy(zero_copy_only=False).view(np.uint64)
            at, hit = segment_of(hashes, segments), np.zeros(len(hashes), bool)
            order = np.argsort(at, kind="stable")
            cut = np.flatnonzero(np.diff(at[order], prepend=-1))
            for a, b in zip(cut, np.append(cut[1:], len(at))):
                if (bloom := known.get(int(at[order[a]]))) is not None:
                    hit[order[a:b]] = bloom.has(hashes[order[a:b]])
            yield pa.array(hit)

    return suspect


def _probe_shuffle(docs: DataFrame, lines: DataFrame, filters: DataFrame, segments: int) -> DataFrame:
    """Suspect lines when the filter is too large to broadcast: (_id, _row, _no, _line)."""

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        hit = np.zeros(left.num_rows, bool)
        if right.num_rows and left.num_rows:
            hit = Bloom(right["bits"][0].as_py(), right["data"][0].as_py()).has(left["_h"].to_numpy().view(np.uint64))
        return left.select(["_id", "_row", "_no"]).filter(pa.array(hit))

    seg = F.pmod(F.shiftrightunsigned("_h", 40), F.lit(segments)).cast("int")
    places = lines.select("_id", "_row", "_no", "_h", seg.alias("seg"))
    kinds = {f.name: f.dataType.simpleString() for f in places.schema.fields}
    met = places.groupBy("seg").cogroup(filters.groupBy("seg")).applyInArrow(check, f"_id {kinds['_id']}, _row {kinds['_row']}, _no int")
    # only documents with suspects are asked for their lines again
    asked = met.groupBy(F.col("_id").alias("_i"), F.col("_row").alias("_r")).agg(F.collect_set("_no").alias("_nos"))
    found = docs.join(asked, (F.col("_row") == F.col("_r")) & F.col("_id").eqNullSafe(F.col("_i")))
    picked = found.select("_id", "_row", F.explode(F.transform("_nos", lambda n: F.struct(n.alias("_no"), F.element_at(F.split("_text", "\n"), n + 1).alias("_line")))).alias("_x"))
    return picked.select("_id", "_row", "_x._no", "_x._line")


def repeats(docs: DataFrame, segments: int | None = None, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(_id, _row, gone array<int>): line numbers that a document must lose.

    ``docs`` has (_id, _row, _text); _row tells apart rows that share an id. The
    result is a written table.
    """
    spark = docs.sparkSession
    segments = segments or 4 * tasks_for(docs, 4 * SEGMENT_BYTES)
    path = fresh_path(spark, "line-filter")
    twice_filter(docs, segments).write.parquet(path)
    filters = spark.read.schema("seg int, bits long, data binary").parquet(path)
    size = filters.agg(F.sum(F.length("data"))).first()[0] or 0
    lines = lines_of(docs).withColumn("_h", F.xxhash64("_line"))
    if size <= broadcast_limit:
        found = lines.where(_probe_broadcast(spark, filters, segments)("_h")).drop("_h")
    else:
        found = _probe_shuffle(docs, lines, filters, segments)
    # written, as they are read twice and found by Python
    suspects = materialise(found, "suspects")
    drop_path(spark, path)
    # the line itself is the key: equal hashes don't make lines equal. One entry
    # per (line, document) first, so a line that fills one document stays small
    place = F.struct("_id", "_row", "_no")
    first = suspects.groupBy("_line").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    later = suspects.join(first, "_line").where(~place.eqNullSafe(F.col("_first")))
    gone = materialise(later.groupBy("_id", "_row").agg(F.collect_set("_no").alias("gone")), "lost-lines")
    drop_tables(suspects)
    return gone


def dedup_lines(docs: DataFrame, segments: int | None = None, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``docs`` with each line kept only where it occurs first.

    First means least (doc_id, row hash, line number). Lines are the pieces
    between newlines, compared byte for byte; blank lines are never repeats.
    A document of which no line with content is left is dropped if it lost one.
    ``n_chars``, where present, is set to the new length.

    Defined cases: null texts and texts without content pass through unchanged;
    null ids sort first and are handled like an id; rows that repeat an id and
    its text are one document, and all come out alike; ids with several
    texts are told apart by a hash of the text; very long texts are
    taken whole; an empty table stays empty; other columns are untouched.
    """
    slim = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_row"), F.col("text").alias("_text"))
    row, gid, grow, cut, new = free_names(docs, "_trow", "_gid", "_grow", "_gone", "_new")
    gone = repeats(slim, segments, broadcast_limit)
    size = gone.agg(F.sum(F.size("gone") * 4 + 48)).first()[0] or 0
    gone = gone.select(F.col("_id").alias(gid), F.col("_row").alias(grow), F.col("gone").alias(cut))
    gone = F.broadcast(gone) if size <= LOST_LIMIT else gone
    # the row hash is part of every key, so the join needs no null-safe form for it
    joined = docs.withColumn(row, F.xxhash64("text")).join(gone, (F.col(row) == F.col(grow)) & F.col("doc_id").eqNullSafe(F.col(gid)), "left")
    # linear in the lines, however many go: split once, as a lambda's variable
    left = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(cut))
    kept = F.transform(F.array(F.split("text", "\n")), lambda ls: F.array_join(F.transform(left(ls), lambda i: F.element_at(ls, i + 1)), "\n"))
    rebuilt = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.element_at(kept, 1))
    out = joined.withColumn(new, rebuilt).where(F.col(cut).isNull() | (F.length(F.trim(F.translate(new, "\n", " "))) > 0))
    values = []
    for field in docs.schema.fields:
        if field.name == "text":
            values.append(F.col(new).alias("text"))
        elif field.name == "n_chars":
            length = F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length(new))
            values.append(length.cast(field.dataType).alias("n_chars"))
        else:
            values.append(F.col("`" + field.name.replace("`", "``") + "`"))
    return out.select(*values)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text")


def lines_sql(source: str, columns: str) -> str:
    """DuckDB: the rows of ``source`` with repeated lines taken out."""
    return f"""
    with src as (select *, row_number() over (order by doc_id, text) as rid from {source}),
    ln as (select rid, doc_id, generate_subscripts(string_split(text, chr(10)), 1) as no, unnest(string_split(text, chr(10))) as line from src where text is not null),
    rk as (select rid, no, line, length(trim(line, ' ')) > 0 as solid, row_number() over (partition by line order by doc_id, rid, no) as rn from ln),
    agg as (select rid, string_agg(line, chr(10) order by no) filter (not solid or rn = 1) as new_text,
        bool_or(solid and rn > 1) as lost, bool_or(solid and rn = 1) as holds from rk group by rid)
    select {columns} from src left join agg using (rid) where not coalesce(lost, false) or holds"""


ORACLE = lines_sql("documents", "doc_id, case when coalesce(lost, false) then new_text else text end as text")
