"""Dictionaries, triples and replies made of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokenizers import Texts, slices, words_of
from ..shared import materialise, spread
from ..sources import rdf
from ..sources.dictionary import index_labels

TOP = 100
LONGEST = 4
LONG = 6
#: Cells of a sketch of n-grams (a power of 2), and those that travel as one row.
CELL_BITS, CHUNK = 20, 1024
#: Cells of the highest counts whose n-grams are counted first.
CANDIDATES = 2_000
FACTORS = np.random.default_rng(0).integers(1, 1 << 63, 1024, np.uint64) * np.uint64(2) + np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, concept_id, label): brands are concepts, their parts' names labels."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("http://example.org/brand_"), "p_brand").alias("concept_id"), F.col("p_name").alias("label"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary of the distinct part names; the id is the name's number."""
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    return names.select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("concept_id"), F.lit(0).alias("label_index"), F.col("p_name").alias("label"))


def _hashes(words: pa.StringArray) -> np.ndarray:
    """A number per word; that some are equal makes bounds wider, not wrong."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    found = np.add.reduceat(FACTORS[place % len(FACTORS)] * (data.astype(np.uint64) + np.uint64(1)), offsets[:-1] - offsets[0]) if len(data) else np.zeros(len(words), np.uint64)
    found = (found ^ (found >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (found ^ (found >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)


def _gram_hashes(rows: np.ndarray, words: pa.DictionaryArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, hashes) of the n-grams of words that stand in ``rows``."""
    one = _hashes(words.dictionary)[words.indices.to_numpy()]
    total = np.zeros(len(one), np.uint64)
    for n in range(1, LONGEST + 1):
        last = n - 1
        total = total[: max(0, len(one) - last)] * np.uint64(0x9E3779B97F4A7C15) + one[last:]
        inside = np.flatnonzero(rows[: max(0, len(rows) - last)] == rows[last:])
        yield n, inside, total[inside] ^ np.uint64(n)


def _cells(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the two sketches count an n-gram."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), (hashes >> np.uint64(60 - 2 * bits)).astype(np.int64) & ((1 << bits) - 1)


def _grams(batches: Iterator[pa.RecordBatch], cut: Callable) -> Iterator[tuple[pa.DictionaryArray, int, np.ndarray, np.ndarray]]:
    """(words, n, places, hashes) of each slice of the batches' texts, for each n."""
    for batch in batches:
        for first, end in slices(batch.column(0)):
            rows, words = cut(Texts(batch.column(0).slice(first, end - first)))
            encoded = words.dictionary_encode()
            for n, places, hashes in _gram_hashes(rows, encoded):
                yield encoded, n, places, hashes


def _pack(counts: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs."""
    return counts.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if counts.max() <= np.iinfo(t).max)).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(packed) // CHUNK]).astype(np.int64)


def _sketches(texts: DataFrame, cut: Callable) -> np.ndarray:
    """[n - 1, sketch, cell]: how many n-grams fall into each cell, which bounds each one's count."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((LONGEST, 2, 1 << CELL_BITS), np.int64)
        waiting: dict[int, list[np.ndarray]] = {n: [] for n in range(1, LONGEST + 1)}

        def flush(n: int) -> None:
            for sketch, cells in enumerate(_cells(np.concatenate(waiting[n]), CELL_BITS)):
                totals[n - 1, sketch] += np.bincount(cells, minlength=1 << CELL_BITS)
            waiting[n].clear()

        for _, n, _, hashes in _grams(batches, cut):
            waiting[n].append(hashes)
            if sum(map(len, waiting[n])) >= 1 << CELL_BITS:
                flush(n)
        for n, left in waiting.items():
            if left:
                flush(n)
        chunks = totals.reshape(-1, CHUNK)
        used = np.flatnonzero(chunks.any(axis=1))
        for at in range(0, len(used), 256):
            some = used[at : at + 256]
            yield pa.record_batch({"chunk": pa.array(some, pa.int32()), "counts": pa.array([_pack(chunks[i]) for i in some], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[chunk] = sums[chunk] + _unpack(packed) if chunk in sums else _unpack(packed)
        for chunk, counts in sums.items():
            yield pa.record_batch({"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([_pack(counts)], pa.binary())})

    schema = "chunk int, counts binary"
    totals = np.zeros((LONGEST * 2 << CELL_BITS) // CHUNK * CHUNK, np.int64).reshape(-1, CHUNK)
    for row in texts.mapInArrow(counted, schema).repartition("chunk").mapInArrow(added, schema).toLocalIterator():
        totals[row["chunk"]] = _unpack(row["counts"])
    return totals.reshape(LONGEST, 2, -1)


def _counts(texts: DataFrame, cut: Callable, least: dict[int, int], totals: np.ndarray) -> DataFrame:
    """(n, label, c) of all n-grams that ``totals`` lets occur ``least[n]`` times or more."""
    wanted = texts.sparkSession.sparkContext.broadcast({n: np.packbits(totals[n - 1] >= c, axis=1) for n, c in least.items()})

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {n: np.unpackbits(bits, axis=1).view(bool) for n, bits in wanted.value.items()}
        for words, n, places, hashes in _grams(batches, cut):
            if n not in cells:
                continue
            a, b = _cells(hashes, CELL_BITS)
            places = places[cells[n][0][a] & cells[n][1][b]]
            parts = [words.dictionary.take(words.indices.take(pa.array(places + k))) for k in range(n)]
            found = pc.value_counts(parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " "))
            yield pa.record_batch({"n": pa.array(np.full(len(found), n, np.int32)), "label": found.field("values").cast(pa.string()), "c": found.field("counts")})

    return texts.mapInArrow(named, "n int, label string, c long").groupBy("n", "label").agg(F.sum("c").alias("c"))


def corpus_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``TOP`` most frequent n-grams of the documents for n up to ``LONGEST``.

    Counts cover all documents. Equal counts rank by the n-gram. Two sketches of
    all n-grams bound every count from above; then n-grams whose bounds are among
    the highest are counted as strings. If the last of the ``TOP`` is below those
    bounds, all n-grams that may reach its count are counted.
    """
    texts = spread(table(spark, sf_dir, "documents").select("text")).where("text is not null").select(F.lower("text").alias("text"))
    cut = words_of(spark)
    totals = _sketches(texts, cut)
    least = {n: max(1, int(np.partition(totals[n - 1, 0], -CANDIDATES)[-CANDIDATES])) for n in range(1, LONGEST + 1)}
    done, order = [], Window.partitionBy("n").orderBy(F.desc("c"), "label")
    while least:
        ranked = _counts(texts, cut, least, totals).withColumn("r", F.row_number().over(order)).where(F.col("r") <= TOP)
        terms = materialise(ranked, "terms")
        last = {r["n"]: r["c"] for r in terms.where(F.col("r") == TOP).collect()}
        missed = {n: last.get(n, 1) for n, c in least.items() if c > last.get(n, 1)}
        done.append(terms.where(F.col("n").isin([n for n in least if n not in missed])))
        least = missed
    every = reduce(DataFrame.unionByName, done)
    terms = every.select(F.concat_ws("_", F.lit("g"), F.col("n").cast("string"), F.col("r").cast("string")).alias("concept_id"), F.lit(0).alias("label_index"), "label")
    # a few hundred rows that index and filters read several times
    return materialise(terms.coalesce(1), "terms")


def long_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus terms of ``LONG`` ASCII characters or more: near ones of shorter words are mostly others."""
    return corpus_terms(spark, sf_dir).where((F.length("label") >= LONG) & F.col("label").rlike("^[ -~]+$"))


def plural_terms(labels: DataFrame) -> DataFrame:
    """A dictionary with a synonym for each label: the label and an s."""
    more = labels.select("concept_id", F.lit(1).alias("label_index"), F.concat("label", F.lit("s")).alias("label"))
    return labels.unionByName(more)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thesaurus of parts in SKOS and SKOS-XL: English names, French types."""
    part = table(spark, sf_dir, "part")
    s = F.concat(F.lit("http://example.org/part_"), F.col("p_partkey").cast("string"))
    node = lambda kind: F.concat(s, F.lit(f"/{kind}"))
    none = F.lit(None).cast("string")
    rows = [
        (s, rdf.TYPE, F.lit(rdf.CONCEPT), none),
        (s, rdf.SKOS + "prefLabel", F.col("p_name"), F.lit("en")),
        (s, rdf.SKOS + "altLabel", F.col("p_type"), F.lit("en")),
        (s, rdf.SKOS + "altLabel", F.col("p_brand"), F.lit("fr")),
        (s, rdf.SKOS_XL + "prefLabel", node("pref"), none),
        (node("pref"), rdf.SKOS_XL + "literalForm", F.col("p_name"), F.lit("en")),
        (s, rdf.SKOS_XL + "altLabel", node("alt"), none),
        (node("alt"), rdf.SKOS_XL + "literalForm", F.col("p_type"), F.lit("fr")),
    ]
    cells = F.array(*[F.struct(a.alias("s"), F.lit(b).alias("p"), c.alias("o"), d.alias("o_lang")) for a, b, c, d in rows])
    return part.select(F.explode(cells).alias("t")).select("t.*")


def search_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(concept_id, json): per brand a reply with a result per part, by part key.

    Parts of odd size have no ``cui``, those of a size divisible by 4 no
    ``semanticType``.
    """
    part = table(spark, sf_dir, "part")
    item = F.struct(
        F.concat(F.lit("id"), F.col("p_partkey").cast("string")).alias("@id"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("C"), F.col("p_size").cast("string")))).alias("cui"),
        F.when(F.col("p_size") % 4 != 0, F.array("p_type")).alias("semanticType"),
        F.array("p_name").alias("synonym"),
    )
    grouped = part.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))).alias("all"))
    return grouped.select(F.col("p_brand").alias("concept_id"), F.to_json(F.struct(F.transform("all", lambda x: x["item"]).alias("collection"))).alias("json"))


def brand_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_labels(brand_rows(spark, sf_dir))


def first_letters(token: str) -> str:
    """A stand-in for a caller's stemmer."""
    return token[:5]


def word_pieces(text: str) -> list[str]:
    """A stand-in for an embedding model's tokenizer: three letters, then the rest."""
    return [piece for word in text.split(" ") if word for piece in (word[:3], *(["##" + word[3:]] if len(word) > 3 else []))]


def make_word_pieces() -> Callable[[str], list[str]]:
    return word_pieces


def make_letter_embedder() -> Callable[[list[str]], list[tuple[list[str], np.ndarray]]]:
    """A stand-in for an embedding model: a piece's length, first and last character."""

    def embed(labels: list[str]) -> list[tuple[list[str], np.ndarray]]:
        cut = [word_pieces(label) for label in labels]
        return [(tokens, np.array([[len(t), ord(t[0]), ord(t[-1])] for t in tokens], np.float32).reshape(len(tokens), 3)) for tokens in cut]

    return embed
