"""Tokenizers: how recognisers cut texts and labels.

A tokenizer has two faces that agree: ``spans`` cuts one string, ``cutter`` a
batch of texts, for kernels that read whole texts; ``explode`` gives a token table.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .text import SPACE, WORD

Spans = Callable[[str], list[tuple[int, int, str]]]
_CLASSES: dict[tuple[str, str], str] = {}
#: Bytes of texts that are cut at once (one text at least), and rows of a batch of tokens.
SLICE_BYTES, BATCH_ROWS = 2 << 20, 100_000


def word_class(spark: SparkSession, chars: str = WORD) -> str:
    """``chars`` as ranges of code points, read from the JVM.

    Python's pattern library may know another Unicode version; with the JVM's
    ranges both cut alike.
    """
    app = spark.sparkContext.applicationId
    if (app, chars) not in _CLASSES:
        # one string of all code points: its runs of such characters are the ranges
        every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]))
        row = spark.createDataFrame([(every,)], "s string").select(F.regexp_extract_all("s", F.lit(f"[{chars}]+"), F.lit(0)).alias("r"))
        for old in [k for k in _CLASSES if k[0] != app]:
            del _CLASSES[old]
        _CLASSES[app, chars] = "".join(f"\\U{ord(r[0]):08x}-\\U{ord(r[-1]):08x}" for r in row.first()["r"])
    return _CLASSES[app, chars]


@lru_cache(maxsize=4)
def code_kinds(words: str) -> np.ndarray:
    """Per code point: 1 is white space, 2 part of a word, 0 anything else."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.zeros(0x110000, np.uint8)
    for kind, chars in ((2, words), (1, SPACE)):
        for run in regex.finditer(f"[{chars}]+", every):
            kinds[ord(run[0][0]) : ord(run[0][-1]) + 1] = kind
    return kinds


def slices(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """(first, end) of neighbouring rows of ``most`` bytes (``SLICE_BYTES``), or of one row."""
    most = most or SLICE_BYTES
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first, done = 0, 0
    while first < len(upto):
        end = max(first + 1, int(np.searchsorted(upto, done + most, "right")))
        yield first, end
        first, done = end, upto[end - 1]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class Texts:
    """The code points of a batch of texts: ``codes``, and in ``at`` where each row begins."""

    def __init__(self, texts: pa.StringArray):
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        data = texts.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        offsets = offsets.astype(np.int64) - int(offsets[0])
        self.plain = not len(self.bytes) or self.bytes.max() < 128
        if self.plain:
            self.codes, self.at, self.places = self.bytes, offsets, None
        else:
            self.codes = np.frombuffer(self.bytes.tobytes().decode().encode("utf-32-le"), np.uint32)
            self.places = np.append(np.flatnonzero((self.bytes & 0xC0) != 0x80), len(self.bytes))
            self.at = np.searchsorted(self.places, offsets)

    def place(self, codes: np.ndarray) -> np.ndarray:
        """Bytes before code points."""
        return codes if self.plain else self.places[codes]

    def surface(self, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
        """What stands from ``starts`` to ``ends`` in ``rows``."""
        begin = self.place(self.at[rows] + starts)
        sizes = self.place(self.at[rows] + ends) - begin
        return strings(self.bytes[ranges(begin, sizes)], sizes)


def strings(data: np.ndarray, sizes: np.ndarray) -> pa.StringArray:
    """Strings of these UTF-8 bytes and sizes."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


@dataclass
class Cut:
    """Tokens of a batch of texts: the row, place in it, offsets and string of each."""

    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    tokens: pa.StringArray

    def pos(self) -> np.ndarray:
        """The number of each token in its row."""
        sizes = np.bincount(self.rows, minlength=1)
        return ranges(np.zeros(len(sizes), np.int64), sizes)


Cuts = Callable[[Texts, pa.StringArray], Cut]


class Cutter:
    """A function that cuts, made at its first use in a process."""

    def __init__(self, make: Callable[[], Callable]):
        self.make, self.made = make, None

    def __call__(self, *texts):
        if self.made is None:
            self.made = self.make()
        return self.made(*texts)

    def __getstate__(self):
        return {"make": self.make, "made": None}


class Tokenizer(ABC):
    @abstractmethod
    def spans(self, spark: SparkSession) -> Spans:
        """A function from a text to (start, end, token), to be sent to tasks."""

    def cutter(self, spark: SparkSession) -> Cuts:
        """As ``spans`` for a batch of texts."""
        spans = self.spans(spark)

        def cut(texts: Texts, values: pa.StringArray) -> Cut:
            found = [(i, *span) for i, value in enumerate(values.to_pylist()) if value for span in spans(value)]
            rows, starts, ends, tokens = zip(*found) if found else ((), (), (), ())
            return Cut(np.array(rows, np.int64), np.array(starts, np.int64), np.array(ends, np.int64), pa.array(tokens, pa.string()))

        return cut

    def column(self, spark: SparkSession, text: Column) -> Column:
        """array<struct<start,end,token>> of a text; null and empty texts have none."""
        cut = self.cutter(spark)

        @F.arrow_udf("array<struct<start:int,end:int,token:string>>")
        def listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                lists = []
                for first, end in slices(batch):
                    part = batch.slice(first, end - first)
                    found = cut(Texts(part), part)
                    rows = pa.StructArray.from_arrays([pa.array(found.starts, pa.int32()), pa.array(found.ends, pa.int32()), found.tokens], ["start", "end", "token"])
                    sizes = np.append(0, np.cumsum(np.bincount(found.rows, minlength=len(part))))
                    lists.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows))
                empty = pa.array([], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string())])))
                yield pa.concat_arrays(lists) if lists else empty

        return listed(text.cast("string"))

    def explode(self, texts: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
        """One row per token: ``key``, pos, start, end, token. No shuffle.

        A batch of texts is cut in slices, so what a task holds doesn't follow the
        length of its texts.
        """
        cut = self.cutter(texts.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, end in slices(batch.column(len(key))):
                    part = batch.slice(first, end - first)
                    found = cut(Texts(part.column(len(key))), part.column(len(key)))
                    pos = found.pos()
                    for at in range(0, len(pos), BATCH_ROWS):
                        some = slice(at, at + BATCH_ROWS)
                        rows = pa.array(found.rows[some])
                        numbers = [pa.array(x[some], pa.int32()) for x in (pos, found.starts, found.ends)]
                        yield pa.record_batch([*(part.column(i).take(rows) for i in range(len(key))), *numbers, found.tokens.slice(at, BATCH_ROWS)], names=[*key, "pos", "start", "end", "token"])

        slim = texts.select(*key, F.col(text).cast("string").alias("_text"))
        schema = StructType(slim.schema.fields[:-1])
        for name in ("pos", "start", "end"):
            schema.add(name, "integer")
        return slim.mapInArrow(run, schema.add("token", "string"))

    def distinct(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """(token): each token once. Those of a slice are made distinct where they are cut."""
        cut = self.cutter(texts.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, end in slices(batch.column(0)):
                    part = batch.column(0).slice(first, end - first)
                    yield pa.record_batch({"token": pc.unique(cut(Texts(part), part).tokens)})

        return texts.select(F.col(text).cast("string")).mapInArrow(run, "token string").distinct()


def _pattern_cutter(words: str) -> Spans:
    find = regex.compile(rf"[{SPACE}]+|[{words}]+|[^{SPACE}{words}]").findall

    def cut(text: str) -> list[tuple[int, int, str]]:
        out, at = [], 0
        for piece in find(text):
            end = at + len(piece)
            if at and piece[0] == " ":
                piece = piece[1:]
            if piece:
                out.append((end - len(piece), end, piece))
            at = end
        return out

    return cut


def _pattern_arrays(words: str) -> Cuts:
    kinds = code_kinds(words)

    def cut(texts: Texts, _: pa.StringArray) -> Cut:
        codes, at = texts.codes, texts.at
        kind = kinds[codes]
        begins = np.ones(len(codes), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 0)
        begins[at[:-1][at[:-1] < at[1:]]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(codes))[: len(starts)]
        rows = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(starts, at)))
        # one space belongs to the word before
        absorbed = (codes[starts] == 32) & (starts != at[rows])
        data = texts.bytes
        if absorbed.any():
            stays = np.ones(len(data), bool)
            stays[texts.place(starts[absorbed])] = False
            data = data[stays]
        starts = starts + absorbed
        kept = starts < ends
        starts, ends, rows = starts[kept], ends[kept], rows[kept]
        tokens = strings(data, texts.place(ends) - texts.place(starts))
        return Cut(rows, starts - at[rows], ends - at[rows], tokens)

    return cut


class PatternTokenizer(Tokenizer):
    """Words, single other characters and runs of white space, as ``explode_tokens`` cuts."""

    def spans(self, spark: SparkSession) -> Spans:
        return Cutter(partial(_pattern_cutter, word_class(spark)))

    def cutter(self, spark: SparkSession) -> Cuts:
        return Cutter(partial(_pattern_arrays, word_class(spark)))


def _word_runs(words: str) -> Callable[[Texts], tuple[np.ndarray, pa.StringArray]]:
    inside = code_kinds(words) == 2

    def cut(texts: Texts) -> tuple[np.ndarray, pa.StringArray]:
        word, at = inside[texts.codes], texts.at
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(word))]
        begins[edge] = word[edge]
        ends[edge - 1] = word[edge - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        data = texts.bytes[word if texts.plain else np.repeat(word, np.diff(texts.places))]
        rows = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(starts, at)))
        return rows, strings(data, texts.place(ends) - texts.place(starts))

    return cut


def words_of(spark: SparkSession) -> Callable[[Texts], tuple[np.ndarray, pa.StringArray]]:
    """A function from texts to the rows and strings of their words, to be sent to tasks."""
    return Cutter(partial(_word_runs, word_class(spark)))


def place_pieces(pieces: Sequence[str], text: str, offset: int = 0) -> list[tuple[int, int, str]]:
    """(start, end, piece) of word pieces: the plain form of ``text.piece_spans``."""
    out, at, size = [], offset, len(text)
    for piece in pieces:
        while at < size and text[at] == " ":
            at += 1
        end = min(at + len(piece.lstrip("#")), size)
        out.append((at, end, piece))
        at = end
    return out


def _piece_cutter(make: Callable[[], Callable[[str], list[str]]]) -> Spans:
    pieces = make()
    return lambda text: place_pieces(pieces(text), text)


class PieceTokenizer(Tokenizer):
    """Word pieces of an embedding model.

    ``make`` builds, once per task, the function from a text to its pieces;
    continuations begin with ``##`` and are placed where they stand in the text.
    """

    def __init__(self, make: Callable[[], Callable[[str], list[str]]]):
        self.make = make

    def spans(self, spark: SparkSession) -> Spans:
        return Cutter(partial(_piece_cutter, self.make))


PATTERN = PatternTokenizer()
