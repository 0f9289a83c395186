"""Byte-level BPE: encode by backtracking over longest matches, decode by lookup.

Bytes become Latin-1 characters, so the trie of an Aho-Corasick automaton over
the vocabulary (pyahocorasick, which takes str) works on bytes; it is asked where a
token may start, its failure links aren't used. Encoding goes left to
right: take the longest token that matches here and is *compatible* with the
token before it; with none left, take the token before back and try its next
shorter one. Two tokens are compatible if merging their joined bytes yields
just these two again. Merge order makes that check local, so a
sequence whose neighbours all are compatible is the sequence that BPE makes.
Positions found to be dead ends are remembered, so time is linear in the length.

Most new pre-tokens are short words. Those of many texts are merged at once, as
rows of a matrix: each round merges the pair of least rank in every row
(``Merger``). Where few are new, and for long ones, there is backtracking.

Pair checks and pre-tokens are memoised per worker, within bounds.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, claim, on_release, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_WORDS = 40_000
#: Chunks repeat less than their words do; letters alone are kept here only.
MEMO_CHUNKS = 120_000
MEMO_PAIRS = 100_000
#: Bytes of the longest word that is merged with others, and how many new words make that worthwhile.
SHORT = 32
MANY = 100
#: Characters of the texts that are cut in words together.
GROUP = 1 << 20
ODD_SPACE = regex.compile(r"[^\S \n]").search


class Merger:
    """Merges the bytes of many short words at once: each round one pair of every word."""

    NONE = np.iinfo(np.int32).max
    ROWS = 2048
    _SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ranks: dict[str, int]):
        self.ids = list(range(max(ranks.values()) + 1))
        #: Beyond a word's end; in no pair.
        self.end = len(self.ids)
        pairs = [(a, b, rank) for token, rank in ranks.items() for n in range(1, len(token)) if (a := ranks.get(token[:n])) is not None and (b := ranks.get(token[n:])) is not None]
        left, right, found = np.array(pairs, np.int64).reshape(-1, 3).T
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.found = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.NONE, np.int32)
        key = self._key(left, right)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[free]
            own = self.keys[slot] == key
            self.found[slot[own]] = found[own]
            key, found, slot = key[~own], found[~own], (slot[~own] + 1) & self.mask
        self.single = np.array([ranks[chr(i)] for i in range(256)], np.int32)
        self.double = self.rank(np.repeat(self.single, 256), np.tile(self.single, 256)).reshape(256, 256)

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) * (self.end + 1) + right

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * self._SPREAD) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or ``NONE``."""
        key = self._key(left, right)
        slot = self._slot(key)
        there = self.keys[slot]
        result = np.where(there == key, self.found[slot], self.NONE)
        rest = np.flatnonzero((there != key) & (there >= 0))
        while len(rest):
            slot[rest] = at = (slot[rest] + 1) & self.mask
            there = self.keys[at]
            hit = there == key[rest]
            result[rest[hit]] = self.found[at[hit]]
            rest = rest[~hit & (there >= 0)]
        return result

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each word."""
        out: list[tuple[int, ...]] = [()] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for start in range(0, len(order), self.ROWS):
            self._merge(words, order[start : start + self.ROWS], out)
        return out

    def _merge(self, words: list[bytes], order: list[int], out: list[tuple[int, ...]]) -> None:
        width = len(words[order[-1]])
        letters = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in order]), np.uint8).reshape(-1, width)
        size = np.array([len(words[i]) for i in order])
        beyond = np.arange(width) >= size[:, None]
        tokens, ranks = self.single[letters], self.double[letters[:, :-1], letters[:, 1:]]
        tokens[beyond] = self.end
        ranks[beyond[:, 1:]] = self.NONE
        which = np.array(order)
        while True:
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(ranks), np.int64)
            best = ranks[np.arange(len(at)), at] if ranks.shape[1] else np.full(len(at), self.NONE)
            over = best == self.NONE
            if over.any():
                # rows from ranges share their numbers, so memos are small
                for i, n, row in zip(which[over].tolist(), size[over].tolist(), tokens[over].tolist()):
                    out[i] = tuple(map(self.ids.__getitem__, row[:n]))
                if over.all():
                    return
                go = ~over
                tokens, ranks, which, size, at, best = tokens[go], ranks[go], which[go], size[go], at[go], best[go]
            rows, last = np.arange(len(at)), tokens.shape[1] - 2
            tokens[rows, at] = best
            tokens = tokens[np.arange(last + 2) != at[:, None] + 1].reshape(len(at), -1)
            ranks = ranks[np.arange(last + 1) != at[:, None]].reshape(len(at), -1)
            size -= 1
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.rank(tokens[some, at[some] - 1], best[some])
            some = np.flatnonzero(at < last)
            ranks[some, at[some]] = self.rank(best[some], tokens[some, at[some] + 1])


class Codec:
    """Encoder and decoder for a file of ``base64(token) rank`` lines."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, file)}
        self.ranks = ranks
        self.bytes = {rank: token.encode("latin-1") for token, rank in ranks.items()}
        self.text = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.most = max(map(len, ranks))
        self.parts = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                self.parts[rank] = self._last_merge(token)
        self.merger = Merger(ranks)
        self.shorter: dict[int, int] = {}
        #: By string of a trie node (there are few of them), the longest token it begins with.
        self.first: dict[str, int] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces = Memo(self._piece, MEMO_WORDS, "bpe")
        self.chunks = Memo(self._chunk, MEMO_CHUNKS, "bpe")
        self.words = Memo(self._piece, MEMO_CHUNKS, "bpe")

    def _last_merge(self, token: str) -> tuple[int, int]:
        """The two tokens whose merge makes ``token`` (itself, if nothing does)."""
        own = self.ranks[token]
        pieces = list(token)
        while len(pieces) > 2:
            best, at = own, -1
            for i in range(len(pieces) - 1):
                rank = self.ranks.get(pieces[i] + pieces[i + 1])
                if rank is not None and rank < best:
                    best, at = rank, i
            if at < 0:
                return own, own
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        return self.ranks[pieces[0]], self.ranks[pieces[1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE keeps ``a`` and ``b`` apart when they stand side by side.

        Undo the later of the two tokens step by step; a merge across the
        border that would have come earlier than the step undone makes it False.
        """
        pair = a << 32 | b
        known = self.pairs.get(pair)
        if known is not None:
            return known
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        left, right, limit = a, b, len(self.ranks) + 2
        result = True
        while True:
            joined = self.ranks.get(self.text[left] + self.text[right])
            if joined is not None and joined < limit:
                result = False
                break
            # the higher rank was merged later; of equals, the left one came first
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left":
                    tail = self.parts.get(left, (left, left))[1]
                    if tail != left:
                        limit, left = left, tail
                        break
                else:
                    head = self.parts.get(right, (right, right))[0]
                    if head != right:
                        limit, right = right + 1, head
                        break
            else:
                break  # nothing left to undo
        self.pairs[pair] = result
        return result

    def next_shorter(self, token: int) -> int:
        """The longest vocabulary token that is a proper prefix, or -1."""
        found = self.shorter.get(token)
        if found is None:
            text, found = self.text[token], -1
            for n in range(len(text) - 1, 0, -1):
                if (rank := self.ranks.get(text[:n])) is not None:
                    found = rank
                    break
            self.shorter[token] = found
        return found

    def longest(self, piece: str, at: int) -> int:
        """The longest token that starts at ``at``.

        The automaton's trie tells how far any token could reach; single bytes
        are tokens, so a match is found.
        """
        rest = piece[at : at + self.most]
        rest = rest[: self.automaton.longest_prefix(rest)]
        rank = self.first.get(rest)
        if rank is None:
            rank = self.first[rest] = next(r for n in range(len(rest), 0, -1) if (r := self.ranks.get(rest[:n])) is not None)
        return rank

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Token ids of one pre-token given as Latin-1 characters."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        return self._by_backtracking(piece)

    def _by_backtracking(self, piece: str) -> tuple[int, ...]:
        starts = [-1] * len(piece)
        tokens: list[int] = []
        dead = bytearray(len(piece) + 1)
        size, pairs, shorter = self.size, self.pairs, self.shorter
        at, token, last = 0, self.longest(piece, 0), -1
        while True:
            end = at + size[token]
            if not dead[end]:
                fits = last < 0 or pairs.get(last << 32 | token)
                if fits is None:
                    fits = self.compatible(last, token)
                if fits:
                    tokens.append(token)
                    if end == len(piece):
                        return tuple(tokens)
                    at, last = end, token
                    token = starts[at]
                    if token < 0:
                        token = starts[at] = self.longest(piece, at)
                    continue
            less = shorter.get(token)
            if less is None:
                less = self.next_shorter(token)
            if less >= 0:
                token = less
                continue
            # no token fits here after the one before: take that back
            dead[at] = 1
            token = tokens.pop()
            at -= size[token]
            last = tokens[-1] if tokens else -1

    def _piece(self, piece: str) -> tuple[int, ...]:
        return self.encode_piece(piece.encode("utf-8").decode("latin-1"))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        # letters alone are one pre-token, and the chunk's memo keeps it; newer letters depend on the
        # Unicode version, so the pattern tells them
        if chunk.isalpha() and (chunk.isascii() or max(chunk) < "\u0250"):
            return self._piece(" " + chunk)
        word = chunk[:-1]
        if chunk and chunk[-1] in ".,;:!?" and word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            return (*self.pieces[" " + word], *self.pieces[chunk[-1]])
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, self.find(" " + chunk))))

    def encode(self, value: str) -> list[int]:
        """Token ids of a whole text.

        Between single spaces, pre-tokens don't depend on what lies around, so
        chunks between spaces are memoised as a whole. Only where a space
        touches other white space does the pattern run over the text at once.
        """
        if "  " in value or "\n " in value or " \n" in value or ODD_SPACE(value):
            return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(value))))
        first, *rest = value.split(" ")
        out = [t for piece in self.find(first) for t in self.pieces[piece]]
        out.extend(chain.from_iterable(map(self.chunks.__getitem__, rest)))
        return out

    def encode_all(self, values: Iterable[str]) -> Iterator[list[int]]:
        """Token ids of each text, as ``encode`` gives them; new words of some texts are merged at once."""
        group, size = [], 0
        for value in values:
            group.append(value)
            size += len(value)
            if size >= GROUP:
                yield from self._encode_group(group)
                group, size = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, values: list[str]) -> Iterator[list[int]]:
        cut = [self.find(value) for value in values]
        words = self.words
        new = [w for w in set().union(*cut).difference(words.old) if w not in words]
        todo = [(w, b) for w in new if len(b := w.encode("utf-8")) <= SHORT and b.decode("latin-1") not in self.ranks]
        if len(todo) >= MANY:
            for (word, _), tokens in zip(todo, self.merger.merge([b for _, b in todo])):
                words.put(word, tokens)
        for pieces in cut:
            yield list(chain.from_iterable(map(words.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return Codec(path)


on_release("bpe", codec.cache_clear)


def _runner(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe")
        own = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                ids, ends, same = [], [0], []
                missing = []
                values = part.column(1).to_pylist()
                coded = own.encode_all(v for v in values if v is not None)
                for value in values:
                    if value is None:
                        missing.append(True)
                        same.append(None)
                    else:
                        missing.append(False)
                        tokens = next(coded)
                        same.append(own.decode(tokens) == value.encode("utf-8"))
                        ids.append(np.array(tokens, np.int32))
                    ends.append(ends[-1] + (0 if missing[-1] else len(ids[-1])))
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array(missing))
                yield pa.record_batch({"doc_id": part.column(0), "n_tokens": pa.array([None if m else b - a for a, b, m in zip(ends, ends[1:], missing)], pa.int32()), "token_ids": tokens, "round_trip": pa.array(same, pa.bool_())})

    return run


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip) for every row.

    round_trip tells whether decoding the ids gave the text's bytes back.
    Defined cases: a null text gives nulls; an empty text gives no tokens and
    true; null ids and repeated rows pass row by row; whole texts are encoded
    however long; an empty table gives an empty result; other columns are not
    read. No shuffle.
    """
    if not os.path.exists(path):
        raise FileNotFoundError(f"tokenizer vocabulary: {path}")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_runner(path), "doc_id long, n_tokens int, token_ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids); null ids arrays give null.

    Bytes that aren't UTF-8 become U+FFFD; an id outside the vocabulary or a
    null element is skipped.
    """

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        claim("bpe")
        own = codec(path)
        for batch in batches:
            yield pa.array([None if v is None else b"".join(own.bytes.get(i, b"") for i in v).decode("utf-8", "replace") for v in batch.to_pylist()], pa.string())

    return tokens.select("doc_id", text("token_ids").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
