"""Matching in one pass over each text, for dictionaries that fit every task.

The postings are broadcast (their bytes are checked, see ``Index``), and each
task reads its texts where they lie: no text is shuffled and no token becomes a
row. From every content token a match walks right through states; a state holds
the labels that have all roots so far. All walks of a slice of texts take a step
at once, as arrays of numbers; each pair of a state and a next root is worked out
once. ``match.match`` has the definition; both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokenizers import PATTERN, Cut, Cuts, Texts, Tokenizer, ranges, slices
from .index import Index

MEMO_TOKENS, MEMO_STATES = 100_000, 50_000
#: Annotations of a batch that a task hands on.
BATCH_ROWS = 100_000
STOP, END = -2, -1


def damerau_levenshtein(a: str, b: str) -> int:
    """Edits with adjacent transpositions, substrings edited again allowed."""
    if a == b:
        return 0
    last: dict[str, int] = {}
    top = len(a) + len(b)
    rows = [[top] * (len(b) + 2), [top, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [top, i] + [0] * len(b)
        rows.append(row)
        seen = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), seen
            cost = 1
            if x == y:
                cost, seen = 0, j
            row[j + 1] = min(rows[i][j] + cost, row[j] + 1, rows[i][j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return rows[len(a) + 1][len(b) + 1]


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each value among the distinct ones, and these."""
    encoded = values.dictionary_encode()
    return encoded.indices.to_numpy(), encoded.dictionary


def _sent(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class Matcher:
    """The postings, broadcast as rows and unpacked once per worker.

    A state is a number; those below the number of roots have seen that root only.
    With ``names`` (concept_id, label) and ``theta``, annotations of one token are
    kept if they are near a label, and those of a concept at a place are one.
    """

    def __init__(self, rows: pa.Table, stop: Sequence[str], terms: Sequence[str], names: pa.Table | None = None, theta: float | None = None):
        self.rows, self.stop, self.terms, self.names, self.theta = rows, frozenset(stop), frozenset(terms), names, theta
        self.ready = False

    def __getstate__(self):
        return _sent(self.rows), self.stop, self.terms, self.names and _sent(self.names), self.theta

    def __setstate__(self, state):
        rows, stop, terms, names, theta = state
        self.__init__(pa.ipc.open_stream(rows).read_all(), stop, terms, names and pa.ipc.open_stream(names).read_all(), theta)

    def prepare(self, root: Callable[[str], str]) -> Matcher:
        if self.ready:
            return self
        numbers: dict[tuple[str, int], int] = {}
        self.lengths: list[int] = []
        posted: dict[str, set[int]] = {}
        often: dict[str, set[int]] = {}
        columns = [self.rows.column(c).to_pylist() for c in ("root", "concept_id", "label_index", "cnt", "n_tokens")]
        for name, concept, label, count, length in zip(*columns):
            key = numbers.setdefault((concept, label), len(numbers))
            if key == len(self.lengths):
                self.lengths.append(length)
            posted.setdefault(name, set()).add(key)
            if count >= 2:
                often.setdefault(name, set()).add(key)
        self.numbers = {name: i for i, name in enumerate(posted)}
        self.posted = [frozenset(keys) for keys in posted.values()]
        self.often = [often.get(name, frozenset()) for name in posted]
        self.keyed = list(numbers)
        self.concepts = pa.array([c for c, _ in numbers], pa.string())
        self.labels = np.array([n for _, n in numbers], np.int32)
        self.written: dict[str, set[str]] = {}
        if self.names is not None:
            for concept, label in zip(*(self.names.column(c).to_pylist() for c in ("concept_id", "label"))):
                if label is not None:
                    self.written.setdefault(concept, set()).add(label)
        self.root, self.rows, self.names, self.ready = root, None, None, True
        self.kinds: dict[str, int] = {}
        self.forget()
        return self

    def forget(self) -> None:
        """Back to the states of single roots."""
        self.keys, self.first, self.size = [], [], []
        self.found: list[tuple[int, ...]] = []
        self.spent: list[bool] = []
        self.next: dict[int, int] = {}
        self.judged: dict[tuple[str, int], tuple[int, ...]] = {}
        for number, keys in enumerate(self.posted):
            self.state(keys, number, 1)

    def state(self, keys: frozenset[int], first: int, size: int) -> int:
        self.keys.append(keys)
        self.first.append(first)
        self.size.append(size)
        self.found.append(tuple(sorted(k for k in keys if self.lengths[k] == size)))
        # more tokens than any label has: whatever follows, nothing is found
        self.spent.append(all(self.lengths[k] < size for k in keys))
        return len(self.keys) - 1

    def kind(self, token: str) -> int:
        """STOP for a stop word, END for what ends a walk, else the number of the root."""
        if token.strip(" ") in self.terms:
            found = END
        elif token in self.stop:
            found = STOP
        else:
            found = self.numbers.get(self.root(token), END)
        if len(self.kinds) >= MEMO_TOKENS:
            self.kinds.clear()
        self.kinds[token] = found
        return found

    def step(self, pair: int) -> int:
        """The state after a state and a root, END if there is none."""
        state, nearby = divmod(pair, len(self.posted))
        keys = self.keys[state] & self.posted[nearby]
        allowed = keys and (nearby != self.first[state] or keys & self.often[nearby])
        found = self.state(keys, self.first[state], self.size[state] + 1) if allowed else END
        self.next[pair] = found
        return found

    def near(self, word: str, concept: str) -> bool:
        names = self.written.get(concept, ())
        if self.theta >= 0:
            return self.theta < 1 and word in names
        return any(1 - damerau_levenshtein(word, name) > self.theta for name in names)

    def kept(self, state: int, word: str | None) -> tuple[int, ...]:
        """What is left of a state's labels: near ones if the mention is one token, one a concept."""
        least: dict[str, int] = {}
        for key in self.found[state]:
            concept, label = self.keyed[key]
            if concept not in least or label < self.keyed[least[concept]][1]:
                least[concept] = key
        return tuple(k for c, k in least.items() if word is None or self.near(word, c))

    def walk(self, cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, state) of the walks that find labels, by place; first and last number tokens."""
        if len(self.keys) - len(self.posted) >= MEMO_STATES or len(self.next) >= 4 * MEMO_STATES:
            self.forget()
        known = self.kinds
        numbers, words = _codes(cut.tokens)
        kinds = np.fromiter((k if (k := known.get(w)) is not None else self.kind(w) for w in words.to_pylist()), np.int64, len(words))[numbers]
        content = np.flatnonzero(kinds != STOP)
        kinds, rows = kinds[content], cut.rows[content]
        after = np.full(len(content), END)
        if len(content):
            beside = np.flatnonzero(rows[1:] == rows[:-1])
            after[beside] = kinds[beside + 1]
        first = np.flatnonzero(kinds >= 0)
        state, last = kinds[first], first.copy()
        going = np.flatnonzero(after[first] >= 0)
        while len(going):
            pairs, distinct = _codes(pa.array(state[going] * len(self.posted) + after[last[going]]))
            to = np.fromiter((s if (s := self.next.get(p)) is not None else self.step(p) for p in distinct.to_pylist()), np.int64, len(distinct))[pairs]
            going, to = going[to >= 0], to[to >= 0]
            state[going] = to
            last[going] += 1
            going = going[(after[last[going]] >= 0) & ~np.array(self.spent)[to]]
        finds = np.array([bool(f) for f in self.found], bool)[state]
        return content[first[finds]], content[last[finds]], state[finds]

    def labels_of(self, texts: Texts, cut: Cut, first: np.ndarray, last: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, list[tuple[int, ...]]]:
        """Per walk the number of its set of labels, and these sets."""
        if self.theta is None:
            numbers, states = _codes(pa.array(state))
            return numbers, [self.found[s] for s in states.to_pylist()]
        several = np.array(self.size)[state] > 1
        words, distinct = _codes(texts.surface(cut.rows[first], cut.starts[first], np.where(several, cut.starts[first], cut.ends[last])))
        numbers, pairs = _codes(pa.array(state * (len(distinct) + 1) + words))
        spelled, sets = distinct.to_pylist(), []
        if len(self.judged) > 4 * MEMO_STATES:
            self.judged.clear()
        for pair in pairs.to_pylist():
            s, w = divmod(pair, len(distinct) + 1)
            asked = (None if self.size[s] > 1 else spelled[w], s)
            if asked not in self.judged:
                self.judged[asked] = self.kept(s, asked[0])
            sets.append(self.judged[asked])
        return numbers, sets


@dataclass(frozen=True)
class Scan:
    """What a scan does; filters and reductions by document can become part of it.

    The DataFrames that ``match.match`` and ``match.annotations`` make of one
    carry it as ``scan``, and ``shape`` is what those made of its rows. ``names``
    and ``theta``: see ``Matcher``; ``longest``: of each document the rows of the
    longest match only.
    """

    docs: DataFrame
    index: Index
    stop: Sequence[str]
    terms: Sequence[str]
    root: Callable[[str], str]
    key: str = "doc_id"
    text: str = "text"
    tokenizer: Tokenizer = PATTERN
    surface: bool = False
    theta: float | None = None
    longest: bool = False
    shape: Callable[[DataFrame], DataFrame] = lambda rows: rows

    def but(self, **changes) -> DataFrame:
        return replace(self, **changes).rows()

    def rows(self) -> DataFrame:
        """(key, concept_id, label_index, start, end, matched_length), with ``surface`` also matched_text.

        ``root`` is the root function's plain form. Rows are taken one by one, so
        ``key`` need not be unique.
        """
        names = self.index.labels_in_memory() if self.theta is not None else None
        context = self.docs.sparkSession.sparkContext
        shared = context.broadcast(Matcher(self.index.rows_in_memory(), self.stop, self.terms, names, self.theta))
        run = _runner(shared, self.tokenizer.cutter(self.docs.sparkSession), self.root, self.key, self.surface, self.longest)
        slim = self.docs.select(self.key, F.col(self.text).cast("string").alias("text"))
        schema = f"`{self.key}` {slim.schema[self.key].dataType.simpleString()}, concept_id string, label_index int, start int, end int, matched_length int"
        made = self.shape(slim.mapInArrow(run, schema + (", matched_text string" if self.surface else "")))
        made.scan = self
        return made


def scan_of(rows: DataFrame) -> Scan | None:
    """The scan whose rows these are, unchanged."""
    return getattr(rows, "__dict__", {}).get("scan")


def _runner(shared, cut: Cuts, root: Callable[[str], str], key: str, surface: bool, longest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.prepare(root)
        for batch in batches:
            for begin, end in slices(batch.column(1)):
                part = batch.slice(begin, end - begin)
                texts = Texts(part.column(1))
                tokens = cut(texts, part.column(1))
                first, last, state = own.walk(tokens)
                numbers, sets = own.labels_of(texts, tokens, first, last, state)
                lengths = np.fromiter(map(len, sets), np.int64, len(sets))
                some = np.flatnonzero(lengths[numbers] > 0) if len(sets) else np.zeros(0, np.int64)
                first, last, state, numbers = first[some], last[some], state[some], numbers[some]
                rows, starts, ends = tokens.rows[first], tokens.starts[first], tokens.ends[last]
                sizes = np.array(own.size, np.int64)[state]
                if longest and len(rows):
                    order = np.lexsort((starts, -sizes, starts - ends, rows))
                    best = order[np.append(True, rows[order][1:] != rows[order][:-1])]
                    numbers, rows, starts, ends, sizes = numbers[best], rows[best], starts[best], ends[best], sizes[best]
                flat = np.fromiter((k for keys in sets for k in keys), np.int64, int(lengths.sum()))
                places = np.cumsum(lengths) - lengths
                # as many walks at once as give a batch
                upto = np.cumsum(lengths[numbers]) if len(numbers) else np.zeros(0, np.int64)
                at = 0
                while at < len(upto):
                    done = upto[at - 1] if at else 0
                    to = max(at + 1, int(np.searchsorted(upto, done + BATCH_ROWS, "right")))
                    now = slice(at, to)
                    each = lengths[numbers[now]]
                    keys = flat[ranges(places[numbers[now]], each)]
                    walks = np.repeat(np.arange(to - at), each)
                    columns = {key: part.column(0).take(pa.array(rows[now][walks])), "concept_id": own.concepts.take(pa.array(keys)), "label_index": pa.array(own.labels[keys])}
                    columns |= {name: pa.array(x[now][walks], pa.int32()) for name, x in (("start", starts), ("end", ends), ("matched_length", sizes))}
                    if surface:
                        columns["matched_text"] = texts.surface(rows[now], starts[now], ends[now]).take(pa.array(walks))
                    yield pa.record_batch(columns)
                    at = to

    return run
