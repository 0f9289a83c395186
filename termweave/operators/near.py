"""Windows of words within an edit distance of labels, in one pass over each text.

For dictionaries that every task holds. Texts are read where they lie, in slices;
no window becomes a row unless a label is near. As in ``fuzzy``, one of k + 1
segments of a label stays whole with at most as many edits before it as its
number and the rest behind it. So windows are tested at the few places where a
segment may stand, all windows of a length at once, by hashes of segments; what
passes is verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from ..functions.tokenizers import Cuts, Texts, code_kinds, ranges, slices

SLICE_BYTES = 1 << 20
#: Pairs of a window and a label that are verified at once.
PAIRS = 50_000
#: Bits of a hash that are looked up first.
TABLE_BITS = 14
_FACTORS = np.random.default_rng(0).integers(1, 1 << 31, 4096, np.uint32) * np.uint32(2) + np.uint32(1)


def _hashes(codes: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """By size: hashes of the runs of so many codes, by the place of the first."""
    codes = codes.astype(np.uint32)
    out, total = {}, np.zeros(len(codes), np.uint32)
    for size in range(1, max(sizes, default=0) + 1):
        total = total[: max(0, len(codes) - size + 1)] + codes[size - 1 :] * _FACTORS[(size - 1) % len(_FACTORS)]
        if size in sizes:
            out[size] = total * np.uint32(0x9E3779B1)
    return out


def _letters(texts: Texts) -> np.ndarray:
    """A bit per kind of letter in each row, spaces apart (codes that share a bit are one kind)."""
    bits = np.where(texts.codes == 32, np.uint64(0), np.uint64(1) << (texts.codes.astype(np.uint64) & np.uint64(63)))
    filled = texts.at[:-1] < texts.at[1:]
    out = np.zeros(len(filled), np.uint64)
    if filled.any():
        out[filled] = np.bitwise_or.reduceat(bits, texts.at[:-1][filled])
    return out


def _matrix(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, fill: int) -> np.ndarray:
    """A row per run of codes, filled up."""
    out = np.full((len(starts), int(sizes.max(initial=0))), fill, np.int32)
    out[np.repeat(np.arange(len(starts)), sizes), ranges(np.zeros(len(sizes), np.int64), sizes)] = codes[ranges(starts, sizes)]
    return out


def distances(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """Edits from each row of ``a`` (n codes) to that of ``b`` (m codes); k + 1 if more than k."""
    far = k + 1
    kind = np.int8 if far < 100 else np.int64
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    found = np.full(len(n), far, kind)
    row = [np.full(len(n), d if d >= 0 else far, kind) for d in range(-k, k + 1)]
    none = np.full(len(n), far, kind)
    one = kind(1)
    for i in range(int(n.max(initial=0)) + 1):
        if i:
            new: list[np.ndarray] = []
            for d in range(-k, k + 1):
                j = i + d
                if j < 0 or j > len(b):
                    new.append(none)
                    continue
                if j == 0:
                    new.append(np.full(len(n), min(i, far), kind))
                    continue
                best = row[d + k] + (a[i - 1] != b[j - 1])
                if d < k:
                    best = np.minimum(best, row[d + k + 1] + one)
                if d > -k:
                    best = np.minimum(best, new[-1] + one)
                new.append(np.minimum(best, kind(far)))
            row = new
        ends = np.flatnonzero((n == i) & (np.abs(m - n) <= k))
        if len(ends):
            found[ends] = np.stack([x[ends] for x in row])[(m - n)[ends] + k, np.arange(len(ends))]
    return found


class NearLabels:
    """Labels (normalized, ...), broadcast as rows and unpacked once per worker."""

    def __init__(self, rows: pa.Table, k: int, longest: int, letters: str):
        self.rows, self.k, self.longest, self.letters = rows.combine_chunks(), k, max(1, longest), letters
        self.ready = False

    def __getstate__(self):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.rows.schema) as out:
            out.write_table(self.rows)
        return sink.getvalue().to_pybytes(), self.k, self.longest, self.letters

    def __setstate__(self, state):
        self.__init__(pa.ipc.open_stream(state[0]).read_all(), *state[1:])

    def prepare(self) -> NearLabels:
        if self.ready:
            return self
        names = self.rows.column("normalized").to_pylist()
        self.columns = {name: self.rows.column(name).combine_chunks() for name in self.rows.column_names}
        self.texts = Texts(pa.array(names, pa.string()))
        self.sizes = np.diff(self.texts.at)
        self.kinds = _letters(self.texts)
        #: by length: the labels; by length and segment: hashes in order, their labels, and a table of first bits
        self.by_size = {int(m): np.flatnonzero(self.sizes == m) for m in np.unique(self.sizes)}
        self.segments: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        bounds = {(m, j): self.bounds(m, j) for m in self.by_size if m > self.k for j in range(self.k + 1)}
        self.runs = sorted({end - first for first, end in bounds.values()})
        hashes = _hashes(self.texts.codes, self.runs)
        for (m, j), (first, end) in bounds.items():
            labels = self.by_size[m]
            found = hashes[end - first][self.texts.at[labels] + first]
            order = np.argsort(found, kind="stable")
            table = np.zeros(1 << TABLE_BITS, bool)
            table[found >> np.uint32(32 - TABLE_BITS)] = True
            self.segments[m, j] = found[order], labels[order], table
        self.letter = code_kinds(self.letters) == 2
        self.normal = regex.compile(f"[^{self.letters}]+").sub
        self.ready = True
        return self

    def bounds(self, m: int, j: int) -> tuple[int, int]:
        return j * m // (self.k + 1), (j + 1) * m // (self.k + 1)

    def candidates(self, hashes: dict[int, np.ndarray], starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, label) pairs that may be near: once each.

        An edit takes one kind of letter away and brings one at most.
        """
        k, sizes = self.k, ends - starts
        order = np.argsort(sizes, kind="stable")
        begin = np.searchsorted(sizes[order], np.arange(int(sizes.max(initial=0)) + 2))
        pairs: list[np.ndarray] = []

        def pair(windows: np.ndarray, labels: np.ndarray) -> None:
            a, b = kinds[windows], self.kinds[labels]
            like = np.flatnonzero((np.bitwise_count(a & ~b) <= k) & (np.bitwise_count(b & ~a) <= k))
            pairs.append(windows[like] * len(self.sizes) + labels[like])

        for n in range(len(begin) - 1):
            windows = order[begin[n] : begin[n + 1]]
            if not len(windows):
                continue
            at = starts[windows]
            for m in range(n - k, n + k + 1):
                if m not in self.by_size:
                    continue
                if m <= k:
                    labels = self.by_size[m]
                    pair(np.repeat(windows, len(labels)), np.tile(labels, len(windows)))
                    continue
                gap = n - m
                for j in range(k + 1):
                    first, end = self.bounds(m, j)
                    known, labels, table = self.segments[m, j]
                    for shift in range(max(-j, gap - (k - j)), min(j, gap + (k - j)) + 1):
                        if first + shift < 0 or end + shift > n:
                            continue
                        asked = hashes[end - first][at + (first + shift)]
                        hit = np.flatnonzero(table[asked >> np.uint32(32 - TABLE_BITS)])
                        if not len(hit):
                            continue
                        low = np.searchsorted(known, asked[hit], "left")
                        many = np.searchsorted(known, asked[hit], "right") - low
                        pair(np.repeat(windows[hit], many), labels[ranges(low, many)])
        once = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return np.divmod(once, max(1, len(self.sizes)))

    def near(self, texts: Texts, hashes: dict[int, np.ndarray], starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, label, distance) of windows from ``starts`` to ``ends`` (code points), by window; ``kinds`` are their letters."""
        windows, labels = self.candidates(hashes, starts, ends, kinds)
        if not len(windows):
            return windows, labels, windows
        # equal windows are compared once
        own, place = np.unique(windows, return_inverse=True)
        spelled = texts.surface(np.zeros(len(own), np.int64), starts[own], ends[own]).dictionary_encode().indices.to_numpy()
        asked, first, back = np.unique(spelled[place].astype(np.int64) * len(self.sizes) + labels, return_index=True, return_inverse=True)
        found = np.empty(len(asked), np.int64)
        for at in range(0, len(asked), PAIRS):
            w, label = windows[first[at : at + PAIRS]], labels[first[at : at + PAIRS]]
            n, m = ends[w] - starts[w], self.sizes[label]
            found[at : at + PAIRS] = distances(_matrix(texts.codes, starts[w], n, -1), n, _matrix(self.texts.codes, self.texts.at[label], m, -2), m, self.k)
        each = found[back]
        kept = each <= self.k
        return windows[kept], labels[kept], each[kept]

    def scan(self, texts: pa.StringArray, cut: Cuts, columns: Sequence[str]) -> Iterator[dict]:
        """Rows and ``columns`` of the windows of ``texts`` that are near labels, for each number of words."""
        source = Texts(texts)
        tokens = cut(source, texts)
        encoded = tokens.tokens.dictionary_encode()
        whole = Texts(encoded.dictionary)
        # most tokens are letters alone
        plain = np.logical_and.reduceat(self.letter[whole.codes], whole.at[:-1]) if len(whole.codes) else []
        spelled = [t.lower() if p else self.normal(" ", t).lower().strip(" ") for t, p in zip(encoded.dictionary.to_pylist(), plain)]
        words = pa.array(spelled, pa.string()).dictionary_encode()
        ids = words.indices.to_numpy()[encoded.indices.to_numpy()]
        kept = np.flatnonzero(np.array([w != "" for w in words.dictionary.to_pylist()], bool)[ids]) if len(ids) else np.zeros(0, np.int64)
        ids, rows, starts, ends = ids[kept], tokens.rows[kept], tokens.starts[kept], tokens.ends[kept]
        spaced = pc.binary_join_element_wise(words.dictionary, " ", "").cast(pa.string())
        each, stream = Texts(spaced), Texts(spaced.take(pa.array(ids)))
        each_kinds = _letters(each)
        kinds, hashes = each_kinds[ids], _hashes(stream.codes, self.runs)
        for count in range(1, self.longest + 1):
            last = count - 1
            if count > 1:
                kinds = kinds[:-1] | each_kinds[ids[last:]]
            at = np.flatnonzero(rows[: max(0, len(rows) - last)] == rows[last:])
            if count == 1:
                # each word is looked up once
                word, label, distance = self.near(each, _hashes(each.codes, self.runs), each.at[:-1], each.at[1:] - 1, each_kinds)
                place = np.searchsorted(word, ids, "left")
                many = np.searchsorted(word, ids, "right") - place
                first, picked = np.repeat(at, many), ranges(place, many)
                label, distance = label[picked], distance[picked]
            else:
                window, label, distance = self.near(stream, hashes, stream.at[at], stream.at[at + count] - 1, kinds[at])
                first = at[window]
            if not len(first):
                continue
            made = {
                "start": lambda: pa.array(starts[first], pa.int32()),
                "end": lambda: pa.array(ends[first + last], pa.int32()),
                "surface": lambda: source.surface(rows[first], starts[first], ends[first + last]),
                "window": lambda: stream.surface(np.zeros(len(first), np.int64), stream.at[first], stream.at[first + count] - 1),
                "n": lambda: pa.array(np.full(len(first), count, np.int32)),
                "distance": lambda: pa.array(distance, pa.int32()),
            }
            yield {"rows": rows[first]} | {c: made[c]() if c in made else self.columns[c].take(pa.array(label)) for c in columns}


def runner(shared, cut: Cuts, key: str, columns: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (key, text) to those of ``columns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.prepare()
        others = [c for c in columns if c != key]
        for batch in batches:
            for first, end in slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(first, end - first)
                for found in own.scan(part.column(1), cut, others):
                    found[key] = part.column(0).take(pa.array(found.pop("rows")))
                    yield pa.record_batch({name: found[name] for name in columns})

    return run
