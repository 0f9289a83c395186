"""Quality rules: documents far from the robust centre of their kind go.

A document becomes a vector of transformed statistics. For each language and
source, minimum-covariance-determinant estimates of location and scatter come
from the half or more of the documents whose covariance has the least
determinant; documents whose Mahalanobis distance is too large are rejected.

The search runs C-steps over the whole table: distances to the present
estimates, the quantile of the distances per group, then mean and covariance of
the documents within it, until no group's determinant moves. Each step is two
passes that leave one small row per task and group, so a group may be larger
than any machine's memory. The start is the spatial-sign covariance around
coordinatewise medians, which needs no random subsets. Only the vectors are read
again, from a table in the shared folder.

Estimates are made for each language and source, each language, and all
documents. A document's distance is the mean of those to its group, its language
and all: the group's counts by its number of documents against ``prior``
documents of its language's, and the language's likewise against that of all. So
a group of few documents is judged by what is known of its language, and there
is no size at which the rule changes. The driver and every task hold one
estimate (some 600 bytes) per group, so ``source`` must be a label of a corpus
and not, say, a web address.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chi2_quantile, claim, drop_tables, gamma_p, materialise, spread

STATS = ("log_words", "word_length", "symbols", "digits", "capitals", "distinct", "top_word", "line_words")
DIM = len(STATS)
#: Least scale of each coordinate: below it a group's spread says nothing.
FLOOR = np.array([0.5, 0.10, 0.05, 0.15, 0.08, 0.15, 0.05, 0.5])
SHRINK = 10
BINS = 2048
SUPPORT = 0.7
#: Vectors have heavier tails than normal ones, so only gross outliers go.
CUT = 1 - 1e-12
PRIOR = 200.0
#: C-steps at most; groups settle in some ten. One that hasn't by then is named in a warning.
STEPS = 60
SETTLED = 1e-3
#: Joins language and source to a key; numpy would strip a NUL at the end.
JOIN = "\x1f"
_CAPS, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_PLAIN = bytes(c for c in range(128) if chr(c).isalnum() or chr(c) in " \n\t\r.,;:!?'\"-()") + bytes(range(128, 256))


def statistics(text: str) -> list[float] | None:
    """The transformed vector of a text; None if it has no words."""
    words = text.split()
    n = len(words)
    if not n:
        return None
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    letters = sum(map(len, words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    caps = size - len(raw.translate(None, _CAPS))
    digits = size - len(raw.translate(None, _DIGITS))
    symbols = len(raw.translate(None, _PLAIN))
    lines = text.count("\n") + 1
    # shares are shrunk by a few pseudo-words, or one word would make an outlier;
    # the number of distinct words grows with a power of the length
    return [
        math.log(n + SHRINK),
        math.log((letters + 5 * SHRINK) / (n + SHRINK)),
        math.sqrt(symbols / (size + 6 * SHRINK)),
        math.sqrt(digits / (size + 6 * SHRINK)),
        math.sqrt(caps / (size + 6 * SHRINK)),
        math.log(len(counts) + SHRINK) - 0.9 * math.log(n + SHRINK),
        math.sqrt((max(counts.values()) - 1) / (n + SHRINK)),
        math.log(n / lines + SHRINK),
    ]


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, x array<double>); x is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) if t else None for t in batch.column(3).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "lang": batch.column(1), "source": batch.column(2), "x": pa.array(rows, pa.list_(pa.float64()))})

    return slim(docs).mapInArrow(run, "doc_id long, lang string, source string, x array<double>")


def slim(docs: DataFrame) -> DataFrame:
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text, F.col("text").cast("string").alias("text"))


class Estimate:
    """Location and inverse scatter on coordinates scaled by ``scale``."""

    def __init__(self, centre: np.ndarray, cov: np.ndarray, scale: np.ndarray, count: float = 0.0):
        self.centre, self.scale, self.count = centre, scale, count
        # a ridge keeps coordinates that don't vary from deciding everything
        self.cov = cov + np.eye(len(centre)) * 0.05
        self.inverse = np.linalg.inv(self.cov)

    def distance(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        return np.einsum("ij,jk,ik->i", z, self.inverse, z)


class Pool:
    """Weighted mean of squared distances: ``own`` by its documents against ``prior`` documents of ``parent``'s."""

    def __init__(self, own: Estimate, parent: Estimate | Pool | None, prior: float):
        self.own, self.parent = own, parent
        self.share = own.count / (own.count + prior) if parent else 1.0

    def distance(self, x: np.ndarray) -> np.ndarray:
        near = self.share * self.own.distance(x)
        return near + (1 - self.share) * self.parent.distance(x) if self.parent else near


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)


def by_group(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    keys = np.array(batch.column(0).to_pylist(), dtype=object)
    x = matrix(batch.column(1))
    for key in set(keys.tolist()):
        yield key, x[keys == key]


def level(d: np.ndarray) -> np.ndarray:
    """Bin of a squared distance on a logarithmic scale."""
    return np.clip((np.log2(d + 2.0**-20) + 20) * (BINS / 60), 0, BINS - 1).astype(np.int64)


def edge(b: int) -> float:
    return 2.0 ** ((b + 1) * 60 / BINS - 20) - 2.0**-20


def summed(grouped: DataFrame, work: Callable[[str, np.ndarray], np.ndarray | None], finish: Callable[[np.ndarray], np.ndarray] = lambda v: v) -> dict[str, np.ndarray]:
    """``finish`` of the sum over the table of ``work(key, x)`` per group.

    Tasks sum their own rows first; reducers add up and finish, so the driver
    sees one small row per group. Where ``work`` gives None the group is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality_rules")
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for key, x in by_group(batch):
                if (found := work(key, x)) is not None:
                    total[key] = total.get(key, 0) + found
        if total:
            yield pa.record_batch({"key": pa.array(list(total), pa.string()), "v": pa.array([v.astype(float).tobytes() for v in total.values()], pa.binary())})

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        v = finish(sum(np.frombuffer(b) for b in table["v"].to_pylist()))
        return pa.table({"key": pa.array([key[0].as_py()], pa.string()), "v": pa.array([v.tobytes()], pa.binary())})

    parts = grouped.mapInArrow(run, "key string, v binary").groupBy("key").applyInArrow(add, "key string, v binary")
    return {r["key"]: np.frombuffer(bytes(r["v"])) for r in parts.toLocalIterator()}


def moments(z: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])


def from_moments(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, s, q = v[0], v[1 : 1 + DIM], v[1 + DIM :].reshape(DIM, DIM)
    mean = s / n
    return mean, q / n - np.outer(mean, mean)


WHOLE = JOIN * 3


def language_key(lang: str) -> str:
    return lang + JOIN * 2


def group_keys(table: DataFrame) -> DataFrame:
    """(doc_id, x, lang, source) of the rows with words, and ``keys``: the groups whose estimates a row takes part in."""
    keys = F.array(F.concat_ws(JOIN, "lang", "source"), F.concat("lang", F.lit(JOIN * 2)), F.lit(WHOLE))
    return table.where("x is not null").select("doc_id", "x", "lang", "source", keys.alias("keys"))


def fit(grouped: DataFrame, support: float = SUPPORT, steps: int = STEPS) -> dict[str, Estimate]:
    """MCD estimates per key of ``grouped`` (key, x)."""
    rows = grouped.select("key", "x")
    middle = rows.groupBy("key").agg(*[F.percentile_approx(F.col("x")[i], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000).alias(f"q{i}") for i in range(DIM)])
    start: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for r in middle.toLocalIterator():
        q = np.array([r[f"q{i}"] for i in range(DIM)])
        start[r["key"]] = q[:, 1], np.maximum((q[:, 2] - q[:, 0]) / 1.349, FLOOR)

    def sign(key, x):
        centre, scale = start[key]
        z = (x - centre) / scale
        return moments(z / np.maximum(np.sqrt((z**2).sum(1, keepdims=True)), 1e-9))

    estimates = {}
    for key, v in summed(rows, sign).items():
        centre, scale = start[key]
        estimates[key] = Estimate(centre, (v[1 + DIM :].reshape(DIM, DIM) / v[0]) * DIM, scale, v[0])

    def quantile(histogram: np.ndarray) -> np.ndarray:
        return np.array([edge(int(np.searchsorted(np.cumsum(histogram), support * histogram.sum())))])

    last: dict[str, float] = {}
    moving = set(estimates)
    for _ in range(steps):
        if not moving:
            break
        fixed = {k: estimates[k] for k in moving}
        cut = summed(rows, lambda k, x: np.bincount(level(fixed[k].distance(x)), minlength=BINS) if k in fixed else None, quantile)

        def inner(key, x):
            if key not in fixed:
                return None
            own = fixed[key]
            return moments((x[own.distance(x) <= cut[key][0]] - own.centre) / own.scale)

        for key, v in summed(rows, inner).items():
            old = fixed[key]
            mean, cov = from_moments(v)
            estimates[key] = Estimate(old.centre + mean * old.scale, cov, old.scale, old.count)
            now = float(np.linalg.slogdet(estimates[key].cov)[1])
            if abs(now - last.get(key, math.inf)) < SETTLED:
                moving.discard(key)
            last[key] = now
    if moving:
        warnings.warn(f"no settled determinant after {steps} steps: {sorted(moving)[:5]}", stacklevel=2)
    # the covariance of the inner part is too small by a known factor if the rest is normal
    inner_chi = chi2_quantile(support, DIM)
    factor = support / gamma_p(DIM / 2 + 1, inner_chi / 2)
    for e in estimates.values():
        e.inverse = np.linalg.inv(e.cov * factor)
    return estimates


def judges(estimates: dict[str, Estimate], prior: float) -> dict[str, Pool]:
    """What judges each language and source: its own estimate with its language's and that of all."""
    if not estimates:
        return {}
    whole = Pool(estimates[WHOLE], None, prior)
    spoken = {k: Pool(e, whole, prior) for k, e in estimates.items() if k.endswith(JOIN * 2) and k != WHOLE}
    return {k: Pool(e, spoken[language_key(k.split(JOIN)[0])], prior) for k, e in estimates.items() if k != WHOLE and k not in spoken}


def distances(docs: DataFrame, support: float = SUPPORT, prior: float = PRIOR) -> DataFrame:
    """(doc_id, distance): squared robust distance, null without words."""
    table = materialise(vectors(docs), "vectors")
    grouped = group_keys(table)
    shared = docs.sparkSession.sparkContext.broadcast(judges(fit(grouped.select(F.explode("keys").alias("key"), "x"), support), prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, x, out = np.array(batch.column(0).to_pylist(), dtype=object), matrix(batch.column(1)), np.zeros(batch.num_rows)
            for key in set(keys.tolist()):
                out[keys == key] = shared.value[key].distance(x[keys == key])
            yield pa.record_batch({"doc_id": batch.column(2), "distance": pa.array(np.round(out, 6))})

    judged = grouped.select(F.col("keys")[0].alias("key"), "x", "doc_id").mapInArrow(run, "doc_id long, distance double")
    wordless = table.where("x is null").select("doc_id", F.lit(None).cast("double").alias("distance"))
    found = materialise(judged.unionByName(wordless), "distances")
    drop_tables(table)
    return found


def kept(docs: DataFrame, cut: float = CUT, support: float = SUPPORT, prior: float = PRIOR) -> DataFrame:
    """(doc_id, distance) of the documents within the cut.

    Kept: distance at most the ``cut`` quantile of chi-squared with ``DIM``
    degrees of freedom. Defined cases: null, empty and wordless texts are
    rejected; null languages and sources count as ''; null ids and repeated
    rows pass row by row; ties at the cut stay; whole texts are read however
    long; an empty table gives an empty result; other columns are not read.
    """
    return distances(docs, support, prior).where(F.col("distance") <= chi2_quantile(cut, DIM))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
