"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
import weakref
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids up to which a table of them is broadcast (some 64 MB); beyond, joins shuffle.
BROADCAST_IDS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Where the setting is missing, a local session (tests) gets a temporary
    folder; a cluster session raises, since a machine-local folder would be
    unreadable from other executors.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    known = getattr(sc, "_termweave_dir", None)
    if known is None:
        known = sc._termweave_dir = tempfile.mkdtemp(prefix="termweave-")
    return known


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/termweave/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The files are replicated by the shared file system, so losing an executor
    costs nothing that was already written.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a finished intermediate table through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_tables(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    for table in tables:
        drop_path(table.sparkSession, table._written_to)


_MEMOS: weakref.WeakSet = weakref.WeakSet()
_RELEASES: list[tuple[str, Callable[[], object]]] = []
_worker = {"owner": ""}


class Memo(dict):
    """Results of ``make`` by key, in two generations of ``size`` entries each.

    When the young generation is full it becomes the old one; what is asked for
    again moves back. Keys of 80 characters and more aren't kept, so a memo
    holds at most some 300 bytes times twice its size. Python workers outlive
    tasks: ``claim`` frees the memos of operators that ran before.
    """

    __hash__ = object.__hash__
    __eq__ = object.__eq__

    def __init__(self, make, size: int, owner: str = ""):
        super().__init__()
        self.make, self.size, self.owner, self.old = make, size, owner, {}
        _MEMOS.add(self)

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) >= 80:
                return found
        self.put(key, found)
        return found

    def put(self, key, found) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found

    def free(self) -> None:
        self.clear()
        self.old = {}


def on_release(owner: str, free: Callable[[], object]) -> None:
    """``free`` is called when another operator claims the worker."""
    _RELEASES.append((owner, free))


def claim(owner: str) -> None:
    """Called where a task of ``owner`` starts: free what others hold in this worker.

    Memos of other operators are emptied and freed memory goes back to the
    system, so a chain of operators in reused workers needs no more memory than
    the most demanding one.
    """
    if _worker["owner"] == owner:
        return
    _worker["owner"] = owner
    for memo in list(_MEMOS):
        if memo.owner != owner:
            memo.free()
    for other, free in _RELEASES:
        if other != owner:
            free()
    give_back()


def give_back() -> None:
    """Freed memory of this worker goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bytes_of(table: DataFrame) -> int:
    """The bytes of the files ``table`` is made of, as far as the planner knows them; 0 if not.

    By them work is cut in tasks; results don't depend on it.
    """
    leaves = table._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # tables without files, such as rows of the driver, are said to be endless
    return sum(s for s in sizes if s < 1 << 60)


def tasks_for(table: DataFrame, each: int, most: int = 1 << 17) -> int:
    """Partitions for a shuffle of ``table``: ``spark.sql.shuffle.partitions``, more where they would hold over ``each`` bytes."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most, -(-bytes_of(table) // each)))


def few(ids: DataFrame) -> DataFrame:
    """``ids``, a written table of narrow rows, marked for broadcast if small.

    Its rows are counted first: up to ``BROADCAST_IDS`` they are sent to every
    executor; beyond, the join shuffles both sides.
    """
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def spread(table: DataFrame) -> DataFrame:
    """``table`` over all cores where its files have fewer splits than those.

    A small file with one row group would be one task's work. Input with more
    splits than cores is left as it is, without a shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores before them until no column is called so."""
    taken = {c.lower() for c in docs.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
    return found


def fmix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, in place where possible."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function (series / continued fraction)."""
    if x <= 0:
        return 0.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-14:
            n += 1
            term *= x / n
            total += term
        return total * lead
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return 1 - lead * h


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 10.0 * df + 2000.0
    for _ in range(200):
        mid = (low + high) / 2
        if gamma_p(df / 2, mid / 2) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2
