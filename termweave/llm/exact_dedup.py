"""Exact dedup: Patricia tries own the texts.

1. Each map task runs its rows through a trie under a byte budget, so copies
   within a task leave as one record: text, least id, ids.
2. Records are partitioned by length and content hash. Each reducer inserts the
   full byte strings into its own compressed radix trie; a terminal node holds
   the least id of its text and the ids seen.
3. A trie over its budget spills its heaviest subtree: that subtree's records
   leave as rows, as do later records that fall under it, and the next round
   partitions them again, salted by the round, so they spread. Spilled rows lie
   in a table in the shared folder; nothing is kept on a machine.

Equality is decided by the bytes alone; hashes only say where to meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, free_names, fresh_path, materialise, spread, tasks_for

COMBINE_BYTES = 24 << 20
TRIE_BYTES = 192 << 20
OUT_ROWS = 50_000
OUT_BYTES = 8 << 20
_SCHEMA = "doc_id long, owner_id long, text binary, ids array<long>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("owner_id", pa.int64()), ("text", pa.binary()), ("ids", pa.list_(pa.int64()))])


def common_prefix(a: bytes, i: int, b: bytes, j: int, most: int) -> int:
    """Length of the longest common prefix of a[i:] and b[j:], at most ``most``."""
    done, step = 0, 32
    while done < most:
        n = min(step, most - done)
        if a[i + done : i + done + n] == b[j + done : j + done + n]:
            done += n
            step *= 4
        elif n == 1:
            break
        elif n <= 8:
            while a[i + done] == b[j + done]:
                done += 1
            break
        else:
            step = n // 4
    return done


class Node:
    """An edge label (a slice of some inserted string) and what lies below it."""

    __slots__ = ("source", "start", "end", "children", "ids", "least", "weight", "spilled")

    def __init__(self, source: bytes, start: int, end: int):
        self.source, self.start, self.end = source, start, end
        self.children: dict[int, Node] = {}
        self.ids: list[np.ndarray] | None = None
        self.least = 0
        self.weight = 0
        self.spilled = False


class Trie:
    """Compressed radix trie from byte strings to ids.

    ``bytes`` estimates what it holds: texts, ids and nodes. A node's weight is
    what was added at or below it.
    """

    NODE = 220

    def __init__(self):
        self.root = Node(b"", 0, 0)
        self.bytes = 0

    def insert(self, text: bytes, ids: np.ndarray) -> bool:
        """False if the text falls under a spilled subtree and wasn't taken."""
        node, at, size = self.root, 0, len(text)
        path = [node]
        while True:
            if node.spilled:
                return False
            if at == size:
                break
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text, at, size)
                path.append(child)
                node = child
                break
            span = child.end - child.start
            same = common_prefix(child.source, child.start, text, at, min(span, size - at))
            if same < span:
                upper = Node(child.source, child.start, child.start + same)
                upper.weight, upper.spilled = child.weight, False
                child.start += same
                upper.children[child.source[child.start]] = child
                node.children[text[at]] = upper
                child = upper
            at += same
            path.append(child)
            node = child
        least = int(ids.min())
        added = 8 * len(ids)
        if node.ids is None:
            node.ids, node.least = [ids], least
            added += size + self.NODE
        else:
            node.ids.append(ids)
            node.least = min(node.least, least)
        for step in path:
            step.weight += added
        self.bytes += added
        return True

    def heaviest(self) -> Node:
        """The subtree to spill: down the heavy path while one child has most."""
        node = self.root
        while node.children:
            child = max(node.children.values(), key=lambda c: c.weight)
            if child.weight * 2 < node.weight and node is not self.root:
                break
            node = child
            if node.ids is not None:
                break
        return node

    def spill(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """Take the heaviest subtree's records out; later ones are refused."""
        node = self.heaviest()
        if node is self.root:
            return
        taken = node.weight
        path, text, at = [self.root], node.source, 0
        while path[-1] is not node:
            child = path[-1].children[text[at]]
            at += child.end - child.start
            path.append(child)
        yield from self.records(node)
        for step in path:
            step.weight -= taken
        node.children, node.ids, node.spilled = {}, None, True
        self.bytes -= taken

    def records(self, top: Node | None = None) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(text, least id, all ids) of each terminal at or below ``top``."""
        stack = [top or self.root]
        while stack:
            node = stack.pop()
            if node.ids is not None:
                ids = node.ids[0] if len(node.ids) == 1 else np.concatenate(node.ids)
                yield node.source[: node.end], node.least, ids
            stack.extend(node.children.values())


class Out:
    """Collects output rows and hands them on in batches of bounded size."""

    def __init__(self):
        self.reset()

    def reset(self):
        self.doc: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []
        self.rows = 0
        self.texts: list[bytes] = []
        self.lists: list[np.ndarray] = []
        self.bytes = 0

    def pairs(self, ids: np.ndarray, owner: int) -> None:
        self.doc.append(ids)
        self.owner.append(np.full(len(ids), owner))
        self.rows += len(ids)

    def record(self, text: bytes, ids: np.ndarray) -> None:
        self.texts.append(text)
        self.lists.append(ids)
        self.bytes += len(text) + 8 * len(ids)

    def full(self) -> bool:
        return self.rows >= OUT_ROWS or self.bytes >= OUT_BYTES

    def batch(self) -> pa.RecordBatch:
        none = len(self.texts)
        doc = pa.concat_arrays([pa.array(np.concatenate(self.doc) if self.doc else np.zeros(0, np.int64)), pa.nulls(none, pa.int64())])
        owner = pa.concat_arrays([pa.array(np.concatenate(self.owner) if self.owner else np.zeros(0, np.int64)), pa.nulls(none, pa.int64())])
        text = pa.concat_arrays([pa.nulls(len(doc) - none, pa.binary()), pa.array(self.texts, pa.binary())])
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in self.lists], dtype=np.int64)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(self.lists) if self.lists else np.zeros(0, np.int64)))
        ids = pa.concat_arrays([pa.nulls(len(doc) - none, pa.list_(pa.int64())), lists.cast(pa.list_(pa.int64()))])
        self.reset()
        return pa.RecordBatch.from_arrays([doc, owner, text, ids], schema=_ARROW)


def _combine(budget: int):
    """Rows (doc_id, text) to records (text, ids): one per text and trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(), Out()

        def flush():
            for text, _, ids in trie.records():
                out.record(text, np.unique(ids))
                if out.full():
                    yield out.batch()

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, text in enumerate(batch.column(1).to_pylist()):
                trie.insert(text, ids[i : i + 1])
                if trie.bytes > budget:
                    yield from flush()
                    trie = Trie()
        yield from flush()
        yield out.batch()

    return run


def _own(budget: int):
    """Records of a partition to (doc_id, owner_id), or to records where spilled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(), Out()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()
            for i, text in enumerate(texts):
                ids = flat[ends[i] : ends[i + 1]].copy()
                if not trie.insert(text, ids):
                    out.record(text, ids)
                while trie.bytes > budget:
                    before = trie.bytes
                    for spilled, _, own in trie.spill():
                        out.record(spilled, np.unique(own))
                        if out.full():
                            yield out.batch()
                    if trie.bytes == before:
                        break
                if out.full():
                    yield out.batch()
        for _, least, ids in trie.records():
            ids = np.unique(ids)
            if len(ids) > 1:
                out.pairs(ids, least)
                if out.full():
                    yield out.batch()
        yield out.batch()

    return run


def owners(docs: DataFrame, trie_bytes: int = TRIE_BYTES, combine_bytes: int = COMBINE_BYTES) -> DataFrame:
    """(doc_id, owner_id) of all documents whose text another id has too.

    owner_id is the least doc_id with the same bytes; owners are listed with
    themselves. Defined cases: null ids and null texts are left out; empty
    texts equal each other; rows that repeat an id and its text count once; an
    id with several texts belongs to the group of each; whole texts are
    compared however long; an empty table gives an empty result; other columns
    are not read. An owner's task holds 8 bytes for each copy of its text.
    """
    spark = docs.sparkSession
    slim = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    records = slim.mapInArrow(_combine(combine_bytes), _SCHEMA).where("text is not null")
    # a partition's texts should fit its trie: compressed files may hold three times their size
    parts = tasks_for(slim, max(1, trie_bytes // 4))
    found, salt, paths = [], 0, []
    while True:
        place = F.xxhash64(F.lit(salt), F.length("text"), "text")
        met = records.select("text", "ids").repartition(parts, place)
        path = fresh_path(spark, "owners")
        met.mapInArrow(_own(trie_bytes), _SCHEMA).write.parquet(path)
        result = spark.read.schema(_SCHEMA).parquet(path)
        paths.append(path)
        found.append(result.where("doc_id is not null").select("doc_id", "owner_id"))
        records = result.where("text is not null")
        if records.isEmpty():
            break
        # a text that filled a trie by itself gets one of its own next time
        salt, parts, trie_bytes = salt + 1, parts * 2, trie_bytes * 2
    if not salt:
        return found[0]
    total = materialise(reduce(DataFrame.unionByName, found), "owned")
    for path in paths:
        drop_path(spark, path)
    return total


def dedup(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text a lesser id has; nulls stay."""
    (name,) = free_names(docs, "_gone")
    gone = owners(docs, **options).where("doc_id <> owner_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owners(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


ORACLE = """
    with rows as (select distinct doc_id, text from documents where doc_id is not null and text is not null),
    met as (select doc_id, min(doc_id) over (partition by text) as owner_id, count(*) over (partition by text) as n from rows)
    select doc_id, owner_id from met where n > 1"""
