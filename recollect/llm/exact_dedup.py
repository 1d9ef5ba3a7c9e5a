"""Exact duplicates through Patricia tries that own the texts.

Every partition first puts its own texts into a trie and passes on each distinct text once, with its
largest identifier and its number of rows, so a text that fills a third of the table is a few rows when
they are dealt by length and content hash. The second trie takes these rows as full byte strings; its
terminal nodes hold the identifier that owns the text. A trie that outgrows its memory writes its heaviest
first-level subtree to the task's local scratch, sends later texts of that subtree there too, and builds
the subtree by itself at the end; the scratch is gone when the task ends, and a lost task starts anew.

Defined cases: null counts as the empty text. Of equal texts the row with the largest doc_id stays (the
smallest with keep="smallest"); a null doc_id only if there is no other; of rows that repeat that doc_id
one stays. Only doc_id and text are read, so other columns can have any name.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of labels that a trie holds before it spills a subtree.
TRIE_BYTES = 96 << 20
_BATCH_BYTES = 8 << 20


class _Node:
    __slots__ = ("label", "below", "owner", "count")

    def __init__(self, label: bytes) -> None:
        self.label, self.below, self.owner, self.count = label, {}, None, 0


def _shared(a: bytes, b: bytes, at: int) -> int:
    """How many bytes a and b[at:] have in common at their start."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class OwnerTrie:
    """A compressed radix trie from byte strings to (owner, count); choose picks between two owners."""

    def __init__(self, choose=max, limit: int = TRIE_BYTES) -> None:
        self.choose, self.limit = choose, limit
        self.root, self.held = _Node(b""), {}
        self.spilled: dict[int, object] = {}

    def add(self, key: bytes, owner: int | None, count: int) -> None:
        first = key[0] if key else -1
        if first in self.spilled:
            self._write(first, key, owner, count)
            return
        node, at = self.root, 0
        while at < len(key):
            child = node.below.get(key[at])
            if child is None:
                child = node.below[key[at]] = _Node(key[at:])
                self.held[first] = self.held.get(first, 0) + len(key) - at + 250
            elif not key.startswith(child.label, at):
                n = _shared(child.label, key, at)
                fork = node.below[key[at]] = _Node(child.label[:n])
                child.label = child.label[n:]
                fork.below[child.label[0]] = child
                child = fork
            node, at = child, at + len(child.label)
        if owner is not None:
            node.owner = owner if node.owner is None else self.choose(node.owner, owner)
        node.count += count
        if sum(self.held.values()) > self.limit:
            self._spill(max(self.held, key=self.held.get))

    def _write(self, first: int, key: bytes, owner: int | None, count: int) -> None:
        self.spilled[first].write(struct.pack("<Q?qQ", len(key), owner is not None, owner or 0, count) + key)

    def _spill(self, first: int) -> None:
        self.spilled[first] = tempfile.TemporaryFile(dir=os.environ.get("TMPDIR"), buffering=1 << 20)
        node = self.root.below.pop(first)
        for key, owner, count in self._walk(node, b""):
            self._write(first, key, owner, count)
        self.held.pop(first)

    @staticmethod
    def _walk(node: _Node, before: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(node, before)]
        while stack:
            node, before = stack.pop()
            path = before + node.label
            if node.count:
                yield path, node.owner, node.count
            stack += [(child, path) for child in node.below.values()]

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        yield from self._walk(self.root, b"")
        self.root, self.held = _Node(b""), {}
        for file in self.spilled.values():
            yield from _below(file, self.choose, self.limit)
            file.close()


def _records(file) -> Iterator[tuple[bytes, int | None, int]]:
    file.seek(0)
    while size := file.read(25):
        n, has, owner, count = struct.unpack("<Q?qQ", size)
        yield file.read(n), owner if has else None, count


def _below(file, choose, limit: int) -> Iterator[tuple[bytes, int | None, int]]:
    """A spilled subtree: a trie of what its keys don't all start with, so that it forks at its root."""
    head = None
    for key, _, _ in _records(file):
        head = key if head is None else head if key.startswith(head) else head[: _shared(head, key, 0)]
    trie = OwnerTrie(choose, limit)
    for key, owner, count in _records(file):
        trie.add(key[len(head) :], owner, count)
    for key, owner, count in trie.items():
        yield head + key, owner, count


def _owned(rows: Iterable[tuple[bytes, int | None, int]], choose, limit: int) -> Iterator[pa.RecordBatch]:
    trie = OwnerTrie(choose, limit)
    for key, owner, count in rows:
        trie.add(key, owner, count)
    out, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())],
            names=["content", "owner", "n"],
        )

    for item in trie.items():
        out.append(item)
        size += len(item[0])
        if size > _BATCH_BYTES or len(out) >= 10_000:
            yield batch()
            out, size = [], 0
    yield batch()


def text_owners(docs: DataFrame, keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """For each distinct text: content (its bytes), owner (the doc_id that stays), n (rows)."""
    choose = max if keep == "largest" else min
    content = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"), F.col("doc_id").cast("long").alias("owner"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _owned(((k, o, 1) for b in batches for k, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), choose, trie_bytes)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _owned((x for b in batches for x in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True)), choose, trie_bytes)

    schema = "content binary, owner long, n long"
    dealt = content.mapInArrow(first, schema).repartition(F.length("content"), F.xxhash64("content"))
    return dealt.mapInArrow(second, schema)


def exact_duplicates(docs: DataFrame, keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    owners = text_owners(docs, keep, trie_bytes).select(F.sha2("content", 256).alias("text_sha256"), F.col("owner").alias("keep_id"), F.col("n").alias("group_size"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"))
    again = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy(F.lit(1)))
    return (
        rows.withColumn("again", again).join(owners, "text_sha256")
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("again") == 1)).alias("kept"), "text_sha256")
    )
