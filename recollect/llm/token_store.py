"""Token ids of documents in sorted-string-table shards, written, read back and looked up by identifier.

A shard holds the documents of one range of doc_id in ascending order:

    blocks   entries of shared key length, rest of the key's length, value length (varints), rest of the
             key, value; keys are compressed against the entry before, each block starts anew
    index    for each block its last key, offset and size
    bloom    bits set for each key
    footer   offsets and sizes of index and bloom, documents, tokens, bytes of an id, magic word

A key is the identifier as eight big-endian bytes with the sign bit turned, so that bytes sort as
numbers do. A value is the ids, little-endian, in two bytes each where the vocabulary allows it. Finding a
document reads the footer, index and Bloom filter, then one block by binary search.

Texts are dealt by range of doc_id and sorted by Spark; each task writes the shards of its range under
names of their own and hands on their paths, so that what a lost or repeated attempt has written is never
read. The ids before a document are summed over the shards' totals.

Defined cases: null counts as the empty text, which has the end id only. Repeated identifiers follow each
other in the order of their texts. A null doc_id counts as the least, and comes back as null.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.llm.pieces import Parts, one_core
from recollect.llm.words import U, mix
from recollect.shared import shared_dir, written

MAGIC = b"RCLSST01"
FOOTER = struct.Struct("<QQQQQQI4x8s")
BLOCK_BYTES, SHARD_BYTES = 64 << 10, 64 << 20
#: Bits for each key and probes of the Bloom filter.
BLOOM_BITS, BLOOM_PROBES = 10, 7
REMEMBERED = 1_000_000
_NULL_KEY = b""
#: Fixed value: the pattern by which the tokenizer file splits words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """The tokenizers library over words: white space never joins two of them, so each is encoded once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        one_core()
        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.parts = Parts(self.tokenizer, SPLIT, self.code, lower=True, whole="<|")
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        cut = [(x or "").replace("\n", " ").split(" ") for x in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
            self.parts.known.clear()
        new = [p for p in {p for pieces in cut for p in pieces} if p not in known]
        known.update(zip(new, self.parts.of(new), strict=True))
        end = array(self.code, [end_id]).tobytes()
        return [b"".join([known[p] for p in pieces]) + end for pieces in cut]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _key(doc_id: int | None) -> bytes:
    return _NULL_KEY if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def _doc_id(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (data[at] & 127) << shift
        at += 1
        if data[at - 1] < 128:
            return n, at
        shift += 7


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    h = mix(np.frombuffer(b"".join(k.rjust(8, b"\xff") for k in keys), ">u8").astype(np.uint64))
    step = mix(h) | U(1)
    return np.stack([(h + U(j) * step) % U(bits) for j in range(BLOOM_PROBES)])


class ShardWriter:
    """Writes one shard; add() takes keys in ascending order."""

    def __init__(self, uri: str, width: int) -> None:
        self.store, self.path = fs.FileSystem.from_uri(uri)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.uri, self.width, self.out = uri, width, self.store.open_output_stream(self.path)
        self.block, self.last, self.offset = bytearray(), b"", 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.ids = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.ids += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            self.out.write(bytes(self.block))
            self.index.append((self.last, self.offset, len(self.block)))
            self.offset += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self._end_block()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros(bits, np.uint8)
        bloom[_probes(self.keys, bits).ravel()] = 1
        packed = np.packbits(bloom).tobytes()
        self.out.write(index + packed)
        self.out.write(FOOTER.pack(self.offset, len(index), self.offset + len(index), bits, len(self.keys), self.ids, self.width, MAGIC))
        self.out.close()


class Shard:
    """Reads one shard."""

    def __init__(self, uri: str) -> None:
        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        at, n, bloom_at, self.bits, self.n_docs, self.n_ids, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        data, i, self.index = self._read(at, n), 0, []
        while i < len(data):
            k, i = _read_varint(data, i)
            self.index.append((data[i : i + k], *struct.unpack_from("<QQ", data, i + k)))
            i += k + 16
        self.bloom = np.unpackbits(np.frombuffer(self._read(bloom_at, (self.bits + 7) // 8), np.uint8))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, at: int, n: int) -> Iterator[tuple[bytes, bytes]]:
        data, i, key = self._read(at, n), 0, b""
        while i < n:
            shared, i = _read_varint(data, i)
            rest, i = _read_varint(data, i)
            size, i = _read_varint(data, i)
            key = key[:shared] + data[i : i + rest]
            yield key, data[i + rest : i + rest + size]
            i += rest + size

    def ids_of(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for _, at, n in self.index:
            for key, value in self._block(at, n):
                yield _doc_id(key), self.ids_of(value)

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each document of that identifier."""
        key = _key(doc_id)
        if not self.bloom[_probes([key], self.bits).ravel()].all():
            return []
        out = []
        for last, at, n in self.index[bisect_left(self.index, (key, 0, 0)) :]:
            out += [self.ids_of(v) for k, v in self._block(at, n) if k == key]
            if last > key:
                break
        return out


def write_token_store(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the shards of docs; one row for each: path, place (order of ranges), first_id, last_id, n_docs, n_ids."""
    where = folder or f"{shared_dir(docs.sparkSession)}/recollect/tokens-{uuid.uuid4().hex[:12]}"
    run = uuid.uuid4().hex[:8]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, attempt = encoder(tokenizer_path), TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        shard, rows, first = None, [], None

        def end() -> None:
            nonlocal shard
            shard.close()
            rows.append((shard.uri, (task << 24) + len(rows), _doc_id(first), _doc_id(shard.last), len(shard.keys), shard.ids))
            shard = None

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for doc_id, value in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist(), end_id), strict=True):
                    if shard is None:
                        shard = ShardWriter(f"{where}/{run}-{task:06d}-{len(rows):04d}-{attempt}.sst", 2 if words.code == "H" else 4)
                        first = _key(doc_id)
                    shard.add(_key(doc_id), value)
                    if shard.offset >= SHARD_BYTES:
                        end()
        if shard is not None:
            end()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=pa.schema(
                [("path", pa.string()), ("place", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]
            ))

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(write, "path string, place long, first_id long, last_id long, n_docs long, n_ids long"), "shards")


def read_token_store(shards: DataFrame) -> DataFrame:
    """From the shards' rows: doc_id, start, n_tokens, ids_crc32 of every document, read from the files."""
    before = F.sum("n_ids").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    placed = shards.select("path", F.coalesce(before, F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = []
                for doc_id, ids in Shard(path):
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(out) == 10_000:
                        yield pack(out)
                        out = []
                if out:
                    yield pack(out)

    return placed.repartition(max(1, shards.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(shards: DataFrame, doc_id: int) -> list[np.ndarray]:
    """The ids of one document, found through the shards' ranges, filters and indexes."""
    paths = [r.path for r in shards.where(F.lit(doc_id).between(F.coalesce("first_id", F.lit(-(1 << 63))), F.col("last_id"))).select("path", "place").orderBy("place").collect()]
    return [ids for path in paths for ids in Shard(path).get(doc_id)]


def token_digests(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    return read_token_store(write_token_store(docs, tokenizer_path, end_id))
