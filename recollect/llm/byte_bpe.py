"""Byte-level BPE: texts to token ids with character offsets, and ids back to bytes.

The tokenizers library does the merges. Its tokenizer is built from a file of ranks: bytes become visible
characters by the byte table below, and every way to join two tokens into a third is a merge with the
third one's rank. A text is cut at single spaces between other characters, where no match of the
splitting pattern can cross, so that a piece that comes back is encoded once for many of its places.
Decoding reverses the byte table token by token and joins bytes, not characters: a character that two
tokens share is whole again once both are there.

Defined cases: null counts as the empty text, which has no tokens. Special tokens in a text are ordinary
text. Offsets count code points; a token that starts within a character has that character's start,
and its end is behind the character that its last byte belongs to.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from recollect.llm.pieces import Parts, one_core

#: Pieces that a task remembers; it starts anew beyond that.
REMEMBERED = 500_000
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_characters() -> list[str]:
    """The visible character of each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class ByteBPE:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        shown = byte_characters()
        name = {token: "".join(shown[b] for b in token) for token in ranks}
        merges = [
            (name[token[:i]], name[token[i:]])
            for token in sorted(ranks, key=ranks.get) for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        self.tokenizer = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        back = {c: b for b, c in enumerate(shown)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for text, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = bytes(back[c] for c in text)
        self.length_of = np.array([len(x) for x in self.bytes_of], np.int64)
        self.known: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.parts = Parts(self.tokenizer, pattern, "I")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit integers."""
        cut = [x.split(" ") if x else [] for x in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.first.clear()
            self.parts.known.clear()
        bad = self._learn({p for pieces in cut for p in pieces[1:]}, self.known, " ")
        for i, pieces in enumerate(cut):
            if pieces and (not pieces[0] or pieces[0][-1].isspace() or not bad.isdisjoint(pieces)):
                cut[i] = _CUT.split(texts[i])
                self._learn(set(cut[i][1:]), self.known, " ", check=False)
        self._learn({pieces[0] for pieces in cut if pieces}, self.first, "", check=False)
        known, first = self.known, self.first
        return [b"".join([first[pieces[0]], *[known[p] for p in pieces[1:]]]) if pieces else b"" for pieces in cut]

    def _learn(self, pieces: set[str], known: dict[str, bytes], lead: str, check: bool = True) -> set[str]:
        """Encodes the pieces that aren't known, each behind lead; returns those that can't stand alone."""
        new = [p for p in pieces if p not in known]
        bad = {p for p in new if not p or p[0].isspace() or p[-1].isspace()} if check else set()
        new = [p for p in new if p not in bad] if bad else new
        known.update(zip(new, self.parts.of([lead + p for p in new]), strict=True))
        return bad

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def offsets(self, ids: bytes, decoded: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Code points where each token starts and ends (exclusive)."""
        end = np.cumsum(self.length_of[np.frombuffer(ids, "<u4")])
        start = np.concatenate(([0], end[:-1])) if len(end) else end
        first = (np.frombuffer(decoded, np.uint8) & 0xC0) != 0x80
        seen = np.concatenate(([0], np.cumsum(first)))
        return seen[start + 1] - 1 if len(start) else seen[:0], seen[end]


@lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str) -> ByteBPE:
    """One coder for each Python worker, which has one core."""
    one_core()
    return ByteBPE(ranks_path, pattern)


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encoded(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """docs with token_ids (array of int) and, if wanted, token_start and token_end in place of columns so named, in whatever case."""
    added = ["token_ids", *(["token_start", "token_end"] if offsets else [])]
    kept = [c for c in docs.columns if c.lower() not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for part in _batches(batches):
            ids = bpe.encode(part.column([c.lower() for c in kept].index(text.lower())).to_pylist())
            out = [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))]
            if offsets:
                spans = [bpe.offsets(x, bpe.decode(x)) for x in ids]
                out += [pa.array([s[k].astype(np.int32) for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*kept, *added])

    frame = docs.select(*[docs[f"`{c}`"] for c in kept])
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in added]]))


def decoded(tokens: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """tokens with decoded (binary): the bytes of each array of ids, null counting as none."""
    kept = [c for c in tokens.columns if c.lower() != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for part in _batches(batches):
            rows = part.column([c.lower() for c in kept].index(ids.lower())).to_pylist()
            out = pa.array([bpe.decode(np.array(r or [], "<u4").tobytes()) for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*kept, "decoded"])

    frame = tokens.select(*[tokens[f"`{c}`"] for c in kept])
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField("decoded", T.BinaryType())]))


def encoded_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs with token_ids, n_tokens, ids_sha256 (of the little-endian ids), decoded_sha256 (of the bytes that they decode to)
    and offsets_sha256 (of all starts, then all ends, as little-endian unsigned 32-bit integers),
    in place of columns so named, in whatever case."""
    added = ["token_ids", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256"]
    kept = [c for c in docs.columns if c.lower() not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        sha = lambda rows: pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string())
        for part in _batches(batches):
            ids = bpe.encode(part.column([c.lower() for c in kept].index("text")).to_pylist())
            ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            back = [bpe.decode(x) for x in ids]
            spans = [np.concatenate(bpe.offsets(x, b)).astype("<u4").tobytes() for x, b in zip(ids, back, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.ListArray.from_arrays(ends, values), pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(back), sha(spans)],
                names=[*kept, *added],
            )

    frame = docs.select(*[docs[f"`{c}`"] for c in kept])
    fields = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.StringType()) for c in added[2:]]]
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, *fields]))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids_sha256, decoded_sha256, offsets_sha256."""
    found = encoded_digests(docs.select("doc_id", "text"), ranks_path, pattern)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256")
