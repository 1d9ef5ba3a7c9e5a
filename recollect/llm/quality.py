"""Quality of documents by a factorisation machine over hashed words and structure.

A text becomes a sparse vector: its words hashed into buckets, weighted 1 + ln(count) and normalised, and
bins of its statistics (shares of capitals, digits, marks and spaces, word and line lengths, repeated
lines and words, size). The machine adds to a linear score the interactions of all pairs of features
through low-rank factors; by the sum-of-squares identity,

    sum over pairs of <v_i, v_j> x_i x_j = 1/2 sum over factors of ((sum v x)^2 - sum v^2 x^2),

a text is scored in time linear in its features. It is trained by AdaGrad on a bounded sample of labelled
documents (SAMPLE, a parameter), chosen by a hash of their ids; the sample is all that reaches the driver.

Defined cases: null counts as the empty text, whose features are the bins of zeroes; it gets a score like
any other. Documents without a label are scored, not learned from; labels without a document, and labels
that are null, are left out. If there is nothing to learn from, all scores are 0.5. Repeated labels of
a document count as often as they occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.words import U, word_hashes

SAMPLE = 6000
WORD_BITS, RANK, BINS = 14, 8, 12
THRESHOLD = 0.3
_WORDS = 1 << WORD_BITS
_KINDS = np.full(256, 5, np.uint8)  # others, among them parts of non-ASCII letters
_KINDS[[*range(97, 123)]] = 0
_KINDS[[*range(65, 91)]] = 1
_KINDS[[*range(48, 58)]] = 2
_KINDS[[9, 10, 13, 32]] = 3
_KINDS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_KINDS[[ord(c) for c in ".,"]] = 6
#: Upper ends of the bins of shares and of counts.
_SHARES = np.array([0.0, 0.002, 0.01, 0.03, 0.06, 0.1, 0.16, 0.25, 0.4, 0.6, 0.85])
_STATS = 14
FEATURES = _WORDS + _STATS * BINS


def _structure(text: str, n_words: int, distinct: int) -> np.ndarray:
    """The bin of each statistic."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(data))
    kinds = np.bincount(_KINDS[data], minlength=7) / n
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    share = lambda x: int(np.searchsorted(_SHARES, x))
    log = lambda x: min(BINS - 1, int(2 * np.log1p(x) / np.log(4)))
    return np.array([
        *[share(x) for x in kinds],
        share(1 - distinct / n_words) if n_words else 0,
        share(1 - len(set(full)) / len(full)) if full else 0,
        share(sum(x[-1:] in ".!?" for x in full) / len(full)) if full else 0,
        min(BINS - 1, int(n / max(1, n_words))), log(n_words), log(len(full)), log(len(text) / max(1, len(full)) / 8),
    ])


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of all texts, in order of rows."""
    words, at = word_hashes(texts)
    bucket = (words >> U(64 - WORD_BITS)).astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), np.diff(at))
    both, count = np.unique(rows << WORD_BITS | bucket, return_counts=True)
    row, value = both >> WORD_BITS, 1 + np.log(count)
    value /= np.sqrt(np.bincount(row, value**2, len(texts)))[row]
    distinct = np.bincount(row, minlength=len(texts))
    bins = np.array([_structure(t or "", int(n), int(d)) for t, n, d in zip(texts, np.diff(at), distinct, strict=True)]).reshape(-1, _STATS)
    flat = (np.arange(_STATS) * BINS + bins + _WORDS).ravel()
    row = np.concatenate([row, np.repeat(np.arange(len(texts)), _STATS)])
    feature, value = np.concatenate([both & (_WORDS - 1), flat]), np.concatenate([value, np.full(len(flat), _STATS**-0.5)])
    order = np.argsort(row, kind="stable")
    return row[order], feature[order], value[order].astype(np.float32)


@dataclass
class Machine:
    """bias, linear weights and factors of a factorisation machine."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of label 1 for rows 0 to n-1; features come in order of rows."""
        total = self.bias + np.bincount(row, self.linear[feature] * value, n)
        for f in range(self.factors.shape[1]):
            vx = self.factors[feature, f] * value
            total += (np.bincount(row, vx, n) ** 2 - np.bincount(row, vx * vx, n)) / 2
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 1200, batch: int = 64, rate: float = 0.08, decay: float = 2e-4, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss over (features, values) of each labelled text, in so many batches at least."""
    rng = np.random.default_rng(seed)
    if not len(rows):
        return Machine(0.0, np.zeros(FEATURES), np.zeros((FEATURES, RANK)))
    machine = Machine(0.0, np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, RANK)))
    parts = -(-len(rows) // batch)
    seen_w, seen_v, seen_b = np.full(FEATURES, 1e-3), np.full((FEATURES, RANK), 1e-3), 1e-3
    for _ in range(-(-steps // parts)):
        for part in np.array_split(rng.permutation(len(rows)), parts):
            feature, value = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            row, n = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part]), len(part)
            error = machine.score(row, feature, value, n) - labels[part]
            push = (error[row] * value) / n
            vx = machine.factors[feature] * value[:, None]
            sums = np.stack([np.bincount(row, vx[:, f], n) for f in range(RANK)], 1)
            used, at = np.unique(feature, return_inverse=True)
            grad_w = np.bincount(at, push) + decay * machine.linear[used]
            pushed = push[:, None] * (sums[row] - vx)
            grad_v = np.stack([np.bincount(at, pushed[:, f]) for f in range(RANK)], 1) + decay * machine.factors[used]
            seen_w[used] += grad_w**2
            seen_v[used] += grad_v**2
            seen_b += error.mean() ** 2
            machine.linear[used] -= rate * grad_w / np.sqrt(seen_w[used])
            machine.factors[used] -= rate * grad_v / np.sqrt(seen_v[used])
            machine.bias -= rate * error.mean() / np.sqrt(seen_b)
    return machine


def held_out_id(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def _held_out(column) -> F.Column:
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            row, feature, value = features(part.column("text").to_pylist())
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=part.num_rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("label"), pa.ListArray.from_arrays(ends, pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value))],
                names=["doc_id", "label", "feature", "value"],
            )


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Machine:
    """A machine learned from at most sample labelled rows whose ids aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id")))
    known = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(11)), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    rows = texts.mapInArrow(_featured, "doc_id long, label int, feature array<int>, value array<float>")
    table = rows.orderBy(F.xxhash64(F.col("doc_id"), F.lit(11)), "doc_id", F.xxhash64("feature")).limit(sample).toArrow()
    columns = [table[c].combine_chunks() for c in ("feature", "value")]
    ends = np.concatenate(([0], np.cumsum([len(x) for x in columns[0]]))).tolist()
    feature, value = (c.flatten().to_numpy() for c in columns)
    pairs = [(feature[a:b], value[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return train(pairs, table["label"].to_numpy().astype(float))


def scored(docs: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score (0 to 1, higher: label 1 likelier) in a column of that name."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    frame = docs.select(*[docs[f"`{c}`"] for c in kept])
    at_text = [c.lower() for c in kept].index(text.lower())
    small = Machine(machine.bias, machine.linear.astype(np.float32), machine.factors.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = small.score(*features(part.column(at_text).to_pylist()), part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], names=[*kept, name])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField(name, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score the threshold or more."""
    name = next(c for c in ("score", *[f"score_{i}" for i in range(1000)]) if c not in {x.lower() for x in docs.columns})
    return scored(docs, fit(docs, labels), name=name).where(F.col(name) >= threshold).drop(name)
