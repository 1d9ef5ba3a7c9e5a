"""A linear reader learned over a table: hashed features, rounds of summed gradients, averaged weights, and a margin.

A round is one pass: every text's score from the weights as they are, its error times its features summed by feature,
first within each task, then over all. The weights (FEATURES numbers) go to every task and their sums come back, so nothing that
is sent grows with the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import tokens
from recollect.plans.dialect import Queries
from recollect.shared import written
from recollect.tables import table

Q = Queries()
HASHED, ROUNDS, RATE, MADE_UP = 4096, 12, 0.6, 0.002
#: Signs whose share of the characters is a feature, each string together.
_SHARES = (".", ",", "!", "|", "$&", "?:", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
FEATURES = HASHED + len(_SHARES) + 2


def features(text: Column) -> Column:
    """array<struct<f int, v double>>: distinct words hashed to HASHED places (together of length 1), shares of signs in per cent, length, and 1."""
    words = F.array_distinct(tokens(text))
    one = lambda ws: F.transform(ws, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(HASHED)).cast("int").alias("f"), (1 / F.sqrt(F.size(ws))).alias("v")))
    hashed = F.element_at(F.transform(F.array(words), one), 1)  # a lambda would take the words from the text again for each of them
    n = F.greatest(F.length(text), F.lit(1))
    shares = [F.struct(F.lit(HASHED + i).alias("f"), (100.0 * (F.length(text) - F.length(F.translate(text, s, ""))) / n).alias("v")) for i, s in enumerate(_SHARES)]
    rest = [F.struct(F.lit(FEATURES - 2).alias("f"), (F.log1p(n.cast("double")) / 10).alias("v")), F.struct(F.lit(FEATURES - 1).alias("f"), F.lit(1.0).alias("v"))]
    return F.concat(hashed, F.array(*shares, *rest))


def scored(examples: DataFrame, weights: DataFrame) -> DataFrame:
    """examples (x, an array of features) with score; weights is one row w, an array of FEATURES numbers."""
    dot = F.aggregate("x", F.lit(0.0), lambda s, f: s + f["v"] * F.element_at("w", f["f"] + 1))
    return examples.crossJoin(F.broadcast(weights.select("w"))).withColumn("score", dot).drop("w")


def _pushes(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's error times feature, summed by feature: FEATURES numbers whatever it has read."""
        sums = np.zeros(len(weights))
        for b in batches:
            x, y = b.column(0), b.column(1).to_numpy(zero_copy_only=False).astype(float)
            flat, sizes = x.flatten(), np.diff(x.offsets.to_numpy())
            f, v = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            of = np.repeat(np.arange(len(y)), sizes)
            error = y - 1 / (1 + np.exp(-np.bincount(of, v * weights[f], len(y))))
            sums += np.bincount(f, v * error[of], len(weights))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["f", "g"])

    return run


def train(examples: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """One row w: weights learned from examples (x, y 0 or 1), the mean of those of the later half of the rounds."""
    spark = examples.sparkSession
    given = examples.where("x is not null and y is not null").select("x", F.col("y").cast("double").alias("y"))
    w, g2, total, n = np.zeros(FEATURES), np.full(FEATURES, 1e-6), np.zeros(FEATURES), max(1, examples.count())
    for i in range(rounds):
        g = np.zeros(FEATURES)
        for r in given.mapInArrow(_pushes(w), "f int, g double").groupBy("f").agg(F.sum("g").alias("g")).collect():  # FEATURES rows at most
            g[r.f] = r.g / n
        g2 += g * g
        w = w + rate * g / np.sqrt(g2)
        total += w if i >= rounds // 2 else 0.0
    return written(spark.createDataFrame([((total / (rounds - rounds // 2)).tolist(),)], "w array<double>"), "weights")


def margin(negatives: DataFrame, made_up: float = MADE_UP) -> float:
    """The score that at most so large a share of the negatives (score) passes."""
    n = negatives.count()
    allowed = int(n * made_up)
    row = negatives.orderBy(F.desc("score")).limit(allowed + 1).agg(F.min("score").alias("m")).first()  # a bounded share of labelled rows
    return float(row.m) if n else 0.0


def part_of(doc_id: Column) -> Column:
    """train, dev or test by the hash of an id: six, two and two of ten."""
    place = F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(10))
    return F.when(place < 2, "test").when(place < 4, "dev").otherwise("train")


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    both = docs.join(labels, "doc_id").where("text is not null and quality in (0, 1)")
    return written(both.select("doc_id", part_of(F.col("doc_id")).alias("part"), F.col("quality").alias("y"), features(F.col("text")).alias("x")), "examples")


@Q.add()
def learned_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents by a reader learned from the training part: score, and whether it passes the margin that the dev part's negatives set."""
    examples = _examples(spark, sf_dir)
    by = scored(examples, train(examples.where("part = 'train'")))
    least = max(0.0, margin(by.where("part = 'dev' and y = 0")))
    return by.select("doc_id", "part", F.col("y").alias("quality"), "score", (F.col("score") > 0).cast("int").alias("predicted"), (F.col("score") > least).alias("sure"))


QUERIES, ORACLE = Q.queries, Q.oracle
