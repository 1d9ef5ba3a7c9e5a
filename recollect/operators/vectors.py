"""Vectors: cosine and distance, sign-bit signatures, exact and two-stage nearest neighbours, centroids.

Question vectors are the rows whose vec_id is divisible by 50. They meet all vectors in blocks: a block of
questions and a block of vectors are one group, compared as two matrices in double precision, and only the
best of each block go on, so nothing of the size of all pairs is ever a table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.plans.dialect import Queries
from recollect.tables import table

Q = Queries()
EVERY, VECTORS_EACH, QUESTIONS_EACH = 50, 4096, 512
_PAIRS = """
    q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT q, vec_id, list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) AS dot, sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[]) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
          FROM q, embeddings WHERE vec_id <> q),
    c AS (SELECT q, vec_id, round(dot / norm, 5) AS cosine FROM s)"""


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of a column of equally long lists, by way of one flat buffer instead of a Python number for each entry."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a @ b.T
    out /= np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1))
    return np.round(out, 5, out=out)


def _signs_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.where(a > 0, 1.0, 0.0), np.where(b > 0, 1.0, 0.0)
    return a.sum(1)[:, None] + b.sum(1) - 2 * a @ b.T


def _within(radius: int):
    """Cosine of the rows whose signs differ in at most radius components; the others are out."""
    return lambda a, b: np.where(_signs_apart(a, b) <= radius, _cosines(a, b), -np.inf)


def _best(k: int, likeness):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, q = left["vec_id"].to_numpy(), right["q"].to_numpy()
        out_q, out_id, out_s = [], [], []
        if len(ids) and len(q):
            score = likeness(_matrix(right["e"]), _matrix(left["e"]))
            score[q[:, None] == ids] = -np.inf
            for i in range(len(q)):
                best = np.lexsort((ids, -score[i]))[:k]
                best = best[np.isfinite(score[i][best])]
                out_q.append(np.full(len(best), q[i]))
                out_id.append(ids[best])
                out_s.append(score[i][best])
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table({"q": pa.array(cat(out_q, np.int64)), "vec_id": pa.array(cat(out_id, np.int64)), "score": pa.array(cat(out_s, float) + 0.0)})

    return run


def _blocks(vectors: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the block numbers bv and bq, so that each block of one meets each block of the other once."""
    nv, nq = max(1, -(-vectors.count() // VECTORS_EACH)), max(1, -(-questions.count() // QUESTIONS_EACH))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("long")
    copies = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    return (
        vectors.select(deal("vec_id", nv).alias("bv"), copies(nq).alias("bq"), "vec_id", "e"),
        questions.select(copies(nv).alias("bv"), deal("q", nq).alias("bq"), "q", "e"),
    )


def block_neighbours(vectors: DataFrame, questions: DataFrame, k: int, likeness=_cosines) -> DataFrame:
    """(q, vec_id, score, rank) of the k best of vectors (vec_id, e) for each of questions (q, e), own row excluded."""
    left, right = _blocks(vectors, questions)
    met = left.groupBy("bv", "bq").cogroup(right.groupBy("bv", "bq")).applyInArrow(_best(k, likeness), "q long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("e"))
    return e, e.where(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "q")


@Q.add(f"WITH {_PAIRS} SELECT q, vec_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, vec_id) AS rank FROM c) WHERE rank <= 10")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_neighbours(*_sides(spark, sf_dir), 10).withColumnRenamed("score", "cosine")


_HAMMING = """
    q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
    h AS (SELECT q, vec_id, list_sum(list_transform(list_zip(e, embedding), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END))::INT AS hamming, e, embedding
          FROM q, embeddings WHERE vec_id <> q),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY hamming, vec_id) AS r FROM h)"""


@Q.add(f"WITH {_HAMMING} SELECT q, vec_id, hamming, r AS rank FROM r WHERE r <= 10")
def signbit_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest by the signs of the components."""
    return block_neighbours(*_sides(spark, sf_dir), 10, lambda a, b: -_signs_apart(a, b)).select("q", "vec_id", (-F.col("score")).cast("int").alias("hamming"), "rank")


CALIBRATION, TARGET = 64, 0.95


def sign_radius(vectors: DataFrame, questions: DataFrame, k: int, sample: int = CALIBRATION, target: float = TARGET) -> int:
    """How many signs may differ so that the share target of the k nearest by cosine is within, over a sample of the questions by brute force."""
    asked = questions.orderBy("q").limit(sample)
    near = block_neighbours(vectors, asked, k).select("q", "vec_id")
    both = near.join(vectors, "vec_id").join(asked.withColumnRenamed("e", "x"), "q")
    apart = both.select(F.expr("size(filter(zip_with(e, x, (p, r) -> (p > 0) <> (r > 0)), d -> d))").alias("apart"))
    return apart.agg(F.expr(f"percentile_disc({target}) within group (order by apart)")).first()[0] or 0


@Q.add(f"""WITH {_HAMMING}, c AS (SELECT q, vec_id, hamming, round(list_dot_product(e::DOUBLE[], embedding::DOUBLE[])
           / sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[]) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS cosine FROM h),
    asked AS (SELECT q FROM q ORDER BY q LIMIT {CALIBRATION}),
    near AS (SELECT hamming, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, vec_id) AS n FROM c JOIN asked USING (q)),
    bound AS (SELECT quantile_disc(hamming, {TARGET}) AS radius FROM near WHERE n <= 5)
    SELECT q, vec_id, cosine, rank FROM (SELECT q, vec_id, cosine, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, vec_id) AS rank FROM c, bound WHERE hamming <= radius) WHERE rank <= 5""")
def knn_signbit_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best by cosine among all rows within a calibrated number of differing signs; a block keeps only its best."""
    vectors, questions = _sides(spark, sf_dir)
    return block_neighbours(vectors, questions, 5, _within(sign_radius(vectors, questions, 5))).withColumnRenamed("score", "cosine")


@Q.add(f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, vec_id) AS rank FROM c)
    SELECT DISTINCT least(q, vec_id) AS a, greatest(q, vec_id) AS b, cosine FROM r WHERE (rank = 1 AND cosine >= 0.28) OR (rank BETWEEN 2 AND 3 AND cosine >= 0.36)""")
def similar_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges to the best three, the first from 0.28 on, the others from 0.36."""
    top = block_neighbours(*_sides(spark, sf_dir), 3)
    return top.where("(rank = 1 and score >= 0.28) or (rank > 1 and score >= 0.36)").select(
        F.least("q", "vec_id").alias("a"), F.greatest("q", "vec_id").alias("b"), F.col("score").alias("cosine")).distinct()


@Q.add(f"""WITH {_PAIRS}, z AS (SELECT q, max(cosine) AS best, avg(cosine) AS mean, stddev_pop(cosine) AS sd FROM c GROUP BY q)
    SELECT q, best, round((best - mean) / sd, 3) AS z FROM z""")
def best_match_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the best match of a question stands out, over blocks that carry sums only."""
    vectors, questions = _sides(spark, sf_dir)

    def sums(key, left: pa.Table, right: pa.Table) -> pa.Table:
        q, ids = right["q"].to_numpy(), left["vec_id"].to_numpy()
        if not len(q) or not len(ids):
            return pa.table({"q": pa.array([], pa.int64()), **{c: pa.array([], pa.float64()) for c in ("best", "n", "s", "ss")}})
        c = _cosines(_matrix(right["e"]), _matrix(left["e"]))
        own = q[:, None] == ids
        return pa.table({"q": q, "best": np.where(own, -2, c).max(1), "n": (~own).sum(1).astype(float), "s": np.where(own, 0, c).sum(1), "ss": np.where(own, 0, c * c).sum(1)})

    left, right = _blocks(vectors, questions)
    met = left.groupBy("bv", "bq").cogroup(right.groupBy("bv", "bq")).applyInArrow(sums, "q long, best double, n double, s double, ss double")
    total = met.groupBy("q").agg(F.max("best").alias("best"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    return total.select("q", "best", F.round((F.col("best") - F.col("s") / F.col("n")) / F.sqrt(F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)), 3).alias("z"))


Q.sql("vector_pair_cosine", "embeddings", lambda d: f"""
    WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT a, b, round({d.dot('x', 'y')} / sqrt({d.dot('x', 'x')} * {d.dot('y', 'y')}), 5) AS cosine FROM p""")


@Q.add("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    s AS (SELECT label, i, sum(v) AS v FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(v * v)) AS n FROM s GROUP BY label)
    SELECT label, (i - 1)::INT AS i, round(v / n, 5) AS v FROM s JOIN n USING (label)""")
def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vector in the direction of each label's sum."""
    x = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    s = x.groupBy("label", "i").agg(F.sum(F.col("v").cast("double")).alias("v"))
    n = s.groupBy("label").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return s.join(n, "label").select("label", "i", F.round(F.col("v") / F.col("n"), 5).alias("v"))


QUERIES, ORACLE = Q.queries, Q.oracle
