"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Entries become whole numbers, y = floor(SCALE * entry), so count, sums and products of the fit list are exact,
and so is the scatter M = n * sum(y y') - T T', which is n * n times the covariance whatever the origin. Each
prime is a task that brings M to Hessenberg form modulo it and reads the characteristic polynomial off; Chinese
remaindering gives its whole coefficients. Its roots are real, so the sign changes of the polynomial shifted by c
count the roots above c exactly (Descartes' bound is met): intervals are halved until each holds one root, and
those are narrowed by the polynomial's sign. Each component is a task of its own: inverse iteration on
M - root in whole numbers of several hundred bits, rounded to doubles at the end. Rows are then projected in
the tasks that read them.

What reaches the driver has the size of the matrix, d * d for d dimensions, not of the table.

Defined cases: rows whose vector is null or has null or non-finite entries take no part; nor do vectors of another
length than the commonest (of equally common ones the longest), or of length 0. An entry beyond 2**62 / SCALE counts
as that bound. Components of eigenvalue 0 can't be whitened and are left out: fewer rows than dimensions, or
equal rows, give fewer components, an empty table none. Components of equal eigenvalues are an orthonormal basis
of their space. The entry of a component with the largest magnitude is positive. Repeated rows all count and
all come back; a null identifier is kept. Columns other than identifier and vector aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, MOST = 64, 32
#: y is held to this, so that it fits a long.
LARGEST = 1 << 62
#: Bits behind the point of a root, raised while neighbouring roots are nearer than APART units of them.
BITS, APART = (64, 128, 256, 512), 1 << 40
_HIGH = 64


def _usable(table: DataFrame, vector: str) -> DataFrame:
    entry = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return table.where(F.col(vector).isNotNull() & ~F.exists(F.col(vector).cast("array<double>"), entry))


def _whole(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of a batch as whole numbers: doubles where these are exact, Python integers otherwise."""
    y = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d) * SCALE)
    if not y.size or np.abs(y).max() < 2**53:
        return y
    return np.vectorize(lambda v: max(-LARGEST, min(LARGEST, int(v) if np.isfinite(v) else LARGEST * (1 if v > 0 else -1))), otypes=[object])(y)


def _products(y: np.ndarray) -> np.ndarray:
    """Sum over rows of (1, y)' (1, y), exact."""
    whole = np.concatenate([np.ones((len(y), 1), y.dtype), y], 1)
    most = max(1, *[abs(int(v)) for v in (whole.max(), whole.min())])
    rows = 2**53 // most**2
    if whole.dtype == object or rows < 1:
        whole = np.vectorize(int, otypes=[object])(whole)
        return whole.T @ whole
    total = np.zeros((whole.shape[1],) * 2, object)
    for at in range(0, len(whole), rows):
        part = whole[at : at + rows]
        total = total + np.vectorize(int, otypes=[object])(part.T @ part)
    return total


def moments(vectors: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums of y, sums of products of y) over vectors (v array<double>)."""
    upper = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                some = _products(_whole(batch.column(0), d))
                total = some if total is None else total + some
        if total is not None:
            values = [int(total[i, j]) for i, j in upper]
            wide = pa.decimal128(38, 0)
            high, low = ([*map(str, c)] for c in ([v >> _HIGH for v in values], [v & ((1 << _HIGH) - 1) for v in values]))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(upper)), pa.int32()), pa.array(high).cast(wide), pa.array(low).cast(wide)], names=["cell", "high", "low"])

    sums = vectors.mapInArrow(partial, "cell int, high decimal(38,0), low decimal(38,0)").groupBy("cell").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    full = np.zeros((d + 1, d + 1), object)
    for r in sums.collect():  # a row for each pair of dimensions
        i, j = upper[r.cell]
        full[i, j] = full[j, i] = (int(r.high) << _HIGH) + int(r.low)
    return int(full[0, 0]), [int(v) for v in full[0, 1:]], full[1:, 1:]


def primes(above: int) -> list[int]:
    """Primes below 2**31, largest first, whose product passes the bound."""
    found, product, p = [], 1, (1 << 31) - 1
    while product <= above:
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        # Miller-Rabin with these bases is exact below 3.2e9
        if all(pow(b, odd, p) in (1, p - 1) or any(pow(b, odd << i, p) == p - 1 for i in range(1, twos)) for b in (2, 3, 5, 7)):
            found.append(p)
            product *= p
        p -= 2
    return found


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - matrix) modulo the prime p, the constant first, by Hessenberg form."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        if below[0]:
            i = m + below[0]
            h[[m, i]] = h[[i, m]]
            h[:, [m, i]] = h[:, [i, m]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(1)) % p
    known = [np.zeros(d + 1, np.int64)]  # of the leading blocks
    known[0][0] = 1
    for k in range(d):
        now = np.concatenate(([0], known[k][:-1])) - h[k, k] * known[k] % p
        path = 1
        for i in range(k - 1, -1, -1):
            path = path * int(h[i + 1, i]) % p
            if not path:
                break
            now = now - path * int(h[i, k]) % p * known[i] % p
        known.append(now % p)
    return known[d].tolist()


def characteristic(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients of det(x - matrix), the constant first, of a positive semidefinite matrix of whole numbers."""
    d, trace = len(matrix), int(sum(matrix.diagonal()))
    # elementary symmetric sums of d numbers that aren't negative are greatest when all are equal
    bound = max(comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    moduli = primes(bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([polynomial_mod(matrix, p) for p in ps], pa.list_(pa.int64()))], names=["p", "c"])

    tasks = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(min(len(moduli), max(1, spark.sparkContext.defaultParallelism)))
    residues = {r.p: r.c for r in tasks.mapInArrow(run, "p long, c array<long>").collect()}
    whole, product = [0] * (d + 1), 1
    for p in moduli:
        inverse = pow(product, -1, p)
        whole = [a + product * ((r - a) * inverse % p) for a, r in zip(whole, residues[p], strict=True)]
        product *= p
    # signs alternate, so a coefficient that is to be negative stands as its complement
    return [a if (d - k) % 2 == 0 or not a else a - product for k, a in enumerate(whole)]


def _above(poly: list[int], c: int) -> int:
    """How many roots are above c: sign changes of the polynomial shifted by c, exact as all roots are real."""
    a, d = list(poly), len(poly) - 1
    for i in range(d):
        carry = a[d]
        for k in range(d - 1, i - 1, -1):
            carry = a[k] = a[k] + c * carry
    signs = [v > 0 for v in a if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], c: int) -> int:
    value = 0
    for a in reversed(poly):
        value = value * c + a
    return (value > 0) - (value < 0)


def roots(poly: list[int], most: int, bits: int) -> list[tuple[int, int]]:
    """(root in units of 2**-bits, at most one unit below it, multiplicity) of the greatest positive roots, `most` or a few more, falling."""
    d = len(poly) - 1
    scaled = [a << bits * (d - k) for k, a in enumerate(poly)]
    high = 1 << (max(-scaled[d - 1], 1)).bit_length()  # the sum of roots that aren't negative bounds each
    found: list[tuple[int, int]] = []
    todo = [(0, high, _above(scaled, 0), 0)]
    while todo:  # the part with the greater roots is on top
        low, high, n_low, n_high = todo.pop()
        if n_low == n_high or n_high >= most:
            continue
        if n_low - n_high == 1:
            # the sign above the root; a root at `high` itself belongs to this part
            sign = _sign(scaled, high)
            if not sign:
                found.append((high, 1))
                continue
            while high - low > 1:
                mid = (low + high) // 2
                s = _sign(scaled, mid)
                low, high = (mid, high) if s == -sign else (low, mid) if s else (mid, mid + 1)
            found.append((low, 1))
        elif high - low == 1:
            found.append((low, n_low - n_high))
        else:
            mid = (low + high) // 2
            n = _above(scaled, mid)
            todo += [(low, mid, n_low, n), (mid, high, n, n_high)]
    return found


def null_vectors(matrix: np.ndarray, root: int, bits: int, n: int) -> list[list[float]]:
    """n orthonormal vectors that matrix - root leaves (nearly) nothing of, by inverse iteration in whole numbers."""
    d, guard = len(matrix), bits + 128
    a = np.array([[(int(v) << bits) - (root if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(matrix)], object) << guard
    lower, order = np.zeros((d, d), object), list(range(d))
    for k in range(d):
        i = max(range(k, d), key=lambda i: abs(a[i, k]))
        for m in (a, lower):
            m[[k, i]] = m[[i, k]]
        order[k], order[i] = order[i], order[k]
        a[k, k] = a[k, k] or 1  # an exact root: the least number there is instead of nothing
        if k + 1 < d:
            factor = (a[k + 1 :, k] << guard) // a[k, k]
            lower[k + 1 :, k] = factor
            a[k + 1 :, k + 1 :] -= (factor[:, None] * a[k, k + 1 :][None, :]) >> guard
            a[k + 1 :, k] = 0
    unit = 1 << guard

    def solved(b: np.ndarray) -> np.ndarray:
        b = b[order].copy()
        for k in range(d):
            b[k + 1 :] -= (lower[k + 1 :, k] * b[k]) >> guard
        for k in range(d - 1, -1, -1):
            b[k] = (b[k] << guard) // a[k, k]
            b[:k] -= (a[:k, k] * b[k]) >> guard
        return b

    def normed(b: np.ndarray) -> np.ndarray:
        return (b << guard) // max(1, isqrt(int((b * b).sum())))

    rng, basis = np.random.default_rng(13), []
    while len(basis) < n:
        v = np.array([int(x) << guard - 20 for x in rng.integers(-(1 << 20), 1 << 20, d)], object)
        for _ in range(3):
            for _ in range(2):
                for known in basis:
                    v = v - ((known * (int((known * v).sum()) >> guard)) >> guard)
                v = normed(v)
            v = solved(v)
            v = normed(v << guard)
        for known in basis:
            v = v - ((known * (int((known * v).sum()) >> guard)) >> guard)
        basis.append(normed(v))
    out = []
    for v in basis:
        if v[int(np.argmax([abs(x) for x in v]))] < 0:
            v = -v
        out.append([int(x) / unit for x in v])
    return out


@dataclass
class Whitening:
    """n and T of the fit list, the trace of its covariance, and components as columns with their eigenvalues."""

    n: int
    sums: list[int]
    trace: float
    eigenvalues: np.ndarray
    vectors: np.ndarray

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * y - T, exact."""
        largest = max([1, *map(abs, self.sums)]) + self.n * (max(abs(int(y.max())), abs(int(y.min()))) if y.size else 0)
        if y.dtype == object or largest >= 2**27:
            y = np.vectorize(int, otypes=[object])(y)
            return y * self.n - np.array(self.sums, object) if y.size else y
        return y.astype(np.int64) * self.n - np.array(self.sums, np.int64)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.eigenvalues)


def commonest_length(vectors: DataFrame) -> int:
    row = vectors.groupBy(F.size("v").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    return row.d if row else 0


def fit(vectors: DataFrame, d: int, most: int = MOST) -> Whitening:
    """The whitening of vectors (v array<double>) of d dimensions."""
    spark = vectors.sparkSession
    n, sums, products = moments(vectors, d)
    scatter = products * n - np.outer(np.array(sums, object), np.array(sums, object)) if n else np.zeros((d, d), object)
    trace = int(sum(scatter.diagonal())) if d else 0
    if not trace:
        return Whitening(n, sums, 0.0, np.zeros(0), np.zeros((d, 0)))
    poly = characteristic(spark, scatter)
    for bits in BITS:
        found = roots(poly, most + 1, bits)
        if all(m == 1 for _, m in found) and all(a - b > APART for (a, _), (b, _) in zip(found, found[1:], strict=False)) and found[-1][0] > APART:
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, root, many in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                basis = null_vectors(scatter, int(root), bits, many)
                yield pa.RecordBatch.from_arrays([pa.array([at] * many, pa.int32()), pa.array(range(many), pa.int32()), pa.array(basis, pa.list_(pa.float64()))], names=["at", "i", "v"])

    rows = [(at, str(root), many) for at, (root, many) in enumerate(found) if sum(m for _, m in found[:at]) < most]
    tasks = spark.createDataFrame(rows, "at int, root string, many int").repartition(min(len(rows), max(1, spark.sparkContext.defaultParallelism)))
    basis = sorted((r.at, r.i, r.v) for r in tasks.mapInArrow(run, "at int, i int, v array<double>").collect())[:most]
    # a root is rounded down: half a unit is nearer, and never 0
    values = [(2 * found[at][0] + 1) / (n * n << bits + 1) for at, _, _ in basis]
    return Whitening(n, sums, trace / (n * n), np.array(values), np.array([v for _, _, v in basis]).T)


def identity_error(vectors: DataFrame, d: int, by: Whitening) -> float:
    """The largest difference between the covariance of the whitened vectors and the identity."""
    k = len(by.eigenvalues)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            if batch.num_rows:
                w = by.whitened(by.centred(_whole(batch.column(0), d)))
                w = np.concatenate([np.ones((len(w), 1)), w], 1)
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "x"])

    sums = vectors.mapInArrow(partial, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x"))
    total = np.zeros((k + 1) ** 2)
    for r in sums.collect():  # a row for each pair of components
        total[r.cell] = r.x
    total = total.reshape(k + 1, k + 1) / by.n
    return float(np.abs(total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:]) - np.eye(k)).max())


def whitened(table: DataFrame, most: int = MOST, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each remaining row and component: vec_id, component, n, deviation decimal(38,0) (null from 10**38), whitened, explained, identity_error."""
    rows = _usable(table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")), "v").withColumn("v", F.col("v").cast("array<double>"))
    d = commonest_length(rows)
    rows = rows.where(F.size("v") == d)
    by = fit(rows.select("v"), d)
    k = len(by.eigenvalues)
    error = identity_error(rows.select("v"), d, by) if k else 0.0
    explained = by.eigenvalues / by.trace if k else by.eigenvalues

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (m := batch.num_rows) or not k:
                continue
            centred = by.centred(_whole(batch.column(1), d))
            deviation = [int(v) if v < 10**38 else None for v in (centred * centred).sum(1)]
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, by.n, np.int64)),
                    pa.array([None if v is None else str(v) for v in deviation], pa.string()).cast(pa.decimal128(38, 0)).take(pa.array(at)),
                    pa.array(by.whitened(centred).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def whitened_rows(table: DataFrame) -> DataFrame:
    """whitened() with deviation as a long; null where it doesn't fit one."""
    return whitened(table).withColumn("deviation", F.expr("try_cast(deviation as long)"))
