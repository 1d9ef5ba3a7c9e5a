"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample (SAMPLE vectors, a parameter) and every vector is put into its leaf by
going down to the nearest child. A search goes best bin first: a priority queue holds the branches seen so
far by the distance of their centres, and leaves come off it in the order of promise. How many leaves a
search visits is calibrated: for a sample of the queries (CALIBRATION) the true neighbours are found by brute
force over all vectors, and the visits are widened until TARGET of them lie in visited leaves. Leaves and
the queries that visit them meet in blocks of bounded size, in double precision.

Equal vectors are one entry with its smallest identifiers, as many as an answer can need, so that copies
of one vector, however many, are a single row to search.

Defined cases: vectors that are null, zero, or hold a null or a non-finite component, take no part, as query
or candidate. Vectors of fewer components than the longest are continued by zeroes. Ties go to the smaller
identifier, however many there are. With fewer candidates than asked for, those are returned. An empty table gives an
empty result. Rows that repeat an identifier with its vector are one candidate.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.shared import written

SAMPLE, BRANCH, LEAF, CALIBRATION, TARGET = 20_000, 8, 48, 96, 0.97
#: Vectors whose leaves are searched together, and most vectors, and queries, that meet in one group.
BIN, BLOCK = 4096, 20_000


class Tree:
    """Centres of the nodes, breadth first; children of node i are rows first[i] to first[i] + n[i]; no children: a leaf."""

    def __init__(self, sample: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        centres, first, count, todo = [sample.mean(0) if len(sample) else np.zeros(1)], [0], [0], [(0, sample)]
        while todo:
            node, rows = todo.pop(0)
            if len(rows) <= LEAF:
                continue
            means, of = _kmeans(rows, min(BRANCH, len(rows)), rng)
            if len(means) < 2:
                continue
            first[node], count[node] = len(centres), len(means)
            for k, mean in enumerate(means):
                todo.append((len(centres), rows[of == k]))
                centres.append(mean)
                first.append(0)
                count.append(0)
        self.centres, self.first, self.count = np.array(centres), np.array(first), np.array(count)

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        at = np.zeros(len(vectors), np.int64)
        while True:
            moved = False
            for node in np.unique(at[self.count[at] > 0]):
                here = np.flatnonzero(at == node)
                low, n = self.first[node], self.count[node]
                at[here] = low + np.argmin(_squares(vectors[here], self.centres[low : low + n]), 1)
                moved = True
            if not moved:
                return at

    def leaves(self, query: np.ndarray, most: int) -> list[int]:
        """The first leaves of a best-bin-first traversal."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            low, n = int(self.first[node]), int(self.count[node])
            if not n:
                out.append(node)
                continue
            gap = self.centres[low : low + n] - query
            for k, d in enumerate(np.einsum("ij,ij->i", gap, gap).tolist()):
                heapq.heappush(queue, (d, low + k))
        return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T)


def _kmeans(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    means = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        of = np.argmin(_squares(rows, means), 1)
        used = np.unique(of)
        means = np.stack([rows[of == j].mean(0) for j in used])
    of = np.argmin(_squares(rows, means), 1)
    used, of = np.unique(of, return_inverse=True)
    return means[used], of


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors kept as bytes of doubles."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1) if data else np.zeros((0, 1))


def _nearest(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance) of the k nearest vectors of each query, ties to the smaller of ids; exact distances.

    Squares by products are near enough to tell what can't be among them: whatever is within twice their
    error of the k-th stays, however many tie there, and is measured again by differences."""
    rough = _squares(queries, vectors)
    error = 1e-12 * ((queries * queries).sum(1)[:, None] + (vectors * vectors).sum(1).max())
    if len(vectors) > k:
        who, at = np.nonzero(rough <= np.partition(rough, k - 1, 1)[:, k - 1 : k] + 2 * error)
    else:
        who, at = np.repeat(np.arange(len(queries)), len(vectors)), np.tile(np.arange(len(vectors)), len(queries))
    d = np.empty(len(who))
    for low in range(0, len(who), 100_000):
        part = slice(low, low + 100_000)
        gap = vectors[at[part]] - queries[who[part]]
        d[part] = np.sqrt((gap * gap).sum(1))
    return _first(who, at, d, ids[at], k)


def _first(who: np.ndarray, at: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of each query with the smallest (d, id)."""
    order = np.lexsort((ids, d, who))
    who, at, d = who[order], at[order], d[order]
    start = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.zeros(0, np.int64)
    keep = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who)))) < k
    return who[keep], at[keep], d[keep]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec) of the vectors that take part, vec as bytes of doubles."""
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    )
    length = plain.agg(F.max(F.size("v"))).first()[0] or 0
    plain = plain.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(length) - F.size("v"))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False) + 0.0  # no negative zeroes
            rows = flat.reshape(-1, length).astype("<f8") if length else flat
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["vec_id", "vec"])

    return plain.mapInArrow(pack, "vec_id long, vec binary")


def _least_ids(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = held.setdefault(v, [])
                if i not in ids:
                    ids.append(i)
                    if len(ids) > most:
                        ids.remove(max(ids))
            if len(held) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["vec", "ids"])
                held = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["vec", "ids"])

    return run


def _truth(entries: DataFrame, asked: np.ndarray, k: int) -> DataFrame:
    """(q, leaf) of the k nearest entries of each asked vector (a bounded number of them) but its own, by brute force."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vec"))
            if len(vectors):
                leaf = np.array(batch.column("leaf").to_pylist())
                who, at, d = _nearest(asked, vectors, leaf, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(leaf[at]), pa.array(d)], names=["q", "leaf", "d"])

    best = F.row_number().over(Window.partitionBy("q").orderBy("d", "leaf"))
    return entries.select("vec", "leaf").mapInArrow(run, "q long, leaf long, d double").where("d > 0").withColumn("r", best).where(F.col("r") <= k).select("q", "leaf")


def _meet(k: int):
    """Of a bin of leaves and the queries that visit some of them: the k nearest vectors of each query in the bin."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        leaf, ids = vectors["leaf"].to_numpy(), vectors["ids"].to_pylist()
        first = np.array([x[0] for x in ids], np.int64)
        if len(leaf) and queries.num_rows:
            rows, asked = _matrix(vectors["vec"]), _matrix(queries["vec"])
            sizes = [len(x) for x in queries["leaves"].to_pylist()]
            visitor, visited = np.repeat(np.arange(len(sizes)), sizes), queries["leaves"].combine_chunks().flatten().to_numpy()
            for one in np.unique(visited):
                here, who = np.flatnonzero(leaf == one), visitor[visited == one]
                step = max(1, 4_000_000 // max(1, len(here)))
                for low in range(0, len(who) if len(here) else 0, step):
                    q, at, d = _nearest(asked[who[low : low + step]], rows[here], first[here], k)
                    found.append((who[low : low + step][q], here[at], d))
        if not found:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.list_(pa.int64()))], names=["q", "score", "ids"])
        who, at, d = (np.concatenate(x) for x in zip(*found, strict=True))
        who, at, d = _first(who, at, d, first[at], k)
        return pa.table([pa.array(queries["q"].to_numpy()[who]), pa.array(d), pa.array([ids[i] for i in at], pa.list_(pa.int64()))], names=["q", "score", "ids"])

    return run


def _bins(sizes: dict[int, int]) -> dict[int, int]:
    """Neighbouring leaves share a bin up to BIN vectors; a larger leaf has its own."""
    out, bin_no, held = {}, 0, 0
    for leaf in sorted(sizes):
        if held and held + sizes[leaf] > BIN:
            bin_no, held = bin_no + 1, 0
        out[leaf], held = bin_no, held + sizes[leaf]
    return out


def nearest_neighbours(vectors: DataFrame, query_every: int = 100, k: int = 10, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest of each row whose vec_id is divisible by query_every."""
    rows = written(usable(vectors), "vectors")
    partial = rows.mapInArrow(_least_ids(k + 1), "vec binary, ids array<long>")
    entries = partial.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    entries = written(entries, "entries")
    tree = Tree(_matrix(entries.orderBy(F.xxhash64("vec"), "vec").limit(sample).select("vec").toArrow()["vec"]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tree.leaf_of(_matrix(batch.column(0))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=["vec", "ids", "leaf"])

    placed = written(entries.select("vec", "ids").mapInArrow(place, "vec binary, ids array<long>, leaf long"), "placed")
    asking = rows.where(F.col("vec_id") % query_every == 0).select("vec", F.col("vec_id").alias("query_id")).distinct()
    asking = written(asking.join(placed.select("vec", F.col("ids")[0].alias("q")), "vec").select("q", "query_id", "vec"), "asking")
    queries = asking.select("q", "vec").distinct()
    some = _matrix(queries.orderBy(F.xxhash64("q"), "q").limit(CALIBRATION).select("vec").toArrow()["vec"])
    visits = _calibrated(tree, some, _truth(placed, some, k).toArrow() if len(some) else None, target)

    sizes = {r.leaf: r.n for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # as many as the tree has leaves
    bins = _bins(sizes)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for q, vec, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _matrix(batch.column(1)), strict=True) if batch.num_rows else ():
                by: dict[int, list[int]] = {}
                for leaf in tree.leaves(v, visits):
                    if leaf in bins:
                        by.setdefault(bins[leaf], []).append(leaf)
                out += [(q, vec, b, leaves) for b, leaves in by.items()]
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["q", "vec", "bin", "leaves"])

    visiting = written(queries.mapInArrow(visit, "q long, vec binary, bin long, leaves array<long>"), "visiting")
    placed = placed.join(vectors.sparkSession.createDataFrame(list(bins.items()), "leaf long, bin long"), "leaf")
    blocks = placed.groupBy("bin").agg(F.ceil(F.count("*") / BLOCK).alias("nv")).join(visiting.groupBy("bin").agg(F.ceil(F.count("*") / BLOCK).alias("nq")), "bin")
    left = placed.join(blocks, "bin").select("bin", F.pmod(F.xxhash64("vec"), "nv").alias("bv"), F.explode(F.expr("sequence(0L, nq - 1)")).alias("bq"), "leaf", "vec", "ids")
    right = visiting.join(blocks, "bin").select("bin", F.explode(F.expr("sequence(0L, nv - 1)")).alias("bv"), F.pmod(F.xxhash64("q"), "nq").alias("bq"), "q", "vec", "leaves")
    key = ["bin", "bv", "bq"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_meet(k + 1), "q long, score double, ids array<long>")
    each = met.select("q", "score", F.explode("ids").alias("vec_id"))
    best = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    tops = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("top"))
    answers = asking.select("q", "query_id").join(tops, "q").select("query_id", F.posexplode(F.expr(f"slice(filter(top, x -> x.vec_id <> query_id), 1, {k})")).alias("at", "x"))
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _calibrated(tree: Tree, asked: np.ndarray, truth: pa.Table | None, target: float) -> int:
    """The fewest visits that find target of the true neighbours of the asked vectors."""
    if truth is None or not truth.num_rows:
        return 1
    total = int((tree.count == 0).sum())
    place = [{leaf: i for i, leaf in enumerate(tree.leaves(v, total))} for v in asked]
    needed = np.sort([place[q][leaf] + 1 for q, leaf in zip(truth["q"].to_pylist(), truth["leaf"].to_pylist(), strict=True)])
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])
