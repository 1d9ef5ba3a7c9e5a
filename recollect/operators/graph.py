"""Graph operators over edge tables: everything is joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.shared import bucketed, settings, written

#: PageRank: edges are dealt to at most so many cells, of so many edges as long as there are fewer.
CELLS, EDGES_EACH = 48, 75_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """Rows (id, component) for every endpoint of an edge; component is the smallest id reached.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014), which converge in a few rounds on stars and in O(log^2 n) on chains. Each step is a
    grouped minimum and an equi-join; a node with very many neighbours is split by adaptive skew joins.
    Raises if the labels still change after `rounds` steps, far more than chains of any real length need.
    Self loops keep isolated nodes in the result; null endpoints are dropped.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select("u")
    now = written(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = written(now.select("u").unionAll(now.select(F.col("v").alias("u"))).unionAll(loops).distinct(), "nodes")
    before = None
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_min, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionAll(joined.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        )
        now = written(small, "edges")
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, "u", "left").select(F.col("u").alias("id"), F.coalesce("component", "u").alias("component"))


def _cells(spark: SparkSession, n: int) -> list[int]:
    """n numbers that Spark's hash deals to n different partitions."""
    slots = spark.range(64 * n + 64).select(F.col("id").cast("int").alias("cell"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("slot"))
    found = [r.cell for r in slots.groupBy("slot").agg(F.min("cell").alias("cell")).collect()]
    if len(found) < n:
        raise RuntimeError(f"{len(found)} of {n} cells found")
    return found


def pagerank(edges: DataFrame, rounds: int = 30, damping: float = 0.85, settled: float = 1e-7, both_ways: bool = False, cells: int = CELLS) -> DataFrame:
    """(node, r) of weighted PageRank over edges (u, v, w), r summing to one over all endpoints; both_ways: every edge leads back as well.

    What nodes without outgoing weight have is dealt to all nodes evenly. Ends after `rounds` rounds, or earlier when
    no round changes the ranks by more than `settled` altogether. Rows that repeat an edge add up.

    Edges are dealt once to cells, by that end which has more different nodes (so fewer edges each), and stay there as a
    bucketed table. A round sends each rank to the cells that have edges of its node, sums there what each node is
    given, and adds the cells' sums up: shuffled are at most two rows for each node and cell that meet, no edges.
    """
    spark = edges.sparkSession
    one = edges.where("u is not null and v is not null and w > 0").select("u", "v", F.col("w").cast("double").alias("w"))
    known = one.agg(F.count("*").alias("n"), F.approx_count_distinct("u").alias("u"), F.approx_count_distinct("v").alias("v")).first()
    n = max(1, min(cells, -(-known.n // EDGES_EACH)))
    by, keys = "u" if known.u >= known.v else "v", F.array(*[F.lit(c) for c in _cells(spark, n)])
    ways = [F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))][: 2 if both_ways else 1]
    kept = {"spark__sql__shuffle__partitions": str(n), "spark__sql__requireAllClusterKeysForCoPartition": "false", "spark__sql__autoBroadcastJoinThreshold": "-1"}
    with settings(spark, **kept), bucketed(spark, n) as put:
        placed = one.withColumn("cell", F.get(keys, F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))).repartition(n, "cell")
        placed = put(placed.select("cell", F.explode(F.array(*ways)).alias("e"), "w").select("cell", "e.u", "e.v", "w"), "cell", "placed")
        out = placed.groupBy("cell", F.col("u").alias("node")).agg(F.sum("w").alias("total"))
        ends = out.unionByName(placed.select(F.col("v").alias("node")).distinct(), allowMissingColumns=True)
        nodes = ends.groupBy("node").agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.collect_list("cell").alias("places"))  # as many as there are cells
        nodes = put(nodes, "node", "nodes")
        count = nodes.count()
        ranks = put(nodes.withColumn("r", F.lit(1.0 / max(1, count))), "node", "ranks")
        lost = ranks.where("total = 0").agg(F.sum("r")).first()[0] or 0.0
        for _ in range(rounds if count else 0):
            sent = ranks.select(F.explode("places").alias("cell"), F.col("node").alias("u"), (F.col("r") / F.col("total")).alias("x"))
            pushed = placed.join(sent.hint("shuffle_hash"), ["cell", "u"]).groupBy(F.col("v").alias("node")).agg(F.sum(F.col("x") * F.col("w")).alias("s"))
            base = (1 - damping) / count + damping * lost / count
            new = ranks.withColumnRenamed("r", "was").join(pushed, "node", "left").withColumn("r", F.lit(base) + damping * F.coalesce("s", F.lit(0.0)))
            ranks = put(new.select("node", "total", "places", "r", "was"), "node", "ranks")
            moved, lost = ranks.agg(F.sum(F.abs(F.col("r") - F.col("was"))), F.coalesce(F.sum(F.when(F.col("total") == 0, F.col("r"))), F.lit(0.0))).first()
            ranks = ranks.drop("was")
            if moved <= settled:
                break
        return written(ranks.select("node", "r"), "ranks")
