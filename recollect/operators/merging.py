"""Things that turn out to be one: merges followed to their end, edges moved at both ends, counts and names carried along."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.operators.linkage import chains
from recollect.plans.dialect import Queries
from recollect.shared import spread, written
from recollect.tables import table

Q = Queries()


def survivors(merges: DataFrame) -> DataFrame:
    """(id, entity) for merges (old, new, at): what each merged or merged-into id is in the end, through chains of any length.

    Of several merges of one id the first counts (ties: the smaller target), as the id is gone afterwards. Nulls and merges with itself count for
    nothing. Ids that go round in a circle, or lead into one, stay what they are. Every id is also its own row, so the rows of an entity are its names.
    """
    usable = merges.where("old is not null and new is not null and old <> new")
    first = usable.groupBy("old").agg(F.min(F.struct("at", "new")).alias("m")).select(F.col("old").alias("id"), F.col("m.new").alias("parent"))
    ends = usable.select(F.col("new").alias("id")).distinct().join(first.select("id"), "id", "left_anti")
    links = written(first.unionByName(ends, allowMissingColumns=True), "merges")
    return chains(links).select("id", F.coalesce("root", "id").alias("entity"))


def moved_edges(edges: DataFrame, alias: DataFrame) -> DataFrame:
    """(src, dst, rel, mentions, weight): edges with both ends replaced by what they are in the end (id, entity). Edges that become one are added
    up, those that would join a thing with itself go (also where they did before). Edges are added up before they are joined, so that a hot
    end is as many rows as it has neighbours, not mentions."""
    known = edges.where("src is not null and dst is not null").groupBy("src", "dst", "rel").agg(F.sum("mentions").alias("mentions"), F.sum("weight").alias("weight"))
    for end in ("src", "dst"):
        known = known.join(alias.select(F.col("id").alias(end), "entity"), end, "left").withColumn(end, F.coalesce("entity", end)).drop("entity")
    return known.where("src <> dst").groupBy("src", "dst", "rel").agg(F.sum("mentions").alias("mentions"), F.sum("weight").alias("weight"))


def _merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of odd number are one with the supplier of half their number, or with the one before, which counts second."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 1 and s_suppkey > 1").select(F.col("s_suppkey").alias("old"))
    return s.select("old", F.floor(F.col("old") / 2).alias("new"), F.lit(1).alias("at")).union(s.select("old", F.col("old") - 1, F.lit(2)))


_SURVIVORS = """a(id, entity) AS (SELECT s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey <= 1
        UNION ALL SELECT s_suppkey, a.entity FROM supplier JOIN a ON s_suppkey // 2 = a.id WHERE s_suppkey % 2 = 1 AND s_suppkey > 1)"""


@Q.add(f"""
    WITH RECURSIVE {_SURVIVORS},
    e AS (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_returnflag, l_quantity) AS dst, l_returnflag AS rel, l_quantity FROM lineitem)
    SELECT x.entity AS src, y.entity AS dst, rel, count(*) AS mentions, sum(l_quantity)::DOUBLE AS weight
    FROM e JOIN a x ON x.id = src JOIN a y ON y.id = dst WHERE x.entity <> y.entity GROUP BY ALL""")
def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which supplier follows which within an order, after suppliers were merged: chains of merges closed, both ends moved."""
    then = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_returnflag", "l_quantity"))
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.select(F.col("l_suppkey").alias("src"), then.alias("dst"), F.col("l_returnflag").alias("rel"), F.lit(1).alias("mentions"), F.col("l_quantity").alias("weight"))
    with spread(spark, lines.count()):
        return written(moved_edges(edges, survivors(_merges(spark, sf_dir))).withColumn("weight", F.col("weight").cast("double")), "moved")


@Q.add(f"""
    WITH RECURSIVE {_SURVIVORS} SELECT entity, count(*) AS names, sum(n)::BIGINT AS supplied FROM a JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) ON l_suppkey = id
    GROUP BY entity""")
def merged_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names each merged supplier goes by among those that supply, and what was counted under all of them."""
    counted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("n"))
    known = counted.join(survivors(_merges(spark, sf_dir)), "id", "left").withColumn("entity", F.coalesce("entity", "id"))
    return known.groupBy("entity").agg(F.count("*").alias("names"), F.sum("n").alias("supplied"))


QUERIES, ORACLE = Q.queries, Q.oracle
