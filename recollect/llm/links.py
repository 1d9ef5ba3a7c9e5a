"""Links between the members of candidate groups, without listing all pairs of a group.

A candidate group holds the ids that share one key (a band bucket, a segment). First every member is
compared with the group's centre, the member that has the most company over all its groups: of a family
of copies that is the text closest to the common original. Connected members form a component. Where a
group still spans several components its members are dealt anew into finer groups, if the caller knows
keys that every link among them shares, and compared with the centres of those. Only what is open then is
compared across components, and there a bound that the caller computes in linear work keeps pairs that
can't be links out of the join. Every candidate pair ends up compared, bounded away, without a common
finer key or inside one component, so the components are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators.graph import connected_components
from recollect.shared import filtered_early, forget, written

#: Up to so many keys (8 MB of them) are sent to every task; more are joined by a shuffle.
BROADCAST_KEYS = 500_000

Fetch = Callable[[DataFrame], DataFrame]
Verify = Callable[[DataFrame, DataFrame], DataFrame]
Bound = Callable[[DataFrame, DataFrame], tuple[DataFrame, Callable[[str, str], Column]]]
Finer = Callable[[DataFrame, DataFrame], DataFrame]


def shared_groups(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) of the groups of two rows, (key, id, own, n) of the larger groups; n counts rows).

    Only groups with an own row count. Keys are counted first, with the two extremes of a number that stands
    for a row: its id, or ~id if it isn't own. Of keys that nobody shares, nearly all, that is all that is
    ever shuffled, and groups of two are known from it. The rows of larger groups are made again."""
    mark = F.when(F.col("own"), F.col("id")).otherwise(F.bitwise_not("id"))
    sizes = groups.select("key", mark.alias("v")).groupBy("key").agg(F.min("v").alias("l"), F.max("v").alias("h"), F.count("*").alias("n"))
    shared = written(sizes.where("h >= 0 and l <> h"), "shared")
    two = shared.where("n = 2").select("h", F.expr("if(l < 0, ~l, l)").alias("l")).where("h <> l").select(*_pair("h", "l")).distinct()
    larger = shared.where("n > 2").select("key", "n")
    few = larger.count() <= BROADCAST_KEYS
    with filtered_early(groups.sparkSession):
        return two, written(groups.join(F.broadcast(larger) if few else larger, "key").select("key", "id", "own", "n"), "members")


def centred(members: DataFrame) -> DataFrame:
    """(key, id, own, centre) of shared_groups(): with each group's centre, an own member."""
    company = members.groupBy("id").agg(F.sum("n").alias("company"))
    centres = members.where("own").join(company, "id").groupBy("key").agg(F.max_by("id", F.struct("company", "id")).alias("centre"))
    return written(members.drop("n").join(centres, "key"), "centred")


def _pair(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _stars(members: DataFrame) -> DataFrame:
    """Pairs of the members with the centres of their groups."""
    return members.where("centre <> id").select(*_pair("centre", "id")).distinct()


def _open(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, id, own, c) of what was compared with centres only: in groups where it spans several components, those being c."""
    component = written(connected_components(edges), "components")
    placed = members.where("id <> centre").join(component, "id", "left").select("key", "id", "own", F.coalesce("component", "id").alias("c"))
    spread = placed.groupBy("key").agg(F.min("c").alias("l"), F.max("c").alias("h"), F.max("own").alias("some")).where("l <> h and some")
    return written(placed.join(spread.select("key"), "key", "left_semi").distinct(), "rest")


def _across(rest: DataFrame, may: Callable[[str, str], Column]) -> DataFrame:
    """Pairs of one group and two components that may be links; of the groups that a pair shares one forms it."""
    keys = rest.groupBy("id").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("own"), F.col("key"))).alias("own_keys"))
    rest = written(rest.join(keys, "id"), "rest")
    once = F.expr("array_min(array_intersect(x.keys, y.own_keys)) = x.key")
    met = F.expr("x.key = y.key and x.c <> y.c and x.id <> y.id and (not x.own or x.id < y.id)")
    return rest.alias("x").join(rest.where("own").alias("y"), met & may("x", "y") & once).select(*_pair("x.id", "y.id")).distinct()


def linked(groups: DataFrame, fetch: Fetch, verify: Verify, bound: Bound | None = None, finer: Finer | None = None) -> tuple[DataFrame, DataFrame]:
    """(verified pairs (a, b) with a < b, components (id, component) of the ids in them).

    groups: (key, id, own), ids from 0, own marking ids that may stand on either side of a pair; an id that
    is not own is compared with own ids only. fetch takes ids, as a written table, and returns their contents, written too;
    verify takes pairs and contents and keeps the rows (a, b) that are true links. finer takes ids and
    contents and returns groups such that ids which may be a link share one. bound takes ids and contents and
    returns the ids with columns, and the condition on the columns of two ids under which they may be a link.
    """
    pairs, members = shared_groups(groups)
    members = centred(members)
    tried = written(pairs.unionByName(_stars(members)).distinct(), "stars")
    ids = tried.select(F.col("a").alias("id")).unionAll(tried.select(F.col("b").alias("id"))).distinct()
    contents = fetch(written(ids, "ids"))
    edges = written(verify(tried, contents), "links")
    rest = _open(members, edges)
    if finer:
        pairs, members = shared_groups(finer(rest.select("id").distinct(), contents))
        members = centred(members)
        stars = written(pairs.unionByName(_stars(members)).distinct().join(tried, ["a", "b"], "left_anti"), "stars")
        edges = written(edges.unionByName(verify(stars, contents)).distinct(), "links")
        tried = tried.unionByName(stars)
        rest = _open(members, edges)
    may = lambda x, y: F.lit(True)
    if bound:
        ids, may = bound(rest.select("id").distinct(), contents)
        rest = written(rest.join(ids, "id"), "rest")
    across = written(_across(rest, may).join(tried, ["a", "b"], "left_anti"), "across")
    edges = written(edges.unionByName(verify(across, contents)).distinct(), "links")
    forget(contents)
    return edges, connected_components(edges)
