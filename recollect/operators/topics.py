"""Graph and topics: weighted edges, neighbourhoods, paths, PageRank, components, votes, names, signatures.

Walks and PageRank are rounds of joins, each followed by a grouped sum or minimum, so a hub costs its edges
and not their square; the number of rounds is fixed. Rounds that widen a frontier write it to the shared
folder before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.graph import connected_components, pagerank
from recollect.plans.dialect import Queries
from recollect.shared import spread, written
from recollect.tables import table

Q = Queries()

Q.sql("edge_weights", "lineitem", lambda d: "SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS rel, count(*) AS mentions, round(sum(l_quantity), 2) AS weight FROM lineitem GROUP BY l_partkey, l_suppkey, l_returnflag")

Q.sql("co_mention_edges", "lineitem part", lambda d: """
    WITH m AS (SELECT DISTINCT l_orderkey AS memory, p_brand AS entity FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT x.entity AS a, y.entity AS b, count(*) AS together FROM m x JOIN m y ON x.memory = y.memory AND x.entity < y.entity GROUP BY x.entity, y.entity""")

Q.sql("induced_subgraph", "lineitem supplier", lambda d: """
    WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem)
    SELECT src, dst FROM e WHERE src IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND dst IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""", large="lineitem")

Q.sql("graph_stats", "lineitem", lambda d: """
    WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS w FROM lineitem GROUP BY l_partkey, l_suppkey)
    SELECT count(*) AS edges, count(DISTINCT src) AS parts, count(DISTINCT dst) AS suppliers, sum(w) AS weight, max(w) AS heaviest FROM e""")

Q.sql("neighbour_union", "orders lineitem supplier", lambda d: """
    SELECT o_custkey AS node, l_suppkey AS neighbour FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'
    UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'""")

Q.sql("node_relations_ranked", "lineitem orders", lambda d: """
    WITH e AS (SELECT o_custkey AS node, l_suppkey AS neighbour, count(*) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_suppkey)
    SELECT node, neighbour, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, neighbour) AS rank FROM e) WHERE rank <= 25""")

Q.sql("conversation_parent_chain", "conversations", lambda d: """
    WITH s AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id)
    SELECT c.conv_id, p.conv_id AS parent, g.conv_id AS grandparent, c.turns + coalesce(p.turns, 0) + coalesce(g.turns, 0) AS turns
    FROM s c LEFT JOIN s p ON p.conv_id = cast(floor(c.conv_id / 3) AS bigint) AND c.conv_id > 0 LEFT JOIN s g ON g.conv_id = cast(floor(p.conv_id / 3) AS bigint) AND p.conv_id > 0""")

Q.sql("entity_topic_vote", "lineitem part orders", lambda d: """
    WITH v AS (SELECT l_suppkey AS entity, p_type AS topic, count(*) AS votes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_type)
    SELECT entity, topic, votes FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY votes DESC, topic) AS r FROM v) WHERE r = 1""")

Q.sql("strict_majority_vote", "lineitem part orders", lambda d: """
    WITH v AS (SELECT o_custkey AS unit, substring(p_type, 1, 5) AS owner, count(*) AS votes FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, substring(p_type, 1, 5)),
    t AS (SELECT *, sum(votes) OVER (PARTITION BY unit) AS total FROM v)
    SELECT unit, owner, votes, total FROM t WHERE 2 * votes > total""")

Q.sql("topic_top_terms", "documents", lambda d: f"""
    WITH t AS (SELECT source, term, count(*) AS n FROM (SELECT source, {d.each}({d.tokens('text')}) AS term FROM documents) WHERE length(term) > 3 GROUP BY source, term),
    df AS (SELECT term, count(*) AS df FROM t GROUP BY term), k AS (SELECT count(DISTINCT source) AS k FROM documents),
    s AS (SELECT source, term, round(n * ln(1 + k / cast(df AS double)), 6) AS score FROM t JOIN df USING (term) CROSS JOIN k)
    SELECT source, term, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 5""")

Q.sql("topic_signature", "documents", lambda d: f"""
    SELECT source, lang, md5({d.joined('cast(doc_id AS varchar(20))', ' ')}) AS signature, count(*) AS members FROM documents GROUP BY source, lang""")

Q.sql("top_entities_per_conversation", "conversations", lambda d: f"""
    WITH w AS (SELECT conv_id, word, count(*) AS n FROM (SELECT conv_id, {d.each}({d.finds('text', '[A-Z][a-z]{4,}')}) AS word FROM conversations) GROUP BY conv_id, word)
    SELECT conv_id, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, word) AS rank FROM w) WHERE rank <= 25""")

Q.sql("pairwise_cluster_f1", "embeddings", lambda d: f"""
    WITH p AS (SELECT label AS gold, cast(floor(4 * ({d.at('embedding', '1')} + 1)) AS bigint) AS pred FROM embeddings),
    both_ AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT count(*) AS n FROM p GROUP BY gold, pred)),
    g AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT count(*) AS n FROM p GROUP BY gold)),
    q AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT count(*) AS n FROM p GROUP BY pred))
    SELECT round(both_.x / q.x, 6) AS precision_, round(both_.x / g.x, 6) AS recall, round(2 * both_.x / (q.x + g.x), 6) AS f1 FROM both_ CROSS JOIN g CROSS JOIN q""")

Q.sql("promote_recurring_phrases", "documents", lambda d: f"""
    WITH w AS (SELECT doc_id, {d.finds('text', '[A-Z][\\p{L}]{3,} [\\p{L}]{4,}')} AS p FROM documents),
    x AS (SELECT DISTINCT doc_id, phrase FROM (SELECT doc_id, {d.each}(p) AS phrase FROM w))
    SELECT phrase, count(*) AS memories, min(doc_id) AS first FROM x GROUP BY phrase HAVING count(*) >= 2""")

Q.sql("pairwise_tfidf_similarity", "documents", lambda d: f"""
    WITH u AS (SELECT source, lang, term, count(*) AS tf FROM (SELECT source, lang, {d.each}({d.tokens('text')}) AS term FROM documents) GROUP BY source, lang, term),
    un AS (SELECT concat(source, '/', lang) AS unit, term, tf FROM u),
    n AS (SELECT count(DISTINCT unit) AS n FROM un), df AS (SELECT term, count(*) AS df FROM un GROUP BY term),
    w AS (SELECT unit, term, (1 + ln(tf)) * ln((1.0 + n) / (1.0 + df)) AS w FROM un JOIN df USING (term) CROSS JOIN n WHERE df <= n / 2),
    l AS (SELECT unit, sqrt(sum(w * w)) AS l FROM w GROUP BY unit),
    s AS (SELECT x.unit AS a, y.unit AS b, sum(x.w * y.w) AS dot FROM w x JOIN w y ON x.term = y.term AND x.unit < y.unit GROUP BY x.unit, y.unit)
    SELECT a, b, round(dot / (la.l * lb.l), 5) AS similarity FROM s JOIN l la ON la.unit = a JOIN l lb ON lb.unit = b WHERE dot / (la.l * lb.l) > 0.01""")

_EDGES = "SELECT DISTINCT l_suppkey AS u, 1000000 + l_partkey AS v FROM lineitem"


def _bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 1000000).alias("v")).distinct()


def _levels(spark: SparkSession, sf_dir: str, rounds: int) -> DataFrame:
    """(node, depth) of the nodes within so many steps of supplier 1, breadth first."""
    one = _bipartite(spark, sf_dir)
    both = written(one.unionAll(one.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    seen = both.where("u = 1").select(F.col("u").alias("node")).distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for step in range(1, rounds + 1):
        near = frontier.join(both, F.col("node") == F.col("u")).select(F.col("v").alias("node")).distinct()
        frontier = written(near.join(seen, "node", "left_anti").withColumn("depth", F.lit(step)), "frontier")
        seen = seen.unionAll(frontier)
    return seen


_WALK = f"""WITH RECURSIVE one AS ({_EDGES}), e AS (SELECT u, v FROM one UNION ALL SELECT v, u FROM one),
    walk(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.v, depth + 1 FROM walk JOIN e ON e.u = node WHERE depth < %d)
    SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node"""


@Q.add(_WALK % 3)
def khop_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir, 3)


@Q.add(_WALK % 5)
def shortest_path_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir, 5)


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS r FROM nodes)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS (SELECT nodes.node, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * coalesce(s, 0) AS r FROM nodes LEFT JOIN "
                     f"(SELECT v AS node, sum(r * w / total) AS s FROM e JOIN out USING (u) JOIN r{i} ON r{i}.node = u GROUP BY v) USING (node))")
    return f"""WITH one AS (SELECT l_suppkey AS u, 1000000 + l_partkey AS v, count(*) AS w FROM lineitem GROUP BY ALL), e AS (SELECT u, v, w FROM one UNION ALL SELECT v, u, w FROM one),
    out AS (SELECT u, sum(w) AS total FROM e GROUP BY u), nodes AS (SELECT u AS node FROM out), {', '.join(steps)}
    SELECT node, round(r / (SELECT max(r) FROM r{rounds}), 6) AS rank FROM r{rounds}"""


@Q.add(_pagerank_sql(30))
def pagerank_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted PageRank with damping 0.85 on the undirected part and supplier graph, scaled by its maximum."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 1000000).alias("v"), F.lit(1).alias("w"))
    ranks = pagerank(lines, settled=1e-9, both_ways=True)
    return ranks.crossJoin(ranks.agg(F.max("r").alias("m"))).select("node", F.round(F.col("r") / F.col("m"), 6).alias("rank"))  # m: one row


STRONG = 4
_MET = "SELECT o_custkey AS a, 1000000 + l_suppkey AS b, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_suppkey"


def _components_sql(at_least: int) -> str:
    return f"""WITH RECURSIVE one AS (SELECT a, b FROM ({_MET}) WHERE n >= {at_least}), e AS (SELECT a AS u, b AS v FROM one UNION SELECT b, a FROM one),
    reach(node, root) AS (SELECT u, u FROM e UNION SELECT e.v, root FROM reach JOIN e ON e.u = node WHERE root <= e.v)
    SELECT node, min(root) AS component FROM reach GROUP BY node"""


def _met(spark: SparkSession, sf_dir: str, at_least: int) -> DataFrame:
    """Edges (a, b) between customers and suppliers that share at_least lines of orders or more."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    both = orders.join(line, orders.o_orderkey == line.l_orderkey).groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("n"))
    return both.where(F.col("n") >= at_least).select(F.col("o_custkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b"))


@Q.add(f"SELECT node AS id, component FROM ({_components_sql(1)})", name="connected_components")
def components_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with spread(spark, table(spark, sf_dir, "lineitem").count()):
        return connected_components(written(_met(spark, sf_dir, 1), "met"))


@Q.add(f"SELECT component, count(*) AS members, count_if(node < 1000000) AS units FROM ({_components_sql(STRONG)}) GROUP BY component")
def single_linkage_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics as components of the edges from weight STRONG on: single linkage, the distributed stand-in for average linkage."""
    found = connected_components(_met(spark, sf_dir, STRONG))
    return found.groupBy("component").agg(F.count("*").alias("members"), F.count_if(F.col("id") < 1000000).alias("units"))


@Q.add(f"SELECT node, CASE WHEN n < 3 THEN 0 ELSE component END AS topic FROM (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM ({_components_sql(STRONG)})) WHERE node < 1000000")
def assign_topic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest member as topic; groups below three are loose ends, topic 0."""
    found = connected_components(_met(spark, sf_dir, STRONG))
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    return found.join(sizes, "component").where("id < 1000000").select(F.col("id").alias("node"), F.when(F.col("n") < 3, 0).otherwise(F.col("component")).alias("topic"))


QUERIES, ORACLE = Q.queries, Q.oracle
