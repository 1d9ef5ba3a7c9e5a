"""Conversations: transcripts, token meters, hand-off selections, joins and simple aggregates, exports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.plans.dialect import SPARK, Queries
from recollect.shared import written
from recollect.tables import table, views

Q = Queries()

Q.sql("conversation_token_meter", "conversations", lambda d: """
    SELECT conv_id, count(*) AS turns, sum(cast(ceil(length(text) / 4.0) AS bigint)) AS tokens, round(100.0 * sum(cast(ceil(length(text) / 4.0) AS bigint)) / 8192, 3) AS percent FROM conversations GROUP BY conv_id""")

Q.sql("merge_same_speaker_runs", "conversations", lambda d: f"""
    WITH t AS (SELECT conv_id, turn, text, CASE WHEN role = 'system' THEN 'user' ELSE role END AS role FROM conversations),
    m AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS new FROM t),
    g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m)
    SELECT conv_id, cast(run AS bigint) AS run, min(role) AS role, count(*) AS turns, md5({d.joined('text', '|', 'turn')}) AS text_md5 FROM g GROUP BY conv_id, run""")

Q.sql("models_in_first_use_order", "events", lambda d: """
    SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first, event_type) AS place FROM (SELECT user_id, event_type, min(ts) AS first FROM events GROUP BY user_id, event_type)""")

Q.sql("captures_by_conversation_title", "documents", lambda d: "SELECT source, lang, count(*) AS n, max(n_chars) AS longest, min(doc_id) AS first FROM documents GROUP BY source, lang")

_SENTENCES = lambda d: f"""
    raw AS (SELECT conv_id, turn, {d.each}({d.split('text', '[.!?]+')}) AS s FROM conversations),
    sent AS (SELECT DISTINCT conv_id, turn, trim({d.replace('s', chr(10), ' ')}) AS s FROM raw WHERE length(trim(s)) > 18)"""

Q.sql("sentences_for_summary", "conversations", lambda d: f"WITH {_SENTENCES(d)} SELECT conv_id, turn, count(*) AS sentences, min(s) AS first FROM sent GROUP BY conv_id, turn")

ROUNDS, DAMPING = 25, 0.85
#: Words of a conversation above which its ranks are worked out by many tasks together instead of one.
LONG = 1_000_000


@Q.add(lambda d: f"""
    WITH RECURSIVE {_SENTENCES(d)},
    each AS (SELECT row_number() OVER (ORDER BY conv_id, s) AS i, conv_id, s FROM (SELECT DISTINCT conv_id, s FROM sent)),
    n AS (SELECT conv_id, count(*) AS n FROM each GROUP BY conv_id),
    w AS (SELECT conv_id, i, term, count(*) AS tf FROM (SELECT conv_id, i, {d.each}({d.tokens('s')}) AS term FROM each) GROUP BY conv_id, i, term),
    df AS (SELECT conv_id, term, count(*) AS df FROM w GROUP BY conv_id, term),
    v AS (SELECT conv_id, i, term, tf * (ln((1.0e0 + n) / (1.0e0 + df)) + 1) AS v FROM w JOIN df USING (conv_id, term) JOIN n USING (conv_id)),
    l AS (SELECT i, sqrt(sum(v * v)) AS l FROM v GROUP BY i),
    e AS (SELECT x.i AS a, y.i AS b, sum(x.v * y.v) AS dot FROM v x JOIN v y ON x.conv_id = y.conv_id AND x.term = y.term AND x.i <> y.i GROUP BY x.i, y.i),
    c AS (SELECT a, b, dot / (p.l * q.l) AS w FROM e JOIN l p ON p.i = a JOIN l q ON q.i = b),
    o AS (SELECT a, sum(w) AS total FROM c GROUP BY a),
    g AS (SELECT a, b, w / total AS p FROM c JOIN o USING (a) UNION ALL SELECT i, i, 0 FROM each),
    r AS (SELECT i, 0 AS k, 1.0e0 AS r FROM each UNION ALL SELECT b, k + 1, {1 - DAMPING:.2f} + {DAMPING} * sum(p * r) FROM r JOIN g ON a = i WHERE k < {ROUNDS} GROUP BY b, k)
    SELECT conv_id, s, round(r, 5) AS rank FROM r JOIN each USING (i) WHERE k = {ROUNDS}""")
def textrank_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TextRank among the sentences of a conversation, likeness being the cosine of tf * idf with idf ln((1 + n) / (1 + df)) + 1 in the conversation."""
    views(spark, sf_dir, "conversations")
    said = spark.sql(f"WITH {_SENTENCES(SPARK)} SELECT DISTINCT conv_id, s FROM sent")
    return textrank(written(said.withColumn("id", F.monotonically_increasing_id()), "sentences"))


def textrank(sentences: DataFrame, rounds: int = ROUNDS, long: int = LONG) -> DataFrame:
    """(conv_id, s, rank) of sentences (id, conv_id, s), each once; one that shares no term with another of its conversation gets nothing from any and keeps 1 - DAMPING.

    No pair of sentences is formed: with vectors of length 1, a's likeness to b is the sum over shared terms of both weights, so what sentences give to each
    other is summed by term first and by sentence then, less what a sentence would give to itself (its likeness to itself is 1). A conversation
    costs its words, not the square of its sentences. One of up to `long` words is ranked in one task, longer ones by a loop of joins.
    """
    terms = F.expr("regexp_extract_all(lower(s), '[\\\\p{L}\\\\p{N}]+', 0)")
    worded = sentences.select("id", "conv_id", terms.alias("terms"))
    far = written(worded.groupBy("conv_id").agg(F.sum(F.size("terms")).alias("n")).where(F.col("n") > long).select("conv_id"), "long")
    ranks = worded.join(far, "conv_id", "left_anti").groupBy("conv_id").applyInPandas(_ranks(rounds), "id long, r double")
    if not far.isEmpty():
        ranks = ranks.unionByName(_ranks_of_long(worded.join(far, "conv_id", "left_semi"), rounds))
    # ranks of few sentences can be short decimals: the sums' last digits must not decide how their halves are rounded
    return sentences.join(ranks, "id").select("conv_id", "s", F.round(F.round("r", 11), 5).alias("rank"))


def _ranks(rounds: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The ranks of one conversation's sentences (id, terms)."""
        n, sizes = len(rows), rows["terms"].map(len).to_numpy()
        words, names = pd.factorize(np.concatenate([np.asarray(t, object) for t in rows["terms"]]))
        held, tf = np.unique(np.repeat(np.arange(n), sizes) * max(1, len(names)) + words, return_counts=True)
        owner, term = np.divmod(held, max(1, len(names)))
        df = np.bincount(term, minlength=len(names))
        v = tf * (np.log((1.0 + n) / (1.0 + df[term])) + 1)
        v /= np.sqrt(np.bincount(owner, v * v, n))[owner]
        met = np.bincount(owner, df[term] > 1, n) > 0

        def got(u: np.ndarray) -> np.ndarray:
            return np.bincount(owner, np.bincount(term, u[owner] * v, len(names))[term] * v, n) - u

        total, r = np.where(met, got(met.astype(float)), 1.0), np.ones(n)
        for _ in range(rounds):
            r = (1 - DAMPING) + DAMPING * np.where(met, got(np.where(met, r / total, 0.0)), 0.0)
        return pd.DataFrame({"id": rows["id"], "r": r})

    return run


def _ranks_of_long(worded: DataFrame, rounds: int) -> DataFrame:
    """(id, r) of sentences (id, conv_id, terms), by joins on terms: no task holds a conversation."""
    n = worded.groupBy("conv_id").agg(F.count("*").alias("n"))
    held = written(worded.select("id", "conv_id", F.explode("terms").alias("term")).groupBy("id", "conv_id", "term").agg(F.count("*").alias("tf")), "terms")
    df = held.groupBy("conv_id", "term").agg(F.count("*").alias("df"))
    weight = F.col("tf") * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1)
    heavy = written(held.join(df, ["conv_id", "term"]).join(n, "conv_id").select("id", "conv_id", "term", "df", weight.alias("v")), "weights")
    length = heavy.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l"), (F.max("df") > 1).alias("met")).where("met")
    # what no other sentence has plays no part beyond the length
    held = written(heavy.where("df > 1").join(length, "id").select("id", "conv_id", "term", (F.col("v") / F.col("l")).alias("v")), "terms")
    own = written(held.groupBy("id").agg(F.sum(F.col("v") * F.col("v")).alias("self")), "own")

    def got(gifts: DataFrame) -> DataFrame:
        """(id, got) for what each sentence gives (id, u)."""
        rows = held.join(gifts, "id")
        by_term = rows.groupBy("conv_id", "term").agg(F.sum(F.col("u") * F.col("v")).alias("all"))
        sums = rows.join(by_term, ["conv_id", "term"]).groupBy("id").agg(F.first("u").alias("u"), F.sum(F.col("all") * F.col("v")).alias("got"))
        return sums.join(own, "id").select("id", (F.col("got") - F.col("u") * F.col("self")).alias("got"))

    total = written(got(own.select("id", F.lit(1.0).alias("u"))).withColumnRenamed("got", "total"), "total")
    ranks = total.select("id", F.lit(1.0).alias("r"))
    for _ in range(rounds):
        gifts = written(ranks.join(total, "id").select("id", (F.col("r") / F.col("total")).alias("u")), "gifts")
        ranks = written(got(gifts).select("id", ((1 - DAMPING) + DAMPING * F.col("got")).alias("r")), "ranks")
    return worded.select("id").join(ranks, "id", "left").select("id", F.coalesce("r", F.lit(1 - DAMPING)).alias("r"))


Q.sql("position_weighted_sentences", "conversations", lambda d: f"""
    WITH {_SENTENCES(d)}, t AS (SELECT conv_id, max(turn) + 1 AS turns FROM conversations GROUP BY conv_id),
    k AS (SELECT conv_id, turn, s, round(length(s) / 100.0 * (0.6 + 0.4 * (turn + 1) / turns), 6) AS score FROM sent JOIN t USING (conv_id))
    SELECT conv_id, turn, s, score, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn, s) AS place FROM k) WHERE place <= 8""")

Q.sql("budgeted_prefix", "conversations", lambda d: """
    SELECT conv_id, turn, spent FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS spent FROM conversations) WHERE spent <= 1200""")

Q.sql("captures_per_role", "conversations", lambda d: "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, max(length(text)) AS longest FROM conversations GROUP BY role")

Q.sql("sync_orphans_adopted", "documents labels", lambda d: "SELECT documents.doc_id, coalesce(labels.quality, -1) AS quality, labels.doc_id IS NULL AS orphan FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id")

Q.sql("profile_ranked", "customer", lambda d: """
    SELECT c_mktsegment, c_custkey, score, rank FROM (SELECT c_mktsegment, c_custkey, round(c_acctbal * (1 + 0.1 * (c_custkey % 5)), 4) AS score,
           row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(c_acctbal * (1 + 0.1 * (c_custkey % 5)), 4) DESC, c_custkey) AS rank FROM customer) WHERE rank <= 20""")

Q.sql("direct_answers", "orders customer nation", lambda d: """
    SELECT c_custkey, concat(c_name, ' of ', n_name, ' has ', cast(n AS varchar(10)), ' open orders') AS answer
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) ON o_custkey = c_custkey""")

Q.sql("briefing_uncovered", "orders", lambda d: """
    WITH covered AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'),
    rest AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'O'),
    open AS (SELECT rest.* FROM rest WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.o_custkey = rest.o_custkey AND c.o_orderpriority = rest.o_orderpriority))
    SELECT o_custkey, o_orderkey, spent FROM (SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS spent FROM open) WHERE spent <= 600000""")

Q.sql("stale_summary_flag", "orders lineitem", lambda d: """
    SELECT o_orderkey, max(l_shipdate) AS latest, max(l_shipdate) > max(o_orderdate) + INTERVAL '90' DAY AS stale FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")

Q.sql("question_intents", "conversations", lambda d: f"""
    SELECT intent, count(*) AS n FROM (SELECT CASE WHEN {d.like('lower(text)', '^(when|quand|wann|cuando)')} THEN 'time' WHEN {d.like('lower(text)', '^(wh|qu|w)')} THEN 'ask' WHEN length(text) < 120 THEN 'short' ELSE 'tell' END AS intent FROM conversations WHERE role = 'user') GROUP BY intent""")

Q.sql("activation_seed", "benchmark documents", lambda d: f"""
    WITH a AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {d.each}({d.tokens('text')}) AS term FROM benchmark) WHERE length(term) > 6),
    t AS (SELECT DISTINCT doc_id, source, term FROM (SELECT doc_id, source, {d.each}({d.tokens('text')}) AS term FROM documents) WHERE length(term) > 6),
    named AS (SELECT item_id, source, 0.8 AS act FROM a JOIN t USING (term) UNION ALL SELECT item_id, source, 0.4 FROM a JOIN t ON substring(a.term, 1, 6) = t.term)
    SELECT item_id, source, max(act) AS activation, count(*) AS hits FROM named GROUP BY item_id, source""")

Q.sql("spreading_activation", "lineitem orders supplier", lambda d: """
    WITH m AS (SELECT o_custkey AS memory, l_suppkey AS entity, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_suppkey),
    seed AS (SELECT s_suppkey AS entity, 1.0 AS act FROM supplier WHERE s_acctbal > 9000),
    direct AS (SELECT memory, sum(act) AS g FROM m JOIN seed USING (entity) GROUP BY memory),
    hop AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
    near AS (SELECT b.l_suppkey AS entity, max(0.4 * act) AS act FROM hop a JOIN seed ON seed.entity = a.l_suppkey JOIN hop b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey GROUP BY b.l_suppkey),
    spread AS (SELECT memory, sum(act) AS g FROM m JOIN near USING (entity) GROUP BY memory)
    SELECT memory, round(sum(g), 4) AS activation FROM (SELECT memory, g FROM direct UNION ALL SELECT memory, g FROM spread) GROUP BY memory""")

Q.sql("neighbour_lending", "lineitem", lambda d: """
    WITH e AS (SELECT l_partkey AS a, l_suppkey AS b, count(*) AS w FROM lineitem GROUP BY l_partkey, l_suppkey),
    s AS (SELECT b, sum(w) / 1000.0 AS score FROM e GROUP BY b)
    SELECT a, round(max(0.25 * least(w, 1) * score), 6) AS lent FROM e JOIN s USING (b) GROUP BY a""")

Q.sql("score_fusion", "documents labels", lambda d: """
    WITH p AS (SELECT doc_id, n_chars, least(1.0e0, n_chars / 5000.0e0) AS text_score, 1.0e0 / (1 + doc_id % 7) AS tfidf, quality, toxic FROM documents JOIN labels USING (doc_id))
    SELECT doc_id, round((0.45e0 * text_score + 0.35e0 * tfidf + 0.3e0 * quality) * (0.7e0 + 0.3e0 * text_score) * (0.85e0 + 0.15e0 * (1 - toxic)) + 0.04e0 * ln(1 + n_chars), 6) AS score FROM p""")

Q.sql("relative_cutoff", "customer", lambda d: """
    SELECT c_mktsegment, c_custkey, score FROM (SELECT *, max(score) OVER (PARTITION BY c_mktsegment) AS best FROM (SELECT c_mktsegment, c_custkey, round(c_acctbal / 10000, 6) AS score FROM customer)) WHERE score >= greatest(0.12, 0.2 * best)""")

Q.sql("abstain_filter", "customer orders", lambda d: """
    SELECT c_custkey, n FROM (SELECT c_custkey, count(o_orderkey) AS n, max(o_totalprice) AS best FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) WHERE n > 0 AND best >= 200000""")

Q.sql("mrr_hit_at_k", "orders customer", lambda d: """
    WITH ranked AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
    best AS (SELECT o_custkey, min(rank) AS rank FROM ranked WHERE o_orderstatus = 'P' GROUP BY o_custkey)
    SELECT c_mktsegment, count(*) AS asked, count_if(rank <= 3) AS hits, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM customer LEFT JOIN best ON o_custkey = c_custkey GROUP BY c_mktsegment""")

@Q.add("""
    SELECT n_nationkey AS id, concat('{"kind":"entity","key":', n_nationkey, ',"label":', to_json(concat(n_name, chr(10), '"', chr(92))), ',"region":', to_json(r_name), '}') AS line FROM nation JOIN region ON n_regionkey = r_regionkey""")
def export_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object a line; the label has a line break, a quote and a backslash added, which have to be escaped."""
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    label = F.concat("n_name", F.lit('\n"\\'))
    return both.select(F.col("n_nationkey").alias("id"), F.to_json(F.struct(F.lit("entity").alias("kind"), F.col("n_nationkey").alias("key"), label.alias("label"), F.col("r_name").alias("region"))).alias("line"))


Q.sql("export_cypher_lines", "customer nation", lambda d: f"""
    SELECT c_custkey AS id, concat('MATCH (a {{id: ', cast(c_custkey AS varchar(20)), '}}), (b {{id: ', cast(n_nationkey AS varchar(20)), '}}) CREATE (a)-[:', upper({d.replace("'lives in'", ' ', '_')}), ']->(b);') AS line FROM customer JOIN nation ON c_nationkey = n_nationkey""")

Q.sql("export_graphml_lines", "supplier nation", lambda d: """
    SELECT s_suppkey AS id, concat('<edge source="s', cast(s_suppkey AS varchar(20)), '" target="n', cast(n_nationkey AS varchar(20)), '"><data key="label">',
           replace(replace(replace(s_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</data></edge>') AS line FROM supplier JOIN nation ON s_nationkey = n_nationkey""")

Q.sql("scalar_subquery_counts", "customer orders", lambda d: "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS latest FROM customer")

Q.sql("null_safe_matches", "orders", lambda d: """
    WITH a AS (SELECT o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS p FROM orders), b AS (SELECT p, count(*) AS n FROM a GROUP BY p)
    SELECT a.p, count(*) AS rows, max(n) AS n FROM a JOIN b ON a.p IS NOT DISTINCT FROM b.p GROUP BY a.p""")

Q.sql("histogram_maps", "events", lambda d: f"SELECT user_id, {d.joined('concat(event_type, cast(n AS varchar(10)))')} AS histogram FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id")

QUERIES, ORACLE = Q.queries, Q.oracle
