"""Logs and mutation as queries: deduplication, upserts, revisions, diffs, tombstones, merges, imports."""

from __future__ import annotations

from recollect.plans.dialect import Queries

Q = Queries()

Q.sql("dedupe_captures", "documents", lambda d: "SELECT text, source, min(doc_id) AS doc_id, count(*) AS times FROM documents GROUP BY text, source")

_REVISIONS = """
    rev AS (SELECT o_custkey AS session, o_orderpriority AS message, o_orderkey AS upload, o_orderstatus AS content,
                   cast(extract(year FROM o_orderdate) AS bigint) AS version FROM orders)"""

Q.sql("current_messages", "orders", lambda d: f"""
    WITH {_REVISIONS} SELECT session, message, version, upload, content FROM (
        SELECT *, row_number() OVER (PARTITION BY session, message ORDER BY version DESC, upload DESC) AS r FROM rev) WHERE r = 1""")

Q.sql("revision_conflicts", "orders", lambda d: f"""
    WITH {_REVISIONS} SELECT session, message, version, count(DISTINCT content) AS variants FROM rev GROUP BY session, message, version HAVING count(DISTINCT content) > 1""")

Q.sql("accepted_batches", "orders", lambda d: f"""
    WITH {_REVISIONS}, bad AS (SELECT session, version FROM rev GROUP BY session, message, version HAVING count(DISTINCT content) > 1)
    SELECT session, version, count(*) AS messages FROM rev WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.session = rev.session AND bad.version = rev.version) GROUP BY session, version""")

Q.sql("project_revision_numbering", "orders", lambda d: "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision FROM orders")

Q.sql("transcript_diff", "conversations", lambda d: """
    WITH old AS (SELECT conv_id, turn, text FROM conversations WHERE (conv_id + turn) % 7 <> 0),
    new AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 0 THEN concat(text, ' …') ELSE text END AS text FROM conversations WHERE turn < 6)
    SELECT coalesce(old.conv_id, new.conv_id) AS conv_id, coalesce(old.turn, new.turn) AS turn,
           CASE WHEN old.turn IS NULL THEN 'new' WHEN new.turn IS NULL THEN 'deleted' WHEN old.text IS NOT DISTINCT FROM new.text THEN 'same' ELSE 'changed' END AS status
    FROM old FULL JOIN new ON old.conv_id = new.conv_id AND old.turn = new.turn""")

Q.sql("outbox_latest_per_key", "events", lambda d: """
    SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")

Q.sql("ack_mismatch", "orders lineitem", lambda d: """
    WITH acks AS (SELECT l_orderkey AS id, max(l_linenumber) AS lines, count(*) AS n FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, lines, n FROM orders LEFT JOIN acks ON o_orderkey = id WHERE n IS NULL OR n <> lines""")

Q.sql("pending_mailbox", "events", lambda d: f"""
    WITH last AS (SELECT max(ts) AS now FROM events),
    e AS (SELECT user_id, event_id, ts, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
    SELECT user_id, event_id, {d.seconds('ts', 'now')} AS age FROM e CROSS JOIN last WHERE next IS NULL AND {d.seconds('ts', 'now')} <= 864000""")

Q.sql("forget_cascade", "customer orders", lambda d: """
    WITH forgotten AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
    SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM forgotten WHERE c_custkey = o_custkey)""")

Q.sql("orphan_entities", "customer orders", lambda d: "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")

Q.sql("merge_entities_edges", "lineitem supplier", lambda d: """
    WITH alias AS (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS target FROM supplier)
    SELECT l_partkey, target AS supplier, count(*) AS mentions, sum(l_quantity) AS weight FROM lineitem JOIN alias ON l_suppkey = s_suppkey GROUP BY l_partkey, target""")

Q.sql("apply_topic_merges", "part", lambda d: """
    WITH merged AS (SELECT p_brand, min(p_brand) OVER (PARTITION BY substring(p_brand, 1, 7)) AS topic FROM (SELECT DISTINCT p_brand FROM part))
    SELECT topic, count(*) AS parts, count(DISTINCT part.p_brand) AS brands FROM part JOIN merged ON part.p_brand = merged.p_brand GROUP BY topic""")

# texts are compared and grouped by their SHA-256, so that no text is shuffled
Q.sql("import_delta", "documents", lambda d: f"""
    WITH named AS (SELECT doc_id, source, {d.sha256('text')} AS h FROM documents), have AS (SELECT DISTINCT h FROM named WHERE source <> 'src0')
    SELECT min(doc_id) AS doc_id, count(*) AS times FROM named i WHERE source = 'src0' AND NOT EXISTS (SELECT 1 FROM have WHERE have.h = i.h) GROUP BY h""")

Q.sql("restore_violations", "lineitem orders part supplier", lambda d: """
    SELECT 'order' AS kind, l_orderkey AS id, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) GROUP BY l_orderkey
    UNION ALL SELECT 'part', l_partkey, count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey) GROUP BY l_partkey
    UNION ALL SELECT 'open', o_orderkey, cast(1 AS bigint) FROM orders WHERE o_totalprice > 480000""")

Q.sql("unread_queue", "documents labels", lambda d: """
    SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS place, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)""")

Q.sql("reinforce_exact", "documents", lambda d: f"""
    SELECT min(doc_id) AS doc_id, count(*) AS times, count(DISTINCT source) AS sources, round(least(1.0, 0.5 + 0.05 * count(*)), 6) AS importance FROM documents GROUP BY {d.sha256('text')} HAVING count(*) > 1""")

Q.sql("reinforce_by_signature", "documents", lambda d: f"""
    WITH s AS (SELECT doc_id, md5({d.join(d.distinct_sorted(d.tokens('text')), ' ')}) AS signature FROM documents)
    SELECT signature, min(doc_id) AS doc_id, count(*) AS times FROM s GROUP BY signature HAVING count(*) > 1""")

Q.sql("noisy_or_confidence", "documents", lambda d: f"""
    SELECT min(doc_id) AS doc_id, round(1 - exp(sum(ln(1 - (0.3 + 0.4 * (doc_id % 10) / 10.0) / 2))), 6) AS confidence, count(*) AS times FROM documents GROUP BY {d.sha256('text')} HAVING count(*) > 1""")

Q.sql("keep_latest_n", "events", lambda d: "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 12")

Q.sql("latest_session_per_source", "events", lambda d: "SELECT event_type, user_id, max(ts) AS ts, max_by(event_id, ts) AS event_id FROM (SELECT event_type, user_id, ts, max(event_id) AS event_id FROM events GROUP BY event_type, user_id, ts) GROUP BY event_type, user_id")

Q.sql("dedupe_triples", "lineitem orders", lambda d: """
    SELECT o_custkey, l_returnflag, l_suppkey, first_order FROM (
        SELECT o_custkey, l_returnflag, l_suppkey, o_orderkey AS first_order, row_number() OVER (PARTITION BY o_custkey, l_returnflag, l_suppkey ORDER BY o_orderdate, o_orderkey, l_linenumber) AS r
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE r = 1""")

QUERIES, ORACLE = Q.queries, Q.oracle
