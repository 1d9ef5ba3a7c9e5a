"""Facts over time: validity intervals, supersession, retraction, settling, points in time.

The fact log of the driver tables is the order history: a customer (subject) has a status (object) from the
day of an order on. Everything is a window over one subject, so that no subject's history meets another's;
the point-in-time join puts a month next to each interval, so that a range join is an equality first.
"""

from __future__ import annotations

from recollect.plans.dialect import Queries

Q = Queries()

_LOG = """
    log AS (SELECT o_custkey AS subj, o_orderstatus AS obj, o_orderdate AS said_at, o_orderkey AS id, o_orderpriority AS slot FROM orders),
    marked AS (SELECT *, lag(obj) OVER (PARTITION BY subj ORDER BY said_at, id) AS before FROM log),
    starts AS (SELECT subj, obj, said_at AS valid_from, id FROM marked WHERE before IS NULL OR before <> obj),
    facts AS (SELECT subj, obj, valid_from, id AS stated_by, lead(valid_from) OVER (PARTITION BY subj ORDER BY valid_from, id) AS valid_to,
                     lead(id) OVER (PARTITION BY subj ORDER BY valid_from, id) AS ended_by FROM starts)"""

Q.sql("fact_intervals", "orders", lambda d: """
    WITH log AS (SELECT o_custkey AS subj, o_orderstatus AS obj, o_orderdate AS said_at, o_orderkey AS id FROM orders),
    m AS (SELECT *, CASE WHEN lag(obj) OVER w = obj THEN 0 ELSE 1 END AS new FROM log WINDOW w AS (PARTITION BY subj ORDER BY said_at, id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY subj ORDER BY said_at, id) AS island FROM m)
    SELECT subj, obj, min(said_at) AS valid_from, max(said_at) AS last_said, count(*) AS times FROM g GROUP BY subj, obj, island""")

Q.sql("exclusive_supersede", "orders", lambda d: f"WITH {_LOG} SELECT subj, obj, valid_from, valid_to, stated_by, ended_by FROM facts")

Q.sql("fact_timeline", "orders customer", lambda d: f"""
    WITH {_LOG} SELECT subj, c_name, obj, valid_from, valid_to, row_number() OVER (PARTITION BY subj ORDER BY valid_from DESC, stated_by DESC) AS position
    FROM facts JOIN customer ON c_custkey = subj""")

Q.sql("facts_as_of", "orders", lambda d: f"""
    WITH {_LOG} SELECT subj, obj, valid_from FROM facts
    WHERE valid_from <= timestamp '1995-06-15 00:00:00' AND (valid_to IS NULL OR valid_to > timestamp '1995-06-15 00:00:00')""")

Q.sql("facts_as_of_many", "orders lineitem", lambda d: f"""
    WITH {_LOG}, ask AS (SELECT o_custkey AS subj, date_trunc('month', l_shipdate) AS said_at, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, date_trunc('month', l_shipdate)),
    merged AS (
        SELECT subj, said_at, 1 AS kind, NULL AS obj, cast(0 AS bigint) AS id, n FROM ask
        UNION ALL SELECT subj, valid_from, 0, obj, stated_by, NULL FROM facts),
    seen AS (SELECT *, count(obj) OVER (PARTITION BY subj ORDER BY said_at, kind, id) AS g FROM merged),
    held AS (SELECT *, max(obj) OVER (PARTITION BY subj, g) AS now FROM seen)
    SELECT subj, said_at, now AS obj, n FROM held WHERE kind = 1""")

Q.sql("previous_value", "orders", lambda d: f"""
    WITH {_LOG} SELECT subj, obj, valid_to AS ended FROM (SELECT *, row_number() OVER (PARTITION BY subj ORDER BY valid_to DESC, stated_by DESC) AS r FROM facts WHERE valid_to IS NOT NULL) WHERE r = 1""")

Q.sql("retract_facts", "orders", lambda d: """
    WITH f AS (SELECT o_custkey AS subj, o_orderpriority AS obj, min(o_orderdate) AS valid_from FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey, o_orderpriority),
    minus AS (SELECT o_custkey AS subj, o_orderpriority AS obj, o_orderdate AS said_at FROM orders WHERE o_orderstatus = 'P')
    SELECT f.subj, f.obj, f.valid_from, min(said_at) AS valid_to FROM f LEFT JOIN minus ON f.subj = minus.subj AND f.obj = minus.obj AND said_at >= valid_from
    GROUP BY f.subj, f.obj, f.valid_from""")

Q.sql("settle_conflicts", "orders", lambda d: """
    WITH rel_map AS (SELECT 'F' AS rel, 'O' AS ends UNION ALL SELECT 'P', 'O' UNION ALL SELECT 'F', 'P'),
    said AS (SELECT o_custkey AS subj, o_orderstatus AS rel, o_orderpriority AS obj, min(o_orderdate) AS said_at FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority),
    ended AS (SELECT a.subj, a.rel, a.obj, min(b.said_at) AS valid_to FROM said a JOIN rel_map m ON a.rel = m.ends JOIN said b ON b.subj = a.subj AND b.obj = a.obj AND b.rel = m.rel AND b.said_at >= a.said_at
              GROUP BY a.subj, a.rel, a.obj)
    SELECT said.subj, said.rel, said.obj, said.said_at AS valid_from, valid_to FROM said LEFT JOIN ended ON said.subj = ended.subj AND said.rel = ended.rel AND said.obj = ended.obj""")

Q.sql("switch_within_category", "lineitem orders part", lambda d: """
    WITH used AS (SELECT o_custkey AS subj, p_type AS category, p_brand AS tool, min(o_orderdate) AS said_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
                  GROUP BY o_custkey, p_type, p_brand)
    SELECT subj, category, tool, said_at AS valid_from, lead(said_at) OVER (PARTITION BY subj, category ORDER BY said_at, tool) AS valid_to FROM used""")

Q.sql("memory_status", "orders", lambda d: f"""
    WITH {_LOG} SELECT stated_by, bool_or(valid_to IS NULL) AS active, count(*) AS facts FROM facts GROUP BY stated_by""")

Q.sql("slot_replacement", "orders", lambda d: """
    SELECT id, subj, slot, replaced_by FROM (
        SELECT o_orderkey AS id, o_custkey AS subj, o_orderpriority AS slot, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS replaced_by FROM orders)
    WHERE replaced_by IS NOT NULL""")

Q.sql("unique_alias_resolution", "customer supplier", lambda d: """
    WITH alias AS (SELECT s_nationkey, floor(s_acctbal / 100) AS band, count(*) AS n, min(s_suppkey) AS target FROM supplier GROUP BY s_nationkey, floor(s_acctbal / 100))
    SELECT c_custkey, target FROM customer JOIN alias ON c_nationkey = s_nationkey AND floor(c_acctbal / 100) = band WHERE n = 1""")

Q.sql("latest_unreplaced", "orders", lambda d: """
    WITH items AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS replaces, o_custkey FROM orders)
    SELECT a.id, a.o_custkey FROM items a WHERE NOT EXISTS (SELECT 1 FROM items b WHERE b.replaces = a.id)""")

Q.sql("replacement_chain", "orders", lambda d: """
    WITH items AS (SELECT o_orderkey AS id, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS depth FROM orders)
    SELECT o_custkey, id, depth - 1 AS depth FROM items WHERE depth <= 6""")

Q.sql("asof_last_event", "events", lambda d: f"""
    WITH e AS (SELECT event_id, user_id, ts, event_type, max(CASE WHEN event_type = 'view' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_view FROM events)
    SELECT event_id, user_id, event_type, CASE WHEN {d.seconds('last_view', 'ts')} <= 21600 THEN last_view END AS last_view FROM e""")

Q.sql("context_links", "events", lambda d: f"""
    WITH e AS (SELECT event_id, user_id, event_type, ts, cast(floor({d.epoch('ts')} / 86400) AS bigint) AS day FROM events),
    a AS (SELECT event_id, user_id, ts, {d.each}({d.array('day', 'day - 1')}) AS day FROM e),
    recent AS (SELECT a.event_id, e.event_type, count(*) AS n FROM a JOIN e ON a.user_id = e.user_id AND a.day = e.day AND e.ts < a.ts AND {d.seconds('e.ts', 'a.ts')} <= 86400 GROUP BY a.event_id, e.event_type)
    SELECT event_id, event_type, n, 0.5 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, event_type) AS r FROM recent) WHERE r <= 3""")

Q.sql("last_entity_in_chat", "lineitem orders part", lambda d: """
    SELECT o_custkey, p_partkey, p_name, o_orderdate FROM (
        SELECT o_custkey, p_partkey, p_name, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, p_partkey) AS r
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey) WHERE r = 1""")

Q.sql("fact_effective_time", "lineitem orders", lambda d: """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate <= o_orderdate THEN l_shipdate ELSE o_orderdate END AS effective FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")

QUERIES, ORACLE = Q.queries, Q.oracle
