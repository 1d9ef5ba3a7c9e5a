"""Rates, debouncing, expiry, budgets and learned-reader arithmetic over the event stream, in batch form."""

from __future__ import annotations

from recollect.plans.dialect import Queries

Q = Queries()

Q.sql("sliding_rate_limit", "events", lambda d: """
    SELECT event_id, user_id, n, n > 20 AS limited FROM (
        SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM events)""")

Q.sql("failure_streak_backoff", "events", lambda d: """
    WITH e AS (SELECT event_id, user_id, ts, event_type = 'error' OR value < 20 AS failed FROM events),
    g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM e),
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id, island, failed ORDER BY ts, event_id) AS streak FROM g)
    SELECT event_id, user_id, streak, least(900, 60 * cast(pow(2, least(streak, 10) - 1) AS bigint)) AS lock_seconds FROM s WHERE failed""")

Q.sql("sliding_session_expiry", "events", lambda d: f"""
    SELECT event_id, user_id, gap IS NULL OR gap > 86400 AS expired FROM (
        SELECT event_id, user_id, {d.seconds('lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)', 'ts')} AS gap FROM events)""")

Q.sql("debounce_batches", "events", lambda d: f"""
    WITH g AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    m AS (SELECT *, sum(CASE WHEN before IS NULL OR {d.seconds('before', 'ts')} > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS batch FROM g),
    f AS (SELECT *, min(ts) OVER (PARTITION BY user_id, batch) AS first FROM m),
    c AS (SELECT user_id, batch, cast(floor({d.seconds('first', 'ts')} / 86400) AS bigint) AS part, event_id, ts FROM f)
    SELECT user_id, batch, part, count(*) AS events, min(ts) AS first, max(ts) AS last FROM c GROUP BY user_id, batch, part""")

Q.sql("weekly_source_status", "events", lambda d: f"""
    WITH last AS (SELECT max(ts) AS now FROM events)
    SELECT event_type, count(*) AS total, count_if({d.seconds('ts', 'now')} <= 604800) AS this_week, max(ts) AS latest FROM events CROSS JOIN last GROUP BY event_type""")

Q.sql("valid_credentials", "customer orders", lambda d: f"""
    WITH last AS (SELECT max(o_orderdate) AS now FROM orders)
    SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey CROSS JOIN last WHERE {d.seconds('o_orderdate', 'now')} <= 30 * 86400 AND o_orderstatus <> 'P'""")

Q.sql("last_activity_union", "orders events", lambda d: """
    SELECT id, max(said_at) AS said_at FROM (SELECT o_custkey AS id, max(o_orderdate) AS said_at FROM orders GROUP BY o_custkey UNION ALL SELECT user_id, max(ts) FROM events GROUP BY user_id) GROUP BY id""")

Q.sql("events_tumbling", "events", lambda d: f"SELECT {d.hour('ts')} AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY {d.hour('ts')}, event_type")

Q.sql("events_session", "events", lambda d: f"""
    WITH g AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    s AS (SELECT *, sum(CASE WHEN before IS NULL OR {d.seconds('before', 'ts')} >= 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, session""")

Q.sql("hash_split", "documents", lambda d: """
    SELECT split, count(*) AS n, min(doc_id) AS first FROM (
        SELECT doc_id, CASE WHEN ascii(substring(md5(cast(doc_id AS varchar(20))), 1, 1)) % 5 = 0 THEN 'held out' ELSE 'train' END AS split FROM documents) GROUP BY split""")

_FEATURES = """
    x AS (SELECT doc_id, quality, length(text) AS n, length(text) - length(replace(text, ' ', '')) AS spaces, length(text) - length(replace(text, '.', '')) AS stops,
                 length(text) - length(replace(text, '|', '')) AS bars, length(text) - length(replace(text, '!', '')) AS shouts, length(text) - length(replace(text, '$', '')) AS marks
          FROM documents JOIN labels USING (doc_id) WHERE length(text) > 0),
    scored AS (SELECT doc_id, quality, round(1.0 + 20.0 * stops / n - 40.0 * bars / n - 40.0 * shouts / n - 60.0 * marks / n, 6) AS score FROM x)"""

Q.sql("linear_margin_predict", "documents labels", lambda d: f"""
    WITH {_FEATURES} SELECT doc_id, score, CASE WHEN abs(score) < 0.2 THEN NULL WHEN score > 0 THEN 1 ELSE 0 END AS predicted FROM scored""")

Q.sql("margin_threshold", "documents labels", lambda d: f"""
    WITH {_FEATURES}, neg AS (SELECT doc_id, score, cast(floor(score * 50) AS bigint) AS b FROM scored WHERE quality = 0),
    buckets AS (SELECT b, count(*) AS c FROM neg GROUP BY b),
    summed AS (SELECT b, sum(c) OVER (ORDER BY b DESC) - c AS above, c, sum(c) OVER () AS n FROM buckets),
    target AS (SELECT b, n, cast(floor(0.002e0 * n) AS bigint) + 1 - above AS place FROM summed WHERE above < floor(0.002e0 * n) + 1 AND above + c >= floor(0.002e0 * n) + 1),
    inside AS (SELECT neg.score, n, place, row_number() OVER (PARTITION BY neg.b ORDER BY neg.score DESC, doc_id) AS r FROM neg JOIN target ON neg.b = target.b)
    SELECT cast(n AS bigint) AS negatives, score AS margin FROM inside WHERE r = place""")

Q.sql("veto_extracted_facts", "documents", lambda d: f"""
    WITH said AS (SELECT doc_id, text, {d.find('text', '([A-Z][a-z]{5,}) ([a-z]{4,})', 1)} AS subj, {d.find('text', '([A-Z][a-z]{5,}) ([a-z]{4,})', 2)} AS obj FROM documents)
    SELECT doc_id, subj, obj, CASE WHEN subj = '' THEN 'nothing said' WHEN length(obj) < 5 THEN 'short' WHEN contains(lower(text), concat('not ', obj)) THEN 'denied' ELSE 'kept' END AS verdict FROM said""")

Q.sql("monthly_spend", "events", lambda d: f"""
    SELECT user_id, {d.month('ts')} AS month, round(sum(value) / 1000, 6) AS usd, count(*) AS calls, sum(value) > 2000 AS over_budget FROM events GROUP BY user_id, {d.month('ts')}""")

Q.sql("provider_fallback", "events", lambda d: """
    WITH calls AS (SELECT event_type AS provider, cast(cast(ts AS date) AS varchar(10)) AS day, count(*) AS n FROM events GROUP BY event_type, cast(cast(ts AS date) AS varchar(10))),
    free AS (SELECT day, provider, n, row_number() OVER (PARTITION BY day ORDER BY n, provider) AS r FROM calls WHERE n < 100)
    SELECT day, provider, n FROM free WHERE r = 1""")

Q.sql("budget_admission", "events", lambda d: """
    SELECT event_id, user_id, spent, spent <= 1500 AS admitted FROM (
        SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS spent FROM events)""")

Q.sql("citation_violations", "lineitem orders", lambda d: """
    SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderdate <= l_shipdate)""")

Q.sql("read_progress_counts", "documents labels", lambda d: """
    SELECT source, count(*) AS total, count(quality) AS read, count_if(quality = 1) AS good, count_if(toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")

Q.sql("ewma_by_user", "events", lambda d: """
    WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, round(sum(value * CASE WHEN i = 1 THEN pow(0.8, n - 1) ELSE 0.2 * pow(0.8, n - i) END), 4) AS ewma FROM e GROUP BY user_id""")

QUERIES, ORACLE = Q.queries, Q.oracle
