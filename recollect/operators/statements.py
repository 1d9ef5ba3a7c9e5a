"""Statements about customers, times of events and secrets in notes: rules applied to sentences made from the tables.

The texts of the tables are invented prose in which no rule finds anything, so sentences are put together from
columns, and the check asks the same columns for the triples, days and redactions that must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.rules import resolved_day, triples, without_secrets
from recollect.plans.dialect import Queries
from recollect.tables import table

Q = Queries()


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.initcap("n_name").alias("place"))
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("work", F.initcap("c_mktsegment"))


@Q.add("""
    WITH p AS (SELECT c_custkey, array_to_string(list_transform(string_split(n_name, ' '), lambda x: concat(upper(left(x, 1)), lower(substring(x, 2)))), ' ') AS place,
                      concat(upper(left(c_mktsegment, 1)), lower(substring(c_mktsegment, 2))) AS work, c_custkey % 10 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, 'me' AS subj, CASE WHEN k IN (0, 1, 2) THEN 'lives_in' WHEN k IN (3, 4) THEN 'works_at' WHEN k = 5 THEN 'visit' WHEN k IN (6, 7) THEN 'uses' END AS rel,
           CASE WHEN k IN (3, 4, 6) THEN work ELSE place END AS obj, CASE WHEN k IN (0, 1, 3, 7) THEN 'is' WHEN k IN (2, 4, 6) THEN 'was' ELSE 'wish' END AS mode FROM p WHERE k < 8 AND k NOT IN (6, 7)
    UNION ALL SELECT c_custkey, 'me', 'lives_in', 'Utopia', 'was' FROM p WHERE k = 1
    UNION ALL SELECT c_custkey, 'me', 'uses', 'vim', 'was' FROM p WHERE k = 6 UNION ALL SELECT c_custkey, 'me', 'uses', 'emacs', 'is' FROM p WHERE k = 6
    UNION ALL SELECT c_custkey, 'sister', 'named', place, 'is' FROM p WHERE k = 7""")
def statement_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What people say of themselves, as triples that hold, end or are wished; questions state nothing."""
    said = [
        "concat('I live in ', place, '.')", "concat('I have moved from Utopia to ', place)", "concat('I no longer live in ', place, '.')", "concat('I work at ', work, ' now.')",
        "concat('I stopped working for ', work, '.')", "concat(\"I'd like to visit \", place, '.')", "'I switched from vim to emacs.'", "concat(\"My sister's name is \", place, '.')",
        "concat('Do I live in ', place, '?')", "concat('rain fell on ', place)",
    ]
    sentence = F.expr(f"element_at(array({', '.join(said)}), cast(c_custkey % 10 as int) + 1)")
    found = _people(spark, sf_dir).select("c_custkey", F.explode(triples(sentence)).alias("t"))
    return found.select("c_custkey", "t.*")


@Q.add("""
    WITH p AS (SELECT c_custkey, array_to_string(list_transform(string_split(n_name, ' '), lambda x: concat(upper(left(x, 1)), lower(substring(x, 2)))), ' ') AS place,
                      concat(upper(left(c_mktsegment, 1)), lower(substring(c_mktsegment, 2))) AS work FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT 'Ana Li' AS subj, 'lives_in' AS rel, place AS obj, count(*) AS said FROM p WHERE c_custkey % 3 = 0 GROUP BY place
    UNION ALL SELECT work, 'works_at', place, count(*) FROM p WHERE c_custkey % 3 = 1 GROUP BY work, place
    UNION ALL SELECT place, 'is_a', 'country', count(*) FROM p WHERE c_custkey % 3 = 2 GROUP BY place""")
def third_party_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts about others, and how often each was said."""
    said = ["concat('Ana Li lives in ', place, '.')", "concat(work, ' works for ', place)", "concat(place, ' is a country.')"]
    sentence = F.expr(f"element_at(array({', '.join(said)}), cast(c_custkey % 3 as int) + 1)")
    found = _people(spark, sf_dir).select(F.explode(triples(sentence)).alias("t")).select("t.subj", "t.rel", "t.obj")
    return found.groupBy("subj", "rel", "obj").agg(F.count("*").alias("said"))


@Q.add("""
    WITH e AS (SELECT event_id, ts::DATE AS d, event_id % 12 AS k, (event_id % 9 + 1)::INT AS n FROM events)
    SELECT event_id, (CASE k WHEN 0 THEN d - 1 WHEN 1 THEN d - n WHEN 2 THEN d + 7 * n WHEN 3 THEN d - to_months(1) WHEN 4 THEN d + to_months(12) WHEN 5 THEN DATE '2023-02-28' WHEN 6 THEN d + 2
        WHEN 7 THEN d - (CASE WHEN (isodow(d) - 5) % 7 = 0 THEN 7 ELSE (isodow(d) - 5 + 7) % 7 END)::INT WHEN 8 THEN d + (CASE WHEN (1 - isodow(d) + 7) % 7 = 0 THEN 7 ELSE (1 - isodow(d) + 7) % 7 END)::INT
        WHEN 9 THEN d - to_months(n) WHEN 10 THEN NULL ELSE d - 14 END)::DATE::VARCHAR AS on_day FROM e""")
def phrase_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time phrases in sentences as days, seen from the time of the message."""
    said = [
        "'we met Yesterday evening'", "concat('it broke ', event_id % 9 + 1, ' days ago')", "concat('due in ', element_at(array('one','two','three','four','five','six','seven','eight','nine'), cast(event_id % 9 as int) + 1), ' weeks')",
        "'since last month'", "'next year then'", "'signed on 2023-02-28 at noon'", "'the day after tomorrow'", "'it was last Friday'", "'see you next monday'", "concat(event_id % 9 + 1, ' months ago')",
        "'no time at all'", "'two weeks ago'",
    ]
    sentence = F.expr(f"element_at(array({', '.join(said)}), cast(event_id % 12 as int) + 1)")
    return table(spark, sf_dir, "events").select("event_id", resolved_day(sentence, F.col("ts")).cast("string").alias("on_day"))


@Q.add("""
    SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'my password is [password], ok' WHEN 1 THEN concat('pin: [pin] order ', o_orderkey) WHEN 2 THEN 'pay with [card] please'
        WHEN 3 THEN 'number 4111 1111 1111 1112 stays' WHEN 4 THEN 'use [stripe key]' WHEN 5 THEN 'token [github token]!' WHEN 6 THEN 'db at postgres://u:[password]@host/x' WHEN 7 THEN 'mail [email] from [ip]'
        WHEN 8 THEN 'account [iban]' ELSE concat('order ', o_orderkey, ' shipped') END AS redacted FROM orders""")
def notes_without_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with secrets of many shapes, redacted; a card number that fails its check is no card."""
    notes = [
        "concat('my password is hunter', o_orderkey, ', ok')", "concat('pin: ', 1000 + o_orderkey % 9000, ' order ', o_orderkey)", "'pay with 4111-1111-1111-1111 please'", "'number 4111 1111 1111 1112 stays'",
        "concat('use sk_live_', substring(md5(cast(o_orderkey as string)), 1, 24))", "concat('token ghp_', md5(cast(o_orderkey as string)), 'Zz09', '!')", "concat('db at postgres://u:pw', o_orderkey, '@host/x')",
        "concat('mail a.b', o_orderkey, '@mail.example.org from 10.0.0.', o_orderkey % 250)", "'account DE89 3704 0044 0532 0130 00'", "concat('order ', o_orderkey, ' shipped')",
    ]
    note = F.expr(f"element_at(array({', '.join(notes)}), cast(o_orderkey % 10 as int) + 1)")
    return table(spark, sf_dir, "orders").select("o_orderkey", without_secrets(note).alias("redacted"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, id, part, text) of all stored texts."""
    docs = table(spark, sf_dir, "documents").selectExpr("'document' AS kind", "doc_id AS id", "0L AS part", "text")
    pages = table(spark, sf_dir, "pages").selectExpr("'page' AS kind", "page_id AS id", "0L AS part", "html AS text")
    return docs.unionByName(pages).unionByName(table(spark, sf_dir, "conversations").selectExpr("'turn' AS kind", "conv_id AS id", "turn AS part", "text"))


@Q.add("""
    WITH t AS (SELECT 'document' AS kind, doc_id AS id, 0::BIGINT AS part, text FROM documents UNION ALL SELECT 'page', page_id, 0, html FROM pages UNION ALL SELECT 'turn', conv_id, turn, text FROM conversations),
    m AS (SELECT *, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', '[email]', 'g'), '[0-9a-fA-F]{32,}', '[hex]', 'g') AS x FROM t),
    d AS (SELECT *, string_split_regex(x, '[0-9]+(?:[.][0-9]+)+') AS between, regexp_extract_all(x, '[0-9]+(?:[.][0-9]+)+') AS runs FROM m),
    i AS (SELECT kind, id, part, text, array_to_string(list_transform(generate_series(1, len(between)), lambda k: concat(between[k], CASE
            WHEN len(string_split(runs[k], '.')) = 4 AND len(list_filter(string_split(runs[k], '.'), lambda o: length(o) > 3 OR o::HUGEINT > 255)) = 0 THEN '[ip]' ELSE coalesce(runs[k], '') END)), '') AS x FROM d),
    e AS (SELECT *, string_split_regex(x, '[0-9](?:[ -]?[0-9])*') AS between, regexp_extract_all(x, '[0-9](?:[ -]?[0-9])*') AS runs FROM i),
    c AS (SELECT kind, id, part, text, between, runs, list_transform(runs, lambda r: reverse(regexp_replace(r, '[ -]', '', 'g'))) AS back FROM e),
    v AS (SELECT *, list_transform(back, lambda b: len(b) BETWEEN 13 AND 19 AND list_sum(list_transform(generate_series(1, len(b)), lambda p:
            CASE WHEN p % 2 = 1 THEN b[p]::INT WHEN b[p]::INT > 4 THEN 2 * b[p]::INT - 9 ELSE 2 * b[p]::INT END)) % 10 = 0) AS card FROM c),
    o AS (SELECT kind, id, part, text, array_to_string(list_transform(generate_series(1, len(between)), lambda k: concat(between[k], CASE WHEN card[k] THEN '[card]' ELSE coalesce(runs[k], '') END)), '') AS x FROM v)
    SELECT kind, id, part, x <> text AS changed, md5(x) AS redacted_md5 FROM o""")
def stored_texts_without_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, pages and turns through the redactor. The tables hold mail, IP and card numbers and hex keys; the SQL looks for these only, by itself."""
    texts = _stored(spark, sf_dir).withColumn("clean", without_secrets(F.col("text")))
    return texts.select("kind", "id", "part", (F.col("clean") != F.col("text")).alias("changed"), F.md5("clean").alias("redacted_md5"))


QUERIES, ORACLE = Q.queries, Q.oracle
