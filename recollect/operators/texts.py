"""Text and date scalars over documents, pages and conversations, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.plans.dialect import Queries
from recollect.tables import table

Q = Queries()

Q.sql("redact_hex_runs", "documents", lambda d: f"SELECT doc_id, md5({d.replace('text', '[0-9a-f]{32,}', '[hex]')}) AS redacted_md5 FROM documents WHERE {d.like('text', '[0-9a-f]{32,}')}")

Q.sql("luhn_card_candidates", "documents", lambda d: f"""
    WITH c AS (SELECT doc_id, run FROM (SELECT doc_id, {d.each}({d.finds('text', '[0-9]+')}) AS run FROM documents) WHERE length(run) BETWEEN 13 AND 19),
    p AS (SELECT doc_id, run, {d.each}({d.series('1', 'length(run)')}) AS i FROM c),
    v AS (SELECT doc_id, run, i, cast(substring(run, i, 1) AS int) * (1 + (length(run) - i) % 2) AS x FROM p),
    s AS (SELECT doc_id, run, sum(CASE WHEN x > 9 THEN x - 9 ELSE x END) AS total FROM v GROUP BY doc_id, run)
    SELECT doc_id, run, total % 10 = 0 AS luhn_ok FROM s""")

Q.sql("shouting_ratio", "documents", lambda d: f"""
    WITH l AS (SELECT doc_id, length({d.replace('text', '[^A-Z]', '')}) AS upper_n, length({d.replace('text', '[^A-Za-z]', '')}) AS letters FROM documents)
    SELECT doc_id, round(cast(upper_n AS double) / letters, 6) AS ratio, letters >= 8 AND upper_n > 0.7 * letters AS shouting FROM l WHERE letters > 0""")

Q.sql("sentence_split", "documents", lambda d: f"""
    SELECT doc_id, count(*) AS sentences, max(length(s)) AS longest FROM (SELECT doc_id, trim(s) AS s FROM (SELECT doc_id, {d.each}({d.split('text', '[.!?]+')}) AS s FROM documents)) WHERE s <> '' GROUP BY doc_id""")

Q.sql("word_ngrams", "conversations", lambda d: f"""
    WITH w AS (SELECT conv_id, turn, {d.tokens('text')} AS w FROM conversations),
    p AS (SELECT conv_id, turn, w, {d.each}({d.series('1', d.size('w') + ' - 1')}) AS i FROM w),
    g AS (SELECT conv_id, concat({d.at('w', 'i')}, ' ', {d.at('w', 'i + 1')}) AS gram FROM p)
    SELECT gram, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM g GROUP BY gram HAVING count(*) > 1""")

Q.sql("gazetteer_mentions", "documents benchmark", lambda d: f"""
    WITH names AS (SELECT DISTINCT word AS name FROM (SELECT {d.each}({d.tokens('text')}) AS word FROM benchmark) WHERE length(word) >= 10),
    said AS (SELECT doc_id, word FROM (SELECT doc_id, {d.each}({d.tokens('text')}) AS word FROM documents) WHERE length(word) >= 10)
    SELECT doc_id, name, count(*) AS times FROM said JOIN names ON word = name GROUP BY doc_id, name""")

Q.sql("canonical_key", "part", lambda d: f"""
    WITH k AS (SELECT p_partkey, trim({d.replace(d.replace('lower(p_name)', '[^a-z0-9 ]', ''), ' +', ' ')}) AS k FROM part)
    SELECT p_partkey, CASE WHEN k LIKE '%ies' THEN concat(substring(k, 1, length(k) - 3), 'y') WHEN k LIKE '%s' AND k NOT LIKE '%ss' THEN substring(k, 1, length(k) - 1) ELSE k END AS entity_key FROM k""")

Q.sql("term_stems", "conversations", lambda d: f"""
    WITH w AS (SELECT {d.each}({d.tokens('text')}) AS w FROM conversations),
    s AS (SELECT CASE WHEN length(w) > 5 AND w LIKE '%ing' THEN substring(w, 1, length(w) - 3) WHEN length(w) > 4 AND w LIKE '%ed' THEN substring(w, 1, length(w) - 2)
                      WHEN length(w) > 3 AND w LIKE '%s' THEN substring(w, 1, length(w) - 1) ELSE w END AS stem FROM w)
    SELECT stem, count(*) AS n FROM s GROUP BY stem""")

Q.sql("one_edit_neighbours", "benchmark documents", lambda d: f"""
    WITH asked AS (SELECT DISTINCT w FROM (SELECT {d.each}({d.tokens('text')}) AS w FROM benchmark) WHERE length(w) BETWEEN 6 AND 12 AND {d.like('w', '^[a-z]+$')}),
    v AS (SELECT DISTINCT w FROM (SELECT {d.each}({d.tokens('text')}) AS w FROM documents) WHERE length(w) BETWEEN 5 AND 13 AND {d.like('w', '^[a-z]+$')}),
    cut AS (SELECT w, {d.each}({d.map(d.series('1', 'length(w)'), 'i', "concat(substring(w, 1, i - 1), substring(w, i + 1, 40))")}) AS k FROM asked UNION SELECT w, w FROM asked),
    cuts AS (SELECT w, {d.each}({d.map(d.series('1', 'length(w)'), 'i', "concat(substring(w, 1, i - 1), substring(w, i + 1, 40))")}) AS k FROM v UNION SELECT w, w FROM v),
    p AS (SELECT DISTINCT cut.w AS a, cuts.w AS b FROM cut JOIN cuts ON cut.k = cuts.k AND cut.w <> cuts.w)
    SELECT a, b FROM p WHERE levenshtein(a, b) = 1""")

@Q.add("""
    WITH e AS (SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier)
    SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name) AS edits FROM e a JOIN e b ON substring(a.name, 1, 1) = substring(b.name, 1, 1) AND a.name < b.name WHERE levenshtein(a.name, b.name) <= 1""")
def fuzzy_entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names with one first letter within one edit."""
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).union(table(spark, sf_dir, "supplier").select("s_name")).where("name <> ''").distinct()
    return one_edit_pairs(names)


def one_edit_pairs(names: DataFrame) -> DataFrame:
    """(a, b, edits) of distinct, non-empty names (name) that begin alike and are one edit apart, a < b.

    Names of one length differ in one place, so they are equal without that place; of two lengths, the longer one is the shorter one
    once a character is left out. A key (place and rest, or rest) is then shared by pairs of the result only: none is compared in vain
    or found twice, and what is joined are names' forms, as many as they have characters. The forms are many times the names that the
    planner sees, so both joins are told to sort rather than to broadcast.
    """
    without = "concat(substring(name, 1, i - 1), substring(name, i + 1))"
    forms = names.select("name", F.explode(F.expr(f"transform(sequence(1, length(name)), i -> struct(i, {without} as rest))")).alias("x")).select("name", "x.i", "x.rest")
    at = forms.where("i > 1")  # the first characters are the same
    same = at.withColumnRenamed("name", "a").hint("merge").join(at.withColumnRenamed("name", "b"), ["i", "rest"]).where("a < b").select("a", "b")
    short = forms.select("name", "rest").distinct().join(names.select(F.col("name").alias("rest")).hint("merge"), "rest").where("substring(name, 1, 1) = substring(rest, 1, 1)")
    other = short.select(F.least("name", "rest").alias("a"), F.greatest("name", "rest").alias("b"))
    return same.unionAll(other).withColumn("edits", F.lit(1).cast("long"))


Q.sql("url_conversation_key", "pages", lambda d: f"""
    SELECT page_id, {d.url('url', 'HOST')} AS host, concat(lower({d.url('url', 'HOST')}), coalesce({d.url('url', 'PATH')}, '')) AS conversation FROM pages""")

Q.sql("harvest_identifiers", "documents", lambda d: f"""
    WITH h AS (SELECT doc_id, {d.each}({d.finds('text', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+|[A-Z][A-Z0-9]+_[A-Z0-9_]+|https?://[^ ]+')}) AS id FROM documents)
    SELECT id, count(*) AS times, count(DISTINCT doc_id) AS documents FROM h GROUP BY id""")

Q.sql("head_tail_truncate", "documents", lambda d: """
    SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE concat(substring(text, 1, 250), ' […] ', substring(text, length(text) - 749, 750)) END AS cut FROM documents""")

Q.sql("classify_mood", "conversations", lambda d: f"""
    SELECT conv_id, turn, CASE WHEN {d.like('text', '[?]\\s*$')} OR {d.like('lower(text)', '^(wh|was|is|are|do|est|qu)')} THEN 'question' WHEN {d.like('lower(text)', '(^|[^a-z])(if|wenn|si)([^a-z]|$)')} THEN 'hypothetical' ELSE 'statement' END AS mood FROM conversations""")

Q.sql("classify_statement", "conversations", lambda d: f"""
    SELECT conv_id, turn, CASE WHEN {d.like('text', '[0-9]')} THEN 'event' WHEN role = 'system' THEN 'preference' WHEN {d.like('lower(text)', '(^|[^a-z])(to|zu|pour|para) ')} THEN 'goal'
           WHEN length(text) < 60 THEN 'note' ELSE 'fact' END AS type FROM conversations""")

Q.sql("statement_importance", "conversations", lambda d: f"""
    WITH s AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 0.6 WHEN 'system' THEN 0.5 ELSE 0.35 END AS base, least(3, {d.size(d.finds('text', '[A-Z][a-z]{4,}'))}) AS entities, {d.like('text', '[0-9]')} AS dated FROM conversations)
    SELECT conv_id, turn, round(least(1.0, base + 0.03 * entities + CASE WHEN dated THEN 0.05 ELSE 0.0 END), 4) AS importance FROM s""")

Q.sql("parse_partial_dates", "orders", lambda d: f"""
    WITH t AS (SELECT o_orderkey, substring(cast(o_orderdate AS varchar(30)), 1, CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END) AS said FROM orders)
    SELECT o_orderkey, said, {d.find('said', '^([0-9]{4})', 1)} AS y, {d.find('said', '^[0-9]{4}-([0-9]{2})', 1)} AS m, {d.find('said', '^[0-9]{4}-[0-9]{2}-([0-9]{2})', 1)} AS dd FROM t""")

Q.sql("resolve_time_phrases", "events", lambda d: f"""
    WITH p AS (SELECT event_id, ts, event_id % 5 AS k, CASE event_id % 5 WHEN 0 THEN 'yesterday' WHEN 1 THEN 'last week' WHEN 2 THEN '3 days ago' WHEN 3 THEN 'last month' ELSE 'today' END AS phrase FROM events)
    SELECT event_id, phrase, CASE k WHEN 0 THEN {d.days('ts', -1)} WHEN 1 THEN {d.days('ts', -7)} WHEN 2 THEN {d.days('ts', -3)} WHEN 3 THEN {d.days('ts', -30)} ELSE ts END AS resolved FROM p""")

Q.sql("extract_relations_basic", "documents", lambda d: f"""
    SELECT doc_id, {d.find('text', '[Ll]icensed under (the )?([A-Z][A-Za-z -]+[A-Za-z])', 2)} AS licence, {d.find('text', 'token = "([0-9a-f]{8})', 1)} AS token_start FROM documents
    WHERE {d.like('text', '[Ll]icensed under|token = ')}""")

Q.sql("parse_export_lines", "documents", lambda d: f"""
    WITH l AS (SELECT doc_id, {d.each}({d.split('text', chr(10))}) AS line FROM documents),
    p AS (SELECT doc_id, {d.split('line', ' [|] ')} AS f FROM l WHERE line LIKE '% | %')
    SELECT doc_id, count(*) AS lines, sum({d.size('f')}) AS fields, min({d.at('f', '1')}) AS first FROM p GROUP BY doc_id""")

Q.sql("json_props_extract", "events", lambda d: f"SELECT event_type, cast({d.json('props', 'k')} AS int) AS k, count(*) AS n FROM events GROUP BY event_type, cast({d.json('props', 'k')} AS int)")

Q.sql("recency_score", "events", lambda d: f"""
    WITH last AS (SELECT max(ts) AS now FROM events) SELECT event_id, round(exp(-{d.seconds('ts', 'now')} / 86400e0 / 60), 6) AS recency FROM events CROSS JOIN last""")

Q.sql("markdown_statements", "documents", lambda d: f"""
    WITH l AS (SELECT doc_id, {d.each}({d.split('text', chr(10))}) AS line FROM documents)
    SELECT doc_id, count(*) AS lines, count_if(length(trim(line)) >= 18) AS statements, count_if({d.like('line', '^ *[-*•] ')}) AS bullets FROM l GROUP BY doc_id""")

Q.sql("limit_banner_rows", "documents", lambda d: f"SELECT doc_id, source FROM documents WHERE {d.like('lower(text)', 'version [0-9.]+|licensed under')}")


class _Visible(HTMLParser):
    """Text outside script and style, one line for each block."""

    HIDDEN = frozenset(("script", "style", "noscript", "template", "head", "button"))
    BLOCKS = frozenset(("p", "div", "li", "tr", "h1", "h2", "h3", "h4", "section", "article", "br", "ul", "ol", "table", "footer", "header", "nav", "pre"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.out = 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in self.HIDDEN
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.depth = max(0, self.depth - (tag in self.HIDDEN))
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.out.append(data)


def visible_text(html: str | None) -> str:
    parser = _Visible()
    parser.feed(html or "")
    parser.close()
    lines = (" ".join(x.split()) for x in "".join(parser.out).split("\n"))
    out: list[str] = []
    for line in lines:
        if line and (not out or out[-1] != line):  # equal neighbours count once
            out.append(line)
    return "\n".join(out)


@Q.add()
def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text a reader sees on each page; no built-in parses HTML, so this is an Arrow batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([visible_text(x) for x in b.column(1).to_pylist()], pa.string())], names=["page_id", "text"])

    return table(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(run, "page_id long, text string").select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


QUERIES, ORACLE = Q.queries, Q.oracle
