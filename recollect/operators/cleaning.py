"""Messages as clients send them, and what they are without it.

Clients wrap what people say: headings, clocks, reminder blocks, headers with model and time. The queries wrap
the turns of `conversations` in the same ways, from the columns, and take the wrapping off again with the
functions of recollect.functions.clean; the check asks the table itself for what must come back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import clean
from recollect.functions.text import tokens
from recollect.plans.dialect import Queries
from recollect.tables import table

Q = Queries()


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@Q.add("SELECT conv_id, turn, md5(regexp_replace(text, '^[ \\n\\t]+|[ \\n\\t]+$', '', 'g')) AS text_md5 FROM conversations")
def scrub_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped turns without their heading, clock and reminder block are the turns."""
    shown = F.concat(F.col("role"), F.lit(":\n<system-reminder>be brief\nand kind</system-reminder>\n"), F.trim("text"), F.lit(" 10:45 PM\n<context>open tail"))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.md5(clean.scrubbed(shown)).alias("text_md5"))


@Q.add("""
    SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN concat('m-', turn % 4) END AS model,
           CASE WHEN turn % 5 < 4 THEN epoch(timestamp '2024-03-05 10:00:00' + to_minutes(turn % 50))::BIGINT END AS said_at FROM conversations""")
def message_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and local time out of a message's header, before the header is scrubbed."""
    minute = F.lpad((F.col("turn") % 50).cast("string"), 2, "0")
    model = F.when(F.expr("turn % 4 < 3"), F.concat(F.lit("Model: M-"), F.expr("turn % 4"), F.lit("\n"))).otherwise(F.lit("Model: a b\n"))
    local = F.when(F.expr("turn % 5 < 4"), F.concat(F.lit("Local time: 2024-03-05 10:"), minute, F.lit("\n"))).otherwise(F.lit("Local time: 2024-13-05 10:00\n"))
    shown = F.concat(model, local, F.col("text"))
    return _turns(spark, sf_dir).select("conv_id", "turn", clean.hinted_model(shown).alias("model"), F.unix_seconds(clean.hinted_time(shown)).alias("said_at"))


@Q.add("SELECT conv_id, turn, CASE WHEN conv_id % 3 < 2 THEN md5(trim(text)) END AS asked_md5 FROM conversations")
def remember_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What somebody asks to be remembered."""
    said = F.concat(F.expr("element_at(array('Please make a note: ', ' merk dir, ', 'I wrote this down '), cast(conv_id % 3 as int) + 1)"), F.trim("text"))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.md5(clean.asked_to_remember(said)).alias("asked_md5"))


@Q.add("SELECT conv_id, turn, md5(concat(trim(text), chr(10), '## Plan', chr(10), role)) AS kept_md5 FROM conversations")
def model_output_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output without what it thought, with blocks that were never closed too."""
    shown = F.concat(F.lit("<thinking>first <b>\nthis</thinking>\n"), F.trim("text"), F.lit("\n## Plan\n"), F.col("role"), F.lit("<think>and so on"))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.md5(clean.without_blocks(shown)).alias("kept_md5"))


@Q.add("""
    SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 0 WHEN turn % 3 = 1 THEN 1 ELSE 2 END AS n,
           md5(CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN concat('a = ', conv_id, chr(10)) ELSE concat('b = ', turn, chr(10), '|', 'c', chr(10)) END) AS code_md5
    FROM conversations""")
def last_code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two whole fenced blocks of a message; one that is not closed isn't code."""
    a, b = F.concat(F.lit("```py\na = "), F.col("conv_id"), F.lit("\n```\n")), F.concat(F.lit("```\nb = "), F.col("turn"), F.lit("\n```\ntext\n```sql\nc\n```\n"))
    shown = F.concat(F.when(F.expr("turn % 3 > 0"), a).otherwise(""), F.regexp_replace("text", "`", ""), F.lit("\n"), F.when(F.expr("turn % 3 = 2"), b).otherwise(""), F.lit("```\nopen"))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.size(clean.code_blocks(shown)).alias("n"), F.md5(F.array_join(clean.code_blocks(shown), "|")).alias("code_md5"))


@Q.add("""
    WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM conversations),
    each AS (SELECT conv_id, turn, unnest(w) AS word FROM w),
    steer AS (SELECT word FROM (SELECT word, count(*) AS n FROM each GROUP BY word) ORDER BY n DESC, word LIMIT 200)
    SELECT w.conv_id, w.turn, len(w) AS words FROM w
    WHERE len(w) BETWEEN 1 AND 40 AND (SELECT count(*) FROM each e WHERE e.conv_id = w.conv_id AND e.turn = w.turn AND e.word NOT IN (SELECT word FROM steer)) <= len(w) // 2""")
def steering_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short messages half of whose words, or more, are among the corpus' 200 commonest: acknowledgements and steering, not statements."""
    said = _turns(spark, sf_dir).select("conv_id", "turn", tokens(F.col("text")).alias("w"))
    common = said.select(F.explode("w").alias("word")).groupBy("word").count().orderBy(F.desc("count"), "word").limit(200)
    words = common.agg(F.collect_list("word").alias("common"))  # 200 words: one row
    other = F.size(F.filter("w", lambda x: ~F.array_contains("common", x)))
    short = said.where(F.size("w").between(1, 40)).crossJoin(F.broadcast(words))
    return short.where(other <= F.floor(F.size("w") / 2)).select("conv_id", "turn", F.size("w").cast("long").alias("words"))


@Q.add("""
    WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
    SELECT page_id, CASE WHEN page_id % 9 = 0 OR trim(regexp_replace(title, '[ \\t\\n]+', ' ', 'g')) = '' THEN NULL
                         ELSE trim(regexp_replace(title, '[ \\t\\n]+', ' ', 'g')) END AS title FROM t""")
def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages without the site's name behind them; generic ones are none."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    shown = F.when(F.expr("page_id % 9 = 0"), F.lit(" Ohne  Titel - Example")).otherwise(F.concat(title, F.lit("  | Example Org")))
    return table(spark, sf_dir, "pages").select("page_id", clean.clean_title(shown).alias("title"))


@Q.add("""
    WITH m AS (SELECT l_orderkey AS order_id, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem GROUP BY l_orderkey)
    SELECT order_id, CASE WHEN len(s) = 1 THEN s[1]::VARCHAR ELSE concat(array_to_string(list_slice(s, 1, len(s) - 1), ', '), ' and ', s[len(s)]) END AS suppliers FROM m""")
def listed_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of an order as a phrase: a, b and c."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    return items.select("order_id", clean.listed(F.transform("s", lambda x: x.cast("string"))).alias("suppliers"))


@Q.add("""
    SELECT p_partkey, CASE WHEN p_partkey % 10 = 7 THEN NULL
      WHEN p_size <> 25 THEN sign(p_size - 25) WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END::INT AS against FROM part""")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions against 25.0: numbers compare, not strings, and 25 is 25.0."""
    shown = F.when(F.expr("p_partkey % 10 = 7"), F.lit("latest")).otherwise(F.concat(F.lit("v"), F.col("p_size"), F.lit("."), F.expr("p_partkey % 4"), F.lit(".0")))
    a, b = clean.version_parts(shown), clean.version_parts(F.lit("25.0"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(a.isNotNull(), F.when(a > b, 1).when(a < b, -1).otherwise(0)).alias("against"))


@Q.add("""
    WITH e AS (SELECT event_id, ts::DATE AS day, strftime(ts::DATE + (event_id % 300)::INT, '%m-%d') AS said, event_id % 2 = 0 AS past FROM events),
    c AS (SELECT event_id, day, past, unnest([try_strptime(concat(year(day) + y, '-', said), '%Y-%m-%d')::DATE for y in generate_series(-8, 8)]) AS on_day FROM e)
    SELECT event_id, CASE WHEN past THEN max(on_day) FILTER (on_day <= day) ELSE min(on_day) FILTER (on_day >= day) END::VARCHAR AS on_day FROM c GROUP BY event_id, past""")
def undated_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day and month without a year, by tense: the last one or the next one."""
    said = F.date_format(F.date_add(F.to_date("ts"), (F.col("event_id") % 300).cast("int")), "MM-dd")
    return table(spark, sf_dir, "events").select("event_id", clean.rolled_year(said, F.col("ts"), F.expr("event_id % 2 = 0")).cast("string").alias("on_day"))


@Q.add("""
    WITH e AS (SELECT event_id, user_id, ts, event_id % 3 AS k FROM events WHERE event_type = 'error'),
    w AS (SELECT event_id, user_id, CASE WHEN k = 0 THEN ts - INTERVAL 36 HOUR ELSE ts END AS low, CASE WHEN k = 0 THEN ts + INTERVAL 36 HOUR WHEN k = 1 THEN ts + INTERVAL 7 DAY ELSE ts + INTERVAL 31 DAY END AS high FROM e)
    SELECT w.event_id, count(*) AS events FROM w JOIN events e ON e.user_id = w.user_id AND e.ts BETWEEN w.low AND w.high GROUP BY w.event_id""")
def events_in_asked_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a user's log lies in the window that a question about a day, week or month names.

    Counted from ranks: asked bounds are ordered among the events and each takes the running count there,
    so a busy user is one sort and not a join of all with all."""
    events = table(spark, sf_dir, "events")
    unit = F.expr("element_at(array('day', 'week', 'month'), cast(event_id % 3 as int) + 1)")
    asked = events.where("event_type = 'error'").select("event_id", "user_id", clean.asked_window(F.col("ts"), unit).alias("w"))
    marks = (
        events.select("user_id", F.col("ts").alias("t"), F.lit(1).alias("at"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("event_id"), F.lit(0).alias("sign"))
        .unionByName(asked.select("user_id", F.col("w.low").alias("t"), F.lit(0).alias("at"), F.lit(0).alias("one"), "event_id", F.lit(-1).alias("sign")))
        .unionByName(asked.select("user_id", F.col("w.high").alias("t"), F.lit(2).alias("at"), F.lit(0).alias("one"), "event_id", F.lit(1).alias("sign")))
    )
    running = F.sum("one").over(Window.partitionBy("user_id").orderBy("t", "at").rowsBetween(Window.unboundedPreceding, 0))
    counted = marks.withColumn("before", running).where("sign <> 0")
    return counted.groupBy("event_id").agg(F.sum(F.col("sign") * F.col("before")).alias("events"))


@Q.add("""
    SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 1 THEN floor(epoch(ts)) - 7200 ELSE floor(epoch(ts)) END::DOUBLE AS seconds FROM events""")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO 8601 times with Z or an offset as seconds; times without either are none."""
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.when(F.expr("event_id % 7 = 0"), plain).otherwise(F.concat(plain, F.when(F.expr("event_id % 3 = 1"), F.lit("+02:00")).otherwise(F.lit("Z"))))
    return table(spark, sf_dir, "events").select("event_id", clean.utc_seconds(stamp).alias("seconds"))


@Q.add("""
    WITH s AS (SELECT conv_id, turn, trim(unnest(regexp_extract_all(text, '[^.!?]+[.!?]*'))) AS s FROM conversations),
    k AS (SELECT *, concat(' ', regexp_replace(lower(s), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ') AS l FROM s WHERE s <> ''),
    m AS (SELECT conv_id, turn, word, kind FROM (VALUES """ + ", ".join(f"('{p}', '{k}')" for k, ps in (("decision", clean.DECIDING), ("constraint", clean.BINDING)) for p in ps) + """) AS v(word, kind), conversations)
    SELECT conv_id, CASE WHEN s LIKE '%?' THEN 'question' WHEN EXISTS (SELECT 1 FROM m WHERE m.conv_id = k.conv_id AND m.turn = k.turn AND kind = 'decision' AND contains(l, concat(' ', word, ' '))) THEN 'decision'
                         WHEN EXISTS (SELECT 1 FROM m WHERE m.conv_id = k.conv_id AND m.turn = k.turn AND kind = 'constraint' AND contains(l, concat(' ', word, ' '))) THEN 'constraint' ELSE 'other' END AS section,
           count(*) AS n FROM k GROUP BY ALL""")
def section_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a conversation by the section of a hand-off that they belong to."""
    each = _turns(spark, sf_dir).select("conv_id", F.explode(F.regexp_extract_all("text", F.lit("[^.!?]+[.!?]*"), F.lit(0))).alias("s"))
    each = each.withColumn("s", F.trim(F.regexp_replace("s", r"^\n+|\n+$", ""))).where("s <> ''")
    return each.groupBy("conv_id", clean.section(F.col("s")).alias("section")).agg(F.count("*").alias("n"))


@Q.add("""
    WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM benchmark),
    k AS (SELECT w, concat(left(w, i - 1), substring(w, i + 1)) AS typo FROM (SELECT w, unnest(generate_series(1, length(w))) AS i FROM a WHERE length(w) >= 5))
    SELECT typo, min(w) AS anchor FROM k WHERE typo NOT IN (SELECT w FROM a) GROUP BY typo HAVING count(DISTINCT w) = 1""")
def typo_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with one character left out that lead back to one word only."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(tokens(F.col("text"))).alias("w")).distinct()
    cut = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.substring(F.col("w"), F.lit(1), i - 1), F.substring(F.col("w"), i + 1, F.length("w"))))
    typos = words.where(F.length("w") >= 5).select("w", F.explode(cut).alias("typo")).distinct()
    one = typos.groupBy("typo").agg(F.min("w").alias("anchor"), F.max("w").alias("other")).where("anchor = other")
    return one.join(words, one.typo == words.w, "left_anti").select("typo", "anchor")


@Q.add("""
    WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM benchmark),
    n AS (SELECT count(DISTINCT doc_id) AS docs FROM documents), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM documents),
    f AS (SELECT word, count(*) AS df FROM d GROUP BY word),
    r AS (SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(df, 0), word) AS r FROM (SELECT DISTINCT item_id, word FROM w) LEFT JOIN f USING (word))
    SELECT item_id, word AS anchor FROM r WHERE r = 1""")
def anchor_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest word of a question: the one that fewest documents hold, ties to the smaller word."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    said = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    wanted = said.join(asked.select("word").distinct(), "word", "left_semi")
    df = wanted.groupBy("word").agg(F.count("*").alias("df"))
    return asked.join(df, "word", "left").groupBy("item_id").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("anchor"))


@Q.add("""
    WITH w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM conversations),
    f AS (SELECT DISTINCT conv_id, turn, ('0x' || substr(md5(word), 1, 8))::BIGINT % 4096 AS feature FROM w)
    SELECT conv_id, turn, count(*) AS features, sum(feature)::BIGINT AS total FROM f GROUP BY conv_id, turn""")
def clause_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary features of a message for a linear reader: its words hashed to 4,096 places."""
    place = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % 4096
    rows = _turns(spark, sf_dir).select("conv_id", "turn", F.array_distinct(F.transform(tokens(F.col("text")), place)).alias("f")).where(F.size("f") > 0)
    return rows.select("conv_id", "turn", F.size("f").cast("long").alias("features"), F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


QUERIES, ORACLE = Q.queries, Q.oracle
