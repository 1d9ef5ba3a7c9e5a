"""What clients send: captures, facts of agents, step records, hook payloads, files; and how it is taken in.

The queries write rows of the given tables in a client's format, some of them broken, and read them back with
the readers below; the check asks the tables for what must come out and what must be refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions.clean import plausible_time
from recollect.plans.dialect import Queries
from recollect.tables import table

Q = Queries()

CAPTURE = "text string, site string, chat string, url string, ts double"
FACT = "text string, entities array<string>, relations array<array<string>>, kind string, confidence double"
MOST_TEXT, LEAST_CONFIDENCE = 20_000, 0.85
#: Kinds of records in the transcript format of steps, and whose words they are.
STEP_ROLES = {"prompt": "user", "completion": "assistant"}
#: Where each tool's hook payload has the site, the conversation and the text.
HOOK_FIELDS = [("editor", "workspace", "session_id", "prompt"), ("terminal", "cwd", "conversation", "input"), ("browser", "host", "thread", "message")]


def captures(raw: DataFrame, received: Column) -> DataFrame:
    """(raw, capture, ts, refused) of rows with a JSON text `raw`: the text is cut at MOST_TEXT, an implausible time is the time of receipt."""
    read = raw.withColumn("capture", F.from_json("raw", CAPTURE))
    text = F.substring(F.coalesce("capture.text", F.lit("")), 1, MOST_TEXT)
    ts = plausible_time(F.coalesce("capture.ts", F.lit(-1.0)), received)
    return read.withColumns({"text": text, "ts": ts, "refused": F.when(F.col("capture").isNull() | (F.trim(text) == ""), "no text")})


def agent_facts(raw: DataFrame) -> DataFrame:
    """raw with fact (kind `fact` at least, LEAST_CONFIDENCE at least) and refused, the reason if the shape is wrong."""
    fact = F.from_json("raw", FACT)
    read = raw.withColumn("fact", fact)
    wrong = F.exists(F.coalesce("fact.relations", F.array().cast("array<array<string>>")), lambda r: (F.size(r) != 3) | F.exists(r, lambda x: x.isNull()))
    reason = (
        F.when(F.coalesce(F.trim("fact.text"), F.lit("")) == "", "no text").when(F.col("fact.entities").isNull(), "entities are no list")
        .when(wrong, "a relation is no triple")
    )
    kept = F.struct(
        "fact.text", "fact.entities", F.coalesce("fact.relations", F.array().cast("array<array<string>>")).alias("relations"),
        F.coalesce("fact.kind", F.lit("fact")).alias("kind"), F.greatest(F.coalesce("fact.confidence", F.lit(0.0)), F.lit(LEAST_CONFIDENCE)).alias("confidence"),
    )
    return read.withColumns({"refused": reason, "fact": F.when(reason.isNull(), kept)})


def steps(raw: DataFrame, *by: str) -> DataFrame:
    """(by, place, role, text) of step records (by, place, raw): known kinds only, runs of one speaker joined by a line break."""
    kinds = F.create_map(*[F.lit(x) for kv in STEP_ROLES.items() for x in kv])
    read = raw.withColumn("r", F.from_json("raw", "kind string, content string")).withColumn("role", kinds[F.col("r.kind")]).where("role is not null")
    order = Window.partitionBy(*by).orderBy("place")
    starts = F.when(F.lag("role").over(order).eqNullSafe(F.col("role")), 0).otherwise(1)
    runs = read.withColumn("starts", starts).withColumn("run", F.sum("starts").over(order))
    joined = runs.groupBy(*by, "run", "role").agg(F.min("place").alias("place"), F.array_sort(F.collect_list(F.struct("place", "r.content"))).alias("parts"))
    return joined.select(*by, "place", "role", F.array_join(F.transform("parts", lambda p: p["content"]), "\n").alias("text"))


def hook_turns(raw: DataFrame) -> DataFrame:
    """raw (tool, payload map) with site, chat and text by the fields of the tool; tools that aren't known give nulls."""
    fields = raw.sparkSession.createDataFrame(HOOK_FIELDS, "tool string, site_field string, chat_field string, text_field string")
    found = raw.join(F.broadcast(fields), "tool", "left")  # one row for each known tool
    return found.select(*raw.columns, *[F.expr(f"element_at(payload, {x}_field)").alias(x) for x in ("site", "chat", "text")])


def files(spark: SparkSession, where: str, glob: str = "*", largest: int = 1 << 20, hidden: str | None = None) -> DataFrame:
    """(name, bytes, modified, sha1) of files, sha1 of those up to `largest` bytes; hidden: a pattern of lines left out of the digest."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(where)
    content = F.col("content")
    if hidden:
        content = F.array_join(F.filter(F.split(content.cast("string"), "\n"), lambda x: ~x.rlike(hidden)), "\n").cast("binary")
    # the reader opens only files whose content is asked for and whose length passes the filter
    row = lambda df, digest: df.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), digest.alias("sha1"))
    return row(found.where(F.col("length") <= largest), F.sha1(content)).unionAll(row(found.where(F.col("length") > largest), F.lit(None).cast("string")))


def appended(df: DataFrame, folder: str, day: str) -> None:
    """Appends rows as JSON lines to the log of their day."""
    df.withColumn("day", F.to_date(day)).write.mode("append").partitionBy("day").json(folder)


def backed_up(df: DataFrame, folder: str) -> None:
    """Writes rows as JSON to a folder that must not exist yet."""
    df.write.mode("errorifexists").json(folder)


@Q.add("""
    SELECT conv_id, turn, CASE WHEN turn % 6 = 5 OR trim(text) = '' THEN 'no text' END AS refused, CASE WHEN turn % 6 = 5 THEN 0 ELSE least(length(text), 20000) END::BIGINT AS chars,
           CASE WHEN turn % 6 = 5 OR turn % 4 = 3 OR turn % 5 = 4 THEN 1.7e9 ELSE 1.6e9 + conv_id END AS ts FROM conversations""")
def capture_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures as JSON: broken rows, times before the epoch or far ahead among them."""
    said = F.when(F.expr("turn % 4 = 3"), F.lit(-5.0)).when(F.expr("turn % 5 = 4"), F.lit(9e9)).otherwise(F.lit(1.6e9) + F.col("conv_id"))
    sent = F.when(F.expr("turn % 6 = 5"), F.lit('{"text": ["broken"')).otherwise(F.to_json(F.struct("text", F.col("role").alias("site"), F.col("conv_id").cast("string").alias("chat"), said.alias("ts"))))
    read = captures(table(spark, sf_dir, "conversations").select("conv_id", "turn", sent.alias("raw")), F.lit(1.7e9))
    return read.select("conv_id", "turn", "refused", F.length("text").cast("long").alias("chars"), "ts")


@Q.add("""
    SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'entities are no list' WHEN p_partkey % 7 = 0 THEN 'a relation is no triple' END AS refused,
           CASE WHEN p_partkey % 11 > 0 AND p_partkey % 7 > 0 THEN 2 END AS relations, CASE WHEN p_partkey % 11 > 0 AND p_partkey % 7 > 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'note' ELSE 'fact' END END AS kind,
           CASE WHEN p_partkey % 11 > 0 AND p_partkey % 7 > 0 THEN greatest(0.85, p_size / 50.0) END::DOUBLE AS confidence FROM part""")
def agent_fact_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of agents with their entities and relations; wrong shapes go to the side with a reason."""
    triple = lambda rel, x: F.array(F.col("p_name"), F.lit(rel), F.col(x))
    broken = F.when(F.expr("p_partkey % 7 = 0"), F.slice(triple("type", "p_type"), 1, 2)).otherwise(triple("type", "p_type"))
    whole = F.to_json(F.struct(
        F.col("p_name").alias("text"), F.array("p_name", "p_brand").alias("entities"), F.array(triple("brand", "p_brand"), broken).alias("relations"),
        F.when(F.expr("p_partkey % 3 = 0"), "note").alias("kind"), (F.col("p_size") / 50.0).alias("confidence"),
    ))
    sent = F.when(F.expr("p_partkey % 11 = 0"), F.to_json(F.struct(F.col("p_name").alias("text"), F.lit(None).cast("string").alias("entities")))).otherwise(whole)
    read = agent_facts(table(spark, sf_dir, "part").select("p_partkey", sent.alias("raw")))
    return read.select("p_partkey", "refused", F.when(F.col("fact").isNotNull(), F.size("fact.relations")).alias("relations"), "fact.kind", "fact.confidence")


@Q.add("""
    WITH t AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS before FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT *, sum(CASE WHEN before IS NOT DISTINCT FROM role THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t)
    SELECT conv_id, min(turn) AS place, role, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5 FROM r GROUP BY conv_id, run, role""")
def step_record_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcript format of steps: two kinds are speech, the rest is machinery."""
    kind = F.when(F.col("role") == "user", "prompt").when(F.col("role") == "assistant", "completion").otherwise("tool")
    turns = table(spark, sf_dir, "conversations")
    raw = turns.select("conv_id", F.col("turn").alias("place"), F.to_json(F.struct(kind.alias("kind"), F.col("text").alias("content"))).alias("raw"))
    raw = raw.unionByName(turns.select("conv_id", F.col("turn").alias("place"), F.lit('{"kind": "checkpoint"}').alias("raw")))
    return steps(raw, "conv_id").select("conv_id", "place", "role", F.md5("text").alias("text_md5"))


@Q.add("""
    SELECT conv_id, turn, CASE WHEN conv_id % 4 < 3 THEN role END AS site, CASE WHEN conv_id % 4 < 3 THEN conv_id::VARCHAR END AS chat,
           CASE WHEN conv_id % 4 < 3 THEN length(text) END AS chars FROM conversations""")
def hook_payload_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of several tools' hooks, each with its own field names, as turns of one shape."""
    value = {"site": F.col("role"), "chat": F.col("conv_id").cast("string"), "text": F.col("text")}
    payload = None
    for i, (_, *fields) in enumerate(HOOK_FIELDS):
        own = F.create_map(*[x for f, v in zip(fields, value.values(), strict=True) for x in (F.lit(f), v)])
        payload = F.when(F.expr(f"conv_id % 4 = {i}"), own) if payload is None else payload.when(F.expr(f"conv_id % 4 = {i}"), own)
    tool = F.expr("element_at(array('editor', 'terminal', 'browser', 'unknown'), cast(conv_id % 4 as int) + 1)")
    raw = table(spark, sf_dir, "conversations").select("conv_id", "turn", tool.alias("tool"), payload.alias("payload"))
    return hook_turns(raw).select("conv_id", "turn", "site", "chat", F.length("text").alias("chars"))


@Q.add()
def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the tables with their sizes, and a digest of the small ones."""
    return files(spark, sf_dir, "*.parquet").select("name", "bytes", "sha1")


@Q.add("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS replaced,
           CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS kept FROM orders""")
def insert_or_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come in beside those that are there: replaced where the key exists, or ignored there; added in both cases."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    held = orders.where("o_orderkey % 3 <> 0")
    new = orders.where("o_orderkey % 2 = 0 or o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("price"))
    both = held.join(new, "o_orderkey", "full_outer")
    return both.select("o_orderkey", F.coalesce("price", "o_totalprice").alias("replaced"), F.coalesce("o_totalprice", "price").alias("kept"))


@Q.add("""
    WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, (floor(value) % 40)::BIGINT AS turns FROM events),
    l AS (SELECT user_id, turns AS kept FROM s WHERE r = 1)
    SELECT user_id, l.kept, greatest(max(turns) - l.kept, 0) AS dropped, count(*) FILTER (turns > l.kept) AS longer_before FROM s JOIN l USING (user_id) GROUP BY user_id, l.kept""")
def tail_of_shorter_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript sent again is the whole state: what a shorter one lacks at its end is dropped."""
    sent = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), (F.floor("value") % 40).cast("long").alias("turns"))
    last = sent.groupBy("user_id").agg(F.max_by("turns", "at").alias("kept"), F.max("turns").alias("longest"))
    longer = sent.join(last, "user_id").where("turns > kept").groupBy("user_id").agg(F.count("*").alias("longer_before"))
    return last.join(longer, "user_id", "left").select("user_id", "kept", (F.col("longest") - F.col("kept")).alias("dropped"), F.coalesce("longer_before", F.lit(0)).alias("longer_before"))


@Q.add("""
    WITH l AS (SELECT user_id, event_id, ts::DATE AS day, length(event_type) + length(props) + 40 AS bytes FROM events),
    r AS (SELECT *, sum(bytes) OVER (PARTITION BY user_id ORDER BY event_id) - bytes AS before FROM l)
    SELECT user_id, (before // 2000)::BIGINT AS file_no, count(*) AS rows_in, sum(bytes)::BIGINT AS bytes FROM r GROUP BY ALL""")
def rotated_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each user's log by the file they fall into, a new one starting once 2,000 bytes are reached."""
    size = F.length("event_type") + F.length("props") + 40
    lines = table(spark, sf_dir, "events").select("user_id", "event_id", size.alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("user_id").orderBy("event_id")) - F.col("bytes")
    return lines.withColumn("file_no", F.floor(before / 2000)).groupBy("user_id", "file_no").agg(F.count("*").alias("rows_in"), F.sum("bytes").alias("bytes"))


QUERIES, ORACLE = Q.queries, Q.oracle
