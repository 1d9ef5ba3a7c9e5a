"""Readers and writers of transcripts and exports: JSON lines, pasted exports, project dumps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions.text import redacted
from recollect.plans.dialect import Queries
from recollect.shared import shared_dir
from recollect.tables import table

Q = Queries()
TURN = "type string, session string, n long, isMeta boolean, message struct<role: string, content: array<struct<type: string, text: string>>>, _bad string"


def read_transcripts(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(session, n, role, text) of a folder of JSON lines. Lenient: records of other kinds, meta records and
    lines that are no JSON are skipped. Strict: any of them fails the read."""
    rows = spark.read.schema(TURN).option("columnNameOfCorruptRecord", "_bad").option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    talk = F.col("type").isin("user", "assistant", "system")
    if strict:
        rows = rows.where(F.when(talk, True).otherwise(F.raise_error(F.concat(F.lit("unknown record type: "), F.coalesce("type", F.lit("none")))).cast("boolean")))
    texts = F.expr("array_join(transform(filter(message.content, c -> c.type = 'text'), c -> c.text), '\\n')")
    return rows.where(talk & ~F.coalesce("isMeta", F.lit(False))).select("session", "n", F.coalesce("message.role", "type").alias("role"), texts.alias("text"))


def write_transcripts(turns: DataFrame, path: str) -> None:
    """The inverse of read_transcripts: one record for each row (session, n, role, text)."""
    record = F.struct(F.col("role").alias("type"), "session", "n", F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message"))
    turns.select(F.to_json(record).alias("value")).write.text(path)


def merged_runs(turns: DataFrame) -> DataFrame:
    """Consecutive turns of one role as one turn, numbered anew."""
    order = Window.partitionBy("session").orderBy("n")
    new = F.coalesce((F.lag("role").over(order) != F.col("role")).cast("int"), F.lit(1))
    runs = turns.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("session", "run").agg(F.first("role").alias("role"), F.expr("array_join(transform(array_sort(collect_list(struct(n, text))), t -> t.text), '\\n')").alias("text"))


def parse_export(lines: DataFrame) -> DataFrame:
    """(category, date, origin, fact) of pasted lines: "category | date | origin | fact" or bullets; fences and chatter dropped, repeats once."""
    line = F.trim(F.regexp_replace("line", r"^[\s*•-]+", ""))
    parts = F.split(line, r"\s*\|\s*")
    rows = lines.where(~F.col("line").rlike("^\\s*```") & (F.length(line) > 0)).select(
        F.when(F.size(parts) == 4, parts[0]).alias("category"), F.when(F.size(parts) == 4, F.try_to_date(parts[1], "yyyy-MM-dd")).alias("date"),
        F.when(F.size(parts) == 4, parts[2]).alias("origin"), F.when(F.size(parts) == 4, F.try_element_at(parts, F.lit(4))).otherwise(line).alias("fact"))
    return rows.where(F.length("fact") > 5).dropDuplicates(["fact"])


@Q.add("SELECT conv_id::VARCHAR AS session, turn AS n, role, md5(text) AS text_md5 FROM conversations")
def transcript_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations written as JSON lines and read back by the strict reader."""
    path = f"{shared_dir(spark)}/recollect/transcripts-{uuid.uuid4().hex[:12]}"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("n"), "role", "text")
    write_transcripts(turns, path)
    return read_transcripts(spark, path, strict=True).select("session", "n", "role", F.md5("text").alias("text_md5"))


@Q.add(lambda d: f"""SELECT doc_id, md5({d.replace(d.replace(d.replace(d.replace('text', '[0-9a-f]{32,}', '[hex]'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', '[email]'),
    '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}', '[ip]'), '[0-9]{13,19}', '[number]')}) AS redacted_md5 FROM documents""")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its secrets and addresses replaced."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(redacted(F.col("text"))).alias("redacted_md5"))


@Q.add("SELECT l AS fact, count(*) AS documents FROM (SELECT DISTINCT doc_id, trim(l) AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE length(l) > 40 GROUP BY l HAVING count(*) > 1")
def repeated_import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that several documents bring in."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("l")).select("doc_id", F.trim("l").alias("fact")).where(F.length("fact") > 40)
    return lines.distinct().groupBy("fact").agg(F.count("*").alias("documents")).where("documents > 1")


QUERIES, ORACLE = Q.queries, Q.oracle
