"""Streaming forms of the event operators: the same table read as a stream of files.

Each query runs what is there to its end (availableNow) and returns what the sink holds, so a stream can be
compared with its batch form. Checkpoints and sinks are in the shared folder; the sinks are idempotent by batch:
a batch that is repeated overwrites what it wrote.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.plans.dialect import Queries
from recollect.shared import shared_dir
from recollect.tables import table

Q = Queries()
QUIET_S, MOST_S = 6 * 3600, 24 * 3600


def stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The table as a stream, its times as instants (a watermark needs them)."""
    schema = table(spark, sf_dir, name).schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(df: DataFrame, name: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs the stream to the end of its input and reads the sink, a folder for each batch. In update mode the
    sink holds what changed in each batch; of a key the row of the last batch counts."""
    spark, where = df.sparkSession, f"{shared_dir(df.sparkSession)}/recollect/{name}-{uuid.uuid4().hex[:12]}"

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/batch_no={batch_id}")

    query = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(df.schema).parquet(f"{where}/out/*")
    rows = spark.read.schema(df.schema.add("batch_no", "long")).option("basePath", f"{where}/out").parquet(f"{where}/out/*")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "batch_no").alias("last"))
    return last.select(*keys, "last.*")


@Q.add(lambda d: f"SELECT {d.hour('ts')} AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY {d.hour('ts')}, event_type")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each hour and type, kept up to date in state."""
    counts = stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = _drained(counts.select(F.col("w.start").alias("start"), "event_type", "n", "total"), "tumbling", "update", ("start", "event_type"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@Q.add("SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS hour FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message of one user, type and hour passes once."""
    keyed = stream(spark, sf_dir).select("user_id", "event_type", F.date_trunc("hour", "ts").alias("hour")).withWatermark("hour", "40 days")
    out = _drained(keyed.dropDuplicatesWithinWatermark(["user_id", "event_type", "hour"]), "dedupe")
    return out.select("user_id", "event_type", F.col("hour").cast("timestamp_ntz").alias("hour"))


@Q.add("SELECT user_id, event_type, max(ts) AS ts, count(*) AS versions FROM events GROUP BY user_id, event_type")
def stream_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each key, whatever order rows come in."""
    latest = stream(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"), F.count("*").alias("versions"))
    return _drained(latest, "latest", "update", ("user_id", "event_type")).select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "versions")


@Q.add(lambda d: f"""
    WITH g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
    s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL '30' MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL '30' MINUTE <= (SELECT max(ts) - INTERVAL '1' HOUR FROM events)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows that end after half an hour of quiet, given out once the watermark has passed their end, and then forgotten."""
    counts = stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    out = _drained(counts.select("user_id", F.col("w.start").alias("start"), "n"), "sessions")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def debounced(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A job is due after QUIET_S seconds of quiet, and MOST_S seconds after its first change at the latest; a change at
    that time or later begins the next job. Rows come in any order within the watermark's delay, so changes are held
    until it has passed them, and are then taken in order of time. A timer in event time wakes the state when it
    passes the next change held or the end of the open job."""
    first, last, n, held = state.get if state.exists else (None, None, 0, [])
    held = sorted([*held, *[t for f in ([] if state.hasTimedOut else frames) for t in f["at"].tolist()]])
    passed = state.getCurrentWatermarkMs() / 1000
    done: list[tuple[int, float, float, int]] = []
    due = lambda: min(first + MOST_S, last + QUIET_S)
    ready = bisect_left(held, passed)
    for t in held[:ready]:
        if n and t >= due():
            done.append((key[0], first, due(), n))
            n = 0
        first, last, n = (t if not n else first), t, n + 1
    held = held[ready:]
    if n and due() < passed:
        done.append((key[0], first, due(), n))
        n = 0
    if n or held:
        state.update((first, last, n, held))
        wakes = min([*held[:1], *([due()] if n else [])])
        state.setTimeoutTimestamp(max(int(wakes * 1000), state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    if done:
        yield pd.DataFrame(done, columns=["user_id", "first", "due", "n"])


#: The jobs of each user by walking the changes in order; `open` marks the last one of a user.
_JOBS = f"""
    WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
    j AS (SELECT user_id, i, t AS first, t AS last, 1::BIGINT AS n FROM e WHERE i = 1
          UNION ALL SELECT e.user_id, e.i, CASE WHEN e.t >= least(first + {MOST_S}, last + {QUIET_S}) THEN e.t ELSE first END, e.t,
                           CASE WHEN e.t >= least(first + {MOST_S}, last + {QUIET_S}) THEN 1 ELSE n + 1 END FROM j JOIN e ON e.user_id = j.user_id AND e.i = j.i + 1),
    r AS (SELECT user_id, first, least(first + {MOST_S}, last + {QUIET_S}) AS due, n, lead(n) OVER (PARTITION BY user_id ORDER BY i) AS following FROM j)
    SELECT user_id, round(first, 3) AS first, round(due, 3) AS due, n FROM r WHERE (following IS NULL OR following = 1)"""


@Q.add(_JOBS + " AND due < (SELECT floor(max(epoch_us(ts)) / 1e3) / 1e3 - 3600 FROM events)")
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that fell due, by keyed state with timers; those that aren't due an hour before the newest change stay in the state."""
    timed = stream(spark, sf_dir).where("user_id is not null").withWatermark("ts", "1 hour").select("user_id", "ts", (F.unix_micros("ts") / 1e6).alias("at"))
    jobs = timed.groupBy("user_id").applyInPandasWithState(
        debounced, "user_id long, first double, due double, n long", "first double, last double, n long, held array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return _drained(jobs, "debounce").select("user_id", F.round("first", 3).alias("first"), F.round("due", 3).alias("due"), "n")


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The jobs of rows that come in the order of user and time: one job is held at a time, however busy a user is."""
    user, first, last, n = None, 0.0, 0.0, 0
    for rows in batches:
        done = []
        for u, t in zip(rows["user_id"].tolist(), rows["at"].tolist(), strict=True):
            if n and (u != user or t >= min(first + MOST_S, last + QUIET_S)):
                done.append((user, first, min(first + MOST_S, last + QUIET_S), n))
                n = 0
            user, first, last, n = u, (t if not n else first), t, n + 1
        yield pd.DataFrame(done, columns=["user_id", "first", "due", "n"])
    yield pd.DataFrame([(user, first, min(first + MOST_S, last + QUIET_S), n)] if n else [], columns=["user_id", "first", "due", "n"])


@Q.add(_JOBS)
def debounced_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form: all jobs, those that nothing has followed yet too."""
    timed = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    jobs = timed.repartition("user_id").sortWithinPartitions("user_id", "at").mapInPandas(_fold, "user_id long, first double, due double, n long")
    return jobs.select("user_id", F.round("first", 3).alias("first"), F.round("due", 3).alias("due"), "n")


QUERIES, ORACLE = Q.queries, Q.oracle
