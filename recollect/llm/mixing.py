"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Every cell has a probability, BUDGET at first, and
these are raked: in turn each dimension's cells are scaled so that the tokens expected to be drawn meet the
dimension's targets. No probability passes 1: a cell that would is held there, and the next rounds make up
for it in the others. There are ROUNDS rounds, in Spark, however many cells there are; if a target is then still
missed by more than the share TOLERANCE of it, a warning says by how much (targets that contradict each other can't
all be met).
A document is then drawn with its cell's probability, by a hash of its doc_id, so that the draw is the same
on every run and for every copy of the row.

Targets are shares of the drawn tokens: tokens to the power ALPHA, scaled to sum to one, unless given. Below
1 that lifts what is rare. A value can't give more tokens than it has, so a target is at most HEADROOM of
them; what that cuts off goes to the dimension's other values in proportion (`targets` has the outcome).
Topics are tied to languages, so unless topics have targets of their own a language's aim is dealt to its topics
in the same way, with HEADROOM for each pair, so that one table can have both margins (`topic_targets`).
Tokens are estimated at a quarter of the characters, rounded up, at least one.

The topic is an expression of the caller over the columns of docs, or comes from the words of the texts: the
TOPICS words (runs of letters in lower case) that the most documents have, of those that at most COMMON of all
documents have, are topic words; a document's topic is the one that it says most often (ties: the one that sorts
first), or "other" without any. Counts are of all documents and whole texts.

Defined cases: a null text is empty; null in a dimension is the value "none". Given targets that name
values without documents are left out and the rest scaled up; values without a target get none, so their
documents are not drawn. A null doc_id is drawn like the others, by the hash of the empty string. Rows are carried
in a struct, so columns of any name are passed on as they are; doc_id, text, source and lang are found whatever the
case of their names.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.shared import written

DIMENSIONS = ("source", "lang", "topic")
ALPHA, BUDGET, HEADROOM, ROUNDS, EACH_PLAN, TOLERANCE = 0.7, 0.6, 0.9, 48, 6, 0.005
TOPICS, COMMON, OTHER = 24, 0.05, "other"
#: Most cells that are raked as arrays by the driver (some 20 MB); more of them stay in Spark, by the same steps.
HERE = 200_000
#: Distinct words that a task holds at most before it hands its counts on.
HELD = 500_000
_RUNS = re.compile(r"[^\W\d_]+").findall
_KEYS = [f"mix_{d}" for d in DIMENSIONS]


def _words(text: str | None) -> list[str]:
    """Runs of letters in lower case. The pattern also lets number signs such as a half through; those part words."""
    found = _RUNS(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, documents that have it) of a task's documents."""
    counts: Counter = Counter()

    def given() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            counts.update(set(_words(text.as_py())))
            if len(counts) > HELD:
                yield given()
    if counts:
        yield given()


def topic_words(texts: DataFrame, topics: int = TOPICS, common: float = COMMON) -> list[str]:
    """The words of texts (text) that stand for topics, at most so many."""
    counts = texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    few = counts.where(F.col("n") <= common * texts.count())
    return [r.word for r in few.orderBy(F.desc("n"), "word").limit(topics).collect()]


def _text(docs: DataFrame) -> Column:
    return F.coalesce(_column(docs, "text").cast("string"), F.lit("")).alias("text")


def _column(docs: DataFrame, name: str) -> Column:
    return docs["`" + next(c for c in docs.columns if c.lower() == name) + "`"]


def _celled(docs: DataFrame, topic: str | None, chosen: list[str] | None = None, rows: bool = False) -> DataFrame:
    """doc_id, mix_source, mix_lang, mix_topic, mix_tokens; with `rows` also row, the document's columns. Topic words may be given."""
    column = lambda c: _column(docs, c)
    dims = [F.coalesce(column(d).cast("string"), F.lit("none")).alias(f"mix_{d}") for d in DIMENSIONS[:2]]
    row = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if rows else []
    text, doc_id = _text(docs), column("doc_id").alias("doc_id")
    if topic is not None:
        length = F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")
        return docs.select(*row, doc_id, *dims, F.coalesce(F.expr(topic).cast("string"), F.lit("none")).alias("mix_topic"), length.alias("mix_tokens"))
    chosen = topic_words(docs.select(text)) if chosen is None else chosen
    place = {w: i for i, w in enumerate(sorted(chosen))}
    names = sorted(chosen)

    def topic_of(said: str) -> str:
        counts = Counter(filter(place.__contains__, _words(said)))
        return names[min((-n, place[w]) for w, n in counts.items())[1]] if counts else OTHER

    frame = docs.select(*row, doc_id, *dims, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(part.num_columns - 1).to_pylist()
                added = [pa.array([topic_of(t) for t in texts], pa.string()), pa.array([max(1, -(-len(t) // 4)) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *added], names=[*part.schema.names[:-1], "mix_topic", "mix_tokens"])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[:-1], T.StructField("mix_topic", T.StringType()), T.StructField("mix_tokens", T.LongType())]))


def _aims(sums: DataFrame) -> DataFrame:
    """sums (wish, most, values) with aim: wishes scaled to sum to one, none above most."""
    sums, scale = written(sums, "aims"), None
    while True:  # each round cuts off at least one more value, in practice a few rounds do
        cut = F.col("wish") * scale > F.col("most") if scale else F.lit(False)
        row = sums.agg(F.sum(F.when(cut, F.col("most")).otherwise(0.0)).alias("held"), F.sum(F.when(cut, 0.0).otherwise(F.col("wish"))).alias("free")).first()
        new = (1.0 - (row["held"] or 0.0)) / row["free"] if row["free"] else 0.0
        if scale is not None and new <= scale * (1 + 1e-12):
            return sums.withColumn("aim", F.least(F.col("wish") * F.lit(new), "most"))
        scale = new


def targets(cells: DataFrame, dimension: str, given: Mapping[str, float] | None = None, budget: float = BUDGET, alpha: float = ALPHA) -> DataFrame:
    """(mix_<dimension>, aim, most) of cells with share: the value's share of all drawn tokens, and what it can give at most."""
    value = f"mix_{dimension}"
    if given is None:
        wish = F.pow(F.sum("tokens").cast("double"), F.lit(alpha))
    else:
        wish = F.coalesce(F.create_map(*[F.lit(x) for kv in given.items() for x in kv])[F.col(value)], F.lit(0.0)).cast("double")
    sums = cells.groupBy(value).agg(wish.alias("wish"), (F.sum("share") * HEADROOM / budget).alias("most"))
    return _aims(sums).select(value, "aim", "most")


def topic_targets(cells: DataFrame, langs: DataFrame, budget: float = BUDGET, alpha: float = ALPHA) -> DataFrame:
    """(mix_topic, aim) that one table of languages and topics can have: each language's aim (mix_lang, aim) is dealt to its
    topics by their tokens to the power alpha, none above what the pair has; what that cuts off goes to the language's others."""
    pairs = cells.groupBy("mix_lang", "mix_topic").agg(F.pow(F.sum("tokens").cast("double"), F.lit(alpha)).alias("wish"), (F.sum("share") * HEADROOM / budget).alias("most"))
    pairs = pairs.join(langs.select("mix_lang", "aim"), "mix_lang")
    # pairs are as few as there are topics in a language: those that are cut come first
    order = Window.partitionBy("mix_lang").orderBy(F.desc(F.col("wish") / F.col("most")), "mix_topic")
    held = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("wish").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    scaled = pairs.withColumn("k", (F.col("aim") - held) / free)
    best = F.max(F.when(F.col("wish") * F.col("k") <= F.col("most"), F.col("k"))).over(Window.partitionBy("mix_lang"))
    return scaled.withColumn("dealt", F.least("most", F.coalesce(F.col("wish") * best, "most"))).groupBy("mix_topic").agg(F.sum("dealt").alias("aim"))


def _raked_here(cells: pd.DataFrame, rounds: int) -> np.ndarray:
    """Probabilities of cells (share, probability, mix_ and aim_<dimension>) as arrays."""
    share, p = cells["share"].to_numpy(float), cells["probability"].to_numpy(float)
    codes = {d: pd.factorize(cells[f"mix_{d}"])[0] for d in DIMENSIONS}
    aims = {d: cells[f"aim_{d}"].to_numpy(float) for d in DIMENSIONS}
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(rounds):
            for d in DIMENSIONS:
                got = np.bincount(codes[d], share * p)[codes[d]]
                p = np.minimum(1.0, np.where(got > 0, p * aims[d] / got, 0.0))
    return p


def residual(cells: DataFrame) -> float:
    """The largest relative difference between what a value gives and its target, of cells with share, probability and aim_<dimension>."""
    worst = 0.0
    for d in DIMENSIONS:
        sums = cells.groupBy(f"mix_{d}").agg(F.sum(F.col("share") * F.col("probability")).alias("got"), F.first(f"aim_{d}").alias("aim")).where("aim > 0")
        worst = max(worst, sums.agg(F.max(F.abs(F.col("got") / F.col("aim") - 1))).first()[0] or 0.0)
    return worst


def raked(cells: DataFrame, given: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, alpha: float = ALPHA, rounds: int = ROUNDS, here: int = HERE) -> DataFrame:
    """cells (mix_source, mix_lang, mix_topic, tokens) with share and probability."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    now = written(cells.withColumn("share", F.col("tokens") / F.lit(float(total))).withColumn("probability", F.lit(float(budget))), "cells")
    given = given or {}
    aims = {d: targets(now, d, given.get(d), budget, alpha) for d in DIMENSIONS[: 3 if "topic" in given else 2]}
    if "topic" not in given:
        aims["topic"] = topic_targets(now, aims["lang"], budget, alpha)
    for d in DIMENSIONS:
        now = now.join(aims[d].select(f"mix_{d}", (F.col("aim") * budget).alias(f"aim_{d}")), f"mix_{d}")
    now = written(now, "cells")
    if 0 < now.count() <= here:
        few = now.orderBy(*_KEYS).toPandas()
        few["probability"] = _raked_here(few, rounds)
        now = cells.sparkSession.createDataFrame(few, now.schema)
    else:
        for done in range(rounds):
            for d in DIMENSIONS:
                # the cells of a value are as many as other dimensions have combinations, whatever the documents
                got = F.sum(F.col("share") * F.col("probability")).over(Window.partitionBy(f"mix_{d}"))
                now = now.withColumn("probability", F.least(F.lit(1.0), F.when(got > 0, F.col("probability") * F.col(f"aim_{d}") / got).otherwise(F.lit(0.0))))
            if (done + 1) % EACH_PLAN == 0 or done + 1 == rounds:
                now = written(now, "cells")
    missed = residual(now)
    if missed > TOLERANCE:
        warnings.warn(f"a mixing target is missed by {missed:.1%} of it after {rounds} rounds", stacklevel=2)
    return now.select(*_KEYS, "tokens", "share", "probability")


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the identifier only."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def _drawn(celled: DataFrame, rows: DataFrame | None = None, **raking) -> DataFrame:
    """celled (or `rows`, the same with more columns) with mix_probability and mix_drawn."""
    cells = written(celled.groupBy(*_KEYS).agg(F.sum("mix_tokens").alias("tokens")), "cells")
    rates = raked(cells, **raking).select(*_KEYS, F.col("probability").alias("mix_probability"))
    return (celled if rows is None else rows).join(rates, _KEYS).withColumn("mix_drawn", draw(F.col("doc_id")) < F.col("mix_probability"))


def mixture(docs: DataFrame, topic: str | None = None, **raking) -> DataFrame:
    """One row for each document: doc_id, source, lang, topic, tokens, probability, drawn."""
    found = _drawn(written(_celled(docs, topic), "celled"), **raking)
    return found.select("doc_id", *[F.col(f"mix_{d}").alias(d) for d in DIMENSIONS], F.col("mix_tokens").alias("tokens"), F.round("mix_probability", 4).alias("probability"), F.col("mix_drawn").alias("drawn"))


def mixed(docs: DataFrame, topic: str | None = None, **raking) -> DataFrame:
    """The documents drawn, with the columns of docs. Cells are found twice, so that no text is written once more."""
    chosen = topic_words(docs.select(_text(docs))) if topic is None else None
    return _drawn(_celled(docs, topic, chosen), _celled(docs, topic, chosen, rows=True), **raking).where("mix_drawn").select("row.*")


def oracle() -> str:
    """The same in DuckDB, all ROUNDS rounds written out; targets are found by ordering values by how far they pass what they have."""
    steps, last = [], "c0"
    for i in range(ROUNDS):
        for d in DIMENSIONS:
            name = f"c{i}_{d}"
            steps.append(f"{name} AS (SELECT * REPLACE (least(1.0, p * aim_{d} / sum(share * p) OVER (PARTITION BY {d})) AS p) FROM {last})")
            last = name

    def aims(name: str, wishes: str) -> str:
        return f"""w_{name} AS ({wishes}),
        o_{name} AS (SELECT *, (1 - coalesce(sum(most) OVER (ORDER BY wish / most DESC, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                         / sum(wish) OVER (ORDER BY wish / most DESC, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS k FROM w_{name}),
        g_{name} AS (SELECT {name}, {BUDGET} * CASE WHEN wish * k > most THEN most ELSE wish * (SELECT max(k) FILTER (wish * k <= most) FROM o_{name}) END AS aim FROM o_{name})"""

    most = f"sum(share) * {HEADROOM} / {BUDGET} AS most"
    by_source = f"SELECT source, pow(sum(tokens)::DOUBLE, {ALPHA}) AS wish, {most} FROM shares GROUP BY source"
    by_lang = f"SELECT lang, pow(sum(tokens)::DOUBLE, {ALPHA}) AS wish, {most} FROM shares GROUP BY lang"
    dealt = f"""w_pair AS (SELECT lang, topic, pow(sum(tokens)::DOUBLE, {ALPHA}) AS wish, {most} FROM shares GROUP BY lang, topic),
        o_pair AS (SELECT *, (aim / {BUDGET} - coalesce(sum(most) OVER (PARTITION BY lang ORDER BY wish / most DESC, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                          / sum(wish) OVER (PARTITION BY lang ORDER BY wish / most DESC, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS k FROM w_pair JOIN g_lang USING (lang)),
        g_pair AS (SELECT topic, {BUDGET} * least(most, coalesce(wish * max(k) FILTER (wish * k <= most) OVER (PARTITION BY lang), most)) AS aim FROM o_pair)"""
    return f"""
    WITH raw AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, coalesce(text, '') AS text FROM documents),
    said AS (SELECT rn, word, count(*) AS n FROM (SELECT rn, unnest(regexp_extract_all(lower(text), '[\\p{{L}}]+')) AS word FROM raw) GROUP BY ALL),
    chosen AS (SELECT word, count(*) AS n FROM said GROUP BY word HAVING count(*) <= {COMMON} * (SELECT count(*) FROM raw) ORDER BY n DESC, word LIMIT {TOPICS}),
    most AS (SELECT rn, word FROM said SEMI JOIN chosen USING (word) QUALIFY row_number() OVER (PARTITION BY rn ORDER BY n DESC, word) = 1),
    d AS (SELECT doc_id, source, lang, coalesce(word, '{OTHER}') AS topic, greatest(1, ceil(length(text) / 4))::BIGINT AS tokens FROM raw LEFT JOIN most USING (rn)),
    cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
    shares AS (SELECT *, tokens / sum(tokens) OVER () AS share FROM cells),
    {aims("source", by_source)}, {aims("lang", by_lang)}, {dealt},
    a_source AS (SELECT source, aim AS aim_source FROM g_source),
    a_lang AS (SELECT lang, aim AS aim_lang FROM g_lang),
    a_topic AS (SELECT topic, sum(aim) AS aim_topic FROM g_pair GROUP BY topic),
    c0 AS (SELECT *, {BUDGET}::DOUBLE AS p FROM shares JOIN a_source USING (source) JOIN a_lang USING (lang) JOIN a_topic USING (topic)),
    {", ".join(steps)}
    SELECT doc_id, source, lang, topic, d.tokens, round(p, 4) AS probability,
           ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < p AS drawn
    FROM d JOIN {last} USING (source, lang, topic)
    """
