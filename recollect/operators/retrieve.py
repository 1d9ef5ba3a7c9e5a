"""Retrieval that is greedy within a question: diversified ranking, and statements of turns by rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.index import most_terms, postings
from recollect.plans.dialect import Queries
from recollect.shared import written
from recollect.tables import table

Q = Queries()
POOL, PICKS, RELEVANCE = 40, 8, 0.8


def mmr(pool: pd.DataFrame) -> pd.DataFrame:
    """Maximal marginal relevance over one question's pool (POOL rows at most): score, terms -> place."""
    pool = pool.sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
    top = max(pool["score"].max(), 1e-9)
    sets = [set(t) for t in pool["terms"]]
    chosen: list[int] = []
    while len(chosen) < min(PICKS, len(pool)):
        near = lambda i: max((len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for j in chosen), default=0.0)
        rest = [i for i in range(len(pool)) if i not in chosen]
        chosen.append(max(rest, key=lambda i: (round(RELEVANCE * pool["score"][i] / top - (1 - RELEVANCE) * near(i), 9), -i)))
    out = pool.loc[chosen, ["item_id", "doc_id"]].copy()
    out["place"] = range(1, len(chosen) + 1)
    return out


@Q.add()
def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight documents of each question's best forty, relevance against likeness to those picked."""
    asked = written(postings(table(spark, sf_dir, "benchmark"), "item_id").select("item_id", "term"), "asked")
    docs = table(spark, sf_dir, "documents")
    top = written(most_terms(asked, docs, POOL).select("item_id", "doc_id", F.col("sum").alias("score")), "top")
    chosen = postings(docs.join(top.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id")  # POOL texts a question at most
    both = top.join(asked, "item_id").join(chosen, ["doc_id", "term"])
    pool = both.groupBy("item_id", "doc_id", "score").agg(F.slice(F.array_sort(F.collect_list("term")), 1, 200).alias("terms"))
    return pool.groupBy("item_id").applyInPandas(mmr, "item_id long, doc_id long, place int")


_CLAUSE = re.compile(r"[.!?;]+\s+|\n+")
_NAME = re.compile(r"(?<![.!?]\s)(?<!^)\b[A-Z][\w-]{3,}")
_RULES = [(relation, re.compile(pattern, re.I)) for relation, pattern in [
    ("named", r"\bmy name is (\w[\w -]{1,30})"), ("lives_in", r"\bi (?:now )?live in (\w[\w -]{1,30})"), ("works_at", r"\bi (?:now )?work (?:at|for) (\w[\w -]{1,30})"),
    ("likes", r"\bi (?:really )?(?:like|love|enjoy) (\w[\w -]{1,40})"), ("dislikes", r"\bi (?:hate|dislike) (\w[\w -]{1,40})"), ("uses", r"\bi (?:use|switched to) (\w[\w -]{1,30})"),
    ("owns", r"\bi (?:have|own|bought) (?:an? )?(\w[\w -]{1,30})"), ("licensed_under", r"\blicensed under (?:the )?(\w[\w -]{1,30})"),
]]


def statements(text: str | None) -> list[dict]:
    """Clauses of a message with mood, kind, named things, relation and object by the rules above."""
    out = []
    for clause in _CLAUSE.split(text or ""):
        clause = clause.strip()
        if len(clause) < 12:
            continue
        mood = "question" if clause.endswith("?") else "hypothetical" if re.search(r"\b(if|would)\b", clause, re.I) else "statement"
        found = next(((r, m.group(1).strip()) for r, p in _RULES if (m := p.search(clause))), (None, None)) if mood == "statement" else (None, None)
        names = list(dict.fromkeys(_NAME.findall(clause)))[:10]
        kind = "question" if mood == "question" else "fact" if found[0] else "note"
        weight = {"question": 0.35, "fact": 0.6, "note": 0.4}[kind] + 0.03 * min(3, len(names))
        out.append({"clause": clause[:500], "mood": mood, "kind": kind, "names": names, "relation": found[0], "object": found[1], "importance": round(weight, 4)})
    return out


@Q.add()
def turn_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clause of every turn, by one Arrow batch function."""
    fields = [("clause", pa.string()), ("mood", pa.string()), ("kind", pa.string()), ("names", pa.list_(pa.string())), ("relation", pa.string()), ("object", pa.string()), ("importance", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c, t, i, s) for c, t, x in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True) for i, s in enumerate(statements(x))]
            keys = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array([r[3][f] for r in rows], t) for f, t in fields]], names=["conv_id", "turn", "n", *[f for f, _ in fields]])

    ddl = "conv_id long, turn long, n long, clause string, mood string, kind string, names array<string>, relation string, object string, importance double"
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").mapInArrow(run, ddl)


QUERIES, ORACLE = Q.queries, Q.oracle
