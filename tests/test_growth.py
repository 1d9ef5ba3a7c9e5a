"""Queries at sizes that one broadcast table, one task or one pair too many would not survive: plans and results held against direct search."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.functions.rules import triples, without_secrets
from recollect.operators import sessions, topics
from recollect.operators.index import ORACLE, QUERIES, near_duplicates
from recollect.operators.learner import features
from recollect.operators.texts import one_edit_pairs
from recollect.operators.packs import ASKING, related_memories
from recollect.operators.recall import PARTS, Memory, _fused, distinct_memories
from recollect.shared import lean, noting, settings, written
from recollect.sources.intake import files
from tests.compare import same_rows


def _one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_one_edit_pairs_once_each_and_without_broadcast(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("aabé1") for _ in range(rng.randint(1, 6))) for _ in range(250)})
    pairs = one_edit_pairs(spark.createDataFrame([(n,) for n in names], "name string"))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    found = [tuple(r) for r in pairs.collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b, 1) for a in names for b in names if a < b and a[0] == b[0] and _one_edit(a, b)}


def _folder(spark, path) -> str:
    """Questions that share common words with every document and turn."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.7 else f"w{rng.randrange(400)}" for _ in range(n))
    spark.createDataFrame([(i, text(30)) for i in range(300)] + [(5000, None), (5001, "")], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, text(15)) for i in range(20)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i // 4, i % 4, text(30)) for i in range(300)], "conv_id long, turn long, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["bm25_topk", "tfidf_cosine_topk", "term_presence_search", "weighted_coverage", "conversation_search"])
def test_no_pair_of_question_and_text_is_shuffled(spark, tmp_path, name):
    """Sums are made where a text's words are; only each task's best go on, by question."""
    path = _folder(spark, tmp_path)
    found = QUERIES[name](spark, path)
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", found._jdf.queryExecution().executedPlan().toString())
    assert dealt and not [d for d in dealt if "item_id" in d and ("doc_id" in d or "conv_id" in d)]
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{path}/{t}.parquet/*.parquet')")
    assert same_rows(found.toPandas(), con.execute(ORACLE[name]).df())


def test_textrank_of_one_long_conversation_forms_no_pairs(spark, tmp_path):
    """Six hundred sentences that all share a word: 360,000 pairs, of which no table is written or joined."""
    rng = random.Random(8)
    turns = [(1, t, " ".join(f"w{rng.randrange(300)} the longer sentence of w{rng.randrange(300)} {t}." for _ in range(3))) for t in range(200)]
    turns += [(2, 0, "nothing shared whatsoever here. 1234567890 0987654321 5555!"), (2, 1, None), (3, 0, "the same words in a sentence. the same words in a sentence. same words other sentence!")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    folders: list[str] = []
    with noting(folders):
        found = sessions.QUERIES["textrank_sentences"](spark, str(tmp_path))
        assert max(spark.read.parquet(f).count() for f in folders) < 10_000
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert same_rows(found.toPandas(), con.execute(sessions.ORACLE["textrank_sentences"]).df())


def test_signature_names_every_member(spark, tmp_path):
    """Digest of the members' ids in order, as the SQL always had it."""
    rows = [(i, "a", "x") for i in (10, 9, 100)] + [(i, "b", "x") for i in (1, 2)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.source: (r.signature, r.members) for r in topics.QUERIES["topic_signature"](spark, str(tmp_path)).collect()}
    assert found == {"a": (hashlib.md5(b"10 100 9").hexdigest(), 3), "b": (hashlib.md5(b"1 2").hexdigest(), 2)}


def test_what_rules_read_is_worked_out_once(spark):
    """Neither a rule nor a word of a text takes the text apart again."""
    text = spark.createDataFrame([("Ab 1 cd.",)], "t string").select(F.upper("t").alias("t"))
    for made, sign in ((triples(F.upper("t")), "upper("), (without_secrets(F.reverse("t")), "reverse(t"), (features(F.reverse("t")), "array_distinct(")):
        plan = text.select(made.alias("x"))._jdf.queryExecution().analyzed().toString().split("Project")[1]
        assert plan.count(sign) == 1, sign


def test_large_files_are_listed_unread(spark, tmp_path):
    """A file above the reader's own limit, which raises if it is opened for its content."""
    (tmp_path / "small.parquet").write_bytes(b"abc")
    (tmp_path / "large.parquet").write_bytes(b"x" * 5000)
    with settings(spark, spark__sql__sources__binaryFile__maxLength="1000"):
        found = {r.name: (r.bytes, r.sha1) for r in files(spark, f"file://{tmp_path}", "*.parquet", 100).collect()}
    assert found == {"small.parquet": (3, hashlib.sha1(b"abc").hexdigest()), "large.parquet": (5000, None)}


def test_recall_meets_no_words_of_its_pool_by_question(spark, tmp_path):
    path = _folder(spark, tmp_path)
    memory = Memory(distinct_memories(spark.read.parquet(f"{path}/documents.parquet")))
    words = written(memory.asked(spark.read.parquet(f"{path}/benchmark.parquet")), "asked")
    pool = written(memory.rarest(words), "pool")
    parts = pool.select("item_id", "doc_id", *[F.lit(None).cast("double").alias(c) for c in PARTS])
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = _fused(memory, pool, words, words.withColumn("own", F.lit(1)), parts, None)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert dealt and not [d for d in dealt if "item_id" in d and "term" in d]


def test_related_memories_are_asked_for_by_the_query_set_and_found_among_all(spark):
    rows = [(c, 0, "user", f"tomato plants {c}") for c in (49, 50, 51, 100)]
    found = related_memories(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), ASKING).collect()
    assert {r.conv_id for r in found} == {50, 100}
    assert {"tomato plants 49", "tomato plants 51"} <= {r.text for r in found if r.conv_id == 50}


def test_shuffles_have_a_partition_for_so_many_rows(spark, monkeypatch):
    from recollect import shared

    monkeypatch.setattr(shared, "ROWS_EACH", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with shared.spread(spark, 100 * int(before) + 1):
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == int(before) + 1
    with shared.spread(spark, 1):
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_vectors_become_a_matrix_without_python_numbers(monkeypatch):
    import pyarrow as pa

    from recollect.operators import vectors

    column = pa.chunked_array([pa.array([[1.0, 2.0], [3.0, 4.0]], pa.list_(pa.float32())).slice(1), pa.array([[5.0, 6.0]], pa.list_(pa.float32()))])
    got = vectors._matrix(column)
    assert got.dtype == float and got.tolist() == [[3.0, 4.0], [5.0, 6.0]] and vectors.VECTORS_EACH <= 4096


def _textrank(sentences: list[str], rounds: int = 25) -> list[float]:
    """Sentence by sentence: cosines of tf * idf, what each passes on by its share of all its likenesses."""
    vectors = [Counter(re.findall(r"\w+", s.lower())) for s in sentences]
    df, n = Counter(t for v in vectors for t in v), len(sentences)
    vectors = [{t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in v.items()} for v in vectors]
    size = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    w = [[sum(x * b.get(t, 0.0) for t, x in a.items()) / (size[i] * size[j]) if i != j and size[i] and size[j] else 0.0 for j, b in enumerate(vectors)] for i, a in enumerate(vectors)]
    r = [1.0] * n
    for _ in range(rounds):
        r = [0.15 + 0.85 * sum(w[j][i] / sum(w[j]) * r[j] for j in range(n) if sum(w[j])) for i in range(n)]
    return r


@pytest.mark.parametrize("long", [10**6, 0])
def test_textrank_weighs_by_tf_idf_for_25_rounds_and_keeps_every_sentence(spark, long):
    """In one task or by joins, against every pair; a sentence that shares no word, or has none, keeps its row."""
    rng = random.Random(6)
    said = {1: ["red red fox runs", "a fox runs home", "home is a red house", "the house is far far away", "nothing shared", "…………"], 2: ["alone here"], 3: ["—"]}
    said[4] = sorted({" ".join(rng.choice("a b c d e f g h i j k".split()) for _ in range(rng.randint(1, 9))) for _ in range(30)})
    rows = [(10 * c + 1000 * i, c, s) for c, ss in said.items() for i, s in enumerate(ss)]
    found = {(r.conv_id, r.s): r["rank"] for r in sessions.textrank(spark.createDataFrame(rows, "id long, conv_id long, s string"), long=long).collect()}
    assert len(found) == len(rows)
    for c, ss in said.items():
        assert [found[c, s] for s in ss] == pytest.approx([round(r, 5) for r in _textrank(ss)], abs=1.1e-5)
    assert found[1, "nothing shared"] == found[1, "…………"] == 0.15


def test_blocks_of_vectors_are_kept_once_however_many_meet(spark, tmp_path):
    """Every text is in one block's row, a block in a file of its own; the pairs are those of a single block."""
    docs = spark.read.parquet(f"{_folder(spark, tmp_path)}/documents.parquet")
    found = {}
    for block in (10**9, 700):
        folders: list[str] = []
        with noting(folders):
            found[block] = {tuple(r) for r in near_duplicates(docs, 0.4, block).collect()}
        packed = spark.read.parquet(next(f for f in folders if "/blocks-" in f))
        ids = np.concatenate([np.frombuffer(r.doc_id, np.int64) for r in packed.collect()])
        assert sorted(ids) == list(range(300)) and len(packed.inputFiles()) == packed.count()
    assert found[10**9] == found[700] != set() and packed.count() > 3
    assert near_duplicates(spark.createDataFrame([(i, f"u{i} v{i}") for i in range(9)], "doc_id long, text string"), 0.4, 1).count() == 0


def test_words_of_a_memory_are_counted_where_it_is(spark, tmp_path):
    """Postings and their idf are shuffled once, by word; what was shuffled for a table is gone when the table is there."""
    docs = spark.createDataFrame([(1, "a b A c"), (2, "b"), (3, ""), (4, None), (5, "— x x")], "doc_id long, text string")
    folders: list[str] = []
    with noting(folders):
        memory = Memory(docs)
    assert sorted(tuple(r) for r in memory.index.select("doc_id", "term", "tf", "df").collect()) == [(1, "a", 2, 1), (1, "b", 1, 2), (1, "c", 1, 1), (2, "b", 1, 2), (5, "x", 2, 1)]
    assert {r.term: r.idf for r in memory.index.collect()} == pytest.approx({t: math.log(7 / (1 + n)) for t, n in (("a", 1), ("b", 2), ("c", 1), ("x", 1))})
    assert memory.lengths.count() == 3 and len(folders) == 3
    with lean(spark):
        assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"


def test_recall_sums_no_pair_outside_its_pool(spark, tmp_path):
    """A memory's words meet those of a question only where the memory is in the question's pool."""
    path = _folder(spark, tmp_path)
    memory = Memory(distinct_memories(spark.read.parquet(f"{path}/documents.parquet")))
    words = written(memory.asked(spark.read.parquet(f"{path}/benchmark.parquet")), "asked")
    pool = written(memory.rarest(words), "pool")
    parts = pool.select("item_id", "doc_id", *[F.lit(None).cast("double").alias(c) for c in PARTS])
    plan = _fused(memory, pool, words, words.withColumn("own", F.lit(1)), parts, None)._jdf.queryExecution().optimizedPlan().toString()
    met = [line for line in plan.splitlines() if "Join Inner" in line and "array_contains" in line]
    assert met and all("term" in line for line in met)
