"""Properties that hold on any input."""

import math
import random
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollect.catalog import QUERIES
from recollect.functions.text import redacted
from recollect.operators.index import near_duplicates
from recollect.operators.retrieve import statements
from recollect.operators.texts import visible_text

few = settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
text = st.text(alphabet="ab .?!\n<>/p019@-+éI", max_size=80)


@few
@given(st.lists(text, min_size=1, max_size=6))
def test_redaction_is_idempotent(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "x string").select(redacted(F.col("x")).alias("x"))
    assert all(r.x == r.y for r in frame.select("x", redacted(F.col("x")).alias("y")).collect())


@given(text)
def test_visible_text_is_stable_and_statements_are_parts(t):
    shown = visible_text(t)
    assert "\n\n" not in shown and shown == "\n".join(x for x in shown.split("\n") if x)
    assert all(s["clause"] in t for s in statements(t))


def test_intervals_of_a_subject_do_not_overlap(spark, sf_dir):
    facts = QUERIES["exclusive_supersede"](spark, sf_dir)
    assert facts.where("valid_to < valid_from").count() == 0
    assert facts.where("valid_to is null").groupBy("subj").count().where("count <> 1").count() == 0


def test_budgets_are_kept(spark, sf_dir):
    assert QUERIES["budgeted_prefix"](spark, sf_dir).where("spent > 1200").count() == 0


def test_deduplication_is_idempotent(spark, sf_dir):
    once = QUERIES["dedupe_captures"](spark, sf_dir)
    assert once.count() == once.dropDuplicates(["text", "source"]).count()
    assert once.agg(F.sum("times")).first()[0] == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_sign_radius_finds_what_brute_force_finds(spark):
    sf = "/root/testdata/sf0.01"
    exact = QUERIES["knn_exact"](spark, sf).where("rank <= 5").select("q", "vec_id")
    found = QUERIES["knn_signbit_rerank"](spark, sf).select("q", "vec_id")
    assert found.join(exact, ["q", "vec_id"]).count() >= 0.9 * exact.count()


def test_near_duplicates_lose_no_pair_and_take_null_empty_and_copies(spark):
    body = " ".join(f"w{i}" for i in range(60))
    changed = " ".join(f"w{i}" if i % 12 else f"v{i}" for i in range(60))  # all of its rarest terms are its own
    texts = [(1, body), (2, changed), (3, body), (4, None), (5, ""), (6, None), (7, "quite another text"), (8, "!!")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, rest int")  # a column that clashes with one inside
    found = {(r.doc_id, r.near_id): r.cosine for r in near_duplicates(docs).collect()}
    assert found[(1, 3)] == 1.0
    assert set(found) - {(1, 2)} == {(1, 3)}
    low = {(r.doc_id, r.near_id) for r in near_duplicates(docs, 0.3).collect()}
    assert low == {(1, 2), (1, 3)}
    assert near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_are_the_same_in_any_number_of_blocks(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(30)]
    for t in texts[:20]:  # families that differ in a few words
        texts += [" ".join(w if rng.random() > 0.1 else rng.choice(words) for w in t.split()) for _ in range(3)]
    texts = list(dict.fromkeys(texts))
    counts = [Counter(t.split()) for t in texts]
    df = Counter(w for c in counts for w in c)
    weights = [{w: k * math.log((2 + len(texts)) / (1 + df[w])) for w, k in c.items()} for c in counts]
    length = [math.sqrt(sum(x * x for x in w.values())) for w in weights]
    for at in (0.8, 0.4):
        cosine = {(i, j): round(sum(x * weights[j].get(w, 0.0) for w, x in weights[i].items()) / (length[i] * length[j]), 5) for i in range(len(texts)) for j in range(i + 1, len(texts))}
        want = {p: c for p, c in cosine.items() if c >= at}
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        for block in (5_000_000, 400):
            got = {(r.doc_id, r.near_id): r.cosine for r in near_duplicates(docs, at, block).collect()}
            assert len(want) > 20 and got.keys() == want.keys()
            assert all(abs(got[p] - want[p]) < 1.1e-5 for p in want)


def test_names_an_edit_apart_meet_wherever_the_edit_is(spark, sf_dir):
    found = QUERIES["fuzzy_entity_match"](spark, sf_dir).select("a", "b")
    assert found.where("substring(a, -1) <> substring(b, -1)").count() > 0
    assert found.where("substring(a, 1, length(a) - 1) <> substring(b, 1, length(b) - 1)").count() > 0
