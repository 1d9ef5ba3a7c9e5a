"""Tokens, word classes, phrases and names against sentences worked out by hand and direct search."""

import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from recollect.operators.phrases import QUERIES, alike_names, mentions, near_names, noun_phrases, tagged, token_rows

SENTENCES = {
    "The old boat isn't in Lisbon, I think 3 mighty ships!": (
        ["The", "old", "boat", "isn't", "in", "Lisbon", ",", "I", "think", "3", "mighty", "ships", "!"],
        ["The old boat", "Lisbon", "3 mighty ships"],
    ),
    "Das kleine Haus von Anna ist sehr schön.": (["Das", "kleine", "Haus", "von", "Anna", "ist", "sehr", "schön", "."], ["Das kleine Haus", "Anna", "schön"]),
    "Ella come una manzana deliciosa con Pedro": (["Ella", "come", "una", "manzana", "deliciosa", "con", "Pedro"], ["una manzana", "Pedro"]),
    "  Nous avons « une maison » — à Paris\n": (["Nous", "avons", "«", "une", "maison", "»", "—", "à", "Paris"], ["une maison", "Paris"]),
    "": ([], []),
}


def test_tokens_classes_and_noun_phrases(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate([*SENTENCES, None])], "id long, text string")
    rows = token_rows(texts, "id")
    found = {i: [(r.start, r.end, r.token) for r in sorted(rows.where(f"id = {i}").collect(), key=lambda r: r.position)] for i in range(len(SENTENCES))}
    for i, (text, (tokens, _)) in enumerate(SENTENCES.items()):
        assert [t for _, _, t in found[i]] == tokens and all(text[s:e] == t for s, e, t in found[i])
        assert re.sub(r"\s", "", text) == "".join(tokens)
    phrases = noun_phrases(tagged(rows, "id"), "id").collect()
    for i, (text, (_, wanted)) in enumerate(SENTENCES.items()):
        assert [text[r.start : r.end] for r in sorted(phrases, key=lambda r: r.start) if r.id == i] == wanted


def test_mentions_equal_direct_search(spark):
    rng = random.Random(2)
    names = {i: " ".join(rng.choice("abcd") for _ in range(rng.choice([1, 2, 2, 3, 5]))) for i in range(12)} | {20: "D  a", 21: "", 22: None}
    texts = [(i, " ".join(rng.choice("abcdAB,") for _ in range(rng.randint(0, 40)))) for i in range(150)] + [(500, None), (501, "")]
    got = {(r.doc, r.place, r.n_words, r.name_id) for r in mentions(spark.createDataFrame(texts, "doc long, text string"), spark.createDataFrame(list(names.items()), "name_id long, name string"), "doc").collect()}
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    known = {}
    for i in sorted(names, reverse=True):
        if split(names[i]):
            known[tuple(split(names[i]))] = i
    want = set()
    for doc, text in texts:
        w, at = split(text), 0
        while at < len(w):
            for n in range(6, 0, -1):
                if at + n <= len(w) and tuple(w[at : at + n]) in known:
                    want.add((doc, at, n, known[tuple(w[at : at + n])]))
                    at += n
                    break
            else:
                at += 1
    assert got == want and want


def test_near_names_equal_all_pairs(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(4, 24))) for _ in range(120)]

    def noisy(w):
        for _ in range(rng.randint(1, 4)):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcde1") + w[i:], w[:i] + rng.choice("abcde") + w[i + 1 :]]) or "a"
        return w

    names = {noisy(w) for w in base for _ in range(4)} | set(base[:10])
    got = {(r.name, r.known) for r in near_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(n,) for n in base], "known string")).collect()}
    fits = lambda w: len(w) >= 5 and not re.search("[0-9]", w)
    want = {(a, b) for a in names for b in base if a != b and fits(a) and fits(b) and a[0] == b[0] and abs(len(a) - len(b)) <= 2 and SequenceMatcher(None, a, b).ratio() >= 0.88}
    assert got == want and len(want) > 50
    assert near_names(spark.createDataFrame([(None,)], "name string"), spark.createDataFrame([("word",)], "known string").where(F.lit(False))).count() == 0


def test_names_meet_by_first_letter_and_length_and_few_reach_python(spark):
    names, known = [f"{a}matters{b}" for a in "abc" for b in ("", "xyzw", "xyzwuv")], ["amattersxyzv", "amatters", "bmattersxyqwuv"]
    found = near_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(n,) for n in known], "known string"))
    assert {(r.name, r.known) for r in found.collect()} == {("amattersxyzw", "amattersxyzv"), ("amattersxyzwuv", "amattersxyzv"), ("bmattersxyzwuv", "bmattersxyqwuv")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all(c in joins[0] for c in ("first", "size", "gram")) and "levenshtein" in plan


def test_alike_names_equal_all_pairs_of_any_letters_and_lengths(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcé1😀") for _ in range(n))
    base = {word(rng.choice([1, 3, 4, 5, 8, 9, 12, 13, 17, 25, 40, 60])) for _ in range(90)}

    def noisy(w):
        for _ in range(rng.randint(1, 2 + len(w) // 6)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + word(1) + w[i:], w[:i] + word(1) + w[i + 1 :]]) or "a"
        return w

    names = {noisy(w) for w in base for _ in range(6)} | set(sorted(base)[:10]) | {""}
    found = alike_names(spark.createDataFrame([(n,) for n in [*names, None]], "name string"), spark.createDataFrame([(n,) for n in [*base, None]], "known string")).collect()
    want = {(a, b, SequenceMatcher(None, a, b).ratio()) for a in names for b in base if a != b and SequenceMatcher(None, a, b).ratio() >= 0.88}
    assert sorted(map(tuple, found)) == sorted(want)
    assert {len(a) - len(b) for a, b, _ in want} >= {-3, 3} and any(a[0] != b[0] for a, b, _ in want) and any(len(b) == 4 for _, b, _ in want)


def test_nearest_known_names_are_of_any_first_letter_and_length(spark, tmp_path):
    known = ["bcdefghijklm", "word", "abcdefghijklmnopqrstuvwx", "model12345"]
    spark.createDataFrame([(1, " ".join(known))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "abcdefghijklm words abcdefghijklmnopqrstuvwxyz12 model1234 other")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.name: r.known for r in QUERIES["nearest_known_names"](spark, str(tmp_path)).collect()}
    assert found == {"abcdefghijklm": "bcdefghijklm", "words": "word", "abcdefghijklmnopqrstuvwxyz12": "abcdefghijklmnopqrstuvwx", "model1234": "model12345"}
