"""The language field, periodic runs and whitening against enumeration, direct search and floating-point algebra."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from recollect.llm import language, queries, runs, whitening
from recollect.tables import table

# runs


def direct_runs(words, least):
    """Every period by walking along the text; of equal bounds the first, smallest period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            begin = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > begin and i - begin + q >= max(least, 2 * q):
                found.setdefault((begin, i - begin + q), q)
            i += i == begin
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_direct_search(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(0, 4)):
            text = [str(rng.randrange(rng.choice([1, 2, 3, 40]))) for _ in range(rng.randint(0, 70))]
            unit = [str(rng.randrange(3)) for _ in range(rng.randint(1, 9))]
            texts.append(text + (unit * 12)[: rng.choice([0, 30, 77])] + text[:5])
        for least in (12, 7, 4):
            assert runs.runs_of(texts, least) == [direct_runs(t, least) for t in texts]


def expected_runs_row(doc_id, text):
    """The contract's row, step by step."""
    words = re.split("[ \t-\r]+", text or "")
    words = [w for w in words if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = direct_runs(words, 12)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[0] if found else (None, None, None)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_query_equals_direct_search_over_the_table(spark, sf_dir):
    got = sorted(map(tuple, queries.op12_periodic_runs(spark, sf_dir).collect()))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert got == sorted(expected_runs_row(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got) > 10


def test_run_cases(spark):
    nbsp, line = chr(0xA0), "a b c\n" * 6
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, line), (4, line), (None, line), (5, "x" * 3_000_000), (6, "w " * 60_000), (7, f"a{nbsp}b " * 13), (8, "é ü " * 7)]
    docs = spark.createDataFrame([(i, t, 0, "n") for i, t in rows], "doc_id long, text string, n_runs int, START string")
    got = [tuple(r) for r in runs.run_digests(docs).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    short = [r for r in rows if r[0] != 6]
    assert sorted((r for r in got if r[0] != 6), key=key) == sorted((expected_runs_row(*r) for r in short), key=key)
    assert next(r for r in got if r[0] == 6)[1:6] == (1, 0, 60_000, 1, 60_000_000)
    assert runs.run_digests(docs.where("false")).count() == 0
    assert {tuple(r) for r in runs.periodic_runs(docs.where("doc_id = 4")).collect()} == {(4, 0, 18, 3)}
    kept = runs.without_periodic_runs(docs).where("doc_id in (1, 4, 5)").collect()
    assert {(r.doc_id, None if r.text is None else len(r.text)) for r in kept} == {(1, None), (4, 5), (5, 3_000_000)}


# whitening


def covariance_of(x):
    centred = x - x.mean(0)
    return centred.T @ centred / len(x)


def check_whitened(got, vectors):
    """got (pandas) against vectors {vec_id: array}, by means other than the operator's."""
    x = np.floor(np.array(list(vectors.values()), float) * 64) + 1_000_000
    n = len(x)
    values = np.sort(np.linalg.eigvalsh(covariance_of(x)))[::-1]
    k = got["component"].max()
    assert (got["n"] == n).all() and len(got) == n * k and got["identity_error"].nunique() == 1
    assert got["identity_error"].max() < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[list(vectors)].to_numpy()
    assert np.abs(covariance_of(wide) - np.eye(k)).max() < 1e-9
    explained = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(explained, values[:k] / np.trace(covariance_of(x)), rtol=1e-8)
    # projections of centred rows on eigenvectors: the covariance with the rows gives sqrt(e) * component
    directions = (x - x.mean(0)).T @ wide / n
    assert np.allclose(covariance_of(x) @ directions, directions * values[:k], atol=1e-7 * values[0] ** 1.5)
    whole = [[int(v) for v in row] for row in x]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    exact = {i: sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for i, row in zip(vectors, whole, strict=True)}
    assert all(exact[i] == int(d) for i, d in zip(got["vec_id"], got["deviation"], strict=True))


def test_whitening_query(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()
    got = queries.op13_whitening(spark, sf_dir).toPandas()
    assert got["component"].max() == 32
    check_whitened(got, {r.vec_id: np.array(r.embedding) for r in rows})


def test_whitening_cases(spark):
    rng = np.random.default_rng(2)
    good = {i: rng.normal(0, 1, 5).round(3) * 10.0 ** rng.integers(-1, 3) for i in range(40)}
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [float("inf")] + [0.0] * 4), (104, [1.0, 2.0]), (105, [])]
    rows = [(int(i), [float(v) for v in vec], 7, "x") for i, vec in good.items()] + [(i, v, 7, "x") for i, v in bad]
    table_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, COMPONENT string")
    got = whitening.whitened_rows(table_).toPandas()
    assert got["component"].max() == 5
    check_whitened(got, good)
    assert whitening.whitened_rows(table_.where("false")).count() == 0
    assert whitening.whitened_rows(table_.where("vec_id = 3")).count() == 0  # one row, no spread
    few = whitening.whitened_rows(table_.where("vec_id < 3")).toPandas()  # three rows have two directions
    assert few["component"].max() == 2
    check_whitened(few, {i: good[i] for i in range(3)})


def test_whitening_of_equal_eigenvalues_ties_and_large_entries(spark):
    corners = {i: np.array([v, 0, 0, 0] if j == 0 else [0] * j + [v] + [0] * (3 - j), float) for i, (j, v) in enumerate((j, v) for j in range(4) for v in (-1, 1))}
    as_rows = lambda d: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in d.items()], "vec_id long, embedding array<double>")
    got = whitening.whitened_rows(as_rows(corners)).toPandas()
    check_whitened(got, corners)
    assert np.allclose(got["explained"], 0.25)
    twice = as_rows(corners).unionByName(as_rows(corners))
    assert (whitening.whitened_rows(twice).toPandas()["n"] == 16).all()
    large = as_rows({1: [1e300, 0.0], 2: [-1e300, 1.0], 3: [0.0, 2.0]})
    found = whitening.whitened(large).toPandas()
    assert found["component"].max() == 2 and np.isfinite(found["whitened"]).all()
    assert whitening.whitened_rows(large).where("deviation is null").count() > 0


def test_polynomial_and_roots():
    rng = np.random.default_rng(4)
    half = rng.integers(-9, 9, (6, 9)).astype(object)
    matrix = half @ half.T
    by_elimination = []
    for at in range(7):  # det(at - matrix) by fractions
        a = [[Fraction((at if i == j else 0) - int(matrix[i, j])) for j in range(6)] for i in range(6)]
        det = Fraction(1)
        for k in range(6):
            i = next(i for i in range(k, 6) if a[i][k])
            if i != k:
                a[k], a[i], det = a[i], a[k], -det
            det *= a[k][k]
            for r in range(k + 1, 6):
                a[r] = [x - a[r][k] / a[k][k] * y for x, y in zip(a[r], a[k], strict=True)]
        by_elimination.append(int(det))
    p = 2_147_483_629
    poly = whitening.polynomial_mod(matrix, p)
    assert [sum(c * at**i for i, c in enumerate(poly)) % p for at in range(7)] == [v % p for v in by_elimination]
    cubic = [-2 * 3 * 3, 3 * 3 + 2 * 3 * 2, -(2 + 3 + 3), 1]  # (x - 2)(x - 3)(x - 3)
    found = whitening.roots(cubic, 3, 64)
    assert [m for _, m in found] == [2, 1] and all(abs(r - (want << 64)) <= 1 for (r, _), want in zip(found, (3, 2), strict=True))
    assert all(all(p % q for q in range(2, 50_000)) for p in whitening.primes(2**100))


# language


def test_chain_equals_enumeration_and_gradient_equals_differences():
    rng = np.random.default_rng(3)
    k, first = 3, np.array([1, 0, 0, 0, 1, 1, 0, 0], bool)
    score, start, move = rng.normal(0, 1, (8, k)), rng.normal(0, 1, k), rng.normal(0, 1, (k, k))
    label = rng.integers(0, k, 8)

    def total(score, start, move):
        """(log of the sum over labellings, expected labels), text by text."""
        log, marginal = 0.0, np.zeros((8, k))
        for a, b in ((0, 4), (4, 5), (5, 8)):
            weights = {}
            for ys in itertools.product(range(k), repeat=b - a):
                weights[ys] = np.exp(start[ys[0]] + sum(score[a + i, y] for i, y in enumerate(ys)) + sum(move[x, y] for x, y in itertools.pairwise(ys)))
            z = sum(weights.values())
            log += np.log(z)
            for ys, w in weights.items():
                for i, y in enumerate(ys):
                    marginal[a + i, y] += w / z
        return log, marginal

    alpha, beta = language.chain(np.exp(score), first, np.exp(start), np.exp(move))
    both = alpha * beta
    assert np.allclose(both / both.sum(1, keepdims=True), total(score, start, move)[1])

    def loss(score, start, move):
        gold = score[np.arange(8), label].sum() + start[label[first]].sum() + sum(move[label[i - 1], label[i]] for i in range(8) if not first[i])
        return total(score, start, move)[0] - gold

    found = language.gradient(score, first, label, start, move)
    for which, at in [(0, (2, 1)), (0, (5, 0)), (1, (2,)), (2, (0, 2)), (2, (1, 1))]:
        arguments = [x.copy() for x in (score, start, move)]
        arguments[which][at] += 1e-5
        high = loss(*arguments)
        arguments[which][at] -= 2e-5
        assert np.isclose((high - loss(*arguments)) / 2e-5, found[which][at], atol=1e-6)


def test_language_query_on_held_out_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    got = queries.op11_language(spark, sf_dir).join(docs, "doc_id").toPandas()
    assert len(got) == docs.count()
    assert got["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() >= 0.95


def test_language_of_switched_text_and_cases(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    field = language.fit(docs)
    text = {r.lang: r.text for r in docs.where("length(text) > 800 and not text like '%|%' and not text like '%!!%'").orderBy("doc_id").collect()}
    halves = " ".join(language.words(text["de"])[:60]) + " " + " ".join(language.words(text["es"])[:90])
    rows = [(1, halves), (2, None), (3, ""), (4, "123 -- ² _"), (None, text["en"]), (6, text["fr"] * 300), (7, text["fr"]), (7, text["fr"])]
    mixed = spark.createDataFrame([(i, t, 3, "zz") for i, t in rows], "doc_id long, text string, score int, LANG_PRED string")
    got = language.predicted(mixed, field).toPandas()
    assert got[got["doc_id"].isin([2, 3, 4])][["lang_pred", "score"]].to_numpy().tolist() == [["und", 0.0]] * 3
    assert got["lang_pred"].iloc[[0, 4, 5, 6, 7]].tolist() == ["es", "en", "fr", "fr", "fr"]
    stretches = language.language_stretches(mixed.where("doc_id = 1"), field).toPandas()
    right = sum(min(s + n, b) - max(s, a) for s, n, x in zip(stretches["start"], stretches["n_words"], stretches["lang"], strict=True) for a, b, y in ((0, 60, "de"), (60, 150, "es")) if x == y and min(s + n, b) > max(s, a))
    assert stretches["n_words"].sum() == 150 and right >= 140
    # word by word in one chain or alone
    alone = language.predicted(mixed.where("doc_id = 6"), field).first()
    assert abs(alone.score - got["score"].iloc[5]) < 1e-9


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, "en"), (None, "more words", "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.languages(docs).collect()} == {("und", 0.0)}
    assert language.languages(docs.where("false")).count() == 0
    one = spark.createDataFrame([(i, "uno dos", "es") for i in range(8)] + [(9, "²", "es")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.languages(one).where("doc_id < 9").collect()} == {"es"}


def test_lexicon_counts_are_of_all_labelled_texts(spark):
    rows = [(i, f"casa casa {'hund' if i % 2 else 'perro'}", "de" if i % 2 else "es") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lexicon = language.lexicon_of(docs, ["de", "es"])
    assert lexicon["hund"] == [4, 0] and lexicon["perro"] == [0, 4] and lexicon["casa"] == [2, 2]
