"""Near copies and line dedup against brute force; edge cases of both."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import line_dedup
from recollect.llm.line_dedup import alike_lines, class_sets, count_bits, frequent, kept_classes, line_decisions, line_digests, segment_keys, within, without_repeated_lines
from recollect.llm.near_dedup import THRESHOLD, bag_minhash, near_duplicate_classes, without_near_duplicates
from recollect.llm.words import bag_overlap, mix, shingle_bags, word_hashes


def texts(seed=1, n=60, size=120):
    rng = random.Random(seed)
    words = ["w" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(20, size))) for _ in range(n)]
    for base in out[:12]:
        for edits in (1, 2, 3, 9):
            w = base.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    return out + out[:7] + ["a b", "a b", "one", "", None, "  ", "x y z q"]


def classes_by_force(rows):
    bags = list(shingle_bags([t for _, t in rows]))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bag_overlap(bags[i], bags[j]) >= THRESHOLD:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_near_duplicates_match_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in near_duplicate_classes(docs).collect()}
    want = classes_by_force(rows)
    assert {d: r.class_id for d, r in got.items()} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[want[d]] and r.kept == (want[d] == d) for d, r in got.items())


def test_near_duplicates_edges(spark):
    docs = spark.createDataFrame(
        [(1, "same text here for all of us", "u", 1), (1, "same text here for all of us", "u", 1), (None, "same text here for all of us", "v", 2), (2, None, "x", 3), (3, None, "x", 3)],
        "doc_id long, text string, node string, class int",
    )
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.node) for r in kept.collect()) == [(1, "u"), (2, "x"), (3, "x")]
    assert near_duplicate_classes(docs.limit(0)).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    keys = np.sort(mix(np.arange(1, 200, dtype=np.uint64)))
    a = (keys, rng.integers(1, 12, len(keys)))
    b = (keys, np.where(rng.random(len(keys)) < 0.4, rng.integers(1, 12, len(keys)), a[1]))
    s = bag_minhash([a, b, a], 4096)
    assert (s[0] == s[2]).all()
    assert abs((s[0] == s[1]).mean() - bag_overlap(a, b)) < 0.03


def test_words():
    h, at = word_hashes(["Größe x", "größe", None, "", "a" * 3_000_000 + " größe"])
    assert at.tolist() == [0, 2, 3, 3, 3, 5]
    assert h[0] == h[2] == h[4]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def lines_by_force(docs, edits, least=24):
    """Lines that stay, of documents in order of their ids; classes are closed under alikeness."""
    all_lines = sorted({x.strip(" ") for _, t in docs for x in (t or "").split("\n") if len(x.strip(" ")) >= least})
    root = {x: x for x in all_lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(all_lines):
        for y in all_lines[:i]:
            if abs(len(x) - len(y)) <= edits and edit(x, y) <= edits:
                root[find(x)] = find(y)
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        kept = []
        for x in (t or "").split("\n"):
            key = find(x.strip(" ")) if len(x.strip(" ")) >= least else None
            if key is None or key not in seen:
                kept.append(x)
            seen.add(key)
        out[d] = "\n".join(kept)
    return out


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_line_dedup_matches_brute_force(spark, edits):
    rng = random.Random(edits)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randint(20, 40))) for _ in range(30)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                k = rng.randrange(len(x))
                x[k : k + 1] = rng.choice([[], ["z"], [x[k], "y"]])
            lines.append("".join(x))
        docs.append((d, "\n".join(lines)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.d: r.kept_text for r in line_decisions(frame, edits, 24).collect()}
    assert got == lines_by_force(docs, edits)


def test_line_dedup_edges(spark):
    long = "this line is long enough to count"
    rows = [(2, f"{long}\nshort\n{long}", 9, "h"), (1, long, 9, "d"), (1, long, 9, "d"), (3, None, 0, "n"), (4, "", 0, "gone"), (None, long, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, gone string")
    got = sorted(((r.doc_id if r.doc_id is not None else 99, r.text, r.n_chars, r.gone) for r in without_repeated_lines(docs).collect()), key=str)
    assert got == sorted([(2, "short", 5, "h"), (1, long, 33, "d"), (1, long, 33, "d"), (3, None, None, "n"), (4, "", 0, "gone"), (99, "", 0, "x")], key=str)
    assert line_digests(docs.limit(0)).count() == 0
    plan = line_digests(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_line_dedup_takes_short_repeats_and_three_edits(spark):
    line = "the committee approved the new budget for the coming school year on monday"
    near = line.replace("new ", "").replace("monday", "mondaz").replace(" for", " fur")
    three = line.replace("budget", "budgzz").replace("committee", "comittee")
    texts = [f"All rights reserved.\n{line}", "All rights reserved.\nAll rights reserve.", three, f"x\n\n{near}", "x\n\nx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in without_repeated_lines(docs).collect()}
    assert got == {0: texts[0], 1: "All rights reserve.", 2: "", 3: texts[3], 4: ""}
    assert {r.doc_id: (r.n_dropped, r.n_near) for r in line_digests(docs).collect()} == {0: (0, 0), 1: (1, 0), 2: (1, 1), 3: (0, 0), 4: (2, 0)}


@pytest.mark.parametrize("edits", [1, 2, 3, 4])
def test_segments_and_classes_cover_close_lines(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for i in range(1500):
        a = [rng.choice("abcdef é") for _ in range(rng.randint(24, 150))]
        b = list(a)
        for _ in range(edits):
            k = rng.choice([0, len(b) - 1, rng.randrange(len(b))])
            b[k : k + 1] = rng.choice([[], ["x"], [b[k], "y"]])
        if len(b) >= 24:
            pairs.append((i, "".join(a), "".join(b)))
    frame = spark.createDataFrame(pairs, "id long, a string, b string").selectExpr("id", "if(length(a) >= length(b), a, b) as a", "if(length(a) >= length(b), b, a) as b")
    side = lambda c: frame.select("id", F.col(c).alias("line"), F.length(c).alias("size"))
    met = segment_keys(side("a"), edits).join(segment_keys(side("b"), edits).where("own"), ["id", "key"]).select("id").distinct().count()
    assert met == len(pairs)
    sets = class_sets(frequent(side("a")), edits)
    two = [F.xxhash64(F.lit(i), F.lit(j), x, y) for (i, x), (j, y) in combinations(enumerate(kept_classes(sets)), 2)]
    keys = lambda c: side(c).select("id", F.explode(F.array(*two)).alias("key"))
    assert keys("a").join(keys("b"), ["id", "key"]).select("id").distinct().count() == len(pairs)


@pytest.mark.parametrize("edits", [0, 1, 2, 3, 4])
def test_bits_equal_the_edit_distance(spark, edits):
    rng, rows = random.Random(edits), [("", ""), ("a", ""), ("", "abc"), ("a" * 3000, "a" * 2998 + "b")]
    for _ in range(1200):
        a = [rng.choice("abé😀") for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(b) + 1)
            b[k : k + 1] = rng.choice([[], ["z"], ["y", "b"]])
        rows.append(("".join(a), "".join(b)))
    frame = spark.createDataFrame(rows, "a string, b string")
    assert [r.got for r in frame.select(within("a", "b", edits).alias("got")).collect()] == [edit(a, b) <= edits if len(a) < 1000 else edits >= 2 for a, b in rows]


def test_lines_that_share_a_half_form_few_pairs(spark):
    """n lines with a common half, or with one of many words replaced, must not meet in n * n pairs."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 9)))
    half, base = " ".join(word() for _ in range(12)), [word() for _ in range(24)]
    lines = [f"{half} {' '.join(word() for _ in range(12))}" for _ in range(400)]
    for _ in range(400):
        line = list(base)
        for _ in range(3):
            line[rng.randrange(len(line))] = word()
        lines.append(" ".join(line))
    near = [x[:-1] + "?" for x in lines[:40]]
    frame = spark.createDataFrame(list(enumerate(lines + near)), "id long, line string").withColumn("size", F.length("line"))
    asked = []

    def counted(pairs, texts, edits, verify=line_dedup.verified):
        asked.append(pairs.count())
        return verify(pairs, texts, edits)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(line_dedup, "verified", counted)
        found = alike_lines(frame, 3).groupBy("component").count().collect()
    assert sorted(r["count"] for r in found) == [2] * 40
    assert sum(asked) < 10 * len(lines)


def test_line_dedup_of_a_very_long_text(spark):
    text = "\n".join(f"row {i % 7000} of a long list of things, each with its number {i % 7000:06d}" for i in range(14000)) + "\n" + "x" * 300_000
    docs = spark.createDataFrame([(1, text), (2, text[:100])], "doc_id long, text string")
    got = {r.doc_id: r for r in line_digests(docs, 0).collect()}
    assert (got[1].n_lines, got[1].n_dropped, got[2].n_dropped) == (14001, 7000, 1)


def test_marks_of_dropped_lines_are_made_once_a_document(spark):
    docs = spark.createDataFrame([(1, "a\na\nb"), (2, "b\nc")], "doc_id long, text string")
    digests = line_digests(docs)
    plan = digests._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("repeat(") < plan.index("filter(split(")  # not within the function of each line
    assert {r.doc_id: (r.n_lines, r.n_dropped) for r in digests.collect()} == {1: (3, 1), 2: (2, 1)}


def test_count_bits_differ_by_the_counts(spark):
    rng, letters = random.Random(7), "abcdefghijklmnopqrstuvé"
    lines = ["".join(rng.choice(letters[: rng.randint(1, 23)]) for _ in range(rng.randint(1, 60))) for _ in range(300)] + ["a" * n for n in range(18)]
    frame = spark.createDataFrame(list(enumerate(lines)), "id long, line string").withColumn("size", F.length("line"))
    numbers = count_bits(list(letters))
    assert len(numbers) == 2
    got = {r["id"]: [r["n0"], r["n1"]] for r in frame.select("id", *[n.alias(f"n{i}") for i, n in enumerate(numbers)]).collect()}
    for i, x in enumerate(lines):
        for j, y in enumerate(lines[:i]):
            apart = [abs(x.count(c) - y.count(c)) % 8 for c in letters]
            assert sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(got[i], got[j], strict=True)) == sum(min(n, 8 - n) for n in apart)


def test_segments_of_bytes_meet_those_of_characters(spark):
    plain = "an ordinary line of text with nothing but ascii letters in it, and a few more"
    lines = [plain, plain[:-2] + "\u00e9" + plain[-1:], "\u00e9" + plain[1:]]
    keys = segment_keys(spark.createDataFrame(list(enumerate(lines)), "id long, line string").withColumn("size", F.length("line")))
    met = keys.where("own").alias("a").join(keys.alias("b"), "key").where("a.id < b.id").select("a.id", "b.id").distinct().count()
    assert met == 3
