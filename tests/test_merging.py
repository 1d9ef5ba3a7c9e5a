"""Merges in order of time, one by one, against the set-based form."""

import random
from collections import Counter

from recollect.operators.merging import moved_edges, survivors


def test_merges_equal_a_walk(spark):
    rng = random.Random(4)
    ids = list(range(60))
    # each id is merged into a smaller one, after whatever was merged into it: every step finds both ids alive
    merges = [(i, rng.randrange(i), 100 - i) for i in ids[1:] if rng.random() < 0.6]
    edges = [(rng.choice(ids), rng.choice(ids), rng.choice("ab"), 1, 0.5) for _ in range(500)]
    walked = Counter()
    for a, b, rel, n, _ in edges:
        walked[a, b, rel] += n
    names = {i: {i} for i in ids}
    for old, new, _ in sorted(merges, key=lambda m: m[2]):
        for (a, b, rel), n in list(walked.items()):
            if old in (a, b):
                del walked[a, b, rel]
                walked[new if a == old else a, new if b == old else b, rel] += n
        names[new] |= names.pop(old)
    wanted = {k: n for k, n in walked.items() if k[0] != k[1]}
    late = [(old, 59, 1000) for old, _, _ in merges[:3]] + [(5, 5, 0), (None, 1, 0), (2, None, 0)]  # merges of what is gone, with itself, of nothing
    alias = survivors(spark.createDataFrame(merges + late, "old long, new long, at int"))
    got = {(x.src, x.dst, x.rel): x.mentions for x in moved_edges(spark.createDataFrame(edges + [(None, 1, "a", 1, 0.5)], "src long, dst long, rel string, mentions long, weight double"), alias).collect()}
    assert got == wanted
    found = {}
    for x in alias.collect():
        found.setdefault(x.entity, set()).add(x.id)
    assert all(names[e] == found[e] for e in found if len(found[e]) > 1)


def test_circles_stay_and_chains_close(spark):
    rows = [(1, 2, 0), (2, 1, 0), (3, 1, 0)] + [(i, i + 1, 0) for i in range(10, 300)]
    got = {x.id: x.entity for x in survivors(spark.createDataFrame(rows, "old long, new long, at int")).collect()}
    assert {i: got[i] for i in (1, 2, 3)} == {1: 1, 2: 2, 3: 3} and {got[i] for i in range(10, 301)} == {300}
    assert survivors(spark.createDataFrame([], "old long, new long, at int")).count() == 0
