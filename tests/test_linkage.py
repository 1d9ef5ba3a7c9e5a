"""Rounds of joins against walking one by one."""

import random
from collections import deque

import pytest

from recollect.operators import linkage
from recollect.operators.linkage import alike_lines, average_linkage, chains, greedy_kept, shortest_paths


def sequential_linkage(similar, owners, least):
    group, own = {}, {}
    for a, b, _ in similar:
        group[a], group[b] = [a], [b]
    for u in owners:
        group[u] = [u]
    own = {u: set(owners.get(u, ())) for u in group}
    s = {(min(a, b), max(a, b)): x for a, b, x in similar}
    while True:
        best = None
        for (a, b), x in s.items():
            mean = round(x / (len(group[a]) * len(group[b])), 12)
            if mean >= least and not (own[a] and own[b] and not own[a] & own[b]) and (best is None or (-mean, a, b) < best):
                best = (-mean, a, b)
        if best is None:
            return {u: c for c, us in group.items() for u in us}
        _, a, b = best
        group[a] += group.pop(b)
        own[a] |= own.pop(b)
        new = {}
        for (x, y), v in s.items():
            x, y = (a if x == b else x), (a if y == b else y)
            if x != y:
                new[min(x, y), max(x, y)] = new.get((min(x, y), max(x, y)), 0) + v
        s = new


@pytest.mark.parametrize(("n", "density", "owned", "least"), [(200, 0.05, 0.5, 0.2), (30, 0.6, 0.9, 0.45), (30, 0.5, 0.0, 0.4)])
def test_average_linkage_equals_sequential(spark, n, density, owned, least):
    rng = random.Random(n)
    similar = [(a, b, rng.random()) for a in range(n) for b in range(a) if rng.random() < density]
    owners = {u: rng.sample("xyz", rng.randint(1, 2)) for u in range(n) if rng.random() < owned}
    frame = spark.createDataFrame(similar, "a long, b long, similarity double")
    got = average_linkage(frame, spark.createDataFrame(list(owners.items()), "unit long, owners array<string>") if owners else None, least)
    want = sequential_linkage(similar, owners, least)
    assert {r.unit: r.cluster for r in got.collect()} == want and 1 < len(set(want.values())) < n


def test_greedy_equals_sequential(spark):
    rng = random.Random(3)
    items = [(i, rng.randrange(30)) for i in range(150)]
    alike = [(rng.randrange(150), rng.randrange(150)) for _ in range(220)] + [(i, i + 1) for i in range(100, 130)]
    near, kept = {}, set()
    for a, b in alike:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for i, _ in sorted(items, key=lambda r: (r[1], r[0])):
        if not (near.get(i, set()) - {i}) & kept:
            kept.add(i)
    got = greedy_kept(spark.createDataFrame(items, "id long, rank long"), spark.createDataFrame(alike, "a long, b long"))
    assert sorted(r.id for r in got.collect()) == sorted(kept)
    assert greedy_kept(spark.createDataFrame([], "id long, rank long"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_alike_lines_equal_all_pairs(spark):
    rng = random.Random(8)
    rows = [(i, i % 3, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 7)))) for i in range(120)]
    got = {(r.a, r.b) for r in alike_lines(spark.createDataFrame(rows, "id long, scope long, text string")).collect()}
    sets = [(i, s, set(t.split())) for i, s, t in rows]
    want = {(i, j) for i, s, x in sets for j, r, y in sets if i < j and s == r and x and y and len(x & y) >= 0.72 * (len(x) * len(y)) ** 0.5 - 1e-12}
    assert got == want and want


def test_chains_of_any_length_and_circles(spark):
    links = [(i, i - 1 if i else None) for i in range(5000)] + [(6000, 5999)] + [(7000 + i, 7000 + (i + 1) % 5) for i in range(5)] + [(7100, 7002), (8000, 8000)]
    got = {r.id: (r.root, r.depth) for r in chains(spark.createDataFrame(links, "id long, parent long")).collect()}
    assert all(got[i] == (0, i) for i in range(5000)) and got[6000] == (6000, 0)
    assert all(got[i] == (None, None) for i in (7000, 7004, 7100, 8000))


def test_shortest_paths_equal_breadth_first(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(95)]
    hubs, wanted = {3, 7}, [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(3, 9)]
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)

    def length(a, b):
        seen, todo = {a: 0}, deque([a])
        while todo:
            x = todo.popleft()
            for y in near.get(x, ()):
                if y not in seen and (y not in hubs or y == b):
                    seen[y] = seen[x] + 1
                    todo.append(y)
        return seen.get(b)

    frames = spark.createDataFrame(edges, "u long, v long"), spark.createDataFrame(wanted, "a long, b long")
    got = {(r.a, r.b): r for r in shortest_paths(*frames, 6, spark.createDataFrame([(h,) for h in hubs], "node long")).collect()}
    want = {(a, b): length(a, b) for a, b in set(wanted) if length(a, b) is not None and length(a, b) <= 6}
    assert {k: r.length for k, r in got.items()} == want and max(want.values()) > 3
    for (a, b), r in got.items():
        assert r.nodes[0] == a and r.nodes[-1] == b and len(r.nodes) == r.length + 1
        assert all(y in near[x] for x, y in zip(r.nodes, r.nodes[1:], strict=False)) and not hubs & set(r.nodes[1:-1])


def test_topics_of_the_tables_equal_sequential(spark, sf_dir):
    from recollect.operators.topics import QUERIES

    similar = [tuple(r) for r in QUERIES["pairwise_tfidf_similarity"](spark, sf_dir).select("a", "b", "similarity").collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang").distinct().collect()
    owners = {f"{r.source}/{r.lang}": [r.lang] for r in docs}
    got = {r.unit: r.cluster for r in linkage.average_linkage_topics(spark, sf_dir).collect()}
    assert got == sequential_linkage(similar, owners, 0.05)


def test_pagerank_with_nodes_that_lead_nowhere(spark):
    from recollect.operators.graph import pagerank

    rng = random.Random(6)
    edges = [(rng.randrange(20), rng.randrange(30), rng.randint(1, 4)) for _ in range(70)] + [(40, 41, 2), (1, 2, 0), (None, 3, 1)]
    real = [e for e in edges if e[0] is not None and e[2] > 0]
    nodes = sorted({x for u, v, _ in real for x in (u, v)})
    r = {x: 1 / len(nodes) for x in nodes}
    total = {u: sum(w for x, _, w in real if x == u) for u in nodes}
    for _ in range(30):
        lost = sum(r[x] for x in nodes if not total[x])
        new = {x: (0.15 + 0.85 * lost) / len(nodes) for x in nodes}
        for u, v, w in real:
            new[v] += 0.85 * r[u] * w / total[u]
        r = new
    got = {x.node: x.r for x in pagerank(spark.createDataFrame(edges, "u long, v long, w long"), settled=0.0).collect()}
    assert got.keys() == r.keys() and max(abs(got[x] - r[x]) for x in r) < 1e-12 and abs(sum(got.values()) - 1) < 1e-9
    assert pagerank(spark.createDataFrame([], "u long, v long, w long")).count() == 0


def test_pagerank_both_ways_in_many_cells_and_without_shuffled_edges(spark, monkeypatch):
    from recollect.operators import graph

    rng = random.Random(8)
    edges = [(rng.randrange(9), 100 + rng.randrange(40), 1 + rng.randrange(3)) for _ in range(300)]
    back = edges + [(v, u, w) for u, v, w in edges]
    plain = {x.node: x.r for x in graph.pagerank(spark.createDataFrame(back, "u long, v long, w long"), settled=0.0, cells=1).collect()}
    monkeypatch.setattr(graph, "EDGES_EACH", 50)
    got = {x.node: x.r for x in graph.pagerank(spark.createDataFrame(edges, "u long, v long, w long"), settled=0.0, both_ways=True).collect()}
    assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 1e-12 for k in got)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("recollect_")]


def test_chains_move_only_what_has_not_arrived(spark):
    from recollect.shared import noting

    folders = []
    with noting(folders):
        got = {r.id: (r.root, r.depth) for r in chains(spark.createDataFrame([(i, i - 1 if i % 64 else None) for i in range(640)], "id long, parent long")).collect()}
    assert got == {i: (i - i % 64, i % 64) for i in range(640)}
    rows = [spark.read.parquet(f).count() for f in folders]
    assert rows[0] == 640 and rows[1:] == sorted(rows[1:], reverse=True) and max(rows[1:]) < 640 and len(rows) == 7
