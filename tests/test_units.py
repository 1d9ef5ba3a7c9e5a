"""Column functions, readers, graph rounds and state functions on small fixtures."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators.graph import connected_components
from recollect.operators.retrieve import mmr, statements
from recollect.operators.texts import visible_text
from recollect.sources.transcripts import merged_runs, parse_export, read_transcripts, write_transcripts
from recollect.streaming.events import MOST_S, QUIET_S, debounced


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("label", "key"), [("Red  Apples!", "red apple"), ("Berries", "berry"), ("glass", "glass"), ("", "")])
def test_canonical_key(spark, label, key):
    assert one(spark, label, T.canonical_key) == key


def test_text_functions(spark):
    assert one(spark, "mail a.b@c.de, 10.0.0.1 and " + "a1" * 16 + " 4111111111111111", T.redacted) == "mail [email], [ip] and [hex] [number]"
    assert one(spark, "abcdefghi", T.token_estimate) == 3
    assert one(spark, "What is it?", T.mood) == "question"
    assert one(spark, "I would go", T.mood) == "hypothetical"
    assert str(one(spark, "2021-02", T.partial_date)) == "2021-02-01"
    assert one(spark, "2021-13", T.partial_date) is None and one(spark, "soon", T.partial_date) is None
    assert one(spark, "https://Host.org/a/b?q=1#x", T.url_key) == "host.org/a/b"


def test_visible_text():
    assert visible_text("<html><head><title>t</title></head><body><p>a b</p><script>x</script><p>a b</p><div>c</div></body>") == "a b\nc"
    assert visible_text(None) == "" and visible_text("<p>open") == "open"


def test_statements_rules():
    found = statements("My name is Ada Byron. I live in Lisbon!\nWould I move? Is this a longer question?")
    assert [(s["relation"], s["object"]) for s in found if s["relation"]] == [("named", "Ada Byron"), ("lives_in", "Lisbon")]
    assert statements(None) == [] and statements("ok") == []


def test_mmr_prefers_new_terms():
    pool = pd.DataFrame({"item_id": [1, 1, 1], "doc_id": [1, 2, 3], "score": [1.0, 0.99, 0.9], "terms": [["a", "b"], ["a", "b"], ["c", "d"]]})
    assert mmr(pool)["doc_id"].tolist() == [1, 3, 2]


def test_transcripts(spark, tmp_path):
    turns = spark.createDataFrame([("s", 0, "user", "hi"), ("s", 1, "user", "there"), ("s", 2, "assistant", "yes")], "session string, n long, role string, text string")
    path = str(tmp_path / "t")
    write_transcripts(turns, path)
    assert sorted(read_transcripts(spark, path, strict=True).collect()) == sorted(turns.collect())
    (tmp_path / "t" / "more.txt").write_text('{"type": "tool", "session": "s", "n": 5}\nno json\n')
    assert read_transcripts(spark, path).count() == 3
    with pytest.raises(Exception, match="unknown record type|FAILFAST|Malformed|parsing"):
        read_transcripts(spark, path, strict=True).collect()
    assert sorted(r.text for r in merged_runs(turns).collect()) == ["hi\nthere", "yes"]


def test_parse_export(spark):
    lines = spark.createDataFrame([("work | 2024-01-02 | chat | builds boats",), ("- likes long walks",), ("```",), ("- likes long walks",), ("",)], "line string")
    got = {r.fact: (r.category, str(r.date)) for r in parse_export(lines).collect()}
    assert got == {"builds boats": ("work", "2024-01-02"), "likes long walks": (None, "None")}


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randint(-50, 200), rng.randint(-50, 200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


class State:
    """A stand-in for the state of one group: a value, a timer and the watermark."""

    def __init__(self):
        self.value, self.timer, self.watermark, self.hasTimedOut = None, None, 0, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def getCurrentWatermarkMs(self):  # noqa: N802
        return self.watermark

    def setTimeoutTimestamp(self, at):  # noqa: N802
        assert at > self.watermark
        self.timer = at


def jobs_by_batches(batches, delay):
    """The jobs given out for batches of times as a stream would: the watermark follows the greatest time seen, and timers fire behind it."""
    state, seen, out = State(), 0.0, []

    def called(rows, timed_out=False):
        state.hasTimedOut, state.timer = timed_out, None
        for frame in debounced((1,), iter([pd.DataFrame({"at": rows})]), state):
            out.extend(frame.itertuples(index=False, name=None))

    for rows in batches:
        late = [t for t in rows if t * 1000 <= state.watermark]
        assert not late, "the test's own rows are within the delay"
        called(rows)
        seen = max([seen, *rows])
        state.watermark = max(0, int((seen - delay) * 1000))
        while state.timer is not None and state.timer < state.watermark:
            called([], True)
    return out


def jobs_in_order(times):
    """All jobs of times by walking along them, with those that nothing has followed yet."""
    jobs = []
    for t in sorted(times):
        if jobs and t < min(jobs[-1][0] + MOST_S, jobs[-1][1] + QUIET_S):
            jobs[-1] = (jobs[-1][0], t, jobs[-1][2] + 1)
        else:
            jobs.append((t, t, 1))
    return [(1, first, min(first + MOST_S, last + QUIET_S), n) for first, last, n in jobs]


@pytest.mark.parametrize("seed", range(6))
def test_debounced_jobs_do_not_depend_on_batches_or_their_order(seed):
    rng, delay = random.Random(seed), 3 * QUIET_S
    times = sorted(rng.uniform(1, 40 * QUIET_S) for _ in range(rng.choice([30, 120, 300])))
    end = max(times) - delay
    want = [j for j in jobs_in_order(times) if j[2] * 1000 < int(end * 1000)]
    assert want
    # rows are late by less than the delay, whatever the batches
    shuffled = sorted(times, key=lambda t: t + rng.uniform(0, delay * 0.99))
    for size in (1, 7, 50, len(times)):
        assert jobs_by_batches([shuffled[i : i + size] for i in range(0, len(times), size)], delay) == want
    assert jobs_by_batches([times], delay) == want


def test_debounced_change_before_an_earlier_one():
    hour = 3600.0
    batches = [[1 * hour, 5 * hour], [2 * hour], [10 * hour], [100 * hour]]
    assert jobs_by_batches(batches, 50 * hour) == [(1, hour, 16 * hour, 4)] == jobs_by_batches([[x for b in batches for x in b]], 50 * hour)


def test_best_sums_equal_all_sums_with_fewer_candidates(spark):
    from recollect.operators.index import best_sums

    rng = random.Random(9)
    weighted = [(d, f"t{t}", round(rng.random() * (0.1 if t < 3 else 3.0), 3)) for d in range(300) for t in range(40) if rng.random() < (0.95 if t < 3 else 0.03)]
    asked = [(i, f"t{t}", 1.0 + t % 2) for i in range(6) for t in {0, 1, 2, *(rng.randrange(40) for _ in range(5))}] + [(99, "t0", 1.0)]
    counts = []
    got = best_sums(spark.createDataFrame(asked, "item_id long, term string, q double"), spark.createDataFrame(weighted, "doc_id long, term string, w double"), 5, 3, lambda n, df: counts.append(df.count()))
    sums = {}
    for i, t, q in asked:
        for d, u, w in weighted:
            if t == u:
                sums[i, d] = sums.get((i, d), 0.0) + q * w
    want = {}
    for i in {i for i, _ in sums}:
        ranked = sorted((-round(s, 6), d) for (j, d), s in sums.items() if j == i)[:5]
        want |= {(i, r + 1): (d, -s) for r, (s, d) in enumerate(ranked)}
    assert {(r.item_id, r.rank): (r.doc_id, r.sum) for r in got.collect()} == want
    assert counts[0] < 0.7 * len(sums)
