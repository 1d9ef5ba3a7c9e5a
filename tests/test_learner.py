"""The learned reader against explicit dot products, gradients and the fixed weights that it replaces."""

import math

import pytest

from recollect.operators import learner
from recollect.operators.limits import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def learned(spark):
    examples = learner._examples(spark, SF)
    return examples, learner.train(examples.where("part = 'train'"))


def test_weights_equal_gradient_rounds_by_hand(spark):
    data = [([(0, 1.0), (7, 0.5)], 1), ([(0, 1.0), (3, 2.0)], 0), ([(7, -1.0), (0, 1.0)], 0)]
    rows = spark.createDataFrame(data, "x array<struct<f int, v double>>, y int")
    got = learner.train(rows, rounds=4).first().w
    w, g2, total = [0.0] * learner.FEATURES, [1e-6] * learner.FEATURES, [0.0] * learner.FEATURES
    for i in range(4):
        g = [0.0] * learner.FEATURES
        for x, y in data:
            error = y - 1 / (1 + math.exp(-sum(w[f] * v for f, v in x)))
            for f, v in x:
                g[f] += error * v / 3
        g2 = [a + b * b for a, b in zip(g2, g, strict=True)]
        w = [a + learner.RATE * b / math.sqrt(c) for a, b, c in zip(w, g, g2, strict=True)]
        total = [a + b * (i >= 2) for a, b in zip(total, w, strict=True)]
    assert all(abs(a - b / 2) < 1e-9 for a, b in zip(got, total, strict=True)) and got[5] == 0.0


def test_reader_is_no_worse_on_held_out_texts_than_weights_set_by_hand(spark, learned):
    examples, weights = learned
    w = weights.first().w
    rows = learner.scored(examples, weights).collect()
    assert all(abs(r.score - sum(w[f.f] * f.v for f in r.x)) < 1e-9 for r in rows)
    held = {r.doc_id: (r.y, r.score > 0) for r in rows if r.part == "test"}
    fixed = {r.doc_id: r.predicted for r in QUERIES["linear_margin_predict"](spark, SF).collect()}
    learned_right = sum(y == p for y, p in held.values()) / len(held)
    fixed_right = sum(y == fixed.get(d) for d, (y, _) in held.items()) / len(held)
    assert len(held) > 40 and learned_right >= fixed_right and learned_right >= 0.95


def test_margin_lets_few_negatives_through(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1000)], "score double")
    assert learner.margin(rows) == 997.0 and sum(i > 997 for i in range(1000)) == 2
    assert learner.margin(rows.limit(0)) == 0.0
