"""Hard negatives: the same rows as sorting all scores, on ties, odd rows, small blocks and small digits."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.llm import hard_negatives
from waymark.llm.hard_negatives import mine_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, place string, window int, score double"


def plain(rows, scale=256, positives=5, negatives=3):
    taken = [r for r in rows if r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    taken = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in taken]
    taken.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (anchor, v, label) in enumerate(taken):
        if anchor is None or anchor % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, r[1])), r[0] is not None, r[0] or 0, n) for n, r in enumerate(taken) if n != k)
        best = [(taken[n][0], -s) for s, _, _, n in scored if taken[n][2] == label][:positives]
        for positive, p in best:
            hard = [(taken[n][0], -s) for s, _, _, n in scored if taken[n][2] != label and 50 * p <= -100 * s <= 95 * p][:negatives]
            out += [(anchor, positive, rank, i, p, s) for rank, (i, s) in enumerate(hard, 1)]
    return out


def same(spark, rows, **more):
    found = mine_negatives(spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA).repartition(3), F.col("vec_id") % 50 == 0, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    have, want = sorted(map(repr, map(tuple, found.collect()))), sorted(map(repr, plain(rows, more.get("scale", 256))))
    assert have == want
    return want


def some(rng, n, width, spread):
    return [(i, [rng.randrange(-spread, spread + 3) / 64 for _ in range(width)], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("width,spread", [(8, 40), (3, 2), (1, 1)])
def test_same_as_sorting(spark, monkeypatch, width, spread):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)  # several blocks
    monkeypatch.setattr(hard_negatives, "PART", 100)
    assert same(spark, some(random.Random(width), 420, width, spread))


def test_ties_are_told_apart_by_digits(spark):
    rng = random.Random(1)
    rows = [(i, [1.0, 0.5], 1) if i < 300 else (i, [0.9, 0.2], 2 if i % 3 else 1) for i in rng.sample(range(700), 600)]
    assert same(spark, rows + [(1000, [1.0, 0.5], 1), (50, [1.0, 0.5], 1)])


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = some(rng, 200, 4, 30)
    odd = [(None, [1.0] * 4, 1), (None, [1.0] * 4, 2), (50, None, 1), (100, [1.0, None, 0.0, 0.0], 1), (150, [float("nan")] * 4, 1), (100, [float("inf")] * 4, 0), (250, [0.5] * 4, None)]
    odd += [rows[50], rows[50], (300, [], 1), (350, [0.25], 2), (400, [0.0] * 4, 3), (401, [0.0] * 4, 3), (402, [0.0] * 4, 2), (450, [-0.3] * 4, 9), (451, [0.3] * 4, 9)]
    assert same(spark, rows + odd)
    assert same(spark, [(i, [x * 300 for x in v], label) for i, v, label in rows], scale=100_000)  # scores above 2**24
    assert same(spark, [(i, [x * 300 for x in v], label) for i, v, label in rows], scale=300_000)  # and 2**53


def test_no_rows(spark):
    assert same(spark, []) == []
    assert same(spark, [(0, [1.0], 1)]) == []
    assert same(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    with pytest.raises(ValueError):
        same(spark, [(0, [1e30], 1), (1, [1e30], 1)])


def test_labels_of_any_type(spark):
    rows = [(0, [1.0], "a"), (1, [0.9], "a"), (2, [0.8], "b"), (3, [0.1], None)]
    found = mine_negatives(spark.createDataFrame(rows, "vec_id int, embedding array<double>, label string"), F.col("vec_id") == 0)
    assert [tuple(r) for r in found.collect()] == [(0, 1, 1, 2, 58880, 52224)]
