"""Negatives against all inner products; ranges of the tree, blocks, ties, copies and rows that take no part."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelio.llm import negatives


def by_hand(rows, every=50):
    good = [(i, lab, v) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good = [(i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, lab, v in good]
    size = max((len(q) for _, _, q in good), default=0)
    good = sorted({(i, lab, q + (0,) * (size - len(q))) for i, lab, q in good if sum(x * x for x in q) < 1 << 62})
    out = []
    for i, lab, q in good:
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, r)), j, other == lab) for j, other, r in good if j != i]
        positives = sorted((s, j) for s, j, same in scored if same)[:5]
        for ps, p in positives:
            near = sorted((s, j) for s, j, same in scored if not same and 50 * -ps <= 100 * -s <= 95 * -ps)[:3]
            out += [(i, p, rank, j, -ps, -s) for rank, (s, j) in enumerate(near, 1)]
    return sorted(out)


def clouds(seed, n=1500, size=12, spread=0.5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(9, size))
    x = centers[rng.integers(0, 9, n)] + rng.normal(size=(n, size)) * spread
    return [(i * 5, int(rng.integers(0, 4)), v.astype(np.float32).tolist()) for i, v in enumerate(x)]


SCHEMA = "vec_id long, label int, embedding array<float>"


def found(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("rows, anchors", [(2048, 1024), (16, 3)])
def test_clouds(spark, monkeypatch, rows, anchors):
    monkeypatch.setattr(negatives, "ROWS", rows)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    data = clouds(rows)
    df = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("clash") for c in ("a", "w", "q", "leaf", "score", "rank")})
    got = negatives.mine(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found(got) == by_hand(data)


def test_ties_copies_and_rows_that_take_no_part(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 2), [rnd.choice([0.0, 0.5, 1.0, -0.5]) for _ in range(4)]) for i in range(400)]
    rows += [(1000 + i, i % 3, [1.0, 0.5, 0.5, 1.0]) for i in range(300)] + rows[:20]  # copies of one vector, repeated rows
    rows += [(2000, 1, None), (2050, None, [1.0] * 4), (2100, 1, [1.0, None, 0.0, 1.0]), (2150, 1, [math.nan, 1.0, 1.0, 1.0]), (None, 1, [1.0] * 4)]
    rows += [(2200, 1, [math.inf, 0.0, 0.0, 0.0]), (2250, 2, []), (2300, 1, [1.0, 1.0]), (2350, 0, [0.0] * 4), (2400, 7, [1.0, 1.0, 1.0, 1.0]), (-50, 1, [0.5] * 4)]
    rows += [(2450, 1, [3e38, 0.0, 0.0, 0.0]), (2500, 1, [2e5, 0.0, 0.0, 0.0]), (100, 2, [0.25] * 4)]
    assert found(negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(5))) == by_hand(rows)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, (rng.integers(-(1 << 20), 1 << 20, 6)).astype(float).tolist()) for i in range(300)]
    assert found(negatives.mine(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows)


def test_empty_and_alone(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.mine(spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0])], SCHEMA)).count() == 0
    rows = [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (3, 2, [0.4])]
    assert found(negatives.mine(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows) != []


def test_ranges_leave_subtrees_out_and_lose_nothing():
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(30, 16)) * 300
    q = np.floor(centers[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 16)) * 20).astype(np.int64)
    tree = negatives.Tree(q[:3000], float((q.astype(float) ** 2).sum(1).max()))

    def visit(node, far, near):
        for j in np.unique(near):
            tree.low[node][:, j] = np.minimum(tree.low[node][:, j], far[near == j].min(0))
            tree.high[node][:, j] = np.maximum(tree.high[node][:, j], far[near == j].max(0))

    leaf = tree.place(q, visit)
    scores = q[:50] @ q.T
    top = np.sort(scores, axis=1)[:, -40]
    low, high = top[:, None], np.full((50, 1), negatives.HIGH)
    alive = tree.read(q[:50], low, high)
    for i in range(50):
        assert alive[i, leaf[scores[i] >= top[i]]].all()
    assert alive.mean() < 0.5
    assert not tree.read(q[:5], np.full((5, 1), 1), np.full((5, 1), 0)).any()
