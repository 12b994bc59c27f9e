import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewell.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, anchor int, row int, tile int, x int, part int, rank int"


def brute(rows, every, scale=negatives.SCALE, positives=5, count=3):
    rows = [(i, [math.floor(scale * v) for v in e], label) for i, e, label in rows]
    late = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for a, (anchor, x, label) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        scores = {b: dot(x, y) for b, (_, y, _) in enumerate(rows) if b != a}
        order = sorted(scores, key=lambda b: (-scores[b], late(b)))
        for p in [b for b in order if rows[b][2] == label][:positives]:
            fits = [b for b in order if rows[b][2] != label and 50 * scores[p] <= 100 * scores[b] <= 95 * scores[p]]
            out += [(anchor, rows[p][0], k + 1, rows[b][0], scores[p], scores[b]) for k, b in enumerate(fits[:count])]
    return sorted(map(str, out))


def mined(df, every):
    found = negatives.mine(df, F.col("vec_id") % every == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(str(tuple(r)) for r in found.collect())


def clustered(rng, n, dims, labels=3):
    centres = rng.normal(size=(8, dims)) / 4
    near = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, dims)) * rng.choice([0.02, 0.1], (n, 1))
    return [(i, v.tolist(), int(rng.integers(0, labels))) for i, v in enumerate(near)]


@pytest.mark.parametrize("tile", [2048, 16])
def test_mined_rows_match_brute_force(spark, monkeypatch, tile):
    for name, value in (("LEAF_ROWS", 20), ("TILE", tile), ("ANCHORS", 7), ("FAN", 4)):
        monkeypatch.setattr(negatives, name, value)
    grown = negatives.Tree.__init__
    monkeypatch.setattr(negatives.Tree, "__init__", lambda self, x, n: grown(self, x, n, 20, 4))
    rng = np.random.default_rng(5)
    rows = clustered(rng, 260, 6)
    rows += [(300 + k, rows[0][1], k % 2) for k in range(90)]  # a third are copies, so that ties go by vec_id
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], SCHEMA).repartition(3)
    want = brute(rows, 10)
    assert mined(df, 10) == want and len(want) > 200


def test_rows_that_take_no_part_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0], 1), (2, [0.9, 0.1], 1), (3, [0.6, 0.0], 2), (5, [0.6, 0.3], 3), (10, [-1.0, 0.0], 2), (None, [0.7, 0.0], 4)]
    odd = [(20, [1.0, 0.0], None), (30, None, 1), (40, [], 1), (50, [1.0, None], 1), (60, [nan, 0.0], 2), (70, [inf, 0.0], 2), (80, [1e300, 0.0], 2)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in good + odd], SCHEMA)
    assert mined(df, 10) == brute(good, 10) and brute(good, 10)
    assert mined(df.limit(0), 10) == [] and mined(df.filter("vec_id = 3"), 10) == []
    twice = good + good  # repeated rows count each, also as anchors
    assert len(mined(df.filter("label is not null and vec_id < 15").unionByName(df.filter("vec_id < 15")), 10)) == len(brute([r for r in twice if r[0] is not None], 10))


def test_the_tree_rules_out_leaves_but_none_that_holds_a_row_of_the_window():
    rng = np.random.default_rng(8)
    x = np.floor(256 * np.array([e for _, e, _ in clustered(rng, 3000, 4)])).astype(np.int64)
    tree = negatives.Tree(x[:400].astype(np.float64), len(x), 40, 8)
    leaf = tree.leaf_of(x.astype(np.float64))
    assert tree.leaves > 20
    for node, _, d, child in tree.walk(x.astype(np.float64)):
        size = (len(node.points),) * 2
        node.near, node.far = np.full(size, np.inf), np.full(size, -1.0)
        for j in np.unique(child):
            node.near[:, j], node.far[:, j] = d[child == j].min(axis=0), d[child == j].max(axis=0)
    squares = (x * x).sum(axis=1).astype(float)
    tree.norms = np.array([[squares[leaf == k].min(initial=np.inf), squares[leaf == k].max(initial=-1)] for k in range(tree.leaves)])
    anchors = x[:50]
    scores = anchors @ x.T
    top = np.sort(scores, axis=1)[:, -6:]
    alive = tree.survivors(anchors.astype(np.float64), top[:, :1].astype(float), top[:, -1:].astype(float))
    inside = (scores >= top[:, :1]) & (scores <= top[:, -1:])
    for i in range(50):
        assert alive[i, leaf[inside[i]]].all()
    assert alive.mean() < 0.6


def test_products_that_doubles_do_not_hold():
    a = np.array([[(1 << 28) + 1, 3]], dtype=np.int64)
    assert negatives.products(a, a).tolist() == [[((1 << 28) + 1) ** 2 + 9]]
