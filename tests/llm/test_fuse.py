import random

import numpy as np

from viewloom.llm.fuse import fuse_rankings, rank_walk


def brute(scores, damping, steps):
    n = len(scores)
    views = [v for v in range(scores.shape[1]) if not np.isnan(scores[:, v]).all()]
    p = np.full(n, 1 / n)
    for _ in range(steps):
        q = np.zeros(n)
        for i in range(n):
            for v in views:
                s = scores[:, v]
                up = np.flatnonzero(~np.isnan(s)) if np.isnan(s[i]) else np.flatnonzero(s > s[i])
                up = up if len(up) else np.arange(n)
                q[up] += p[i] / len(up) / len(views)
        p = (1 - damping) / n + damping * q
    return p


def test_walk_equals_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 30):
        s = rng.integers(0, 6, (n, 2)).astype(float)
        s[rng.random((n, 2)) < 0.25] = np.nan
        if np.isnan(s).all():
            s[0, 0] = 1
        assert np.allclose(rank_walk(s, 0.3, 10), brute(s, 0.3, 10))


def test_units_do_not_matter():
    s = np.array([[5.0, 0.2], [4.0, 0.9], [1.0, 0.1], [np.nan, 0.5]])
    assert np.allclose(rank_walk(s), rank_walk(s * [1000, 0.01] + [7, -3]))
    assert rank_walk(s).argmax() == 1


def edges(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([1, 2, 3]), r.randint(1, 40), r.choice([None, float("nan"), 1.0, 2.0, r.random() * 9])) for _ in range(160)]
    rows += [(None, 4, 1.0), (1, None, 1.0), (1, 1, 99.0)]
    return spark.createDataFrame(rows, "row long, col long, val double")


def test_large_groups_give_the_same_result(spark):
    """To the 12 digits the rank uses, with a third of a group's items on one score."""
    r = random.Random(6)
    views = [edges(spark, 1).unionByName(spark.createDataFrame([(1, 100 + k, 4.0 if k % 3 else r.random()) for k in range(150)], "row long, col long, val double")), edges(spark, 2)]
    want = spark.createDataFrame([(1,), (2,), (2,), (None,), (99,)], "row long")
    small = {(r.row, r.col): (r.p, r["rank"]) for r in fuse_rankings(views, want, steps=6).collect()}
    large = {(r.row, r.col): (r.p, r["rank"]) for r in fuse_rankings(views, want, group_items=5, steps=6).collect()}
    assert small.keys() == large.keys() and {k[0] for k in small} == {1, 2}
    assert all(abs(small[k][0] - large[k][0]) < 5e-14 for k in small)
    assert {k: v[1] for k, v in small.items()} == {k: v[1] for k, v in large.items()}


def test_empty(spark):
    none = spark.createDataFrame([], "row long, col long, val double")
    assert fuse_rankings([none, none], none.select("row")).count() == 0
