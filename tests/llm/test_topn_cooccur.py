import random
from collections import Counter
from itertools import combinations

from viewloom.llm import cooccur, topn


def test_top_n_hot_and_cold(spark, same):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 1, 2, 3]), c, float(r.choice([0, 1, 1, 2, r.random()])), "x") for c in range(900)]
    rows += [(None, 1, 1.0, "x"), (2, None, 1.0, "x"), (2, 5000, None, "x"), (2, 5001, float("nan"), "x")]
    df = spark.createDataFrame(rows, "row long, col long, val double, rank string")
    expected = []
    for g in (1, 2, 3):
        own = sorted([(-v, c) for a, c, v, _ in rows if a == g and c is not None and v is not None and v == v])[:10]
        expected += [(g, c, -v, k + 1) for k, (v, c) in enumerate(own)]
    for limit in (10_000, 50):
        same(topn.top_n(df, "row", "col", "val", 10, heavy_rows=limit), expected)


def test_all_ties_in_a_heavy_group(spark, same):
    df = spark.createDataFrame([(7, c, 1.0) for c in range(500)], "row long, col long, val double")
    same(topn.top_n(df, "row", "col", "val", 3, heavy_rows=10), [(7, 0, 1.0, 1), (7, 1, 1.0, 2), (7, 2, 1.0, 3)])


def test_clean_edges(spark, same):
    rows = [(1, 2, 0.5), (1, 2, 0.7), (1, 1, 9.0), (1, 3, None), (1, 4, float("nan")), (None, 2, 1.0), (2, 1, 0.1)]
    same(topn.clean_edges(spark.createDataFrame(rows, "row long, col long, val double")), [(1, 2, 0.7), (2, 1, 0.1)])


def test_top_n_empty(spark):
    assert topn.top_n(spark.createDataFrame([], "row long, col long, val double"), "row", "col", "val", 3).count() == 0


def brute(rows, least, share, times):
    sets = {}
    for b, i in rows:
        if b is not None and i is not None:
            sets.setdefault(b, set()).add(i)
    n, single, pair = len(sets), Counter(), Counter()
    for s in sets.values():
        single.update(s)
        pair.update(combinations(sorted(s), 2))
    return [(a, b, m) for (a, b), m in pair.items() if m >= least and share * m >= n and m * n >= times * single[a] * single[b]]


def test_pairs_equal_brute_force_also_in_chunks(spark, same):
    r = random.Random(2)
    rows = [(b, i) for b in range(60) for i in r.sample(range(25), r.randint(1, 14))] + [(99, i) for i in range(25)]
    rows += [(b, 30 + b % 3) for b in range(60)] + [(b, 40 + b % 3) for b in range(60)]
    rows += rows[:20] + [(None, 3), (3, None)]
    df = spark.createDataFrame([(b, i, 1) for b, i in rows], "basket long, item long, n int")
    for chunk in (128, 4):
        got = cooccur.far_above_chance(cooccur.associations(df, "basket", "item", 5, 2000, chunk), 2)
        same(got.select("a", "b", "n_ab"), brute(rows, 5, 2000, 2))
    assert brute(rows, 5, 2000, 2)


def test_pairs_empty(spark):
    assert cooccur.associations(spark.createDataFrame([], "b long, i long"), "b", "i").count() == 0
