import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewloom.functions import rng, text, vector
from viewloom.operators import clean, evaluate, fusion, graph, integrity, profile, similar, tagstats, walks, weights

E5 = list(zip([0, 0, 1, 1, 2, 3, 3, 4], [1, 2, 0, 3, 4, 0, 4, 2], [0.5, 0.3, 0.4, 0.6, 0.8, 0.2, 0.7, 0.9]))


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(E5, "row long, col long, val double")


def rows(df):
    return {(r.row, r.col): r.val for r in df.collect()}


def test_text_functions(spark):
    t = "[Label](http://x.y) <b>Big</b>\n  www.a.b ÉTÉ & co! https://q.r/s?t"
    df = spark.createDataFrame([(t, "['A b', \"c\"]", "A  b,c, ,C"), (None, None, None)], "t string, l string, s string")
    r = df.select(
        text.clean_text(F.col("t")).alias("a"), text.clean_text_strict(F.col("t")).alias("b"), text.parse_tags(F.col("l")).alias("c"), text.split_tags(F.col("s")).alias("d"),
        text.ensure_list(F.col("l")).alias("e"), text.ensure_list(F.col("s")).alias("f"), text.tag_overlaps(F.col("s"), ["c"]).alias("g"), text.joined_text("t", "l").alias("h"), text.tokens(F.col("t")).alias("i"),
    ).collect()
    assert r[0].a == "[label]( big www.a.b été & co!"
    assert r[0].c == ["A b", "c"] and r[0].d == ["a b", "c"] and r[0].e == ["A b", "c"] and r[0].f == ["A  b", "c", "C"] and r[0].g is True
    assert "big" in r[0].i and "the" not in r[0].i
    assert tuple(r[1]) == ("", "", [], [], [], [], False, " ", [])


def test_uniform_is_reproducible(spark):
    df = spark.range(2000).select(rng.uniform(5, "id").alias("u"))
    u = [r.u for r in df.collect()]
    assert u == [r.u for r in df.repartition(3).sortWithinPartitions("u").orderBy("u").collect()] or sorted(u) == sorted(r.u for r in df.collect())
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.03


def test_pick_by_weight(spark):
    df = spark.createDataFrame([([7, 8, 9], [0.0, 1.0, 3.0], u) for u in (0.0, 0.2, 0.3, 0.99)] + [([7], [0.0], 0.5), ([], [], 0.5)], "i array<long>, w array<double>, u double")
    assert [r.x for r in df.select(rng.pick_by_weight(F.col("i"), F.col("w"), F.col("u")).alias("x")).collect()] == [8, 8, 9, 9, None, None]


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(vector.unit(F.col("v")).alias("u"), vector.norm(F.col("v")).alias("n"), vector.dot(F.col("v"), F.col("v")).alias("d")).collect()
    assert r[0].u == [0.6, 0.8] and r[0].n == 5 and r[0].d == 25 and r[1].u == [0.0, 0.0]


def test_dense_index_and_running_total(spark):
    ids = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)
    assert {r.id: r.doc_idx for r in clean.dense_index(df, [F.asc("id")]).collect()} == {i: k for k, i in enumerate(sorted(ids))}
    got = {r.id: r.t for r in clean.running_total(df, [F.desc("id")], F.col("id"), "t").collect()}
    assert got[max(ids)] == max(ids) and got[min(ids)] == sum(ids)
    assert clean.dense_index(df.limit(0), [F.asc("id")]).count() == 0


def test_keep_first_and_last(spark, same):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "c")], "k long, at long, v string")
    same(clean.keep_first(df, "k", "at").select("v"), [("a",), ("c",)])
    same(clean.keep_last(df, "k", "at").select("v"), [("b",), ("c",)])


def test_pick_preset():
    p = {10: "s", 100: "l"}
    assert [clean.pick_preset(p, t) for t in (5, 10, 11, 500)] == ["s", "s", "l", "l"]


def test_match_slugs(spark, same):
    s = spark.createDataFrame([(1, "a-b", "My Data"), (2, "x", "Other"), (3, "y", "Zed"), (4, "z", None)], "id long, slug string, title string")
    o = spark.createDataFrame([(1, 0, "u/q", "my data"), (1, 1, "u/A-B", "?"), (2, 0, "u/q", "the other one"), (3, 0, "u/q", "nope")], "id long, pos int, ref string, title string")
    same(clean.match_slugs(s, o), [(1, "u/A-B", "exact"), (2, "u/q", "fuzzy"), (3, None, "none"), (4, None, "none")])


def test_symmetrise(edges):
    s = rows(graph.symmetrise(edges, norm=False))
    assert s[0, 1] == s[1, 0] == 0.5 and s[0, 3] == s[3, 0] == 0.2 and all(a != b for a, b in s)
    total = {}
    for (a, _), v in rows(graph.symmetrise(edges)).items():
        total[a] = total.get(a, 0) + v
    assert all(math.isclose(t, 1) for t in total.values())
    avg = rows(graph.symmetrise(edges, "avg", norm=False))
    assert math.isclose(avg[0, 1], 0.45) and avg[0, 3] == 0.1
    top = rows(graph.symmetrise(edges, "sum", k=1))
    assert all(math.isclose(v, 1) for v in top.values()) and len(top) == 5


def test_negative_single_direction_counts_as_zero(spark):
    e = spark.createDataFrame([(1, 2, -0.5), (3, 4, -0.5), (4, 3, -0.2)], "row long, col long, val double")
    assert rows(graph.symmetrise(e, norm=False)) == {(3, 4): -0.2, (4, 3): -0.2}


def test_graph_tools(edges, spark, same):
    assert rows(graph.transpose(edges))[1, 0] == 0.5
    assert {r.row: round(r.rho, 6) for r in graph.concentration(edges).collect()}[0] == 0.34
    same(graph.degree_distribution(edges), [(1, 2), (2, 3)])
    dup = spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.25), (1, 3, None), (None, 1, 1.0), (1, 4, float("nan"))], "row long, col long, val double")
    assert rows(graph.sum_duplicates(dup)) == {(1, 2): 0.75} and rows(graph.max_duplicates(dup)) == {(1, 2): 0.5}
    ties = spark.createDataFrame([(1, c, 1.0) for c in (5, 3, 9)], "row long, col long, val double")
    assert [(r.col, r["rank"]) for r in graph.top_edges(ties, 2).orderBy("rank").collect()] == [(3, 1), (5, 2)]
    assert graph.top_edges(ties.limit(0), 2).count() == 0
    same(graph.histogram(spark.createDataFrame([(0.0,), (1.0,), (2.0,), (4.0,), (None,)], "x double"), "x", 4), [(0, 1), (1, 1), (2, 1), (3, 1)])


def test_fusion(spark):
    a = spark.createDataFrame([(1, 2, 0.6), (1, 3, 0.4)], "row long, col long, val double")
    b = spark.createDataFrame([(1, 3, 1.0), (2, 1, 1.0)], "row long, col long, val double")
    f = rows(fusion.fuse_fixed({"a": a, "b": b}, {"a": 0.5, "b": 0.5}, 5))
    assert math.isclose(f[1, 3], 0.7) and math.isclose(f[1, 2], 0.3) and f[2, 1] == 1
    alpha = {(r.view, r.row): r.alpha for r in fusion.adaptive_alpha(fusion.views_table({"a": a, "b": b})).collect()}
    assert math.isclose(alpha["a", 1], 0.52 / 1.52) and alpha["b", 2] == 1
    c = fusion.consistency(a, b).where("row = 1").first()
    assert (c.jaccard, c.n_meta, c.n_cont, c.n_intersect) == (0.5, 2, 1, 1) and math.isclose(c.weighted_consistency, 0.4)
    damped = fusion.consistency_alpha(fusion.adaptive_alpha(fusion.views_table({"a": a, "b": b})), spark.createDataFrame([(1, 0.4)], "row long, c double"), "b")
    d = {(r.view, r.row): r.alpha for r in damped.collect()}
    assert math.isclose(d["a", 1] + d["b", 1], 1) and d["b", 1] < alpha["b", 1] and d["b", 2] == 1
    rrf = rows(fusion.reciprocal_ranks({"a": a, "b": b}, 5))
    assert rrf[1, 3] > rrf[1, 2]
    sel = rows(fusion.selective(a, b, 0.5, spark.createDataFrame([(1,)], "row long"), 5))
    assert sel == {(1, 2): 0.3, (1, 3): 0.7}
    empty = a.limit(0)
    assert fusion.fuse_adaptive({"a": empty, "b": empty}, 5).count() == 0


def metrics(spark, gains, rel=None, **kw):
    rel = rel if rel is not None else [int(g > 0) for g in gains]
    df = spark.createDataFrame([("m", 1, k + 1, float(g), r, kw.get("n", 1)) for k, (g, r) in enumerate(zip(gains, rel))], "method string, row long, rank int, gain double, rel int, total long")
    return evaluate.query_metrics(df, ["method", "row"], "total" if "n" in kw else None, kw.get("ideal", "retrieved"), 5).first()


def test_metrics_in_closed_form(spark):
    assert math.isclose(metrics(spark, [3, 2, 1, 0]).ndcg, 1, abs_tol=1e-9)
    assert metrics(spark, [0, 0]).ndcg == 0
    m = metrics(spark, [1, 0, 1, 0, 1])
    assert math.isclose(m.ap, (1 + 2 / 3 + 3 / 5) / 3) and m.mrr == 1 and math.isclose(m.precision, 0.6) and m.hit == 1
    assert math.isclose(metrics(spark, [0, 0, 1]).mrr, 1 / 3) and metrics(spark, [0, 0]).mrr == 0 and metrics(spark, [0]).hit == 0
    m = metrics(spark, [1, 0, 1, 0, 0], n=5)
    assert math.isclose(m.precision, 0.4) and math.isclose(m.recall, 0.4)
    assert metrics(spark, [1], n=0).recall == 0
    m = metrics(spark, [0, 1], n=1, ideal="total")
    assert math.isclose(m.ndcg, 1 / math.log2(3), rel_tol=1e-9)


def test_evaluate_empty_and_improvement(spark, same):
    s = spark.createDataFrame([("base", 0.5), ("new", 0.6)], "method string, x double")
    got = {r.method: r.improvement for r in evaluate.improvement(s, "base", "x").collect()}
    assert got["base"] == 0 and math.isclose(got["new"], 20)
    zero = spark.createDataFrame([("base", 0.0), ("new", 0.6)], "method string, x double")
    assert {r.improvement for r in evaluate.improvement(zero, "base", "x").collect()} == {None}
    top = spark.createDataFrame([], "method string, row long, col long, val double, rank int")
    assert evaluate.query_metrics(evaluate.owner_gains(top, spark.createDataFrame([], "doc long, owner long")), ["method", "row"], "total").count() == 0


def test_weights(spark):
    e = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "c")], "row long, col string")
    p = {(r.row, r.col): r.val for r in weights.ppmi(e, l2=False).collect()}
    assert math.isclose(p[1, "b"], math.log(5 / 2)) and p[2, "a"] == max(0, math.log(5 / 3)) and p[1, "a"] == 0.0
    t = weights.tf_idf(e, 3).groupBy("row").agg(F.sum(F.col("val") * F.col("val")).alias("s")).collect()
    assert all(math.isclose(r.s, 1) for r in t)
    v = {r.term: r.idx for r in weights.vocabulary(e.withColumnRenamed("col", "term"), "term").collect()}
    assert v == {"a": 0, "b": 1, "c": 2}
    assert weights.ppmi(e.limit(0)).count() == 0


def test_nearest_equals_numpy(spark):
    g = np.random.default_rng(0)
    x = g.normal(size=(70, 8))
    x[3] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = np.round(u @ u.T, 9) + 0.0
    np.fill_diagonal(s, -9)
    expected = {(i, int(j)) for i in range(70) for j in sorted(range(70), key=lambda j: (-s[i, j], j))[:5]}
    for block in (4096, 16):
        assert {(r.row, r.col) for r in similar.nearest(df, 5, block=block).collect()} == expected
    near = {(r.row, r.col) for r in similar.nearest_in_cells(df, 5, similar.Cells(similar.fit_cells(df, 5, cells=6).centres, 6), part=20).collect()}
    assert len(near & expected) / len(expected) > 0.99
    assert similar.nearest(df.limit(0), 5).count() == 0


def test_anchored_cosine(spark):
    e = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, "b", 1.0), (2, "b", 1.0)], "row long, col string, val double")
    r = rows(similar.anchored_cosine(e, 5))
    assert math.isclose(r[1, 2], 1 / math.sqrt(2), abs_tol=1e-8) and (1, 3) not in r
    assert math.isclose(rows(similar.anchored_cosine(e, 5, mode="binary"))[1, 2], 1 / math.sqrt(2), abs_tol=1e-8)
    assert similar.anchored_cosine(e, 5, df_cap=1).count() == 0


def test_quantiles_equal_numpy(spark):
    r = random.Random(2)
    rows = [(r.choice("abc"), r.choice([r.random(), 0.5, 3.0])) for _ in range(200)] + [("a", None), ("b", float("nan")), ("d", None), ("e", 7.0)]
    got = {x.g: (x.lo, x.mid, x.hi) for x in clean.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.9}).collect()}
    for g in "abce":
        v = [x for k, x in rows if k == g and x is not None and x == x]
        assert np.allclose(got[g], np.quantile(v, [0.1, 0.5, 0.9]))
    assert got.keys() == set("abce")
    assert clean.quantiles(spark.range(5), [], "id", {"m": 0.5}).first().m == 2.0


def test_few_probes_where_vectors_form_groups(spark):
    g = np.random.default_rng(1)
    centres = g.normal(size=(30, 16))
    v = [(i, (centres[i % 30] + g.normal(size=16) * 0.1).tolist()) for i in range(900)]
    df = spark.createDataFrame(v, "id long, v array<double>")
    cells = similar.fit_cells(df, 10)
    assert len(cells.centres) == 30 and cells.probes <= 7
    pairs = lambda e: {(x.row, x.col) for x in e.collect()}
    q = df.where("id % 20 = 0")
    exact = pairs(similar.nearest(df, 10, q))
    assert len(exact & pairs(similar.nearest_in_cells(df, 10, cells, q))) >= 0.95 * len(exact)
    assert similar.nearest_in_cells(df.limit(0), 3).count() == 0


def test_same_creator(spark, same):
    o = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, None)], "id long, owner long")
    same(similar.same_creator(o), [(1, 2, 1.0), (2, 1, 1.0)])
    same(similar.same_creator(o, o.where("id = 2")), [(2, 1, 1.0)])
    same(similar.owner_classes(o), [(1, 1, 1), (2, 1, 1)])


def test_walks(spark):
    r = random.Random(3)
    e = {(d, x): 1.0 + r.random() for d in range(30) for x in r.sample(range(100, 110), 3)}
    df = spark.createDataFrame([(d, x, v) for (d, x), v in e.items()] + [(50, 200, 1.0)], "row long, col long, val double")
    got = walks.random_walks(df, walks.WalkParams(walks=2, length=6)).collect()
    docs = {}
    for d, x in e:
        docs.setdefault(d, set()).add(x)
    assert len(got) == 60 + 2  # document 50 only meets itself
    for w in got:
        assert w.path[0] == w.start and 2 <= len(w.path) <= 6
        assert w.start == 50 or all(docs[a] & docs[b] for a, b in zip(w.path, w.path[1:]))
        assert w.start == 50 or all(a != c for a, c in zip(w.path, w.path[2:]))
    again = walks.random_walks(df.repartition(3), walks.WalkParams(walks=2, length=6)).collect()
    assert {(w.start, w.walk): w.path for w in got} == {(w.start, w.walk): w.path for w in again}
    assert walks.random_walks(df.limit(0), walks.WalkParams(length=3)).count() == 0


@pytest.mark.parametrize("kind", [{"x_no_repeat": 2, "restart": 0.2}, {"x_no_repeat": 0, "avoid_backtrack": False}])
def test_walks_are_the_same_in_memory_and_distributed(spark, monkeypatch, kind):
    monkeypatch.setattr(walks, "LIST", 40)
    r = random.Random(4)
    rows = sorted({(i, r.randrange(9) if r.random() < 0.6 else 0): round(r.random(), 6) for i in range(150) for _ in range(4)}.items())
    df = spark.createDataFrame([(a, b, w) for (a, b), w in rows] + [(700, 99, 1.0), (701, 98, 0.5), (702, 98, 0.5), (703, 97, 0.0)], "row long, col long, val double")
    p = walks.WalkParams(walks=2, length=4, **kind)
    got = [sorted((w.start, w.walk, *w.path) for w in walks.random_walks(df, p, graph_edges=n).collect()) for n in (10_000, 0)]
    assert got[0] == got[1] and len(got[0]) > 280


def test_numpy_draws_equal_the_column(spark):
    got = spark.range(50).select("id", rng.uniform_long(5, "id", F.lit(3)).alias("u")).collect()
    assert [x.u for x in got] == rng.uniform_long_np(5, np.array([x.id for x in got]), 3).tolist()


def test_picks_of_long_lists(monkeypatch):
    monkeypatch.setattr(walks, "WEIGHTS", 500)
    g = np.random.default_rng(2)
    size = g.integers(0, 300, 80)
    w, u = np.where(g.random((80, 300)) < 0.2, 0.0, g.random((80, 300))), g.random(80)
    run = [np.cumsum(x[:n]) for x, n in zip(w, size, strict=True)]
    expected = [int(np.searchsorted(r, t * r[-1])) if len(r) and r[-1] > 0 else -1 for r, t in zip(run, u, strict=True)]
    assert walks._pick_ragged(lambda r, j: w[r[:, None], j], size, u).tolist() == expected
    first = np.append(0, np.cumsum(size))
    flat = walks._running(np.concatenate([x[:n] for x, n in zip(w, size, strict=True)]), first)
    assert flat.tolist() == np.concatenate(run).tolist()
    at = np.flatnonzero(size > 0)
    got = walks._first_reaching(flat, first[at], first[at + 1], u[at] * flat[first[at + 1] - 1]) - first[at]
    assert got.tolist() == [expected[k] for k in at]
    assert (rng.xxhash64_np(7, seed=rng.xxhash64_np(3, size)) == rng.xxhash64_np(3, size, 7)).all()


def test_walk_draws_follow_the_weights(spark, monkeypatch):
    monkeypatch.setattr(walks, "LIST", 4)
    df = spark.createDataFrame([(d, 1000, float(1 + d % 3)) for d in range(20)], "row long, col long, val double")
    p = walks.WalkParams(walks=400, length=2, x_degree_pow=0.0)
    got = walks.random_walks(df, p, spark.createDataFrame([(0,)], "row long")).collect()
    share = sum(w.path[1] % 3 == 2 for w in got) / len(got)
    assert abs(share - 18 / 39) < 0.09


def test_skip_gram_pairs(spark):
    w = spark.createDataFrame([(s, 0, list(range(s * 10, s * 10 + 6))) for s in range(5)], "start long, walk int, path array<long>")
    p = walks.skip_gram_pairs(w, 2).collect()
    assert p and all(1 <= abs(r.center - r.context) <= 2 for r in p)
    assert all(r.context > r.center for r in walks.skip_gram_pairs(w, 2, forward_only=True).collect())
    capped = walks.skip_gram_pairs(w, 5, cap=1).groupBy("start", "walk", "at").count()
    assert capped.where("count > 1").count() == 0
    assert walks.skip_gram_pairs(w, 5, keep=0.3).count() < walks.skip_gram_pairs(w, 5).count()
    assert walks.batch_numbers(walks.skip_gram_pairs(w, 2), [F.asc("start"), F.asc("at"), F.asc("j")], 7).groupBy("batch").count().where("count > 7").count() == 0


def test_noise(spark):
    d = spark.createDataFrame([(0, 10), (1, 50), (2, 200), (3, 0)], "id long, deg long")
    n = {r.id: r.p for r in walks.noise_distribution(d).collect()}
    assert math.isclose(sum(n.values()), 1) and n[2] > n[1] > n[0] > n[3] > 0
    q, a = walks.alias_table([0.1, 0.2, 0.7])
    mass = q.copy()
    for i in range(3):
        mass[a[i]] += (1 - q[i]) if a[i] != i else 0
    assert np.allclose(mass / 3, [0.1, 0.2, 0.7])
    pairs = spark.range(4000).select(F.col("id").alias("start"), F.lit(0).alias("walk"), F.lit(0).alias("at"), F.lit(0).alias("j"))
    c = {r.negative: r["count"] / 8000 for r in walks.negatives(pairs, walks.noise_distribution(d), 2, cells=8).groupBy("negative").count().collect()}
    assert all(abs(c.get(i, 0) - p) < 0.03 for i, p in n.items())


@pytest.mark.parametrize("cell_ids", [4, 4096])
def test_alias_draws_follow_the_distribution(spark, cell_ids):
    p = {i: (i % 5 + 1) / 60 for i in range(20)}
    noise = spark.createDataFrame([*p.items(), (99, 0.0)], "id long, p double")
    got = {r.id: r.p for r in walks.alias_mass(*walks.alias_tables(noise, cell_ids)).collect()}
    assert got.keys() == p.keys() and all(math.isclose(got[i], p[i], abs_tol=1e-12) for i in p)
    pairs = spark.range(8000).selectExpr("id as start", "0 as walk", "0 as at", "0 as j")
    n = {r.negative: r["count"] / 24_000 for r in walks.alias_negatives(pairs, noise, 3, cell_ids=cell_ids).groupBy("negative").count().collect()}
    assert n.keys() == p.keys() and all(abs(n[i] - p[i]) < 0.01 for i in p)
    assert walks.alias_negatives(pairs, noise.limit(0), 3).count() == 0


def test_sgns(spark):
    """Two groups of ids that only occur with their own, trained in two shards."""
    pairs = spark.createDataFrame([(a, b) for a in range(12) for b in range(12) if a // 6 == b // 6 and a != b] * 20, "center long, context long")
    v = walks.train_sgns(pairs, spark.createDataFrame([(i, 5) for i in range(12)], "id long, deg long"), dim=8, epochs=6, shard_pairs=700, lr=0.1).collect()
    x = np.array([r.v for r in sorted(v, key=lambda r: r.id)])
    assert np.allclose(np.linalg.norm(x, axis=1), 1)
    near = x @ x.T
    assert near[:6, :6].mean() > near[:6, 6:].mean() + 0.2
    loss = walks.sgns_loss(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "id long, v array<double>"), spark.createDataFrame([(0, 1, [1])], "center long, context long, negs array<long>")).first()
    assert math.isclose(loss.loss, math.log1p(math.exp(-2)) + math.log1p(math.exp(2)))


def test_profile(spark):
    n = 40
    df = spark.createDataFrame(
        [(i, float(i), ["red", "blue", "green"][i % 3], f"2024-01-{i % 28 + 1:02d}", "a long free text of more than thirty characters " + str(i), None, "c", [1]) for i in range(n)],
        "row_id long, num double, cat string, day string, free string, nothing string, const string, list array<int>",
    )
    p = {r.col_name: r for r in profile.profile(profile.long_columns(df)).collect()}
    assert {c: r.dtype for c, r in p.items()} == {"row_id": "numeric", "num": "numeric", "cat": "categorical", "day": "datetime", "free": "text", "nothing": "categorical", "const": "categorical"}
    assert p["num"].num_min == 0 and p["num"].num_max == 39 and p["num"].num_median == 19.5 and p["nothing"].missing_pct == 100 and p["nothing"].n_unique == 0
    assert p["day"].span_days == 27
    rough = {r.col_name: r for r in profile.profile(profile.long_columns(df), exact=False).collect()}
    assert abs(rough["num"].num_median - 19.5) <= 1 and abs(rough["num"].n_unique - 40) <= 1
    assert profile.sample_table(df, 1000, 60).columns == ["num", "cat", "day", "free"]
    text_ = {r.col_name: r.description for r in profile.describe(profile.profile(profile.long_columns(df)), profile.top_values(profile.long_columns(df))).collect()}
    assert text_["cat"].startswith('Column "cat": categorical with 3 unique values') and "datetime from 2024-01-01 to 2024-01-28" in text_["day"]


def test_tag_statistics(spark, same):
    lists = spark.createDataFrame([(1, ["b", "a", "a"]), (2, ["a"]), (3, [])], "doc long, tags array<string>")
    same(tagstats.cooccurrence(lists), [("a", "a", 1), ("a", "b", 2)])
    c = spark.createDataFrame([("a", 6), ("b", 3), ("c", 1)], "tag string, n long")
    same(tagstats.cumulative_coverage(c), [("a", 6, 1, 0.6), ("b", 3, 2, 0.9), ("c", 1, 3, 1.0)])
    same(tagstats.coverage_reached(tagstats.cumulative_coverage(c), [0.8]), [(0.8, 2)])
    same(tagstats.by_category(c, {"x": ["a", "c"], "y": ["z"]}), [("x", 7), ("y", 0)])


def test_integrity(spark, same):
    chosen = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (3, 9)], "Id long, doc_idx long")
    tables = spark.createDataFrame([(1, 0, "p"), (4, 3, " ")], "Id long, doc_idx long, path string")
    index = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "Id long, doc_idx long")
    same(integrity.check_selection(chosen, tables, index, 4), [("count", 0), ("without_table", 2), ("without_id", 1), ("repeated", 1), ("empty_path", 1), ("other_index", 1)])
    cand = spark.createDataFrame([(7, 2, 5), (8, 1, 1), (9, 2, 9), (1, 1, 9)], "Id long, tier int, score int")
    usable = spark.createDataFrame([(i,) for i in (1, 2, 7, 8, 9)], "Id long")
    same(integrity.refill(chosen.select("Id"), usable, cand, 4), [(1, "kept"), (2, "kept"), (8, "tier1"), (9, "tier2")])
