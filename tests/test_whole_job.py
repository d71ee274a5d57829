"""Queries on small fixtures that a cut would show in."""

import random

from pyspark.sql import functions as F

from viewloom.operators import fusion, graph, similar, tagstats
from viewloom.operators import walks as wk
from viewloom.plans import q_walks
from viewloom.plans.registry import QUERIES


def related(tags):
    holders = {}
    for r, t in tags:
        holders.setdefault(t, set()).add(r)
    n = {r: len(set().union(*(holders[t] for q, t in tags if q == r)) - {r}) for r, _ in tags}
    return [(r, k) for r, k in n.items() if k]


def test_tag_total_related_counts_frequent_tags(spark, same, tmp_path):
    rows = [(i, ["hot"] + (["rare"] if i < 3 else [])) for i in range(250)] + [(900, ["rare"]), (901, ["alone"]), (902, None)]
    spark.createDataFrame(rows, "doc_idx long, tags array<string>").write.parquet(str(tmp_path / "relevance_tag_docs.parquet"))
    same(QUERIES["tag_total_related"](spark, str(tmp_path)), [(i, 250 if i < 3 else 249) for i in range(250)] + [(900, 3)])


def test_related_counts_equal_brute_force(spark, same):
    r = random.Random(5)
    tags = sorted({(i, f"t{min(r.randrange(60), r.randrange(60), r.randrange(60))}") for i in range(300) for _ in range(r.randint(1, 4))})
    df = spark.createDataFrame(tags, "row long, tag string")
    same(tagstats.related_counts(df), related(tags))
    same(tagstats.related_counts(df, block=70, chunk=50), related(tags))
    assert tagstats.related_counts(df.limit(0)).count() == 0


def test_an_owner_of_many_records_keeps_its_edges(spark):
    o = spark.range(6_800).selectExpr("id", "7L as owner")
    assert similar.same_creator(o).where("row = 5").count() == 6_799


def test_fusion_keeps_an_owner_of_many_records(spark, tmp_path):
    spark.range(6_800).selectExpr("id as doc_idx", "7L as CreatorUserId").write.parquet(str(tmp_path / "beh_base.parquet"))
    for name in ("s_fused3_symrow", "s_tabcontent_symrow"):
        spark.createDataFrame([(0, 1, 0.5), (9, 8_000, 0.5)], "row long, col long, val double").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r.row: (r.n, r.least, r.best) for r in QUERIES["fusion_weighted_views"](spark, str(tmp_path)).groupBy("row").agg(F.count("*").alias("n"), F.min("val").alias("least"), F.max("val").alias("best")).collect()}
    assert len(got) == 6_801 and got[5] == (20, round(0.1 / 6_799, 7), round(0.1 / 6_799, 7)) and got[8_000][0] == 1


def test_part_of_the_creator_view_is_enough(spark):
    r = random.Random(8)
    o = spark.createDataFrame([(i, r.choice([1, 1, 1, 2, 3, None])) for i in range(120)], "id long, owner long")
    e = spark.createDataFrame(sorted({(r.randrange(130), r.randrange(130)): r.random() / 9 for _ in range(900)}.items()), "e struct<row:long,col:long>, val double").selectExpr("e.row", "e.col", "val").where("row <> col").cache()
    w = {"a": 0.5, "creator": 0.5}
    whole, part = graph.row_normalise(similar.same_creator(o)), similar.same_creator_among(o, e, 6)
    best = lambda c: sorted((x.row, x.col, round(x.val, 12)) for x in fusion.fuse_fixed({"a": e, "creator": c}, w, 6, None).collect())
    assert best(part) == best(whole) and part.count() < whole.count()


def test_random_walks_have_the_production_size(spark, tmp_path):
    rows = [(i, [f"a{i % 5}", f"b{i % 5}"]) for i in range(60)]
    spark.createDataFrame(rows, "doc_idx long, tags array<string>").write.parquet(str(tmp_path / "relevance_tag_docs.parquet"))
    got = QUERIES["random_walks"](spark, str(tmp_path)).collect()
    assert {(r.start, r.walk) for r in got} == {(i, w) for i in range(60) for w in range(10)} and {r.length for r in got} == {40}
    assert all(int(x) % 5 == r.start % 5 for r in got for x in r.path.split(">"))


def _paths(spark, monkeypatch):
    paths = {(1, 0): list(range(100, 130)), (1, 1): [1, 2], (20, 0): list(range(40))}
    w = spark.createDataFrame([(s, n, p) for (s, n), p in paths.items()], "start long, walk int, path array<long>")
    monkeypatch.setattr(q_walks, "_walks", lambda spark, d: w)
    return paths


def test_pairs_and_vectors_come_from_the_walks(spark, monkeypatch):
    paths = _paths(spark, monkeypatch)
    got = {tuple(r) for r in QUERIES["skip_gram_pairs"](spark, "").collect()}
    near = {(s, n, i, j, p[i], p[j]) for (s, n), p in paths.items() for i in range(len(p)) for j in range(max(0, i - 5), min(len(p), i + 6)) if i != j}
    assert got <= near and len(got) > len(near) / 5 and max(r[2] for r in got) > 35
    assert {r.id for r in QUERIES["word2vec_embeddings"](spark, "").collect()} == {x for p in paths.values() for x in p}


def test_negatives_for_every_position_of_every_walk(spark, monkeypatch):
    paths = _paths(spark, monkeypatch)
    monkeypatch.setattr(q_walks, "_ppmi", lambda spark, d: spark.createDataFrame([(i, c, 1.0) for i in range(6) for c in range(1 + 3 * i)], "row long, col long, val double"))
    got = {(r.start, r.walk, r.at, r.slot): r.negative for r in QUERIES["negative_draws"](spark, "").collect()}
    assert set(got) == {(s, n, i, k) for (s, n), p in paths.items() for i in range(len(p)) for k in range(5)}
    assert set(got.values()) == set(range(6))


def test_engagement_neighbours_of_every_document(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, *[float(r.choice([0, 0, 1, 2, 7])) for _ in range(4)]) for i in range(300)]
    names = ["doc_idx", *(f"Total{c}_log1p" for c in ("Views", "Downloads", "Votes", "Kernels"))]
    spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'doc_idx' else 'double'}" for n in names)).write.parquet(str(tmp_path / "beh_base.parquet"))
    got = QUERIES["engagement_knn"](spark, str(tmp_path)).groupBy("row").count().collect()
    assert {(x.row, x["count"]) for x in got} == {(i, 10) for i in range(300)}


def test_nearest_in_boxes_equals_nearest(spark):
    r = random.Random(6)
    rows = [(i, [0.0] * 3 if i % 97 == 0 else [r.choice([r.gauss(0, 1), float(r.randrange(-2, 3))]) for _ in range(3)]) for i in range(900)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    rounded = lambda df: sorted((x.row, x.col, x.val) for x in df.collect())
    for k, leaf in ((5, 40), (12, 8), (3, 5_000)):
        assert rounded(similar.nearest_in_boxes(v, k, leaf)) == rounded(similar.nearest(v, k))
    assert similar.nearest_in_boxes(v.limit(0), 5).count() == 0
    assert rounded(similar.nearest_in_boxes(v.limit(4), 5)) == rounded(similar.nearest(v.limit(4), 5))


def test_pairs_are_drawn_without_text(spark):
    walks = spark.createDataFrame([(s, n, list(range(s, s + 12))) for s in range(300) for n in range(4)], "start long, walk int, path array<long>")
    p = wk.skip_gram_pairs(walks, 5, 42, keep=0.5)
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan and "lambda" not in plan
    reach = {r.w: r.n for r in wk.skip_gram_pairs(walks, 5, 42).groupBy("start", "walk", "at").agg(F.max(F.abs(F.col("j") - F.col("at"))).alias("w")).where("at = 5").groupBy("w").agg(F.count("*").alias("n")).collect()}
    assert set(reach) == {1, 2, 3, 4, 5} and all(180 < n < 300 for n in reach.values())
    assert abs(p.count() / wk.skip_gram_pairs(walks, 5, 42).count() - 0.5) < 0.02


def test_negatives_are_drawn_where_the_walks_are(spark):
    noise = wk.noise_distribution(spark.range(20_000).selectExpr("id", "id % 9 + 1 as deg"))
    p = spark.range(50).selectExpr("id as start", "0 as walk", "0 as at", "0 as j")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        got = wk.alias_negatives(p, noise, 5)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.count() == 250 and got.where("negative between 0 and 19999").count() == 250
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_word2vec_trains_in_several_tasks(spark, monkeypatch):
    from pyspark.ml.feature import Word2Vec

    monkeypatch.setattr(wk, "WALK_SHARD", 100)
    parts, fit = [], Word2Vec.fit
    monkeypatch.setattr(Word2Vec, "fit", lambda self, x: parts.append(self.getNumPartitions()) or fit(self, x))
    paths = [(s, 0, [g * 10 + random.Random(s * 40 + i).randrange(6) for i in range(40)]) for s in range(400) for g in [s % 2]]
    v = {r.id: r.v for r in wk.word2vec(spark.createDataFrame(paths, "start long, walk int, path array<long>"), dim=8).collect()}
    assert parts == [4] and len(v) == 12
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    assert min(dot(0, i) for i in range(1, 6)) > max(dot(0, i) for i in range(10, 16))


def test_nearest_is_the_same_with_broadcast_vectors(spark, monkeypatch):
    r = random.Random(9)
    base = [[r.gauss(0, 1) for _ in range(6)] for _ in range(40)]
    rows = [(i, [0.0] * 6 if i % 50 == 7 else [x + (1e-8 if i % 3 else 0) * r.random() for x in r.choice(base)]) for i in range(700)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    found = lambda *a, **k: sorted((x.row, x.col, x.val) for x in similar.nearest(v, *a, **k).collect())
    args = [((5,), {}), ((30, v.where("id % 9 = 0")), {"positive_only": True}), ((3,), {"block": 64})]
    plan = similar.nearest(v, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    got = [found(*a, **k) for a, k in args]
    monkeypatch.setattr(similar, "SHARED_NUMBERS", 0)
    assert got == [found(*a, **k) for a, k in args]


def test_training_on_walks_takes_every_pair(spark):
    """One walk, one epoch: the vectors are those of a plain loop over ``skip_gram_pairs`` with the same draws."""
    import numpy as np

    r = random.Random(3)
    path, dim, negs, lr, mask = [r.choice([2, 5, 7, 9, 99]) for _ in range(60)], 8, 2, 0.1, 2**64 - 1
    w = spark.createDataFrame([(4, 1, path)], "start long, walk int, path array<long>")
    ids = spark.createDataFrame([(2, 1), (5, 3), (7, 2), (9, 4), (11, 1)], "id long, deg long")
    got = {x.id: x.v for x in wk.train_sgns_on_walks(w, ids, 5, 42, dim=dim, epochs=1, negs=negs, lr=lr, seed=6).collect()}

    def mix(z):
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & mask
        return z ^ (z >> 31)

    place = {2: 0, 5: 1, 7: 2, 9: 3, 11: 4}
    upper, other = wk.alias_table(np.array([1, 3, 2, 4, 1]) ** 0.75)
    v, u = (np.random.default_rng(6).random((5, dim)) - 0.5) / dim, np.zeros((5, dim))
    s = (mix(mix(mix(6))) + 0x9E3779B97F4A7C15) & mask  # one more draw gives the order of the walks
    pairs = sorted((x.at, x.j, x.center, x.context) for x in wk.skip_gram_pairs(w, 5, 42).collect())
    assert len(pairs) > 200
    for at in sorted({p[0] for p in pairs}):
        targets = []
        for _, _, a, b in (p for p in pairs if p[0] == at and p[2] != 99 and p[3] != 99):
            targets.append((place[b], 1))
            for _ in range(negs):
                s = (s + 0x9E3779B97F4A7C15) & mask
                slot = (mix(s) >> 32) * 5 >> 32
                targets.append((slot if (mix(s) & 0xFFFFFF) / 2**24 < upper[slot] else other[slot], 0))
        if targets:
            x = v[place[path[at]]]
            g = [lr * (y - 1 / (1 + np.exp(-(x @ u[t])))) for t, y in targets]
            step = np.zeros(dim)
            for (t, _), d in zip(targets, g, strict=True):
                step += d * u[t]
                u[t] += d * x
            x += step
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert got.keys() == place.keys() and all(np.allclose(got[i], v[p], atol=2e-3) for i, p in place.items())


def test_embeddings_write_no_pairs_and_put_related_documents_together(spark, tmp_path, monkeypatch):
    import numpy as np

    rows = [(i, [f"a{i % 3}", f"b{i % 3}"]) for i in range(60)]
    spark.createDataFrame(rows, "doc_idx long, tags array<string>").write.parquet(str(tmp_path / "relevance_tag_docs.parquet"))
    monkeypatch.setattr(wk, "skip_gram_pairs", None)
    monkeypatch.setattr(wk, "SHARD_PAIRS", 20_000)
    assert {(r.id, r.dim, r.length) for r in QUERIES["sgns_embeddings"](spark, str(tmp_path)).collect()} == {(i, 32, 1.0) for i in range(60)}
    v = {r.id: np.array(r.v) for r in q_walks._trained(spark, str(tmp_path)).collect()}
    assert min(v[0] @ v[i] for i in range(3, 60, 3)) > max(v[0] @ v[i] for i in range(60) if i % 3)
    none = wk.train_sgns_on_walks(spark.createDataFrame([], "start long, walk int, path array<long>"), spark.createDataFrame([(1, 2)], "id long, deg long"))
    assert [len(r.v) for r in none.collect()] == [32]


def _two_groups(spark, tmp_path, monkeypatch):
    rows = [(i, [f"a{i % 2}", f"b{i % 2}"]) for i in range(50)]
    spark.createDataFrame(rows, "doc_idx long, tags array<string>").write.parquet(str(tmp_path / "relevance_tag_docs.parquet"))
    spark.createDataFrame([(0, 1, 0.5), (90, 2, 0.5)], "row long, col long, val double").write.parquet(str(tmp_path / "s_fused3_symrow.parquet"))
    monkeypatch.setattr(wk, "skip_gram_pairs", None)
    return str(tmp_path)


def test_walk_graph_fusion_has_every_document_and_writes_no_pairs(spark, tmp_path, monkeypatch):
    got = QUERIES["walk_graph_fusion"](spark, _two_groups(spark, tmp_path, monkeypatch)).collect()
    assert {r.row for r in got} == {*range(50), 90} and {r.col for r in got if r.row == 90} == {2}
    assert sum(r.row % 2 == r.col % 2 for r in got) > 0.8 * len(got)


def test_walk_graph_quality_counts_every_document_and_writes_no_pairs(spark, tmp_path, monkeypatch):
    got = {r.method: (r.n, r.tag_jaccard) for r in QUERIES["walk_graph_quality"](spark, _two_groups(spark, tmp_path, monkeypatch)).collect()}
    assert got["walk"] == (500, 1.0) and got["random"][0] == 500 and got["random"][1] < 0.8


def test_nearest_over_several_blocks_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(i, [float(r.randrange(-3, 4)) for _ in range(3)]) for i in range(150)]
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / max((sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 1e-300), 9) + 0.0
    want = sorted((i, j, v) for i, a in rows for v, j in sorted((-cos(a, b), j) for j, b in rows if j != i)[:7] for v in [-v + 0.0])
    got = similar.nearest(spark.createDataFrame(rows, "id long, v array<double>"), 7, block=16)
    assert sorted((x.row, x.col, x.val) for x in got.collect()) == want
