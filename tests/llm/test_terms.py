import math
import re
from collections import Counter

import numpy as np

from viewloom.llm import terms as t


def test_terms_of():
    assert t.terms_of('<b class="x">Big</b> see https://a.b/c?d=e now_2 A 42') == ["big", "see", "now_2", "42"]
    assert t.terms_of("É à") == []


def test_mixture_finds_two_rates():
    rng = np.random.default_rng(0)
    tf = np.concatenate([rng.poisson(6.0, 300), rng.poisson(0.05, 9700)])
    values, counts = np.unique(tf[tf > 0], return_counts=True)
    share, elite, base = t.fit_two_poisson(np.array([10000.0]), np.array([float(counts.sum())]), values.astype(float), counts.astype(float), np.array([0]), 300)
    assert math.isclose(share[0], 0.03, rel_tol=0.2) and math.isclose(elite[0], 6.0, rel_tol=0.1) and base[0] < 0.1


def rows():
    out = [(i, "common words here " * 3 + f"rare{i % 7} rare{i % 7} rare{i % 7} once{i}", "x") for i in range(200)]
    out += [(3, out[3][1], "x"), (5, "other other other other", "x"), (None, "common", "x"), (900, None, "x"), (901, "", "x"), (902, "<p>..</p>", "x"), (903, "long " * 30000, "x")]
    return out


def test_counts_cover_all_records(spark):
    data = rows()
    df = spark.createDataFrame(data, "Id long, Description string, term string")
    tf = {}
    for i, text, _ in data:
        if i is not None and text:
            for w, n in Counter(x for x in re.findall("[a-z0-9_]+", text.lower()) if len(x) > 1 and text[0] != "<").items():
                tf[i, w] = max(tf.get((i, w), 0), n)
    df_of = Counter(w for _, w in tf)
    n = len({i for i, _ in tf})
    for keep in (1, 3):
        got = t.distinctive_terms(df, "Id", "Description", keep, 2, 0.2).collect()
        expected = {(i, w, k, df_of[w], n) for (i, w), k in tf.items() if k >= keep and 2 <= df_of[w] <= 0.2 * n}
        assert {(r.id, r.term, r.tf, r.df, r.total) for r in got} == expected
        assert all(0 <= r.score <= 1 for r in got) and len(got) == len(expected)
    score = {r.term: r.score for r in got}
    assert score["rare1"] > 0.5


def test_empty(spark):
    df = spark.createDataFrame([], "Id long, Description string")
    assert t.distinctive_terms(df, "Id", "Description").count() == 0


def test_tag(spark, same):
    idf = spark.createDataFrame([("A", 5, 1.0), ("a ", 9, 3.0), ("b", 1, 3.0), ("c", 1, None), ("d", 1, float("nan")), (None, 1, 9.0), ("e", None, 9.0), ("f", 2, 0.5)], "tag string, df long, idf double")
    docs = spark.createDataFrame([(1, ["a", "b", "B", "c", "f"]), (1, ["F", "a"]), (2, ["f", "c"]), (None, ["a"]), (3, None), (4, [None, " "])], "doc_idx long, tags array<string>")
    same(t.distinctive_tag(docs, idf, 3).drop("score"), [(1, "a", 3.0)])
    same(t.distinctive_tag(docs, idf, 1).drop("score"), [(1, "a", 3.0), (2, "f", 0.5)])
    got = {(r.id, r.term): r.score for r in t.tag_scores(docs, idf, 1).collect()}
    assert got.keys() == {(1, "a"), (1, "b"), (1, "f"), (2, "f")} and 1 > got[1, "a"] == got[1, "b"] > got[1, "f"] > 0
    assert t.distinctive_tag(docs.limit(0), idf).count() == 0 and t.distinctive_tag(docs, idf.limit(0), 1).count() == 0


def test_found_terms_depend_on_the_fit(spark, monkeypatch, tmp_path):
    """Equal rates for both components tell no term apart: nothing of the descriptions is found."""
    from viewloom.llm import queries

    texts = [(i, f"shared words of all {'zebra zebra zebra' if i in (3, 7) else ''}") for i in range(150)]
    spark.createDataFrame(texts, "Id long, Description string").write.parquet(str(tmp_path / "metadata_merged_raw.parquet"))
    spark.createDataFrame([(1, ["a", "b"])], "doc_idx long, tags array<string>").write.parquet(str(tmp_path / "relevance_tag_docs.parquet"))
    spark.createDataFrame([("a", 1, 1.0)], "tag string, df long, idf double").write.parquet(str(tmp_path / "relevance_tag_idf.parquet"))
    found = lambda: {(r.record_id, r.term) for r in queries.p6_found(spark, str(tmp_path)).collect()}
    assert found() == {(3, "zebra"), (7, "zebra")}

    def flat(batches):
        for b in batches:
            rate = t.pa.array([0.5] * b.num_rows)
            yield t.pa.RecordBatch.from_arrays([b.column("term"), b.column("df"), b.column("total"), rate, rate, rate], names=["term", "df", "total", "share", "elite", "base"])

    monkeypatch.setattr(t, "_fit", flat)
    assert found() == set()
