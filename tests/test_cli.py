import json

import pytest

from viewloom import cli


def test_stages_from_edges_to_metrics(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    # documents of two groups, each with terms of its own
    spark.createDataFrame([(i, 100 + 10 * (i % 2) + t, 1.0) for i in range(24) for t in range(4)], "row long, col long, val double").write.parquet(at("edges"))
    spark.createDataFrame([(i, i % 2 + 1) for i in range(24)], "doc long, owner long").write.parquet(at("owners"))
    (tmp_path / "train.json").write_text(json.dumps({"walks": 4, "length": 8, "dim": 8, "epochs": 6}))
    cli.main(["train", "--edges", at("edges"), "--out", at("vectors"), "--config", at("train.json")])
    assert spark.read.parquet(at("vectors")).count() == 24
    cli.main(["neighbours", "--vectors", at("vectors"), "--out", at("graph"), "--k", "5", "--kind", "exact"])
    cli.main(["fuse", "--view", f"a={at('graph')}::S::5", "--view", f"b={at('graph')}::S::5", "--out", at("fused"), "--k", "5"])
    cli.main(["evaluate", "--view", f"fused={at('fused')}::S::5", "--owners", at("owners"), "--out", at("metrics"), "--k", "5"])
    m = spark.read.csv(at("metrics"), header=True).first()
    assert m.method == "fused" and int(m.n) == 24 and float(m.precision) > 0.8


def test_content_of_many_small_tables(spark, tmp_path):
    rows = [(g, float(i), "red" if g % 2 else f"name {i}", g % 2 == 0 and i or None) for g in range(6) for i in range(8)]
    spark.createDataFrame(rows, "g long, x double, s string, n long").write.parquet(str(tmp_path / "t"))
    cli.main(["content", "--table", str(tmp_path / "t"), "--key", "g", "--out", str(tmp_path / "out"), "--k", "3"])
    assert {r.row for r in cli._edges(spark, f"{tmp_path / 'out'}::S::3").collect()} <= set(range(6))


def test_unknown_names(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"walk": 1}')
    with pytest.raises(ValueError, match="walk"):
        cli.main(["train", "--edges", "x", "--out", "y", "--config", str(tmp_path / "c.json")])
    with pytest.raises(SystemExit):
        cli.main(["query", "--name", "none", "--data", "x", "--out", "y"])


def test_an_encoder_takes_the_place_of_hashing(spark):
    import numpy as np

    from viewloom.operators.content import encode_texts

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id long, text string")
    got = {r.id: r.v for r in encode_texts(df, ["id"], "text", lambda ts: np.array([[len(t), 1.0] for t in ts])).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0]}
    assert encode_texts(df, ["id"], "text", dim=4).count() == 1
