import json
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from viewloom.session import materialise, shared_dir
from viewloom.sources import edges, files
from viewloom.streaming import counters

ROOT = Path(__file__).resolve().parents[1]


def test_csv(spark, tmp_path, same):
    p = tmp_path / "a.csv"
    p.write_text('id,t\n1,"x ""y"", z\nw"\n2,\n3,b,extra\n')
    df = files.read_csv(spark, str(p), need=["t", "nope"], multi_line=True)
    assert df.columns == ["t"] and 'x "y", z\nw' in [r.t for r in df.collect()]
    same(files.read_csv(spark, str(p), "id int, t string", bad_rows="drop", multi_line=True).select("id"), [(1,), (2,)])


def test_read_table(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("id,t\n1,caf\xe9\n".encode("latin-1"))
    (tmp_path / "u.tsv").write_text("id\tt\n1\tcafé\n2\tx\n")
    assert files.read_table(spark, str(tmp_path / "l.csv")).first().t == "café"
    (tmp_path / "late.csv").write_bytes(b"id\n" + b"1\n" * 150_000 + "caf\xe9\n".encode("latin-1"))
    assert files.read_table(spark, str(tmp_path / "late.csv")).where("id = 'café'").count() == 1
    assert files.read_table(spark, str(tmp_path / "u.tsv"), rows=1).collect()[0].t == "café"
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    assert files.read_table(spark, str(tmp_path / "p.parquet"), 2).count() == 2
    assert files.read_table(spark, str(tmp_path / "x.doc")) is None
    assert files.read_table(spark, str(tmp_path / "gone.csv")) is None


def test_main_tables_and_listing(spark, tmp_path, same):
    for name, size in (("d1/a.csv", 5), ("d1/sub/b.TSV", 9), ("d1/big_codebook.csv", 99), ("d1/README.csv", 99), ("d1/pic.png", 99), ("d2/note.txt", 3)):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x" * size)
    listing = files.list_files(spark, str(tmp_path)).withColumn("key", F.regexp_extract("path", "/(d[0-9])/", 1))
    got = files.main_tables(listing, "key").select("key", F.element_at(F.split("path", "/"), -1), "length", "suffix")
    same(got, [("d1", "b.TSV", 9, ".tsv")])


def test_quoted_lines_and_latex(spark, tmp_path, same):
    df = spark.createDataFrame([(1, 'a "b"'), (None, None)], "n int, t string")
    same(files.quoted_line(df, ["t"]), [('1,"a ""b"""',), (',""',)])
    files.write_quoted_csv(df, str(tmp_path / "q"), ["t"])
    assert spark.read.text(str(tmp_path / "q" / "_header")).first()[0] == "n,t"
    assert '1 & a "b"' in files.to_latex(df)


def test_stage_table_resumes(spark, tmp_path):
    path, calls = str(tmp_path / "s"), []

    def make():
        calls.append(1)
        return spark.range(5)

    assert files.stage_table(spark, path, make).count() == 5
    assert files.stage_table(spark, path, make, 5).count() == 5 and len(calls) == 1
    files.stage_table(spark, path, make, 6)
    assert len(calls) == 2


def test_edges_and_manifests(spark, tmp_path):
    e = spark.createDataFrame([(i, i + 1, 0.5) for i in range(50)], "row long, col long, val double")
    folder = str(tmp_path)
    m = edges.save_edges(e, folder, "S", 50, 51, part_rows=10)
    assert m["nnz"] == 50
    got, back = edges.load_graph(spark, folder, "S", 50)
    assert got.count() == 50 and back["nodes"] == 51 and back["k"] == 50
    part = m["parts"][0]
    for name, content in {
        "A_manifest.json": {"N": 51, "k": 5, "total_edges": 50, "part_files": [part]},
        "B_manifest.json": {"nodes": 51, "k": 5, "files": [part, "gone.parquet"], "nnz": 50},
        "C_manifest.json": {"shape": [51, 51], "parts": [{"path": part}]},
    }.items():
        (tmp_path / name).write_text(json.dumps(content, indent=1))
        got, back = edges.load_graph(spark, folder, name[0], 7)
        assert got.count() == 50 and back["nodes"] == 51
    e.unionByName(e).write.parquet(str(tmp_path / "t"))
    assert edges.load_edges(spark, str(tmp_path / "t")).agg(F.max("val")).first()[0] == 1.0


def test_shared_folder_is_taken_from_the_session(spark):
    class Session:
        conf = {"spark.checkpoint.dir": "hdfs://somewhere/shared/"}

    assert shared_dir(Session()) == "hdfs://somewhere/shared"
    assert materialise(spark.range(4)).count() == 4


def test_stream_equals_batch(spark, tmp_path, same):
    rows = [(i, f"2024-01-01 0{i % 3}:1{i % 6}:00", i % 4, 1.0) for i in range(24)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, value double").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "value")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = counters.engagement(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), late="1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("eng").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    expected = [tuple(r) for r in counters.engagement(df).collect()]
    same(spark.table("eng"), expected)


def test_registry_and_core_alone():
    """All queries have a name of their own, SQL belongs to queries, and the core works without the extra folder."""
    code = """
import sys, importlib.abc
class No(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name.startswith("viewloom.llm"):
            raise ImportError(name)
sys.meta_path.insert(0, No())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert len(q) > 120 and set(o) <= set(q) and "p5_found" in q and "p1_found" not in q
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_core_never_imports_the_extra_folder():
    for f in (ROOT / "viewloom").rglob("*.py"):
        if "llm" not in f.parts:
            assert "viewloom.llm" not in f.read_text(), f
