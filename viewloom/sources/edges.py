"""Edge tables on disk: parts plus a manifest; all known spellings of the manifest are read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.operators.graph import sum_duplicates
from viewloom.sources.files import exists

PART_ROWS = 2_000_000


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, val) of a triplet file; repeated cells add up."""
    e = spark.read.parquet(path).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("val").cast("double").alias("val"))
    return sum_duplicates(e)


def save_edges(edges: DataFrame, folder: str, prefix: str, k: int, nodes: int, note: str = "", part_rows: int = PART_ROWS) -> dict:
    """Edges in parts of at most ``part_rows`` rows and ``{prefix}_k{k}_manifest.json``; returns the manifest."""
    spark, name = edges.sparkSession, f"{prefix}_k{k}_parts"
    edges.select("row", "col", "val").write.mode("overwrite").option("maxRecordsPerFile", part_rows).parquet(f"{folder}/{name}")
    n = spark.read.parquet(f"{folder}/{name}").count()
    manifest = {"view": prefix, "k_target": k, "nodes": nodes, "nnz": n, "parts": [name], "note": note}
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{prefix}_k{k}_manifest.json")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    return manifest


def read_manifest(spark: SparkSession, folder: str, prefix: str, k: int) -> dict:
    """{nodes, k, nnz, parts}: the manifest with or without k in its name; parts, files or part_files; names or objects with a path."""
    for name in (f"{prefix}_k{k}_manifest.json", f"{prefix}_manifest.json"):
        if exists(spark, f"{folder}/{name}"):
            m = json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/{name}").collect()))
            parts = next((m[x] for x in ("parts", "files", "part_files") if isinstance(m.get(x), list)), [])
            shape = m.get("shape") or [None]
            pick = lambda *keys: next((m[x] for x in keys if x in m), None)  # noqa: B023, E731
            return {
                "nodes": pick("nodes", "N") or shape[0],
                "k": pick("k_target", "k"),
                "nnz": pick("nnz", "total_edges"),
                "parts": [p["path"] if isinstance(p, dict) else p for p in parts],
            }
    raise FileNotFoundError(f"no manifest of {prefix} in {folder}")


def load_graph(spark: SparkSession, folder: str, prefix: str, k: int) -> tuple[DataFrame, dict]:
    """(edges, manifest); parts that are gone are left out."""
    m = read_manifest(spark, folder, prefix, k)
    paths = [p if "://" in p or p.startswith("/") else f"{folder}/{p}" for p in m["parts"]]
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "row long, col long, val double"), m
    e = spark.read.parquet(*there)
    return e.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("val").cast("double").alias("val")), m
