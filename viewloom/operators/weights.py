"""Vocabularies and edge weights: document frequency, TF-IDF, PPMI, BM25. Edges are (row, col, val)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.operators.clean import dense_index
from viewloom.operators.graph import with_total


def vocabulary(edges: DataFrame, term: str, min_df: int = 1, max_df: int | None = None) -> DataFrame:
    """(term, df, idx): terms by distinct rows, idx by df descending, then term. ``edges`` is distinct (row, term)."""
    v = edges.groupBy(term).agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    if max_df is not None:
        v = v.where(F.col("df") <= max_df)
    return dense_index(v, [F.desc("df"), F.asc(term)], "idx")


def unit_rows(edges: DataFrame) -> DataFrame:
    """Rows at L2 length 1; a zero row stays 0."""
    x = with_total(edges, ["row"], F.col("val") * F.col("val"), "_total")
    return x.withColumn("val", F.when(F.col("_total") > 0, F.col("val") / F.sqrt("_total")).otherwise(F.lit(0.0))).drop("_total")


def inverse_frequency(df: Column, n: Column, kind: str = "smooth") -> Column:
    """smooth: ln((1+n)/(1+df))+1; relevance: ln((n+1)/(df+1)); bm25a: ln((n-df+.5)/(df+.5)), not below 0; bm25b: ln of that +1."""
    odds = (n - df + 0.5) / (df + 0.5)
    return {
        "smooth": lambda: F.log((1 + n) / (1 + df)) + 1,
        "relevance": lambda: F.log((n + 1) / (df + 1)),
        "bm25a": lambda: F.greatest(F.log(odds), F.lit(0.0)),
        "bm25b": lambda: F.log(odds + 1),
    }[kind]()


def tf_idf(edges: DataFrame, n_rows: int, norm: str = "l2") -> DataFrame:
    """Smooth TF-IDF of distinct (row, col), tf 1. norm: ``l2``, or ``count``: divided by the root of the row's edge count."""
    df = edges.groupBy("col").agg(F.count("*").alias("df"))
    e = edges.join(df, "col").select("row", "col", inverse_frequency(F.col("df"), F.lit(float(n_rows))).alias("val"))
    if norm == "l2":
        return unit_rows(e)
    return with_total(e, ["row"], F.lit(1), "_n").withColumn("val", F.col("val") / F.sqrt("_n")).drop("_n")


def ppmi(edges: DataFrame, l2: bool = True) -> DataFrame:
    """max(0, ln(n / (row edges * col edges))) of distinct (row, col), n = all edges; zero cells stay, rows at L2 length 1."""
    n = edges.agg(F.count("*").cast("double").alias("n"))
    rows = edges.groupBy("row").agg(F.count("*").alias("r"))
    cols = edges.groupBy("col").agg(F.count("*").alias("c"))
    e = edges.join(rows, "row").join(cols, "col").crossJoin(F.broadcast(n))
    e = e.select("row", "col", F.greatest(F.log(F.col("n") / (F.col("r") * F.col("c"))), F.lit(0.0)).alias("val"))
    return unit_rows(e) if l2 else e


def term_frequency(docs: DataFrame, row: str, tokens: str) -> DataFrame:
    """(row, term, tf)."""
    return docs.select(F.col(row).alias("row"), F.explode(tokens).alias("term")).groupBy("row", "term").agg(F.count("*").alias("tf"))


def bm25(tf: DataFrame, n_docs: int, variant: str = "b", min_df: int = 1, max_df: int | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """(row, term, val) from (row, term, tf), rows at L2 length 1.

    a: k1 1.2, idf not below 0, length = kept words, weights of 0 dropped. b: k1 1.5, idf with + 1, length = all words
    (``lengths`` (row, dl), else from ``tf``). b = 0.75 in both.
    """
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    if max_df is not None:
        df = df.where(F.col("df") <= max_df)
    kept = tf.join(df, "term")
    dl = lengths if lengths is not None else (kept if variant == "a" else tf).groupBy("row").agg(F.sum("tf").alias("dl"))
    mean = dl.agg((F.sum("dl") / F.lit(float(n_docs))).alias("avg_dl"))
    k1, b = (1.2 if variant == "a" else 1.5), 0.75
    idf = inverse_frequency(F.col("df"), F.lit(float(n_docs)), f"bm25{variant}")
    w = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    e = kept.join(dl, "row").crossJoin(F.broadcast(mean)).select("row", "term", w.alias("val"))
    if variant == "a":
        e = e.where("val > 0")
    return unit_rows(e)
