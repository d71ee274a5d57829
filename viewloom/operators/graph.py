"""Graphs as edge tables (row, col, val): symmetry, norms, top lists, concentration, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12


def sum_duplicates(edges: DataFrame) -> DataFrame:
    """One edge per (row, col): the values add up. NULL and NaN values are left out."""
    ok = "row is not null and col is not null and val is not null and not isnan(val)"
    return edges.where(ok).groupBy("row", "col").agg(F.sum("val").alias("val"))


def max_duplicates(edges: DataFrame) -> DataFrame:
    """One edge per (row, col): the largest value. NULL and NaN values are left out."""
    ok = "row is not null and col is not null and val is not null and not isnan(val)"
    return edges.where(ok).groupBy("row", "col").agg(F.max("val").alias("val"))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def with_total(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over its key group as column ``name``.

    Totals are pre-aggregated and joined back: small totals are broadcast by AQE, and a hot key is a skewed join that AQE splits;
    a window would sort and hold the hot group in one task. NULL keys are left out.
    """
    return df.join(df.groupBy(*keys).agg(F.sum(value).alias(name)), keys)


def row_normalise(edges: DataFrame, kind: str = "l1") -> DataFrame:
    """(row, col, val): rows at L1 (or L2) length 1; sums under 1e-12 count as 1e-12."""
    v = F.col("val")
    x = with_total(edges.select("row", "col", "val"), ["row"], v if kind == "l1" else v * v, "_total")
    total = F.col("_total") if kind == "l1" else F.sqrt("_total")
    return x.select("row", "col", (v / F.greatest(total, F.lit(TINY))).alias("val"))


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    """(row, col, val, rank): the k largest of each row, ties by col."""
    w = Window.partitionBy("row").orderBy(F.desc("val"), F.asc("col"))
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def symmetrise(edges: DataFrame, mode: str = "max", diagonal: bool = False, k: int | None = None, norm: bool = True) -> DataFrame:
    """Edges made symmetric, then L1 rows. A missing direction counts as 0.

    max: the larger direction; avg: half the sum; sum: the sum, then the ``k`` best per row (no longer symmetric).
    Zero edges go; the diagonal goes unless ``diagonal``. ``edges`` must have one edge per (row, col).
    """
    both = edges.select("row", "col", "val").unionByName(transpose(edges))
    if mode == "max":
        val = F.when(F.count("*") < 2, F.greatest(F.max("val"), F.lit(0.0))).otherwise(F.max("val"))
    else:
        val = F.sum("val") / (2 if mode == "avg" else 1)
    e = both.groupBy("row", "col").agg(val.alias("val")).where("val <> 0")
    if not diagonal:
        e = e.where("row <> col")
    if k is not None:
        e = top_edges(e, k).drop("rank")
    return row_normalise(e) if norm else e


def concentration(edges: DataFrame) -> DataFrame:
    """(row, rho): sum of squared values."""
    return edges.groupBy("row").agg(F.sum(F.col("val") * F.col("val")).alias("rho"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(row, nbrs): the edges of a row as an array of (col, val), ordered by col."""
    return edges.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "val"))).alias("nbrs"))


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("row").agg(F.count("*").alias("deg"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    return degree(edges).groupBy("deg").agg(F.count("*").alias("n_rows"))


def statistics(edges: DataFrame) -> DataFrame:
    """(stat, low, high, mean, median, std) of row sums, values and edges per row; population deviation."""
    rows = edges.groupBy("row").agg(F.sum("val").alias("row_sum"), F.count("*").cast("double").alias("row_edges"))
    long = rows.unpivot([], ["row_sum", "row_edges"], "stat", "x").unionByName(edges.select(F.lit("value").alias("stat"), F.col("val").alias("x")))
    from viewloom.operators.clean import quantiles

    stats = long.groupBy("stat").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return stats.join(quantiles(long, ["stat"], "x", {"median": 0.5}), "stat").select("stat", "low", "high", "mean", "median", "std")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n): equal-width bins from the least to the largest value; the largest falls in the last bin."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    x = df.crossJoin(F.broadcast(ends)).where(F.col(value).isNotNull())
    at = F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(at, F.lit(bins - 1)))
    return x.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
