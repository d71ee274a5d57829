"""Fusion of several graphs: fixed, rank-based and adaptive weights, consistency, reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewloom.operators.graph import TINY, row_normalise, top_edges

#: Weights below this take no part.
LEAST_WEIGHT = 1e-9
#: Fused values are rounded to so many digits before they are ranked, so equal ones are ties whatever the order of their sums.
DIGITS = 9


def views_table(views: dict[str, DataFrame]) -> DataFrame:
    """(view, row, col, val) of all views."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(v).alias("view"), "row", "col", "val") for v, df in views.items()])


def adaptive_alpha(views: DataFrame, inverse: bool = False) -> DataFrame:
    """(view, row, rho, alpha): each view's share of the row's concentration; ``inverse``: of 1 / (rho + 1e-12)."""
    rho = views.groupBy("view", "row").agg(F.sum(F.col("val") * F.col("val")).alias("rho"))
    w = 1 / (F.col("rho") + TINY) if inverse else F.col("rho")
    return rho.withColumn("alpha", w / F.greatest(F.sum(w).over(Window.partitionBy("row")), F.lit(TINY)))


def fixed_alpha(views: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(view, row, alpha) with the same weight for all rows."""
    a = F.create_map(*[x for v, w in weights.items() for x in (F.lit(v), F.lit(float(w)))])
    return views.select("view", "row").distinct().withColumn("alpha", a[F.col("view")])


def consistency_alpha(alpha: DataFrame, scores: DataFrame, view: str, beta: float = 0.5) -> DataFrame:
    """``alpha`` with ``view`` damped by beta + (1 - beta)(1 - c), c of ``scores`` (row, c) or 0, shares renormalised."""
    g = beta + (1 - beta) * (1 - F.coalesce(F.col("c"), F.lit(0.0)))
    x = alpha.join(scores.select("row", "c"), "row", "left")
    x = x.withColumn("alpha", F.when(F.col("view") == view, F.col("alpha") * g).otherwise(F.col("alpha")))
    return x.withColumn("alpha", F.col("alpha") / F.greatest(F.sum("alpha").over(Window.partitionBy("row")), F.lit(TINY))).drop("c")


def fuse(views: DataFrame, alpha: DataFrame, k: int, norm: str | None = "l1") -> DataFrame:
    """Per row the weighted sum of the views, its ``k`` best edges, rows at L1 (or L2) length 1; rows of about 0 go."""
    a = alpha.where(F.col("alpha") >= LEAST_WEIGHT).select("view", "row", "alpha")
    e = views.join(a, ["view", "row"]).groupBy("row", "col").agg(F.round(F.sum(F.col("alpha") * F.col("val")), DIGITS).alias("val"))
    e = top_edges(e, k).drop("rank")
    if norm is None:
        return e
    # at most k edges a row are left here
    e = e.withColumn("_t", F.sum("val").over(Window.partitionBy("row"))).where(F.col("_t") >= TINY).drop("_t")
    return row_normalise(e, norm)


def fuse_fixed(views: dict[str, DataFrame], weights: dict[str, float], k: int, norm: str | None = "l1") -> DataFrame:
    v = views_table({n: df for n, df in views.items() if weights.get(n, 0) >= LEAST_WEIGHT})
    w = F.create_map(*[x for n, a in weights.items() for x in (F.lit(n), F.lit(float(a)))])
    e = v.groupBy("row", "col").agg(F.round(F.sum(w[F.col("view")] * F.col("val")), DIGITS).alias("val"))
    e = top_edges(e, k).drop("rank")
    return e if norm is None else row_normalise(e, norm)


def fuse_adaptive(views: dict[str, DataFrame], k: int, norm: str | None = "l1", inverse: bool = False) -> DataFrame:
    v = views_table(views)
    return fuse(v, adaptive_alpha(v, inverse), k, norm)


def reciprocal_ranks(views: dict[str, DataFrame], k: int, c: int = 60) -> DataFrame:
    """Sum of 1 / (c + rank) over the views, the ``k`` best, L1 rows."""
    v = views_table(views)
    rank = F.row_number().over(Window.partitionBy("view", "row").orderBy(F.desc("val"), F.asc("col")))
    e = v.withColumn("val", 1 / (c + rank)).groupBy("row", "col").agg(F.round(F.sum("val"), DIGITS).alias("val"))
    return row_normalise(top_edges(e, k).drop("rank"))


def comb_sum(views: dict[str, DataFrame], k: int) -> DataFrame:
    """Mean value over the views, the ``k`` best, L1 rows."""
    return fuse_fixed(views, dict.fromkeys(views, 1 / len(views)), k)


def selective(meta: DataFrame, content: DataFrame, weight: float, content_rows: DataFrame, k: int) -> DataFrame:
    """Rows of ``content_rows`` fused with the given weight of ``meta``, all others from ``meta`` alone; top ``k``, not normalised."""
    rows = content_rows.select("row").distinct()
    fused = fuse_fixed({"meta": meta.join(rows, "row", "left_semi"), "content": content.join(rows, "row", "left_semi")}, {"meta": weight, "content": 1 - weight}, k, None)
    return fused.unionByName(top_edges(meta.select("row", "col", F.round("val", DIGITS).alias("val")).join(rows, "row", "left_anti"), k).drop("rank"))


def consistency(meta: DataFrame, content: DataFrame) -> DataFrame:
    """(row, jaccard, weighted_consistency, n_meta, n_cont, n_intersect) of each row of either graph."""
    m = meta.select("row", "col", F.col("val").alias("wm"))
    c = content.select("row", "col", F.col("val").alias("wc"))
    g = m.join(c, ["row", "col"], "full").groupBy("row").agg(
        F.count("wm").alias("n_meta"),
        F.count("wc").alias("n_cont"),
        F.count_if(F.col("wm").isNotNull() & F.col("wc").isNotNull()).alias("n_intersect"),
        F.sum(F.when(F.col("wm").isNotNull() & F.col("wc").isNotNull(), F.least("wm", "wc")).otherwise(0.0)).alias("s"),
        F.coalesce(F.sum("wm"), F.lit(0.0)).alias("tm"),
        F.coalesce(F.sum("wc"), F.lit(0.0)).alias("tc"),
    )
    possible = F.least("tm", "tc")
    return g.select(
        "row",
        (F.col("n_intersect") / F.greatest(F.col("n_meta") + F.col("n_cont") - F.col("n_intersect"), F.lit(1))).alias("jaccard"),
        F.when((F.col("tm") > 0) & (F.col("tc") > 0), F.least(F.col("s") / F.greatest(possible, F.lit(TINY)), F.lit(1.0))).otherwise(0.0).alias("weighted_consistency"),
        "n_meta",
        "n_cont",
        "n_intersect",
    )


def rerank(base: DataFrame, views: dict[str, DataFrame], tag_boost: DataFrame, same_creator: DataFrame, a: float, b: float, c: float) -> DataFrame:
    """base value + a * support + b * tag boost + c * behaviour boost, per edge of ``base``.

    support: share of the views that hold the edge; tag boost: (row, col, boost), 0 if absent; behaviour boost: 1 for the pairs of ``same_creator``
    (row, col). Ties by col where ranked later.
    """
    v = views_table(views).groupBy("row", "col").agg((F.count_distinct("view") / len(views)).alias("support"))
    x = base.join(v, ["row", "col"], "left").join(tag_boost.select("row", "col", "boost"), ["row", "col"], "left")
    x = x.join(same_creator.select("row", "col").distinct().withColumn("same", F.lit(1.0)), ["row", "col"], "left")
    z = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    return x.select("row", "col", (F.col("val") + a * z("support") + b * z("boost") + c * z("same")).alias("val"))


def blend(base: DataFrame, reranked: DataFrame, eta: float) -> DataFrame:
    """(1 - eta) * base + eta * reranked, per edge of ``base``."""
    r = reranked.select("row", "col", F.col("val").alias("rr"))
    return base.join(r, ["row", "col"], "left").select("row", "col", ((1 - eta) * F.col("val") + eta * F.coalesce("rr", F.lit(0.0))).alias("val"))

