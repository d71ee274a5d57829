"""Top N items within every group, with a hot-cold split of the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A group is heavy from HEAVY_ROWS rows and from HEAVY_SHARE of all rows on: at most 1 / HEAVY_SHARE groups are.
HEAVY_ROWS = 10_000
HEAVY_SHARE = 1e-5
#: Range cuts of a heavy group, and salts within a range.
CUTS = 64
SALTS = 16


def clean_edges(df: DataFrame) -> DataFrame:
    """(row, col, val) without NULL, NaN and self edges; of a repeated (row, col) the largest val."""
    ok = F.col("row").isNotNull() & F.col("col").isNotNull() & F.col("val").isNotNull() & ~F.isnan("val") & (F.col("row") != F.col("col"))
    return df.where(ok).groupBy("row", "col").agg(F.max("val").alias("val"))


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(group, item, score, rank): the ``n`` best items of each group by score descending, then item ascending.

    Items are distinct per group; NULL groups, items and scores and NaN scores are left out; groups with fewer items
    are kept whole. Other columns are dropped. Empty input gives an empty result.

    Groups are counted exactly. Light groups go through an ordinary window. A heavy group is cut into score ranges
    (quantiles); exact counts per range tell which top ranges can hold the best ``n``; these are ranked within (range, salt) and
    the at most n * salts winners of each range once more. The cuts only steer the balance, not the result.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s")).where(
        F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s")
    )
    limit = max(heavy_rows, int(df.count() * HEAVY_SHARE))
    heavy = F.broadcast(rows.groupBy("g").count().where(F.col("count") >= limit).select("g"))
    order = [F.desc("s"), F.asc("i")]

    light = rows.join(heavy, "g", "left_anti")
    light = light.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("rank") <= n)

    hot = rows.join(heavy, "g", "left_semi")
    share = [k / CUTS for k in range(1, CUTS)]
    cuts = hot.groupBy("g").agg(F.approx_percentile("s", share, 1000).alias("cuts"))
    # 0 is the range of the highest scores
    hot = hot.join(F.broadcast(cuts), "g").withColumn("range", F.size(F.filter("cuts", lambda c: c > F.col("s")))).drop("cuts")
    sizes = hot.groupBy("g", "range").count()
    above = F.coalesce(F.sum("count").over(Window.partitionBy("g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = F.broadcast(sizes.withColumn("above", above).where(F.col("above") < n).select("g", "range"))
    hot = hot.join(needed, ["g", "range"], "left_semi").withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(SALTS)))
    hot = hot.withColumn("local", F.row_number().over(Window.partitionBy("g", "range", "salt").orderBy(*order))).where(F.col("local") <= n)
    hot = hot.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("rank") <= n)

    out = light.select("g", "i", "s", "rank").unionByName(hot.select("g", "i", "s", "rank"))
    return out.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
