"""Cleaning: duplicates, dense indexes, latest rows, counters, dates, candidate filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewloom.functions.text import tag_overlaps
from viewloom.session import materialise


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key by ``order``, which must be total for a stable result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    return keep_one(df, [key], [F.asc(order)])


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    return keep_one(df, [key], [F.desc(order)])


def running_total(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """The sum of ``value`` up to and with each row in ``order`` (total), without gathering the rows in one task.

    Sorted ranges are written first, so a retry sees the same ones; the totals before each range are one row per range.
    """
    parts = materialise(df.withColumn("_v", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.sum("_v").alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return out.withColumn(name, F.col("_before") + F.sum("_v").over(inner)).drop("_part", "_before", "_v")


def dense_index(df: DataFrame, order: list[Column], name: str = "doc_idx") -> DataFrame:
    """0, 1, 2, ... in ``order`` (total)."""
    return running_total(df, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) - 1)


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """(keys..., one column per entry of ``probs``): exact quantiles with linear interpolation; NULL and NaN values don't count, nor NULL keys.

    Equal values are added up before the shuffle, the distinct ones are placed by a running total over sorted ranges: no task
    holds a group, however large, and nothing but the two values beside each quantile is kept.
    """
    v = F.col(value).cast("double")
    c = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("_x")).agg(F.count("*").alias("_n"))
    x = running_total(c, [*[F.asc(k) for k in keys], F.asc("_x")], F.col("_n"), "_upto")
    ends = x.groupBy(*keys).agg(F.min(F.col("_upto") - F.col("_n")).alias("_base"), F.sum("_n").alias("_size"))
    x = x.join(ends, keys) if keys else x.crossJoin(F.broadcast(ends))
    upto, since = F.col("_upto") - F.col("_base"), F.col("_upto") - F.col("_base") - F.col("_n")
    pick = lambda at: F.max(F.when((since <= at) & (at < upto), F.col("_x")))
    out = []
    for name, p in probs.items():
        at = (F.col("_size") - 1) * F.lit(float(p))
        low, high = pick(F.floor(at)), pick(F.ceil(at))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return x.groupBy(*keys).agg(*out)


def counters(df: DataFrame, cols: list[str]) -> DataFrame:
    """Counters not below 0 (NULL is 0), each with its log1p twin."""
    for c in cols:
        v = F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
        df = df.withColumn(c, v).withColumn(f"{c}_log1p", F.log1p(v))
    return df


def activity(df: DataFrame, created: str, active: str, as_of: str) -> DataFrame:
    """age_days, recency_days and active_30d against the given day."""
    day = F.lit(as_of).cast("date")
    return (
        df.withColumn("age_days", F.date_diff(day, F.col(created).cast("date")))
        .withColumn("recency_days", F.date_diff(day, F.col(active).cast("date")))
        .withColumn("active_30d", F.col("recency_days") <= 30)
    )


def filter_candidates(df: DataFrame, tags: list[str] | None, size: str, size_min: int, size_max: int, views: str, min_views: int = 0) -> DataFrame:
    """Rows with one of the tags (None: any), a size within the bounds (NULL isn't) and enough views (0: any)."""
    ok = F.col(size).between(size_min, size_max)
    if tags is not None:
        ok = ok & tag_overlaps(F.col("Tags"), tags)
    if min_views > 0:
        ok = ok & (F.col(views) >= min_views)
    return df.where(ok)


def pick_preset(presets: dict[int, dict], target: int) -> dict:
    """The preset with the least key that reaches ``target``, else the largest."""
    return presets[min((k for k in presets if k >= target), default=max(presets))]


def date_like(df: DataFrame, cols: list[str], share: float = 0.9) -> DataFrame:
    """(col_name, parsed, is_date): share of the non-NULL values that are times, in one pass over all columns."""
    long = df.select([F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "col_name", "value").where("value is not null")
    out = long.groupBy("col_name").agg(F.avg(F.try_to_timestamp("value").isNotNull().cast("int")).alias("parsed"))
    return out.withColumn("is_date", F.col("parsed") >= share)


def match_slugs(slugs: DataFrame, offers: DataFrame) -> DataFrame:
    """(id, ref, confidence): of the offers (id, pos, ref, title) of each slug (id, slug, title) the first whose ref ends in /slug
    ("exact"), else the first whose title equals, holds or lies in the title ("fuzzy"), else NULL ("none")."""
    s = slugs.select("id", F.trim(F.lower("slug")).alias("_slug"), F.trim(F.lower("title")).alias("_title"))
    o = offers.select("id", "pos", "ref", F.trim(F.lower("ref")).alias("_ref"), F.trim(F.lower(F.coalesce("title", F.lit("")))).alias("_offer"))
    exact = F.col("_ref").endswith(F.concat(F.lit("/"), F.col("_slug")))
    fuzzy = (F.col("_title") != "") & (F.col("_offer").contains(F.col("_title")) | F.col("_title").contains(F.col("_offer")))
    kind = F.when(exact, 1).when(fuzzy, 2)
    best = s.join(o, "id", "left").withColumn("kind", kind).groupBy("id").agg(F.min(F.when(F.col("kind").isNotNull(), F.struct("kind", "pos", "ref"))).alias("b"))
    return best.select("id", F.col("b.ref").alias("ref"), F.when(F.col("b.kind") == 1, "exact").when(F.col("b.kind") == 2, "fuzzy").otherwise("none").alias("confidence"))


def latest_version(versions: DataFrame, key: str, version: str, tie: str) -> DataFrame:
    """The row with the largest version per key (then the least ``tie``)."""
    return keep_one(versions.where(F.col(version).isNotNull()), [key], [F.desc(version), F.asc(tie)])
