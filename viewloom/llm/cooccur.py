"""Items that appear together: pair counts over baskets, with huge baskets cut into chunk pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.session import materialise

#: Baskets of more items than this are cut into chunks of this size.
CHUNK = 128


def pair_counts(baskets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b, n_ab), a < b, for ``baskets`` (items: sorted array of distinct items)."""
    size = F.size("items")
    small = baskets.where((size > 1) & (size <= chunk)).select("items", F.posexplode("items").alias("at", "a"))
    small = small.select("a", F.explode(F.slice("items", F.col("at") + 2, size)).alias("b"))
    huge = baskets.where(size > chunk).select(
        F.transform(F.sequence(F.lit(0), F.floor((size - 1) / chunk).cast("int")), lambda k: F.slice(F.col("items"), k * chunk + 1, F.lit(chunk))).alias("chunks")
    )
    huge = huge.select("chunks", F.posexplode("chunks").alias("at", "left"))
    huge = huge.select("left", F.posexplode(F.slice("chunks", F.col("at") + 1, F.size("chunks"))).alias("same", "right"))
    # chunk pairs of one basket go to many tasks
    huge = huge.repartition(F.xxhash64("left", "right")).select(F.explode("left").alias("a"), "same", "right")
    huge = huge.select("a", "same", F.explode("right").alias("b")).where((F.col("same") > 0) | (F.col("a") < F.col("b")))
    return small.unionByName(huge.select("a", "b")).groupBy("a", "b").agg(F.count("*").alias("n_ab"))


def associations(df: DataFrame, basket: str, item: str, min_count: int = 5, share: int = 2000, chunk: int = CHUNK) -> DataFrame:
    """Pairs of items that are together in at least ``min_count`` baskets and in at least 1 / ``share`` of all.

    (a, b, n, n_a, n_b, n_ab, lift, pmi, npmi, jaccard), a < b. n counts the baskets that have an item, n_a, n_b and n_ab
    those with a, b and both. Repeated (basket, item) count once, rows with a NULL in either are left out, further columns are
    ignored, empty input gives an empty result.

    An item of a counted pair is itself in that many baskets, so rarer items are dropped first, without loss. At most
    share * (mean basket size) items remain: that bounds the broadcast counts and the length of a basket's array.
    """
    pairs = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null").distinct()
    pairs = materialise(pairs, "baskets")
    n = pairs.select("basket").distinct().count()
    least = max(min_count, -(-n // share), 1)
    items = pairs.groupBy("item").agg(F.count("*").alias("m")).where(F.col("m") >= least)
    items = materialise(items, "items")
    kept = pairs.join(F.broadcast(items.select("item")), "item")
    baskets = kept.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items"))
    both = pair_counts(baskets.select("items"), chunk).where(F.col("n_ab") >= least)
    a = F.broadcast(items.select(F.col("item").alias("a"), F.col("m").alias("n_a")))
    b = F.broadcast(items.select(F.col("item").alias("b"), F.col("m").alias("n_b")))
    out = both.join(a, "a").join(b, "b").withColumn("n", F.lit(n).cast("long"))
    expected = F.col("n_a").cast("double") * F.col("n_b") / F.col("n")
    out = out.withColumn("lift", F.col("n_ab") / expected).withColumn("pmi", F.log("lift"))
    rare = -F.log(F.col("n_ab") / F.col("n"))
    return out.select(
        "a", "b", "n", "n_a", "n_b", "n_ab", "lift", "pmi",
        F.when(rare > 0, F.col("pmi") / rare).otherwise(F.lit(1.0)).alias("npmi"),
        (F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab"))).alias("jaccard"),
    )


def far_above_chance(pairs: DataFrame, times: int = 5) -> DataFrame:
    """The pairs seen at least ``times`` as often as chance; compared in whole numbers."""
    d = lambda c: F.col(c).cast("decimal(18,0)")
    return pairs.where(d("n_ab") * d("n") >= d("n_a") * d("n_b") * F.lit(times).cast("decimal(1,0)"))
