"""Tag statistics: frequencies, co-occurrence, coverage, categories, years."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.operators.clean import quantiles, running_total
from viewloom.session import materialise

# Tags by category.
CATEGORIES = {
    "Domain": ["business", "finance", "health", "education", "arts and entertainment", "earth and nature", "biology", "cancer", "news", "sports", "music"],
    "Skill Level": ["beginner", "intermediate", "advanced", "expert"],
    "Data Type": ["tabular", "image", "text", "time series", "geospatial"],
    "Technology": ["computer vision", "nlp", "deep learning", "machine learning", "pre-trained model", "computer science", "programming"],
    "Task": ["classification", "regression", "clustering", "data cleaning", "data visualization", "exploratory data analysis", "data analytics"],
}


def frequency(tags: DataFrame) -> DataFrame:
    """(tag, n) of one row per occurrence."""
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


def frequency_statistics(counts: DataFrame) -> DataFrame:
    """One row: tags, least, largest, median, mean, singletons, tags of up to 5, quartiles and their distance (linear interpolation)."""
    plain = counts.agg(
        F.count("*").alias("tags"), F.min("n").alias("low"), F.max("n").alias("high"), F.avg("n").alias("mean"),
        F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") <= 5).alias("up_to_5"),
    )
    q = quantiles(counts, [], "n", {"median": 0.5, "q1": 0.25, "q3": 0.75})
    return plain.crossJoin(F.broadcast(q)).withColumn("iqr", F.col("q3") - F.col("q1"))


def per_document(lists: DataFrame) -> DataFrame:
    """(n_tags, n_docs) of (doc, tags array)."""
    return lists.groupBy(F.size("tags").alias("n_tags")).agg(F.count("*").alias("n_docs"))


def cooccurrence(lists: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(t1, t2, n): pairs of positions in each document's sorted tags; a repeated tag pairs with itself.

    The pairs are made inside a row from its own list; lists are short by nature (a document's tags). ``only``: no other tags take part.
    """
    if only is not None:
        lists = lists.select(F.filter("tags", lambda t: t.isin(only)).alias("tags"))
    s = lists.select(F.array_sort("tags").alias("tags"))
    a = s.select("tags", F.posexplode("tags").alias("at", "t1"))
    return a.select("t1", F.explode(F.slice("tags", F.col("at") + 2, F.size("tags"))).alias("t2")).groupBy("t1", "t2").agg(F.count("*").alias("n"))


def cumulative_coverage(counts: DataFrame) -> DataFrame:
    """(tag, n, pos, coverage): share of all occurrences that the most frequent tags up to this one make."""
    total = counts.agg(F.sum("n").alias("total"))
    x = running_total(counts, [F.desc("n"), F.asc("tag")], F.col("n"), "run")
    x = running_total(x, [F.desc("n"), F.asc("tag")], F.lit(1).cast("long"), "pos")
    return x.crossJoin(F.broadcast(total)).select("tag", "n", "pos", (F.col("run") / F.col("total")).alias("coverage"))


def coverage_reached(coverage: DataFrame, shares: list[float]) -> DataFrame:
    """(share, tags): how many tags reach each share."""
    return coverage.select(F.explode(F.array(*[F.lit(s) for s in shares])).alias("share"), "pos", "coverage").where("coverage >= share").groupBy("share").agg(F.min("pos").alias("tags"))


def by_category(counts: DataFrame, categories: dict[str, list[str]] | None = None) -> DataFrame:
    """(category, n): occurrences of the tags of each category, 0 if none."""
    rows = [(c, t) for c, ts in (categories or CATEGORIES).items() for t in ts]
    table = counts.sparkSession.createDataFrame(rows, "category string, tag string")
    return F.broadcast(table).join(counts, "tag", "left").groupBy("category").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


#: Documents in a block of ``related_counts`` and distinct tag sets in a chunk: a task holds one block's bitmaps against one chunk.
BLOCK, CHUNK = 65_536, 32_768


def _unions(sets: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
    """(tags, n) per tag set: documents of the block that hold one of its tags or more.

    A tag with many documents is a bitmap, the others are lists of positions, so all lie within a multiple of the block's tags.
    """
    if sets.empty or docs.empty:
        return pd.DataFrame({"tags": [], "n": []})
    at: dict[str, list[int]] = {}
    for i, tags in enumerate(docs["tags"]):
        for t in tags:
            at.setdefault(t, []).append(i)
    size = (len(docs) + 63) // 64 * 8
    bits, few = {}, {}
    for t, p in at.items():
        if len(p) * 64 > len(docs):
            b = np.zeros(size * 8, dtype=bool)
            b[p] = True
            bits[t] = np.packbits(b, bitorder="little").view(np.uint64)
        else:
            few[t] = np.array(p)
    n = []
    for tags in sets["tags"]:
        hot, cold = [bits[t] for t in tags if t in bits], [few[t] for t in tags if t in few]
        union = np.bitwise_or.reduce(hot) if hot else None
        k = int(np.bitwise_count(union).sum()) if hot else 0
        if cold:
            p = np.unique(np.concatenate(cold))
            k += len(p) if union is None else int(len(p) - (union[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).sum())
        n.append(k)
    return pd.DataFrame({"tags": sets["tags"], "n": n})


def related_counts(tags: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(row, total): other documents that share a tag or more, of distinct (row, tag); documents without such are left out.

    Exact for tags of any frequency and without pairs of documents: equal tag sets are counted once, each as the sizes of
    its unions of document sets over blocks of about ``block`` documents.
    """
    docs = materialise(tags.groupBy("row").agg(F.array_sort(F.collect_set("tag")).alias("tags")), "tag-sets")
    sets = materialise(docs.select("tags").distinct(), "classes")
    blocks, chunks = max(1, math.ceil(docs.count() / block)), max(1, math.ceil(sets.count() / chunk))
    d = docs.select("tags", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    s = sets.select("tags", F.pmod(F.xxhash64("tags"), F.lit(chunks)).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    n = s.groupBy("block", "chunk").cogroup(d.groupBy("block", "chunk")).applyInPandas(_unions, "tags array<string>, n long")
    n = n.groupBy("tags").agg((F.sum("n") - 1).alias("total")).where("total > 0")
    return docs.join(n, "tags").select("row", "total")
