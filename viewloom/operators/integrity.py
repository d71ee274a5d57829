"""Checks of a selection against its sources, and refilling of rows without a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check_selection(chosen: DataFrame, tables: DataFrame, index: DataFrame, target: int) -> DataFrame:
    """(check_name, n_bad) of a selection (Id, doc_idx), its main tables (Id, doc_idx, path) and the index (Id, doc_idx).

    Checks: rows short of or beyond ``target``, Ids without table, tables without Id, repeated Ids, empty paths, doc_idx unlike the index.
    """
    row = lambda name, df: df.select(F.lit(name).alias("check_name"), F.col("n").cast("long").alias("n_bad"))
    count = lambda df: df.agg(F.count("*").alias("n"))
    ids, have = chosen.select("Id").distinct(), tables.select("Id").distinct()
    pairs = index.select("Id", F.col("doc_idx").alias("known")).distinct()
    parts = [
        row("count", chosen.agg(F.abs(F.count("*") - target).alias("n"))),
        row("without_table", count(ids.join(have, "Id", "left_anti"))),
        row("without_id", count(have.join(ids, "Id", "left_anti"))),
        row("repeated", count(chosen.groupBy("Id").count().where("count > 1"))),
        row("empty_path", count(tables.where("path is null or trim(path) = ''"))),
        row("other_index", count(chosen.join(pairs, "Id").where("doc_idx <> known"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side only."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def refill(chosen: DataFrame, usable: DataFrame, candidates: DataFrame, target: int) -> DataFrame:
    """(Id, source): the chosen Ids that are usable, filled up to ``target`` with the usable candidates (Id, tier, score) by tier, score
    descending, Id. Only the best ``target`` candidates are ordered (a top-k, not a sort of all)."""
    kept = chosen.select("Id").distinct().join(usable.select("Id").distinct(), "Id", "left_semi").withColumn("source", F.lit("kept"))
    fresh = candidates.join(kept, "Id", "left_anti").join(usable.select("Id").distinct(), "Id", "left_semi")
    best = fresh.orderBy("tier", F.desc("score"), "Id").limit(target).withColumn("rn", F.row_number().over(Window.orderBy("tier", F.desc("score"), "Id")))
    need = kept.agg((F.lit(target) - F.count("*")).alias("need"))
    filled = best.crossJoin(F.broadcast(need)).where("rn <= need").select("Id", F.concat(F.lit("tier"), F.col("tier")).alias("source"))
    return kept.unionByName(filled)
