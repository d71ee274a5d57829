"""Ranking metrics of top-K lists against relevance standards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewloom.operators.graph import top_edges

EPS = 1e-12
#: Similarity above which a described neighbour counts as relevant.
DESC_THRESHOLD = 0.2
#: Weights of the dimensions in the unified score.
WEIGHTS = {"tag": 0.5, "desc": 0.3, "creator": 0.2}


def discounted(gain: Column, rank: Column) -> Column:
    return gain / F.log2(rank.cast("double") + 1)


def query_metrics(ranked: DataFrame, keys: list[str], total: str | None = None, ideal: str = "retrieved", k: int = 20) -> DataFrame:
    """Metrics per query of ``ranked`` (keys..., rank, gain, rel).

    ndcg, ap, mrr, precision (hits / list size), hits_over_k, hit, and with ``total`` (a column: all relevant items) recall (0 when none).
    ideal: ``retrieved`` = the list's own gains sorted; ``total`` = min(k, total) gains of 1.
    """
    w = Window.partitionBy(*keys)
    x = ranked.withColumn("_best", F.row_number().over(w.orderBy(F.desc("gain"), F.asc("rank"))))
    x = x.withColumn("_hits", F.sum("rel").over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hits = F.sum("rel")
    aggs = [
        F.sum(discounted(F.col("gain"), F.col("rank"))).alias("dcg"),
        F.sum(discounted(F.col("gain"), F.col("_best"))).alias("idcg"),
        (F.sum(F.when(F.col("rel") > 0, F.col("_hits") / F.col("rank")).otherwise(0.0)) / F.greatest(hits, F.lit(1))).alias("ap"),
        F.coalesce(1 / F.min(F.when(F.col("rel") > 0, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        (hits / F.greatest(F.count("*"), F.lit(1))).alias("precision"),
        (hits / k).alias("hits_over_k"),
        F.max("rel").cast("double").alias("hit"),
    ]
    if total:
        t = F.max(total)
        aggs += [F.when(t <= 0, 0.0).otherwise(hits / t).alias("recall"), t.alias("_total")]
    g = x.groupBy(*keys).agg(*aggs)
    idcg = F.col("idcg")
    if ideal == "total":
        n = F.least(F.lit(k), F.col("_total")).cast("int")
        idcg = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + 1 / F.log2(i.cast("double") + 1))).otherwise(F.lit(1.0))
    return g.withColumn("ndcg", F.col("dcg") / (idcg + EPS)).drop("dcg", "idcg", "_total")


def tag_gains(top: DataFrame, doc_tags: DataFrame, idf: DataFrame, unknown: float = 1.0, form: str = "jaccard") -> DataFrame:
    """(method, row, col, rank, gain, rel) for rows that have tags.

    gain: idf of the shared tags / idf of all tags of both (``jaccard``), or / idf of the query's tags (``query``). Tags without idf weigh ``unknown``.
    """
    t = doc_tags.join(idf.select("tag", "idf"), "tag", "left").select("doc", "tag", F.coalesce("idf", F.lit(unknown)).alias("w"))
    total = t.groupBy("doc").agg(F.sum("w").alias("total"))
    base = top.join(total.select(F.col("doc").alias("row"), F.col("total").alias("ti")), "row")
    base = base.join(total.select(F.col("doc").alias("col"), F.col("total").alias("tj")), "col", "left")
    pairs = top.select("row", "col").distinct()
    shared = pairs.join(t.select(F.col("doc").alias("row"), "tag", "w"), "row").join(t.select(F.col("doc").alias("col"), "tag"), ["col", "tag"])
    shared = shared.groupBy("row", "col").agg(F.sum("w").alias("s"), F.count("*").alias("n"))
    x = base.join(shared, ["row", "col"], "left")
    s, tj = F.coalesce("s", F.lit(0.0)), F.coalesce("tj", F.lit(0.0))
    whole = F.col("ti") + tj - s if form == "jaccard" else F.col("ti")
    return x.select("method", "row", "col", "rank", F.when(whole > 0, s / whole).otherwise(0.0).alias("gain"), (F.coalesce("n", F.lit(0)) > 0).cast("int").alias("rel"))


def edge_gains(top: DataFrame, standard: DataFrame, threshold: float = DESC_THRESHOLD) -> DataFrame:
    """Gain = the standard's value of the edge (0 if absent), relevant above the threshold; rows that the standard has."""
    rows = standard.select("row").distinct()
    x = top.join(rows, "row", "left_semi").join(standard.select("row", "col", F.col("val").alias("g")), ["row", "col"], "left")
    return x.select("method", "row", "col", "rank", F.coalesce("g", F.lit(0.0)).alias("gain"), (F.coalesce("g", F.lit(0.0)) > threshold).cast("int").alias("rel"))


def owner_gains(top: DataFrame, owners: DataFrame) -> DataFrame:
    """Gain 1 for a neighbour of the same owner, from (doc, owner > 0); total = the owner's other documents, 1 at least."""
    o = owners.where("owner > 0").select("doc", "owner").distinct()
    n = o.groupBy("owner").agg(F.count("*").alias("n"))
    a = o.join(n, "owner").select(F.col("doc").alias("row"), F.col("owner").alias("oi"), F.greatest(F.col("n") - 1, F.lit(1)).alias("total"))
    x = top.join(a, "row").join(o.select(F.col("doc").alias("col"), F.col("owner").alias("oj")), "col", "left")
    rel = F.coalesce(F.col("oi") == F.col("oj"), F.lit(False)).cast("int")
    return x.select("method", "row", "col", "rank", rel.cast("double").alias("gain"), rel.alias("rel"), "total")


def top_lists(methods: dict[str, DataFrame], k: int, subset: DataFrame | None = None) -> DataFrame:
    """(method, row, col, val, rank): the ``k`` best of each row and method; the subset (row) comes first, so other rows aren't ranked."""
    out = None
    for name, e in methods.items():
        e = e.join(subset.select("row").distinct(), "row", "left_semi") if subset is not None else e
        part = top_edges(e.select("row", "col", "val"), k).select(F.lit(name).alias("method"), "row", "col", "val", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def evaluate(top: DataFrame, doc_tags: DataFrame, idf: DataFrame, described: DataFrame, owners: DataFrame, n_rows: int, k: int = 20) -> DataFrame:
    """(method, dim, n, coverage, ndcg, map, mrr, precision, recall): means over the queries each dimension covers.

    recall is hits / k for tag and desc, hits / the owner's other documents for creator.
    """
    tag = query_metrics(tag_gains(top, doc_tags, idf), ["method", "row"], k=k).withColumn("recall", F.col("hits_over_k"))
    desc = query_metrics(edge_gains(top, described), ["method", "row"], k=k).withColumn("recall", F.col("hits_over_k"))
    own = query_metrics(owner_gains(top, owners), ["method", "row"], "total", k=k)
    cols = ["method", "row", "ndcg", "ap", "mrr", "precision", "recall"]
    all_ = tag.select(F.lit("tag").alias("dim"), *cols).unionByName(desc.select(F.lit("desc").alias("dim"), *cols)).unionByName(own.select(F.lit("creator").alias("dim"), *cols))
    return all_.groupBy("method", "dim").agg(
        F.count("*").alias("n"),
        (F.count("*") / n_rows).alias("coverage"),
        F.avg("ndcg").alias("ndcg"),
        F.avg("ap").alias("map"),
        F.avg("mrr").alias("mrr"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
    )


def unified(scores: DataFrame, weights: dict[str, float] | None = None, by_coverage: bool = False) -> DataFrame:
    """(method, unified): weighted sum of ndcg over the dimensions; ``by_coverage``: weights times coverage, as a mean."""
    weights = weights or WEIGHTS
    w = F.create_map(*[x for d, v in weights.items() for x in (F.lit(d), F.lit(float(v)))])[F.col("dim")]
    if by_coverage:
        w = w * F.col("coverage")
        return scores.groupBy("method").agg(F.coalesce(F.try_divide(F.sum(w * F.col("ndcg")), F.sum(w)), F.lit(0.0)).alias("unified"))
    return scores.groupBy("method").agg(F.sum(w * F.col("ndcg")).alias("unified"))


def improvement(scores: DataFrame, baseline: str, metric: str) -> DataFrame:
    """(method, metric, improvement in percent of the baseline; NULL when that is 0)."""
    base = scores.where(F.col("method") == baseline).select(F.col(metric).alias("b"))
    x = scores.crossJoin(F.broadcast(base.limit(1)))
    return x.select("method", metric, F.try_divide((F.col(metric) - F.col("b")) * 100, F.abs("b")).alias("improvement"))


def candidate_union(top: DataFrame) -> DataFrame:
    """(row, col): the neighbours any method gives, itself excluded."""
    return top.select("row", "col").where("row <> col").distinct()


def ndcg_over_candidates(gains: DataFrame, candidates: DataFrame) -> DataFrame:
    """(method, row, ndcg): DCG of each list over the best DCG that the candidates (row, col, gain) allow at its length."""
    dcg = gains.groupBy("method", "row").agg(F.sum(discounted(F.col("gain"), F.col("rank"))).alias("dcg"), F.count("*").alias("size"))
    best = candidates.withColumn("rk", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("gain"), F.asc("col"))))
    x = dcg.join(best.select("row", "rk", "gain"), "row").where("rk <= size")
    g = x.groupBy("method", "row").agg(F.max("dcg").alias("dcg"), F.sum(discounted(F.col("gain"), F.col("rk"))).alias("idcg"))
    return g.select("method", "row", (F.col("dcg") / (F.col("idcg") + EPS)).alias("ndcg"))
