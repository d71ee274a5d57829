"""Queries of the sections: graph algebra, top lists, set operations, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.operators import fusion as fu
from viewloom.operators import graph as g
from viewloom.plans.views import DT, IDF, OW, TWO, A, B, creator_view, doc_tags, graph, graph_sql, owners, scaled, scaled_sql, tag_idf, two_views
from viewloom.session import materialise
from viewloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.withColumn("val", F.round("val", digits))


# 7
@query(f"SELECT row, col, round(sum(val), 6) AS val FROM {A} WHERE val IS NOT NULL AND val::VARCHAR <> 'nan' AND row IS NOT NULL AND col IS NOT NULL GROUP BY row, col")
def summed_triplets(spark: SparkSession, d: str) -> DataFrame:
    return _r(g.sum_duplicates(table(spark, d, A)), 6)


# 121
@query(f"WITH {scaled_sql('a', A)} SELECT row, col, round(val, 8) AS val FROM a")
def sym_max_rownorm(spark: SparkSession, d: str) -> DataFrame:
    return _r(scaled(spark, d, A))


# 122
_AVG = graph_sql("e", B) + ", s AS (SELECT row, col, sum(val) / 2 AS val FROM (SELECT row, col, val FROM e UNION ALL SELECT col, row, val FROM e) GROUP BY row, col)"


@query(f"WITH {_AVG} SELECT row, col, round(val / greatest(sum(val) OVER (PARTITION BY row), 1e-12), 7) AS val FROM s WHERE val <> 0")
def sym_avg_rownorm(spark: SparkSession, d: str) -> DataFrame:
    return _r(g.symmetrise(graph(spark, d, B), "avg", diagonal=True), 7)


# 123
@query(f"""WITH {graph_sql('e', A)}, s AS (SELECT row, col, sum(val) AS val FROM (SELECT row, col, val FROM e UNION ALL SELECT col, row, val FROM e) GROUP BY row, col),
t AS (SELECT * FROM s WHERE val <> 0 QUALIFY row_number() OVER (PARTITION BY row ORDER BY val DESC, col) <= 20) SELECT row, col, round(val / greatest(sum(val) OVER (PARTITION BY row), 1e-12), 7) AS val FROM t""")
def sym_sum_topk(spark: SparkSession, d: str) -> DataFrame:
    return _r(g.symmetrise(graph(spark, d, A), "sum", k=20), 7)


# 124, 125
@query(f"WITH {graph_sql('e', B)} SELECT col AS row, count(*) AS n, min(row) AS first_col FROM e GROUP BY col")
def transposed_adjacency(spark: SparkSession, d: str) -> DataFrame:
    a = g.adjacency(g.transpose(graph(spark, d, B)))
    return a.select("row", F.size("nbrs").cast("long").alias("n"), F.col("nbrs")[0]["col"].alias("first_col"))


# 71, 72
@query(f"WITH {TWO}, r AS (SELECT view, row, sum(val * val) AS rho FROM v GROUP BY view, row) SELECT view, row, round(rho, 8) AS rho, round(rho / greatest(sum(rho) OVER (PARTITION BY row), 1e-12), 8) AS alpha FROM r")
def adaptive_alpha(spark: SparkSession, d: str) -> DataFrame:
    a = fu.adaptive_alpha(fu.views_table(two_views(spark, d)))
    return a.select("view", "row", F.round("rho", 8).alias("rho"), F.round("alpha", 8).alias("alpha"))


# 90, 95
@query(f"""WITH {scaled_sql('a', A)}, r AS (SELECT sum(val) AS row_sum, count(*)::DOUBLE AS row_edges FROM a GROUP BY row),
x AS (SELECT 'row_sum' AS stat, row_sum AS x FROM r UNION ALL SELECT 'row_edges', row_edges FROM r UNION ALL SELECT 'value', val FROM a)
SELECT stat, round(min(x), 6) AS low, round(max(x), 6) AS high, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_pop(x), 6) AS std FROM x GROUP BY stat""")
def graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = g.statistics(materialise(scaled(spark, d, A), "graph"))
    return s.select("stat", *[F.round(c, 6).alias(c) for c in ("low", "high", "mean", "median", "std")])


@query(f"""WITH {graph_sql('e', A)}, x AS (SELECT count(*)::DOUBLE AS deg FROM e GROUP BY row), l AS (SELECT min(deg) AS lo, max(deg) AS hi FROM x)
SELECT least(floor((deg - lo) / (hi - lo) * 20), 19)::INT AS bin, count(*) AS n FROM x CROSS JOIN l GROUP BY 1""")
def degree_histogram(spark: SparkSession, d: str) -> DataFrame:
    deg = g.degree(graph(spark, d, A)).select(F.col("deg").cast("double").alias("deg"))
    return g.histogram(deg, "deg", 20)


# 100
@query(f"SELECT greatest(max(row), max(col)) + 1 AS n_rows, count(*) AS n_edges FROM {A}")
def scan_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, A).agg((F.greatest(F.max("row"), F.max("col")) + 1).alias("n_rows"), F.count("*").alias("n_edges"))


# 101-107
@query(f"WITH {graph_sql('e', A)} SELECT row, col, val, row_number() OVER (PARTITION BY row ORDER BY val DESC, col)::INT AS rank FROM e QUALIFY rank <= 20")
def top_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return g.top_edges(graph(spark, d, A), 20)


# 126
@query(f"""WITH {TWO}, r AS (SELECT view, row, sum(val * val) AS rho FROM v GROUP BY view, row), l AS (SELECT view, row, rho / greatest(sum(rho) OVER (PARTITION BY row), 1e-12) AS al FROM r),
f AS (SELECT row, col, round(sum(al * val), 9) AS val FROM v JOIN l USING (view, row) WHERE al >= 1e-9 GROUP BY row, col) SELECT row, col, val FROM f QUALIFY row_number() OVER (PARTITION BY row ORDER BY val DESC, col) <= 50""")
def fuse_two_views(spark: SparkSession, d: str) -> DataFrame:
    v = fu.views_table(two_views(spark, d))
    a = fu.adaptive_alpha(v).where("alpha >= 1e-9").select("view", "row", "alpha")
    e = v.join(a, ["view", "row"]).groupBy("row", "col").agg(F.round(F.sum(F.col("alpha") * F.col("val")), 9).alias("val"))
    return g.top_edges(e, 50).drop("rank")


def _fused_sql(f: str, k: int = 20) -> str:
    """SQL of the k best of f (row, col, val), rows at sum 1."""
    return f"t AS (SELECT row, col, round(val, 9) AS val FROM {f} QUALIFY row_number() OVER (PARTITION BY row ORDER BY round(val, 9) DESC, col) <= {k}), z AS (SELECT row, col, val / greatest(sum(val) OVER (PARTITION BY row), 1e-12) AS val FROM t)"


# fused values have nine digits, so exact halves occur at the eighth: a trifle makes every engine round these up
_EDGES = "SELECT row, col, round(val + 1e-12, 7) AS val FROM z"


def _e(df: DataFrame) -> DataFrame:
    return df.withColumn("val", F.round(F.col("val") + 1e-12, 7))


# 127, 130
@query(f"""WITH {TWO}, r AS (SELECT view, row, sum(val * val) AS rho FROM v GROUP BY view, row), l AS (SELECT view, row, rho / greatest(sum(rho) OVER (PARTITION BY row), 1e-12) AS al FROM r),
f AS (SELECT row, col, sum(al * val) AS val FROM v JOIN l USING (view, row) WHERE al >= 1e-9 GROUP BY row, col), {_fused_sql('f')} {_EDGES}""")
def fusion_adaptive(spark: SparkSession, d: str) -> DataFrame:
    return _e(fu.fuse_adaptive(two_views(spark, d), 20))


# 116, 117
_CONS = """c AS (SELECT coalesce(a.row, b.row) AS row, count(a.val) AS n_meta, count(b.val) AS n_cont, count(*) FILTER (a.val IS NOT NULL AND b.val IS NOT NULL) AS n_intersect,
sum(CASE WHEN a.val IS NOT NULL AND b.val IS NOT NULL THEN least(a.val, b.val) ELSE 0 END) AS s, coalesce(sum(a.val), 0) AS tm, coalesce(sum(b.val), 0) AS tc FROM a FULL JOIN b ON a.row = b.row AND a.col = b.col GROUP BY 1),
cs AS (SELECT row, n_intersect / greatest(n_meta + n_cont - n_intersect, 1) AS jaccard, CASE WHEN tm > 0 AND tc > 0 THEN least(s / greatest(least(tm, tc), 1e-12), 1.0) ELSE 0 END AS wc, n_meta, n_cont, n_intersect FROM c)"""


@query(f"WITH {TWO}, {_CONS} SELECT row, round(jaccard, 8) AS jaccard, round(wc, 8) AS weighted_consistency, n_meta, n_cont, n_intersect FROM cs")
def view_consistency(spark: SparkSession, d: str) -> DataFrame:
    c = fu.consistency(scaled(spark, d, A), scaled(spark, d, B))
    return c.withColumn("jaccard", F.round("jaccard", 8)).withColumn("weighted_consistency", F.round("weighted_consistency", 8))


# 128, 131
@query(f"""WITH {TWO}, {_CONS}, r AS (SELECT view, row, sum(val * val) AS rho FROM v GROUP BY view, row), l AS (SELECT view, row, rho / greatest(sum(rho) OVER (PARTITION BY row), 1e-12) AS al FROM r),
m AS (SELECT l.view, l.row, CASE WHEN view = 'b' THEN al * (0.5 + 0.5 * (1 - coalesce(wc, 0))) ELSE al END AS al FROM l LEFT JOIN cs ON cs.row = l.row), k AS (SELECT view, row, al / greatest(sum(al) OVER (PARTITION BY row), 1e-12) AS al FROM m),
f AS (SELECT row, col, sum(al * val) AS val FROM v JOIN k USING (view, row) WHERE al >= 1e-9 GROUP BY row, col), {_fused_sql('f')} {_EDGES}""")
def fusion_adaptive_cons(spark: SparkSession, d: str) -> DataFrame:
    views = {n: materialise(e, "view") for n, e in two_views(spark, d).items()}
    v = fu.views_table(views)
    c = fu.consistency(views["a"], views["b"]).select("row", F.col("weighted_consistency").alias("c"))
    return _e(fu.fuse(v, fu.consistency_alpha(fu.adaptive_alpha(v), c, "b"), 20))


# 129, 132, 133
@query(f"WITH {TWO}, f AS (SELECT row, col, sum(0.5 * val) AS val FROM v GROUP BY row, col), {_fused_sql('f')} {_EDGES}")
def fusion_naive(spark: SparkSession, d: str) -> DataFrame:
    return _e(fu.fuse_fixed(two_views(spark, d), {"a": 0.5, "b": 0.5}, 20))


# 132: only the requested rows
@query(f"WITH {TWO}, q AS (SELECT DISTINCT row_id AS row FROM rank_requests), f AS (SELECT row, col, sum(CASE view WHEN 'a' THEN 0.7 ELSE 0.3 END * val) AS val FROM v WHERE row IN (SELECT row FROM q) GROUP BY row, col), z AS (SELECT row, col, round(val, 9) AS val FROM f QUALIFY row_number() OVER (PARTITION BY row ORDER BY round(val, 9) DESC, col) <= 20) {_EDGES}")
def fusion_requested_rows(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "rank_requests").select(F.col("row_id").alias("row")).distinct()
    views = {n: e.join(q, "row", "left_semi") for n, e in two_views(spark, d).items()}
    return _e(fu.fuse_fixed(views, {"a": 0.7, "b": 0.3}, 20, None))


# 133: four views
@query(f"""WITH {TWO}, {OW}, cg AS (SELECT a.doc AS row, b.doc AS col, 1.0 AS val FROM ow a JOIN ow b USING (owner) WHERE a.doc <> b.doc),
w AS (SELECT row, col, 0.3 * val AS val FROM a UNION ALL SELECT row, col, 0.2 * val FROM b UNION ALL SELECT row, col, 0.1 * val / sum(val) OVER (PARTITION BY row) FROM cg),
f AS (SELECT row, col, sum(val) AS val FROM w GROUP BY row, col), z AS (SELECT row, col, round(val, 9) AS val FROM f QUALIFY row_number() OVER (PARTITION BY row ORDER BY round(val, 9) DESC, col) <= 20) {_EDGES}""")
def fusion_weighted_views(spark: SparkSession, d: str) -> DataFrame:
    views = two_views(spark, d)
    views |= {"creator": creator_view(spark, d, views, 20), "off": scaled(spark, d, B)}
    return _e(fu.fuse_fixed(views, {"a": 0.3, "b": 0.2, "creator": 0.1, "off": 0.0}, 20, None))


# 134
@query(f"""WITH {TWO}, c AS (SELECT DISTINCT row FROM b), f AS (SELECT row, col, sum(CASE view WHEN 'a' THEN 0.6 ELSE 0.4 END * val) AS val FROM v WHERE row IN (SELECT row FROM c) GROUP BY row, col
UNION ALL SELECT row, col, val FROM a WHERE row NOT IN (SELECT row FROM c)), z AS (SELECT row, col, round(val, 9) AS val FROM f QUALIFY row_number() OVER (PARTITION BY row ORDER BY round(val, 9) DESC, col) <= 20) {_EDGES}""")
def fusion_selective(spark: SparkSession, d: str) -> DataFrame:
    v = two_views(spark, d)
    return _e(fu.selective(v["a"], v["b"], 0.6, v["b"].select("row"), 20))


# 135
@query(f"WITH {TWO}, r AS (SELECT row, col, 1.0 / (60 + row_number() OVER (PARTITION BY view, row ORDER BY round(val, 12) DESC, col)) AS x FROM v), f AS (SELECT row, col, sum(x) AS val FROM r GROUP BY row, col), {_fused_sql('f', 50)} {_EDGES}")
def fusion_rrf(spark: SparkSession, d: str) -> DataFrame:
    views = {n: e.withColumn("val", F.round("val", 12)) for n, e in two_views(spark, d).items()}
    return _e(fu.reciprocal_ranks(views, 50))


# 136
@query(f"WITH {TWO}, f AS (SELECT row, col, sum(val / 2) AS val FROM v GROUP BY row, col), {_fused_sql('f', 50)} {_EDGES}")
def fusion_combsum(spark: SparkSession, d: str) -> DataFrame:
    return _e(fu.comb_sum(two_views(spark, d), 50))


# 137
def _reranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    views = {n: materialise(e, "view") for n, e in two_views(spark, d).items()}
    half = fu.views_table(views).groupBy("row", "col").agg(F.round(F.sum(0.5 * F.col("val")), 9).alias("val"))
    base = materialise(g.top_edges(half, 20).drop("rank"), "base")
    t = doc_tags(spark, d).join(tag_idf(spark, d), "tag").select(F.col("row").alias("doc"), "tag", "idf")
    tot = t.groupBy("doc").agg(F.sum("idf").alias("total"))
    s = base.select("row", "col").join(t.select(F.col("doc").alias("row"), "tag", "idf"), "row").join(t.select(F.col("doc").alias("col"), "tag"), ["col", "tag"])
    s = s.groupBy("row", "col").agg(F.sum("idf").alias("s")).join(tot.select(F.col("doc").alias("row"), F.col("total").alias("a")), "row").join(tot.select(F.col("doc").alias("col"), F.col("total").alias("b")), "col")
    boost = s.select("row", "col", (F.col("s") / (F.col("a") + F.col("b") - F.col("s"))).alias("boost"))
    o = owners(spark, d)
    same = base.join(o.select(F.col("doc").alias("row"), F.col("owner").alias("x")), "row").join(o.select(F.col("doc").alias("col"), F.col("owner").alias("y")), "col").where("x = y").select("row", "col")
    return base, fu.rerank(base, views, boost, same, 0.1, 0.05, 0.02)


_RR = f"""{TWO}, {DT}, {IDF}, {OW}, f AS (SELECT row, col, round(sum(0.5 * val), 9) AS val FROM v GROUP BY row, col),
base AS (SELECT row, col, val FROM f QUALIFY row_number() OVER (PARTITION BY row ORDER BY val DESC, col) <= 20), sup AS (SELECT row, col, count(DISTINCT view) / 2 AS support FROM v GROUP BY row, col),
ti AS (SELECT dt.row AS doc, tag, idf FROM dt JOIN idf USING (tag)), tot AS (SELECT doc, sum(idf) AS total FROM ti GROUP BY doc),
sh AS (SELECT base.row, base.col, sum(x.idf) AS s FROM base JOIN ti x ON x.doc = base.row JOIN ti y ON y.doc = base.col AND y.tag = x.tag GROUP BY ALL),
bo AS (SELECT sh.row, sh.col, s / (p.total + q.total - s) AS boost FROM sh JOIN tot p ON p.doc = sh.row JOIN tot q ON q.doc = sh.col),
rr AS (SELECT base.row, base.col, base.val, base.val + 0.1 * coalesce(support, 0) + 0.05 * coalesce(boost, 0) + 0.02 * coalesce((o1.owner = o2.owner)::INT, 0) AS rr FROM base LEFT JOIN sup ON sup.row = base.row AND sup.col = base.col
LEFT JOIN bo ON bo.row = base.row AND bo.col = base.col LEFT JOIN ow o1 ON o1.doc = base.row LEFT JOIN ow o2 ON o2.doc = base.col)"""


@query(f"WITH {_RR}, z AS (SELECT row, col, rr AS val FROM rr) {_EDGES}")
def fusion_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _e(_reranked(spark, d)[1])


@query(f"WITH {_RR}, z AS (SELECT row, col, 0.7 * val + 0.3 * rr AS val FROM rr) {_EDGES}")
def fusion_blend(spark: SparkSession, d: str) -> DataFrame:
    return _e(fu.blend(*_reranked(spark, d), 0.3))


# 138
@query(f"""WITH {TWO}, r AS (SELECT view, row, 1 / (sum(val * val) + 1e-12) AS w FROM v GROUP BY view, row), l AS (SELECT view, row, w / greatest(sum(w) OVER (PARTITION BY row), 1e-12) AS al FROM r),
f AS (SELECT row, col, sum(al * val) AS val FROM v JOIN l USING (view, row) WHERE al >= 1e-9 GROUP BY row, col), t AS (SELECT row, col, round(val, 9) AS val FROM f QUALIFY row_number() OVER (PARTITION BY row ORDER BY round(val, 9) DESC, col) <= 20),
z AS (SELECT row, col, val / greatest(sqrt(sum(val * val) OVER (PARTITION BY row)), 1e-12) AS val FROM t) {_EDGES}""")
def fusion_inverse_concentration(spark: SparkSession, d: str) -> DataFrame:
    return _e(fu.fuse_adaptive(two_views(spark, d), 20, "l2", inverse=True))


# 118
@query(f"WITH {graph_sql('x', A)}, {graph_sql('y', B)}, t AS (SELECT row, col FROM x QUALIFY row_number() OVER (PARTITION BY row ORDER BY val DESC, col) <= 10 UNION SELECT row, col FROM y QUALIFY row_number() OVER (PARTITION BY row ORDER BY val DESC, col) <= 10) SELECT row, count(*) AS n_candidates FROM t GROUP BY row")
def candidate_unions(spark: SparkSession, d: str) -> DataFrame:
    from viewloom.operators.evaluate import candidate_union, top_lists

    top = top_lists({"a": graph(spark, d, A), "b": graph(spark, d, B)}, 10)
    return candidate_union(top).groupBy("row").agg(F.count("*").alias("n_candidates"))
