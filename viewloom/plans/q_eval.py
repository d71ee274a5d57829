"""Queries of the sections: metrics and evaluation, improvement, sweeps, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewloom.functions.rng import uniform, uniform_sql
from viewloom.operators import evaluate as ev
from viewloom.operators import fusion as fu
from viewloom.operators.clean import quantiles
from viewloom.operators.graph import symmetrise, top_edges
from viewloom.operators.similar import nearest
from viewloom.plans.views import DT, IDF, OG, OW, TWO, A, B, creator_view, doc_tags, graph, graph_sql, organisations, owners, scaled, tag_idf, two_views, vectors
from viewloom.session import materialise
from viewloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}
K = 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _tops(spark: SparkSession, d: str, subset: bool = False) -> DataFrame:
    v = {n: e.withColumn("val", F.round("val", 9)) for n, e in two_views(spark, d).items()}
    only = table(spark, d, "rank_requests").select(F.col("row_id").alias("row")) if subset else None
    return materialise(ev.top_lists(v, K, only), "tops")


def _sub(spark: SparkSession, d: str, *names: str) -> tuple[DataFrame, ...]:
    t = materialise(doc_tags(spark, d).select(F.col("row").alias("doc"), "tag"), "tags")
    i = materialise(tag_idf(spark, d), "idf")
    return t, i, scaled(spark, d, B), owners(spark, d)


_TOP = TWO + f""", tops AS (SELECT view AS method, row, col, val, row_number() OVER (PARTITION BY view, row ORDER BY round(val, 9) DESC, col) AS rank FROM v QUALIFY rank <= {K})"""
_TAGG = f"""{DT}, {IDF}, dw AS (SELECT dt.row AS doc, tag, idf AS w FROM dt JOIN idf USING (tag)), tt AS (SELECT doc, sum(w) AS total FROM dw GROUP BY doc),
pr AS (SELECT DISTINCT row, col FROM tops), sh AS (SELECT pr.row, pr.col, sum(x.w) AS s, count(*) AS n FROM pr JOIN dw x ON x.doc = pr.row JOIN dw y ON y.doc = pr.col AND y.tag = x.tag GROUP BY ALL),
tg AS (SELECT method, tops.row, tops.col, rank, CASE WHEN i.total + coalesce(j.total, 0) - coalesce(s, 0) > 0 THEN coalesce(s, 0) / (i.total + coalesce(j.total, 0) - coalesce(s, 0)) ELSE 0 END AS gain, (coalesce(n, 0) > 0)::INT AS rel, NULL::BIGINT AS total
FROM tops JOIN tt i ON i.doc = tops.row LEFT JOIN tt j ON j.doc = tops.col LEFT JOIN sh ON sh.row = tops.row AND sh.col = tops.col)"""
_DESC = "ds AS (SELECT tops.method, tops.row, tops.col, tops.rank, coalesce(b.val, 0) AS gain, (coalesce(b.val, 0) > 0.2)::INT AS rel, NULL::BIGINT AS total FROM tops LEFT JOIN b ON b.row = tops.row AND b.col = tops.col WHERE tops.row IN (SELECT row FROM b))"


def _own(ow: str, name: str) -> str:
    return f"""{name} AS (SELECT method, tops.row, tops.col, rank, coalesce((x.owner = y.owner)::INT, 0)::DOUBLE AS gain, coalesce((x.owner = y.owner)::INT, 0) AS rel, greatest(n - 1, 1) AS total
FROM tops JOIN {ow} x ON x.doc = tops.row JOIN (SELECT owner, count(*) AS n FROM {ow} GROUP BY owner) c ON c.owner = x.owner LEFT JOIN {ow} y ON y.doc = tops.col)"""


def _metrics(src: str, name: str, ideal: str = "idcg") -> str:
    return f"""{name}0 AS (SELECT *, row_number() OVER (PARTITION BY method, row ORDER BY gain DESC, rank) AS best, sum(rel) OVER (PARTITION BY method, row ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits FROM {src}),
{name} AS (SELECT method, row, sum(gain / log2(rank + 1)) / (sum(gain / log2(best + 1)) + 1e-12) AS ndcg, sum(CASE WHEN rel > 0 THEN hits / rank ELSE 0 END) / greatest(sum(rel), 1) AS ap, coalesce(1 / min(rank) FILTER (rel > 0), 0) AS mrr,
sum(rel) / count(*) AS precision, sum(rel) / {K} AS hits_over_k, max(rel)::DOUBLE AS hit, CASE WHEN max(total) <= 0 THEN 0 ELSE sum(rel) / max(total) END AS recall, sum(gain / log2(rank + 1)) AS dcg, max(total) AS total FROM {name}0 GROUP BY method, row)"""


# 156-163: all metrics per query
@query(f"WITH {_TOP}, {OW}, {_own('ow', 'cg')}, {_metrics('cg', 'm')} SELECT method, row, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("ndcg", "ap", "mrr", "precision", "hits_over_k", "hit", "recall")) + " FROM m")
def query_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = ev.query_metrics(ev.owner_gains(_tops(spark, d), owners(spark, d)), ["method", "row"], "total", k=K)
    return _round(m.select("method", "row", "ndcg", "ap", "mrr", "precision", "hits_over_k", "hit", "recall"))


# 165, 166, 172, 173
_ALL = f"{_TOP}, {_TAGG}, {_DESC}, {OW}, {_own('ow', 'cg')}, {_metrics('tg', 'mt')}, {_metrics('ds', 'md')}, {_metrics('cg', 'mc')}"
_DIMS = "q AS (SELECT 'tag' AS dim, method, row, ndcg, ap, mrr, precision, hits_over_k AS recall FROM mt UNION ALL SELECT 'desc', method, row, ndcg, ap, mrr, precision, hits_over_k FROM md UNION ALL SELECT 'creator', method, row, ndcg, ap, mrr, precision, recall FROM mc)"
_SCORES = "sc AS (SELECT method, dim, count(*) AS n, count(*) / 1000 AS coverage, avg(ndcg) AS ndcg, avg(ap) AS map, avg(mrr) AS mrr, avg(precision) AS precision, avg(recall) AS recall FROM q GROUP BY method, dim)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    t, i, desc, own = _sub(spark, d)
    return ev.evaluate(_tops(spark, d), t, i, desc, own, 1000, K)


@query(f"WITH {_ALL}, {_DIMS}, {_SCORES} SELECT method, dim, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("coverage", "ndcg", "map", "mrr", "precision", "recall")) + " FROM sc")
def evaluation(spark: SparkSession, d: str) -> DataFrame:
    return _round(_scores(spark, d))


# 167: per query, for the requested rows
@query(f"WITH {_TOP.replace('FROM v QUALIFY', 'FROM v WHERE row IN (SELECT row_id FROM rank_requests) QUALIFY')}, {_TAGG}, {_metrics('tg', 'mt')} SELECT method, row, round(ndcg, 6) AS ndcg, round(ap, 6) AS ap FROM mt")
def evaluation_requested_rows(spark: SparkSession, d: str) -> DataFrame:
    t, i, _, _ = _sub(spark, d)
    m = ev.query_metrics(ev.tag_gains(_tops(spark, d, True), t, i), ["method", "row"], k=K)
    return _round(m.select("method", "row", "ndcg", "ap"))


# 165, 171
_UNI = "CASE dim WHEN 'tag' THEN 0.5 WHEN 'desc' THEN 0.3 ELSE 0.2 END"


@query(f"WITH {_ALL}, {_DIMS}, {_SCORES} SELECT method, round(sum({_UNI} * ndcg), 6) AS unified, round(sum({_UNI} * coverage * ndcg) / sum({_UNI} * coverage), 6) AS unified_cov FROM sc GROUP BY method")
def unified_scores(spark: SparkSession, d: str) -> DataFrame:
    s = materialise(_scores(spark, d), "scores")
    return _round(ev.unified(s).join(ev.unified(s, by_coverage=True).withColumnRenamed("unified", "unified_cov"), "method"))


# 170
@query(f"WITH {_ALL}, {_DIMS}, {_SCORES} SELECT method, round(sum(CASE dim WHEN 'tag' THEN 1.0 WHEN 'desc' THEN 0.5 ELSE 1.5 END * ndcg) / 3, 6) AS unified, round(avg(ndcg * coverage), 6) AS unified_cov FROM sc GROUP BY method")
def unified_comprehensive(spark: SparkSession, d: str) -> DataFrame:
    s = materialise(_scores(spark, d), "scores")
    u = ev.unified(s, {"tag": 1 / 3, "desc": 0.5 / 3, "creator": 1.5 / 3})
    return _round(u.join(s.groupBy("method").agg(F.avg(F.col("ndcg") * F.col("coverage")).alias("unified_cov")), "method"))


# 168: binary relevance, ideal from all relevant documents
@query(f"WITH {_TOP}, {OG}, {_own('og', 'cg')}, {_metrics('cg', 'm')} SELECT method, row, round(dcg / ((SELECT sum(1 / log2(i + 1)) FROM generate_series(1, least({K}, m.total)) AS s(i)) + 1e-12), 6) AS ndcg FROM m")
def ndcg_global_ideal(spark: SparkSession, d: str) -> DataFrame:
    m = ev.query_metrics(ev.owner_gains(_tops(spark, d), organisations(spark, d)), ["method", "row"], "total", "total", K)
    return _round(m.select("method", "row", "ndcg"))


# 169: ideal over the candidates of all methods; gain over the query's tags
_QG = _TAGG.replace("CASE WHEN i.total + coalesce(j.total, 0) - coalesce(s, 0) > 0 THEN coalesce(s, 0) / (i.total + coalesce(j.total, 0) - coalesce(s, 0)) ELSE 0 END", "CASE WHEN i.total > 0 THEN round(coalesce(s, 0) / i.total, 9) ELSE 0 END")


@query(f"""WITH {_TOP}, {_QG}, dg AS (SELECT method, row, sum(gain / log2(rank + 1)) AS dcg, count(*) AS size FROM tg GROUP BY ALL), cd AS (SELECT DISTINCT row, col, gain FROM tg),
bs AS (SELECT row, gain, row_number() OVER (PARTITION BY row ORDER BY gain DESC, col) AS rk FROM cd) SELECT dg.method, dg.row, round(max(dcg) / (sum(gain / log2(rk + 1)) + 1e-12), 6) AS ndcg FROM dg JOIN bs ON bs.row = dg.row AND rk <= size GROUP BY dg.method, dg.row""")
def ndcg_candidate_union(spark: SparkSession, d: str) -> DataFrame:
    t, i, _, _ = _sub(spark, d)
    gains = materialise(ev.tag_gains(_tops(spark, d), t, i, form="query").withColumn("gain", F.round("gain", 9)), "gains")
    return _round(ev.ndcg_over_candidates(gains, gains.select("row", "col", "gain").distinct()))


# 174: whole against requested rows
@query(f"""WITH {_TOP}, {_TAGG}, {_metrics('tg', 'mt')}, x AS (SELECT 'global' AS scope, * FROM mt UNION ALL SELECT 'subset', * FROM mt WHERE row IN (SELECT row_id FROM rank_requests)) SELECT scope, method, count(*) AS n, round(avg(ndcg), 6) AS ndcg FROM x GROUP BY ALL""")
def global_against_subset(spark: SparkSession, d: str) -> DataFrame:
    t, i, _, _ = _sub(spark, d)
    m = materialise(ev.query_metrics(ev.tag_gains(_tops(spark, d), t, i), ["method", "row"], k=K), "metrics")
    q = table(spark, d, "rank_requests").select(F.col("row_id").alias("row")).distinct()
    x = m.withColumn("scope", F.lit("global")).unionByName(m.join(q, "row", "left_semi").withColumn("scope", F.lit("subset")))
    return _round(x.groupBy("scope", "method").agg(F.count("*").alias("n"), F.avg("ndcg").alias("ndcg")))


# 91
@query(f"WITH {_TOP}, {OW}, {_own('ow', 'cg')}, {_metrics('cg', 'm')} SELECT method, round(coalesce(avg(ndcg), 0), 6) AS ndcg, round(coalesce(avg(recall), 0), 6) AS recall FROM m GROUP BY method")
def metric_means(spark: SparkSession, d: str) -> DataFrame:
    m = ev.query_metrics(ev.owner_gains(_tops(spark, d), owners(spark, d)), ["method", "row"], "total", k=K)
    return m.groupBy("method").agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in ("ndcg", "recall")])


# 176
@query(f"WITH {_ALL}, {_DIMS}, {_SCORES}, u AS (SELECT method, sum({_UNI} * ndcg) AS unified FROM sc GROUP BY method) SELECT method, round(unified, 6) AS unified, round((unified - (SELECT unified FROM u WHERE method = 'a')) * 100 / abs((SELECT unified FROM u WHERE method = 'a')), 4) AS improvement FROM u")
def improvement(spark: SparkSession, d: str) -> DataFrame:
    s = ev.improvement(materialise(ev.unified(_scores(spark, d)), "unified"), "a", "unified")
    return s.select("method", F.round("unified", 6).alias("unified"), F.round("improvement", 4).alias("improvement"))


# 177, 99: weights as a column, one job for all
def _sweep(spark: SparkSession, d: str) -> DataFrame:
    weights = [round(0.1 * k, 1) for k in range(1, 10)]
    v = {n: materialise(e, "view") for n, e in two_views(spark, d).items()}
    w = spark.createDataFrame([(x,) for x in weights], "weight double")
    e = fu.views_table(v).crossJoin(F.broadcast(w))
    e = e.groupBy("weight", "row", "col").agg(F.round(F.sum(F.when(F.col("view") == "a", F.col("weight")).otherwise(1 - F.col("weight")) * F.col("val")), 9).alias("val"))
    e = e.withColumn("method", F.format_string("w%.1f", F.col("weight")))
    top = e.withColumn("rank", F.row_number().over(Window.partitionBy("method", "row").orderBy(F.desc("val"), "col"))).where(F.col("rank") <= K)
    m = ev.query_metrics(ev.owner_gains(materialise(top.select("method", "row", "col", "val", "rank"), "sweep"), owners(spark, d)), ["method", "row"], "total", k=K)
    return m.groupBy("method").agg(F.count("*").alias("n"), F.avg("ndcg").alias("ndcg"))


_SWEEP = f"""{TWO}, {OW}, ws AS (SELECT 'w0.' || i AS method, round(0.1 * i, 1)::DOUBLE AS weight FROM generate_series(1, 9) AS s(i)), e AS (SELECT method, row, col, round(sum(CASE view WHEN 'a' THEN weight ELSE 1 - weight END * val), 9) AS val FROM v CROSS JOIN ws GROUP BY ALL),
tops AS (SELECT method, row, col, val, row_number() OVER (PARTITION BY method, row ORDER BY val DESC, col) AS rank FROM e QUALIFY rank <= {K}), {_own('ow', 'cg')}, {_metrics('cg', 'm')}, sw AS (SELECT method, count(*) AS n, avg(ndcg) AS ndcg FROM m GROUP BY method)"""


@query(f"WITH {_SWEEP} SELECT method, n, round(ndcg, 4) AS ndcg FROM sw")
def weight_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _round(_sweep(spark, d), 4)


@query(f"WITH {_SWEEP} SELECT arg_max(method, (round(ndcg, 4), method)) AS method, round(max(ndcg), 4) AS ndcg FROM sw")
def best_weight(spark: SparkSession, d: str) -> DataFrame:
    s = _round(_sweep(spark, d), 4)
    return s.agg(F.max(F.struct("ndcg", "method")).alias("b")).select(F.col("b.method").alias("method"), F.col("b.ndcg").alias("ndcg"))


# 180: five weight sets over four views
_GRID = [(1, 0, 0, 0), (0.5, 0.5, 0, 0), (0.4, 0.3, 0.1, 0.2), (0.25, 0.25, 0.25, 0.25), (0.2, 0.5, 0.1, 0.2)]
_GRID_SQL = f"""{TWO}, {graph_sql('av0', B)}, av1 AS (SELECT row, col, sum(val) / 2 AS val FROM (SELECT row, col, val FROM av0 UNION ALL SELECT col, row, val FROM av0) GROUP BY row, col),
{OW}, cr AS (SELECT a.doc AS row, b.doc AS col, 1.0 / (count(*) OVER (PARTITION BY a.doc)) AS val FROM ow a JOIN ow b USING (owner) WHERE a.doc <> b.doc),
v4 AS (SELECT * FROM v UNION ALL SELECT 'avg', row, col, val / greatest(sum(val) OVER (PARTITION BY row), 1e-12) FROM av1 WHERE val <> 0 AND row <> col UNION ALL SELECT 'creator', row, col, val FROM cr),
ws AS (SELECT * FROM (VALUES {", ".join(f"('g{i}', '{n}', {float(w)})" for i, ws in enumerate(_GRID) for n, w in zip(("a", "b", "avg", "creator"), ws, strict=True) if w)}) AS t(method, view, w)),
e AS (SELECT method, row, col, round(sum(w * val), 9) AS val FROM v4 JOIN ws USING (view) GROUP BY ALL), tops AS (SELECT method, row, col, val, row_number() OVER (PARTITION BY method, row ORDER BY val DESC, col) AS rank FROM e QUALIFY rank <= {K})"""


@query(f"WITH {_GRID_SQL}, {_TAGG}, {_metrics('tg', 'mt')} SELECT method, count(*) AS n, round(avg(ndcg), 5) AS ndcg FROM mt GROUP BY method")
def four_view_grid(spark: SparkSession, d: str) -> DataFrame:
    v = {n: materialise(e, "view") for n, e in two_views(spark, d).items()}
    v["avg"] = materialise(symmetrise(graph(spark, d, B), "avg"), "view")
    v["creator"] = materialise(creator_view(spark, d, v, K), "view")
    sets = [(f"g{i}", n, float(w)) for i, ws in enumerate(_GRID) for n, w in zip(v, ws, strict=True) if w > 0]
    w = spark.createDataFrame(sets, "method string, view string, w double")
    e = fu.views_table(v).join(F.broadcast(w), "view").groupBy("method", "row", "col").agg(F.round(F.sum(F.col("w") * F.col("val")), 9).alias("val"))
    top = e.withColumn("rank", F.row_number().over(Window.partitionBy("method", "row").orderBy(F.desc("val"), "col"))).where(F.col("rank") <= K)
    t, i, _, _ = _sub(spark, d)
    m = ev.query_metrics(ev.tag_gains(materialise(top, "grid"), t, i), ["method", "row"], k=K)
    return _round(m.groupBy("method").agg(F.count("*").alias("n"), F.avg("ndcg").alias("ndcg")), 5)


# 178, 155: selective fusion on the content rows and on these among more and more other rows
@query(f"""WITH {TWO}, {OW}, c AS (SELECT DISTINCT row FROM b), f AS (SELECT row, col, sum(CASE view WHEN 'a' THEN 0.6 ELSE 0.4 END * val) AS val FROM v WHERE row IN (SELECT row FROM c) GROUP BY row, col UNION ALL SELECT row, col, val FROM a WHERE row NOT IN (SELECT row FROM c)),
x AS (SELECT row, row_number() OVER (ORDER BY {uniform_sql(42, 'row')}, row) AS rn FROM (SELECT DISTINCT row FROM a WHERE row NOT IN (SELECT row FROM c))),
sz AS (SELECT unnest([0, 100, 500]) AS extra), sub AS (SELECT extra, row FROM sz, c UNION ALL SELECT extra, row FROM sz JOIN x ON rn <= extra),
tops AS (SELECT 'selective' AS method, row, col, val, row_number() OVER (PARTITION BY row ORDER BY round(val, 9) DESC, col) AS rank FROM f QUALIFY rank <= {K}), {_own('ow', 'cg')}, {_metrics('cg', 'm')}
SELECT extra, count(*) AS n, round(avg(ndcg), 5) AS ndcg FROM m JOIN sub USING (row) GROUP BY extra""")
def dilution_sizes(spark: SparkSession, d: str) -> DataFrame:
    sizes = [0, 100, 500]
    v = {n: materialise(e, "view") for n, e in two_views(spark, d).items()}
    c = materialise(v["b"].select("row").distinct(), "rows")
    e = materialise(fu.selective(v["a"], v["b"], 0.6, c, K), "selective")
    u = uniform(42, "row")
    extra = v["a"].select("row").distinct().join(c, "row", "left_anti").orderBy(u, "row").limit(max(sizes))
    extra = extra.withColumn("rn", F.row_number().over(Window.orderBy(u, "row")))  # at most the largest size
    sz = F.broadcast(spark.createDataFrame([(s,) for s in sizes], "extra int"))
    sub = c.crossJoin(sz).select("extra", "row").unionByName(extra.join(sz, F.col("rn") <= F.col("extra")).select("extra", "row"))
    m = ev.query_metrics(ev.owner_gains(ev.top_lists({"selective": e}, K), owners(spark, d)), ["method", "row"], "total", k=K)
    return _round(m.join(sub, "row").groupBy("extra").agg(F.count("*").alias("n"), F.avg("ndcg").alias("ndcg")), 5)


# 181: search once at the largest k
_KS = [20, 30, 50, 75, 100]


@query(
    "WITH x AS (SELECT vec_id AS id, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM embeddings), u AS (SELECT id, list_transform(v, lambda e: e / sqrt(list_dot_product(v, v))) AS v FROM x), "
    + "nn AS (SELECT a.id AS row, b.id AS col, round(list_dot_product(a.v, b.v), 9) AS val, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.v, b.v), 9) DESC, b.id) AS r FROM u a, u b WHERE a.id <> b.id QUALIFY r <= 100), "
    + "e AS (SELECT k, row, col, val FROM nn, (VALUES (20), (30), (50), (75), (100)) AS s(k) WHERE r <= k), s1 AS (SELECT k, row, col, CASE WHEN count(*) < 2 THEN greatest(max(val), 0.0) ELSE max(val) END AS val "
    + "FROM (SELECT k, row, col, val FROM e UNION ALL SELECT k, col, row, val FROM e) GROUP BY k, row, col), "
    + "s2 AS (SELECT k, row, col, round(val / greatest(sum(val) OVER (PARTITION BY k, row), 1e-12), 9) AS val FROM s1 WHERE val <> 0), "
    + f"tops AS (SELECT 'k' || k AS method, row, col, val, row_number() OVER (PARTITION BY k, row ORDER BY val DESC, col) AS rank FROM s2 QUALIFY rank <= {K}), ow AS (SELECT vec_id AS doc, label + 1 AS owner FROM embeddings), "
    + f"{_own('ow', 'cg')}, {_metrics('cg', 'm')} SELECT method, round(avg(ndcg), 5) AS ndcg, round(avg(precision), 5) AS precision FROM m GROUP BY method"
)
def k_sweep(spark: SparkSession, d: str) -> DataFrame:
    e = materialise(nearest(vectors(spark, d), max(_KS)), "knn")
    label = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), (F.col("label") + 1).alias("owner"))
    tops = {f"k{k}": symmetrise(top_edges(e, k).drop("rank")).withColumn("val", F.round("val", 9)) for k in _KS}
    m = ev.query_metrics(ev.owner_gains(materialise(ev.top_lists(tops, K), "tops"), label), ["method", "row"], "total", k=K)
    return _round(m.groupBy("method").agg(F.avg("ndcg").alias("ndcg"), F.avg("precision").alias("precision")), 5)


# 178, 179: selective fusion where the content is good enough
@query(f"""WITH {TWO}, {OW}, qu AS (SELECT row, sum(val * val) AS q FROM b GROUP BY row), lim AS (SELECT quantile_cont(q, 0.5) AS l FROM qu), c AS (SELECT row FROM qu, lim WHERE round(q, 9) >= round(l, 9)),
f AS (SELECT row, col, sum(CASE view WHEN 'a' THEN 0.6 ELSE 0.4 END * val) AS val FROM v WHERE row IN (SELECT row FROM c) GROUP BY row, col UNION ALL SELECT row, col, val FROM a WHERE row NOT IN (SELECT row FROM c)),
tops AS (SELECT 'selective' AS method, row, col, val, row_number() OVER (PARTITION BY row ORDER BY round(val, 9) DESC, col) AS rank FROM f QUALIFY rank <= {K}), {_own('ow', 'cg')}, {_metrics('cg', 'm')} SELECT method, count(*) AS n, round(avg(ndcg), 4) AS ndcg FROM m GROUP BY method""")
def quality_filtered_fusion(spark: SparkSession, d: str) -> DataFrame:
    v = {n: materialise(e, "view") for n, e in two_views(spark, d).items()}
    q = v["b"].groupBy("row").agg(F.sum(F.col("val") * F.col("val")).alias("q"))
    lim = quantiles(q, [], "q", {"l": 0.5})
    good = q.crossJoin(F.broadcast(lim)).where(F.round("q", 9) >= F.round("l", 9)).select("row")
    e = fu.selective(v["a"], v["b"], 0.6, good, K).withColumn("val", F.round("val", 9))
    m = ev.query_metrics(ev.owner_gains(ev.top_lists({"selective": e}, K), owners(spark, d)), ["method", "row"], "total", k=K)
    return _round(m.groupBy("method").agg(F.count("*").alias("n"), F.avg("ndcg").alias("ndcg")), 4)


def _wide(spark: SparkSession, d: str) -> DataFrame:
    m = ev.query_metrics(ev.owner_gains(_tops(spark, d), owners(spark, d)), ["method", "row"], "total", k=K)
    return m.groupBy("row").pivot("method", ["a", "b"]).agg(F.first(F.round("ndcg", 6)))


_W = f"{_TOP}, {OW}, {_own('ow', 'cg')}, {_metrics('cg', 'm')}, w AS (SELECT row, max(round(ndcg, 6)) FILTER (method = 'a') AS a, max(round(ndcg, 6)) FILTER (method = 'b') AS b FROM m GROUP BY row)"


# 183
@query(f"WITH {_W} SELECT count(*) AS n, count(*) FILTER (b - a > 0.01) AS n_better, count(*) FILTER (b - a < -0.01) AS n_worse, round(avg(greatest(a, b)), 6) AS best_single FROM w WHERE a IS NOT NULL AND b IS NOT NULL")
def per_doc_comparison(spark: SparkSession, d: str) -> DataFrame:
    x = _wide(spark, d).where("a is not null and b is not null").withColumn("delta", F.col("b") - F.col("a"))
    return x.agg(F.count("*").alias("n"), F.count_if(F.col("delta") > 0.01).alias("n_better"), F.count_if(F.col("delta") < -0.01).alias("n_worse"), F.round(F.avg(F.greatest("a", "b")), 6).alias("best_single"))


# 109
@query(f"WITH {_W}, x AS (SELECT row, round(b - a, 6) AS delta FROM w WHERE a IS NOT NULL AND b IS NOT NULL) (SELECT 'best' AS side, row, delta FROM x ORDER BY delta DESC, row LIMIT 10) UNION ALL (SELECT 'worst', row, delta FROM x ORDER BY delta, row LIMIT 10)")
def best_and_worst(spark: SparkSession, d: str) -> DataFrame:
    x = _wide(spark, d).where("a is not null and b is not null").select("row", F.round(F.col("b") - F.col("a"), 6).alias("delta"))
    best = x.orderBy(F.desc("delta"), "row").limit(10).select(F.lit("best").alias("side"), "row", "delta")
    return best.unionByName(x.orderBy("delta", "row").limit(10).select(F.lit("worst").alias("side"), "row", "delta"))


# 97
@query("SELECT round(corr(TotalViews_log1p, TotalDownloads_log1p), 8) AS pearson FROM beh_base WHERE TotalViews_log1p IS NOT NULL AND TotalDownloads_log1p IS NOT NULL AND TotalViews_log1p::VARCHAR <> 'nan' AND TotalDownloads_log1p::VARCHAR <> 'nan'")
def correlation(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "beh_base").where("TotalViews_log1p is not null and TotalDownloads_log1p is not null and not isnan(TotalViews_log1p) and not isnan(TotalDownloads_log1p)")
    return b.agg(F.round(F.corr("TotalViews_log1p", "TotalDownloads_log1p"), 8).alias("pearson"))


# 98: right-closed bins, 0 lies outside
@query(f"WITH {TWO}, x AS (SELECT row, val FROM b) SELECT CASE WHEN val > 0 AND val <= 0.001 THEN 1 WHEN val > 0.001 AND val <= 0.005 THEN 2 WHEN val > 0.005 AND val <= 0.01 THEN 3 WHEN val > 0.01 AND val <= 1 THEN 4 END AS bin, count(*) AS n, round(avg(val), 8) AS mean FROM x GROUP BY bin")
def binned_means(spark: SparkSession, d: str) -> DataFrame:
    x, v = scaled(spark, d, B), F.col("val")
    edges = [0.0, 0.001, 0.005, 0.01, 1.0]
    b = F.when((v > edges[0]) & (v <= edges[1]), 1)
    for i in range(1, 4):
        b = b.when((v > edges[i]) & (v <= edges[i + 1]), i + 1)
    return x.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("val"), 8).alias("mean"))


# 92, 93
@query(f"WITH {_ALL}, {_DIMS}, {_SCORES} SELECT method, round(max(ndcg) FILTER (dim = 'tag'), 6) AS tag, round(max(ndcg) FILTER (dim = 'desc'), 6) AS \"desc\", round(max(ndcg) FILTER (dim = 'creator'), 6) AS creator FROM sc GROUP BY method")
def score_pivot(spark: SparkSession, d: str) -> DataFrame:
    return _round(_scores(spark, d).groupBy("method").pivot("dim", ["tag", "desc", "creator"]).avg("ndcg"))


# 184
@query(f"WITH {_ALL}, {_DIMS}, {_SCORES} SELECT method, dim, 'ndcg' AS metric, round(ndcg, 6) AS value FROM sc UNION ALL SELECT method, dim, 'mrr', round(mrr, 6) FROM sc")
def score_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return _round(_scores(spark, d).select("method", "dim", "ndcg", "mrr").unpivot(["method", "dim"], ["ndcg", "mrr"], "metric", "value"))


# 96, 186
@query(f"WITH {_ALL}, {_DIMS}, {_SCORES} SELECT method, round(stddev_pop(ndcg), 6) AS balance FROM sc GROUP BY method")
def dimension_balance(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).groupBy("method").agg(F.round(F.stddev_pop("ndcg"), 6).alias("balance"))


@query(f"""WITH {_ALL}, {_DIMS}, {_SCORES}, l AS (SELECT method, list_reverse_sort(list(ndcg)) AS s FROM sc GROUP BY method)
SELECT method, round(s[1] + greatest((s[1] - s[2]) * 0.1, s[1] * 0.005), 6) AS oracle FROM l""")
def oracle_score(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d).groupBy("method").agg(F.sort_array(F.collect_list("ndcg"), asc=False).alias("s"))
    best, second = F.col("s")[0], F.col("s")[1]
    return s.select("method", F.round(best + F.greatest((best - second) * 0.1, best * 0.005), 6).alias("oracle"))


# 185
@query(f"""WITH {_ALL}, {_DIMS}, {_SCORES}, u AS (SELECT method, 1 AS run, max(ndcg) FILTER (dim = 'desc') AS de, max(ndcg) FILTER (dim = 'creator') AS cr FROM sc GROUP BY method UNION ALL SELECT method, 2, NULL, max(ndcg) FILTER (dim = 'creator') FROM sc GROUP BY method)
SELECT method, run, round(coalesce(de, cr), 6) AS score FROM u QUALIFY row_number() OVER (PARTITION BY method ORDER BY run DESC) = 1""")
def merged_metric_table(spark: SparkSession, d: str) -> DataFrame:
    from viewloom.operators.clean import keep_last

    p = materialise(_scores(spark, d).groupBy("method").pivot("dim", ["desc", "creator"]).agg(F.max("ndcg")), "pivot")
    runs = p.withColumn("run", F.lit(1)).unionByName(p.withColumn("run", F.lit(2)).withColumn("desc", F.lit(None).cast("double")))
    return keep_last(runs, "method", "run").select("method", "run", F.round(F.coalesce("desc", "creator"), 6).alias("score"))


# 77
@query(f"WITH {TWO}, qu AS (SELECT row, sum(val * val) AS q FROM b GROUP BY row) SELECT round(quantile_cont(q, 0.1), 8) AS p10, round(quantile_cont(q, 0.25), 8) AS p25, round(quantile_cont(q, 0.5), 8) AS p50, round(quantile_cont(q, 0.75), 8) AS p75 FROM qu")
def quality_thresholds(spark: SparkSession, d: str) -> DataFrame:
    q = scaled(spark, d, B).groupBy("row").agg(F.sum(F.col("val") * F.col("val")).alias("q"))
    return _round(quantiles(q, [], "q", {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75}), 8)


__all__ = ["A", "ORACLES", "QUERIES"]
