"""Queries of the sections: column profiles, descriptions, quality, dataset vectors, manifests, streams."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.operators import content as co
from viewloom.operators import evaluate as ev
from viewloom.operators import profile as pr
from viewloom.operators.fusion import fuse_adaptive
from viewloom.operators.graph import symmetrise
from viewloom.plans.views import A, doc_tags, graph, owners, tag_idf
from viewloom.session import materialise, scratch, shared_dir
from viewloom.sources import edges as ed
from viewloom.sources import files
from viewloom.sources.tables import table
from viewloom.streaming import counters

QUERIES: dict = {}
ORACLES: dict = {}

_COLS = ["Id", "Title", "Slug", "CreationDate", "TotalViews", "TotalVotes", "Medal", "Subtitle", "Description"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _long(spark: SparkSession, d: str) -> DataFrame:
    return pr.long_columns(table(spark, d, "metadata_merged_raw"), cols=_COLS)


_LONG = "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col_name, {c}::VARCHAR AS value FROM metadata_merged_raw" for c in _COLS) + ")"


# 74, 75
@query(f"""WITH {_LONG}, x AS (SELECT *, try_cast(value AS DOUBLE) AS num, CASE WHEN regexp_full_match(value, '[0-9]{{4}}-.*') THEN try_cast(value AS TIMESTAMP) END AS t FROM l),
g AS (SELECT col_name, count(*) AS n, count(value) AS ok, count(DISTINCT value) AS n_unique, count(num) AS n_num, count(t) AS n_t, min(num) AS num_min, max(num) AS num_max, median(num) AS num_median, avg(num) AS num_mean, stddev_samp(num) AS num_std,
avg(length(value)) AS avg_len, max(length(value)) AS max_len, min(t)::DATE AS earliest, max(t)::DATE AS latest FROM x GROUP BY col_name),
k AS (SELECT *, CASE WHEN ok = 0 THEN 'categorical' WHEN n_num / ok >= 0.95 THEN 'numeric' WHEN n_t / ok >= 0.9 THEN 'datetime' WHEN avg_len >= 30 THEN 'text' ELSE 'categorical' END AS dtype FROM g)
SELECT col_name, dtype, round((n - ok) / n * 100, 6) AS missing_pct, n_unique, round(n_unique * 100.0 / ok, 6) AS unique_pct, CASE WHEN dtype = 'numeric' THEN num_min END AS num_min, CASE WHEN dtype = 'numeric' THEN num_max END AS num_max,
CASE WHEN dtype = 'numeric' THEN num_median END AS num_median, round(CASE WHEN dtype = 'numeric' THEN num_mean END, 6) AS num_mean, round(CASE WHEN dtype = 'numeric' THEN num_std END, 4) AS num_std, CASE WHEN dtype = 'datetime' THEN latest - earliest END::INT AS span_days,
round(CASE WHEN dtype = 'text' THEN avg_len END, 6) AS avg_len, CASE WHEN dtype = 'text' THEN max_len END AS max_len FROM k""")
def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    p = pr.profile(_long(spark, d))
    num = {"missing_pct": 6, "unique_pct": 6, "num_mean": 6, "num_std": 4, "avg_len": 6}
    cols = ["col_name", "dtype", "missing_pct", "n_unique", "unique_pct", "num_min", "num_max", "num_median", "num_mean", "num_std", "span_days", "avg_len", "max_len"]
    return p.select(*[F.round(c, num[c]).alias(c) if c in num else F.col(c) for c in cols])


@query(f"WITH {_LONG}, c AS (SELECT col_name, value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY col_name ORDER BY n DESC, value)::INT AS rank FROM c QUALIFY rank <= 5")
def top_values(spark: SparkSession, d: str) -> DataFrame:
    return pr.top_values(_long(spark, d))


# 42
@query()
def sampled_table(spark: SparkSession, d: str) -> DataFrame:
    s = pr.sample_table(table(spark, d, "metadata_merged_raw").orderBy("Id", "Title"), 1024, 8)
    return spark.createDataFrame([(c,) for c in s.columns], "col_name string")


# 192, 197
@query()
def column_descriptions(spark: SparkSession, d: str) -> DataFrame:
    long = materialise(_long(spark, d), "long")
    return pr.describe(pr.profile(long), pr.top_values(long))


def _per_creator(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of the tables that one creator's datasets form: many small tables in one job."""
    m = table(spark, d, "metadata_merged_raw").where("CreatorUserId > 0").select("CreatorUserId", "TotalViews", "TotalVotes", "Medal", "Subtitle", "Title")
    return pr.profile(pr.long_columns(m, ["CreatorUserId"]), ["CreatorUserId"])


# 76
_PC = "l AS (" + " UNION ALL ".join(f"SELECT CreatorUserId, '{c}' AS col_name, {c}::VARCHAR AS value FROM metadata_merged_raw WHERE CreatorUserId > 0" for c in ("TotalViews", "TotalVotes", "Medal", "Subtitle", "Title")) + ")"


@query(f"""WITH {_PC}, g AS (SELECT CreatorUserId, col_name, count(*) AS n, count(value) AS ok, count(DISTINCT value) AS u, count(try_cast(value AS DOUBLE)) AS nn FROM l GROUP BY ALL), p AS (SELECT CreatorUserId, (ok > 0 AND nn / ok >= 0.95)::INT AS num, (n - ok) / n AS miss, CASE WHEN ok > 0 THEN u / ok ELSE 0 END AS uniq FROM g),
q AS (SELECT CreatorUserId, count(*) AS n_cols, avg(num) AS numeric_ratio, avg(miss) AS mean_missing, least(avg(uniq), 0.95) AS mean_unique FROM p GROUP BY CreatorUserId)
SELECT CreatorUserId, n_cols, round(numeric_ratio, 6) AS numeric_ratio, round(mean_missing, 6) AS mean_missing, round(mean_unique, 6) AS mean_unique, round(n_cols * greatest(numeric_ratio, 0.1) * (1 - mean_missing) * greatest(mean_unique, 0.01), 6) AS quality FROM q""")
def content_quality(spark: SparkSession, d: str) -> DataFrame:
    q = pr.quality(_per_creator(spark, d), "CreatorUserId")
    return q.select("CreatorUserId", "n_cols", *[F.round(c, 6).alias(c) for c in ("numeric_ratio", "mean_missing", "mean_unique", "quality")])


# 73: a weighted mean of vectors
@query("""WITH x AS (SELECT label AS key, list_transform(embedding, lambda e: e::DOUBLE) AS v, CASE vec_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 ELSE 1.2 END * greatest((1 - (vec_id % 50) / 100.0) * least((vec_id % 100 + 1) / 100.0, 0.95), 1e-6) AS w FROM embeddings),
e AS (SELECT key, w, unnest(v) AS e, generate_subscripts(v, 1) AS pos FROM x), m AS (SELECT key, pos, sum(w * e) / sum(w) AS e FROM e GROUP BY key, pos) SELECT key, pos::INT AS pos, round(e / sqrt(sum(e * e) OVER (PARTITION BY key)), 8) AS e FROM m""")
def dataset_vectors(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(t) for t in ("numeric", "categorical", "datetime", "text")]), (F.col("vec_id") % 4 + 1).cast("int"))
    c = table(spark, d, "embeddings").select(
        F.col("label").alias("key"), F.col("embedding").cast("array<double>").alias("v"), kind.alias("dtype"), (F.col("vec_id") % 50).cast("double").alias("missing_pct"), (F.col("vec_id") % 100 + 1).cast("double").alias("unique_pct")
    )
    v = pr.dataset_vectors(c, "key").select("key", F.posexplode("v").alias("at", "e"))
    return v.select("key", (F.col("at") + 1).alias("pos"), F.round("e", 8).alias("e"))


_TABLE = ["TotalViews", "TotalVotes", "Medal", "Subtitle", "Title"]


def _content_vectors(spark: SparkSession, d: str, budgets: list[tuple[str, int, int]]) -> DataFrame:
    """(label, id, v): vectors of the tables that one creator's datasets form, under each budget of rows and columns."""
    m = table(spark, d, "metadata_merged_raw").where("CreatorUserId > 0").select("CreatorUserId", "Id", *_TABLE)
    b = spark.createDataFrame(budgets, "label string, max_rows int, max_cols int")
    keys = ["label", "max_cols", "CreatorUserId"]
    rows = co.table_rows(m, ["CreatorUserId"], [F.asc("Id"), *[F.asc(c) for c in _TABLE]], b).drop("Id")
    v = co.table_vectors(co.column_profiles(rows, keys, "max_cols"), keys, dim=32)
    return materialise(v.select("label", F.col("CreatorUserId").alias("id"), "v"), "vectors")


# 189, 193: sample, profile, describe, encode, aggregate, neighbours
@query()
def content_view(spark: SparkSession, d: str) -> DataFrame:
    v = _content_vectors(spark, d, [("all", 1024, 60)]).select("id", "v")
    return co.content_graph(v, 10).withColumn("val", F.round("val", 6))


# 182: the content view under each budget of rows and columns, alone and fused with the graph of the creators' documents
@query()
def content_ablation(spark: SparkSession, d: str) -> DataFrame:
    budgets = [("rows 2", 2, 60), ("rows 16", 16, 60), ("whole", 1024, 60), ("columns 2", 1024, 2)]
    v = _content_vectors(spark, d, budgets)
    o = materialise(owners(spark, d), "owners")
    pairs = graph(spark, d, A).join(o.select(F.col("doc").alias("row"), F.col("owner").alias("a")), "row").join(o.select(F.col("doc").alias("col"), F.col("owner").alias("b")), "col")
    meta = materialise(symmetrise(pairs.where("a <> b").groupBy(F.col("a").alias("row"), F.col("b").alias("col")).agg(F.sum("val").alias("val"))), "meta")
    methods = {"meta": meta}
    for label, _, _ in budgets:
        g = materialise(co.content_graph(v.where(F.col("label") == label).select("id", "v"), 20, in_cells=False), "content")
        methods |= {f"content, {label}": g, f"fused, {label}": fuse_adaptive({"meta": meta, "content": g}, 20)}
    t = doc_tags(spark, d).join(o.withColumnRenamed("doc", "row"), "row").select(F.col("owner").alias("doc"), "tag").distinct()
    tops = materialise(ev.top_lists({n: e.withColumn("val", F.round("val", 9)) for n, e in methods.items()}, 10), "tops")
    m = ev.query_metrics(ev.tag_gains(tops, materialise(t, "tags"), tag_idf(spark, d)), ["method", "row"], k=10)
    return m.groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("ndcg"), 5).alias("ndcg"), F.round(F.avg("precision"), 5).alias("precision"))


# 8-14, 198: written in parts and read by the manifest
@query("SELECT count(*) AS n, round(sum(val), 6) AS total FROM (SELECT row, col, max(val) AS val FROM s_fused3_symrow WHERE row IS NOT NULL AND col IS NOT NULL AND row <> col AND val IS NOT NULL AND val::VARCHAR <> 'nan' GROUP BY row, col)")
def edge_round_trip(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "edges")
    ed.save_edges(graph(spark, d, A), folder, "S_a", 50, 1, part_rows=1000)
    e, _ = ed.load_graph(spark, folder, "S_a", 50)
    return e.agg(F.count("*").alias("n"), F.round(F.sum("val"), 6).alias("total"))


# 3, 19: written as CSV and read back, rows that don't fit left out
@query("SELECT count(*) AS n, sum(Id)::BIGINT AS ids FROM datasets WHERE Id IS NOT NULL")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    table(spark, d, "datasets").where("Id is not null").select("Id", "TotalViews").write.mode("overwrite").csv(path, header=True)
    t = files.read_csv(spark, path, "Id bigint, TotalViews bigint", bad_rows="drop")
    return t.agg(F.count("*").alias("n"), F.sum("Id").alias("ids"))


# 20: the second call reads what the first one wrote
@query("SELECT count(*) AS n FROM tags")
def resumed_stage(spark: SparkSession, d: str) -> DataFrame:
    # the same path for the same data folder, so that a later driver finds the stage
    path = f"{shared_dir(spark)}/stage-{hashlib.md5(d.encode()).hexdigest()}"
    files.stage_table(spark, path, lambda: table(spark, d, "tags"))
    return files.stage_table(spark, path, lambda: table(spark, d, "tags").limit(0)).agg(F.count("*").alias("n"))


# behaviour counters over the event table, the same as on a stream
@query("SELECT date_trunc('hour', ts) AS window_start, user_id, count(*) AS n_events, round(sum(value), 6) AS value_sum FROM events GROUP BY ALL")
def engagement_windows(spark: SparkSession, d: str) -> DataFrame:
    e = counters.engagement(table(spark, d, "events"))
    return e.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id", "n_events", F.round("value_sum", 6).alias("value_sum"))


