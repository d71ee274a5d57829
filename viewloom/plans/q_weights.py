"""Queries of the sections: vocabularies, weights, inverted-index similarity, tag statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.functions.text import tokens
from viewloom.functions.vector import norm
from viewloom.operators import graph as g
from viewloom.operators import similar, tagstats, weights
from viewloom.operators.clean import quantiles
from viewloom.plans.views import DT, IDF, OW, TF, TX, doc_tags, doc_texts, owners, tag_idf, vectors, words
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


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """(row, col = tag) of the tags in 10 documents or more."""
    t = materialise(doc_tags(spark, d), "tags")
    v = t.groupBy("tag").agg(F.count("*").alias("df")).where("df >= 10").select("tag")
    return t.join(v, "tag", "left_semi").select("row", F.col("tag").alias("col"))


_E = DT + ", e AS (SELECT row, tag AS col FROM dt WHERE tag IN (SELECT tag FROM dt GROUP BY tag HAVING count(*) >= 10))"
_PPMI = _E + """, r AS (SELECT row, count(*) AS r FROM e GROUP BY row), c AS (SELECT col, count(*) AS c FROM e GROUP BY col), n AS (SELECT count(*)::DOUBLE AS n FROM e),
w0 AS (SELECT e.row, e.col, greatest(ln(n / (r * c)), 0.0) AS val FROM e JOIN r USING (row) JOIN c USING (col) CROSS JOIN n),
w AS (SELECT row, col, CASE WHEN sum(val * val) OVER (PARTITION BY row) > 0 THEN val / sqrt(sum(val * val) OVER (PARTITION BY row)) ELSE 0 END AS val FROM w0)"""


# 62
@query(r"""SELECT tag, count(*) AS df FROM (SELECT trim(regexp_replace(lower(t), '\s+', ' ', 'g')) AS tag FROM (SELECT unnest(tags) AS t FROM relevance_tag_docs)) WHERE tag <> '' GROUP BY tag HAVING count(*) >= 10""")
def tag_occurrences(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "relevance_tag_docs").select(F.explode("tags").alias("t")).select(F.trim(F.regexp_replace(F.lower("t"), r"\s+", " ")).alias("tag"))
    return t.where("tag <> ''").groupBy("tag").agg(F.count("*").alias("df")).where("df >= 10")


# 63
@query(f"WITH {DT} SELECT tag, count(*) AS df, row_number() OVER (ORDER BY count(*) DESC, tag) - 1 AS idx FROM dt GROUP BY tag")
def tag_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return weights.vocabulary(doc_tags(spark, d), "tag")


# 64
@query(f"WITH {TF}, v AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 5 AND count(*) <= (SELECT floor(0.5 * count(*)) FROM tx)) SELECT term, df, row_number() OVER (ORDER BY df DESC, term) - 1 AS idx FROM v")
def word_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    n = doc_texts(spark, d).count()
    return weights.vocabulary(words(spark, d), "term", 5, n // 2)


# 65
@query(f"WITH {TF} SELECT row, term, tf FROM tf WHERE term IN (SELECT term FROM tf GROUP BY term HAVING count(*) >= 5)")
def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    tf = materialise(words(spark, d), "tf")
    v = tf.groupBy("term").agg(F.count("*").alias("df")).where("df >= 5").select("term")
    return tf.join(v, "term", "left_semi").select("row", "term", "tf")


# 66
_IDF1 = ", c AS (SELECT col, ln((1 + (SELECT count(DISTINCT row) FROM dt)::DOUBLE) / (1 + count(*))) + 1 AS i FROM e GROUP BY col)"


@query(f"WITH {_E}{_IDF1} SELECT row, col, round(i / sqrt(sum(i * i) OVER (PARTITION BY row)), 8) AS val FROM e JOIN c USING (col)")
def doc_tag_tfidf(spark: SparkSession, d: str) -> DataFrame:
    n = doc_tags(spark, d).select("row").distinct().count()
    return weights.tf_idf(_edges(spark, d), n).withColumn("val", F.round("val", 8))


@query(f"WITH {_E}{_IDF1} SELECT row, col, round(i / sqrt(count(*) OVER (PARTITION BY row)), 8) AS val FROM e JOIN c USING (col)")
def doc_tag_tfidf_count_norm(spark: SparkSession, d: str) -> DataFrame:
    n = doc_tags(spark, d).select("row").distinct().count()
    return weights.tf_idf(_edges(spark, d), n, "count").withColumn("val", F.round("val", 8))


# 67
@query(f"WITH {_PPMI} SELECT row, col, round(val, 8) AS val FROM w")
def doc_tag_ppmi(spark: SparkSession, d: str) -> DataFrame:
    return weights.ppmi(_edges(spark, d)).withColumn("val", F.round("val", 8))


# 68, 69
def _bm25_sql(k1: float, idf: str, dl: str, more: str) -> str:
    return f"""WITH {TF}, n AS (SELECT count(*)::DOUBLE AS n FROM tx), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 5 AND count(*) <= (SELECT floor(0.5 * count(*)) FROM tx)),
k AS (SELECT * FROM tf JOIN df USING (term)), dl AS (SELECT row, sum(tf) AS dl FROM {dl} GROUP BY row), a AS (SELECT sum(dl) / (SELECT n FROM n) AS avg_dl FROM dl),
w AS (SELECT row, term, {idf} * tf * ({k1} + 1) / (tf + {k1} * (1 - 0.75 + 0.75 * dl / avg_dl)) AS x FROM k JOIN dl USING (row) CROSS JOIN a CROSS JOIN n)
SELECT row, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY row)), 8) AS val FROM w {more}"""


@query(_bm25_sql(1.2, "greatest(ln((n - df + 0.5) / (df + 0.5)), 0.0)", "k", "WHERE x > 0"))
def doc_word_bm25_a(spark: SparkSession, d: str) -> DataFrame:
    n = doc_texts(spark, d).count()
    return weights.bm25(materialise(words(spark, d), "tf"), n, "a", 5, n // 2).withColumn("val", F.round("val", 8))


@query(_bm25_sql(1.5, "ln((n - df + 0.5) / (df + 0.5) + 1)", "tf", ""))
def doc_word_bm25_b(spark: SparkSession, d: str) -> DataFrame:
    n = doc_texts(spark, d).count()
    return weights.bm25(materialise(words(spark, d), "tf"), n, "b", 5, n // 2).withColumn("val", F.round("val", 8))


# 70, 94
@query(f"WITH {_E}, dg AS (SELECT row, count(*) AS deg FROM e GROUP BY row) SELECT deg, count(*) AS n_rows FROM dg GROUP BY deg")
def degree_distribution(spark: SparkSession, d: str) -> DataFrame:
    return g.degree_distribution(_edges(spark, d))


# 195
@query(f"WITH {DT}, {IDF} SELECT tag, round(idf, 9) AS idf FROM idf")
def relevance_idf(spark: SparkSession, d: str) -> DataFrame:
    return tag_idf(spark, d).select("tag", F.round("idf", 9).alias("idf"))


# 53: the flagship: PPMI, inverted index, cosine, top lists
def _anchored_sql(w: str, k: int, t: int, r: int, cap: int, val: str) -> str:
    return f"""WITH {w}, ln AS (SELECT row, sqrt(sum(val * val)) AS len, count(*) AS deg FROM w GROUP BY row), df AS (SELECT col, count(*) AS df FROM w GROUP BY col),
m AS (SELECT s.row, s.col AS term, s.val AS w1 FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY row ORDER BY val DESC, col) <= {t}) s JOIN df USING (col) WHERE df <= {cap}),
o AS (SELECT row AS other, col AS term, val AS w2 FROM w QUALIFY row_number() OVER (PARTITION BY col ORDER BY val DESC, row) <= {r}),
p AS (SELECT m.row, other, sum(w1 * w2) AS dot, count(*) AS shared FROM m JOIN o USING (term) WHERE m.row <> other GROUP BY ALL),
s AS (SELECT p.row, other AS col, round({val}, 9) AS val FROM p JOIN ln a ON a.row = p.row JOIN ln b ON b.row = p.other)
SELECT row, col, val FROM s QUALIFY row_number() OVER (PARTITION BY row ORDER BY val DESC, col) <= {k}"""


_COS = "dot / (greatest(a.len, 1e-12) * greatest(b.len, 1e-12))"
_R = ", w0x AS (SELECT row, col, round(val, 8) AS val FROM w)"


@query(_anchored_sql(_PPMI.replace("w AS (SELECT row, col, CASE", "wr AS (SELECT row, col, CASE") + ", w AS (SELECT row, col, round(val, 8) AS val FROM wr)", 20, 3, 200, 10_000, _COS))
def tag_ppmi_topk(spark: SparkSession, d: str) -> DataFrame:
    w = materialise(weights.ppmi(_edges(spark, d)).withColumn("val", F.round("val", 8)), "ppmi")
    return similar.anchored_cosine(w, 20)


# 54
_BM = _bm25_sql(1.5, "ln((n - df + 0.5) / (df + 0.5) + 1)", "tf", "")[5:]
_BM_W = _BM[: _BM.rindex("SELECT row, term")].rstrip().replace("df AS (SELECT term", "dfw AS (SELECT term", 1).replace("JOIN df USING", "JOIN dfw USING").replace("w AS (SELECT row, term", "wx AS (SELECT row, term") + ", w AS (SELECT row, term AS col, round(x / sqrt(sum(x * x) OVER (PARTITION BY row)), 8) AS val FROM wx)"


def _bm25_edges(spark: SparkSession, d: str) -> DataFrame:
    n = doc_texts(spark, d).count()
    e = weights.bm25(materialise(words(spark, d), "tf"), n, "b", 5, n // 2)
    return materialise(e.select("row", F.col("term").alias("col"), F.round("val", 8).alias("val")), "bm25")


@query(_anchored_sql(_BM_W, 20, 5, 200, 20_000, _COS))
def text_bm25_cosine(spark: SparkSession, d: str) -> DataFrame:
    return similar.anchored_cosine(_bm25_edges(spark, d), 20, 5, 200, 20_000)


@query(_anchored_sql(_BM_W, 20, 5, 200, 20_000, "shared / sqrt(a.deg::DOUBLE * b.deg)"))
def text_binary_cosine(spark: SparkSession, d: str) -> DataFrame:
    return similar.anchored_cosine(_bm25_edges(spark, d), 20, 5, 200, 20_000, "binary")


# 55, 153
_VEC = "x AS (SELECT vec_id AS id, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM embeddings), u AS (SELECT id, list_transform(v, lambda e: e / sqrt(list_dot_product(v, v))) AS v FROM x)"
_KNN = "p AS (SELECT a.id AS row, b.id AS col, round(list_dot_product(a.v, b.v), 9) AS s FROM {q} a, u b WHERE a.id <> b.id)"


@query(f"WITH {_VEC}, {_KNN.format(q='u')} SELECT row, col, round(s, 6) AS val FROM p QUALIFY row_number() OVER (PARTITION BY row ORDER BY s DESC, col) <= 20")
def embedding_knn(spark: SparkSession, d: str) -> DataFrame:
    return similar.nearest(vectors(spark, d), 20).withColumn("val", F.round("val", 6))


@query(f"WITH {_VEC}, q AS (SELECT * FROM u WHERE id % 20 = 0), {_KNN.format(q='q')} SELECT row, col, round(s, 6) AS val FROM p WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY row ORDER BY s DESC, col) <= 10")
def embedding_knn_of_queries(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return similar.nearest(v, 10, v.where("id % 20 = 0"), positive_only=True).withColumn("val", F.round("val", 6))


# 56: recall of the cells against the exact search, over the stated queries, and the share of the cells a query searches
@query()
def cell_knn_recall(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    q = v.where("id % 20 = 0")
    cells = similar.fit_cells(v, 10)
    exact, near = similar.nearest(v, 10, q), similar.nearest_in_cells(v, 10, cells, queries=q)
    hit = exact.join(near.select("row", "col").withColumn("hit", F.lit(1)), ["row", "col"], "left")
    share = F.lit(round(cells.probes / len(cells.centres), 4)).alias("probed")
    return hit.agg(F.count("*").alias("n_exact"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"), share)


# 88
@query(f"""WITH {_VEC}, e AS (SELECT unnest(v) AS e FROM x) SELECT round(avg(e), 8) AS mean, round(stddev_pop(e), 8) AS std, min(e) AS low, max(e) AS high,
(SELECT round(avg(sqrt(list_dot_product(v, v))), 8) FROM x) AS norm_mean FROM e""")
def embedding_statistics(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    s = v.select(F.explode("v").alias("e")).agg(F.round(F.avg("e"), 8).alias("mean"), F.round(F.stddev_pop("e"), 8).alias("std"), F.min("e").alias("low"), F.max("e").alias("high"))
    return s.crossJoin(F.broadcast(v.agg(F.round(F.avg(norm(F.col("v"))), 8).alias("norm_mean"))))


# 89
@query(f"WITH {_VEC}, e AS (SELECT unnest(v) AS e, generate_subscripts(v, 1) - 1 AS pos FROM x) SELECT pos, round(avg(e), 8) AS mean, round(stddev_pop(e), 8) AS std FROM e GROUP BY pos")
def dimension_statistics(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select(F.posexplode("v").alias("pos", "e")).groupBy("pos").agg(F.round(F.avg("e"), 8).alias("mean"), F.round(F.stddev_pop("e"), 8).alias("std"))


# 51: the records of one owner are one class; pairs only of the stated queries
@query(f"WITH {OW}, n AS (SELECT owner, min(doc) AS class_id, count(*) - 1 AS n_links FROM ow GROUP BY owner HAVING count(*) > 1) SELECT doc AS id, class_id, n_links FROM ow JOIN n USING (owner)")
def creator_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return similar.owner_classes(owners(spark, d).select(F.col("doc").alias("id"), "owner"))


@query(f"WITH {OW} SELECT a.doc AS row, b.doc AS col, 1.0 AS val FROM ow a JOIN ow b USING (owner) WHERE a.doc <> b.doc AND a.doc % 20 = 0")
def creator_pairs_of_queries(spark: SparkSession, d: str) -> DataFrame:
    o = owners(spark, d).select(F.col("doc").alias("id"), "owner")
    return similar.same_creator(o, o.where("id % 20 = 0"))


# 52
@query("""WITH w AS (SELECT user_id, event_type AS item, count(*)::DOUBLE AS w FROM events GROUP BY ALL), n AS (SELECT item, sqrt(sum(w * w)) AS len FROM w GROUP BY item)
SELECT a.item AS row, b.item AS col, round(sum(a.w * b.w / (x.len * y.len)), 8) AS val FROM w a JOIN w b USING (user_id) JOIN n x ON x.item = a.item JOIN n y ON y.item = b.item WHERE a.item <> b.item GROUP BY ALL""")
def item_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("item"), F.lit(1.0).alias("w"))
    return similar.item_cosine(e).withColumn("val", F.round("val", 8))


# 139
_FEATURES = ["TotalViews_log1p", "TotalDownloads_log1p", "TotalVotes_log1p", "TotalKernels_log1p"]


def _engagement(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "beh_base").where("doc_idx is not null").groupBy("doc_idx").agg(*[F.max(F.nanvl(F.col(f), F.lit(0.0))).alias(f) for f in _FEATURES])
    return similar.engagement_vectors(b, "doc_idx", _FEATURES)


@query(
    "WITH b AS (SELECT doc_idx, "
    + ", ".join(f"coalesce(max(CASE WHEN {f}::VARCHAR = 'nan' THEN 0 ELSE {f} END), 0) AS f{i}" for i, f in enumerate(_FEATURES))
    + " FROM beh_base WHERE doc_idx IS NOT NULL GROUP BY doc_idx), s AS (SELECT "
    + ", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}" for i in range(4))
    + " FROM b) SELECT doc_idx AS id, "
    + ", ".join(f"round((f{i} - m{i}) / (s{i} + 1e-9), 7) AS z{i}" for i in range(4))
    + " FROM b CROSS JOIN s"
)
def engagement_scores(spark: SparkSession, d: str) -> DataFrame:
    return _engagement(spark, d).select("id", *[F.round(F.col("v")[i], 7).alias(f"z{i}") for i in range(4)])


@query()
def engagement_knn(spark: SparkSession, d: str) -> DataFrame:
    return similar.nearest_in_boxes(materialise(_engagement(spark, d), "engagement"), 10)


# 80
@query(f"WITH {DT} SELECT row, total FROM (SELECT a.row, count(DISTINCT b.row) - 1 AS total FROM dt a JOIN dt b USING (tag) GROUP BY a.row) WHERE total > 0")
def tag_total_related(spark: SparkSession, d: str) -> DataFrame:
    """Other documents that share a tag, of any frequency."""
    return tagstats.related_counts(materialise(doc_tags(spark, d), "tags"))


def _lists(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "relevance_tag_docs").where("doc_idx is not null and size(tags) > 0")
    clean = F.filter(F.transform("tags", lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))), lambda x: x.isNotNull() & (x != ""))
    return t.select(F.col("doc_idx").alias("doc"), clean.alias("tags"))


_L = r"""l AS (SELECT doc_idx AS doc, list_filter(list_transform(tags, lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))), lambda x: x IS NOT NULL AND x <> '') AS tags
  FROM relevance_tag_docs WHERE doc_idx IS NOT NULL AND len(tags) > 0), c AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM l) GROUP BY tag)"""


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return tagstats.frequency(_lists(spark, d).select(F.explode("tags").alias("tag")))


# 81
@query(f"WITH {_L}, e AS (SELECT row_number() OVER () AS id, tags FROM l), x AS (SELECT id, unnest(list_sort(tags)) AS t, generate_subscripts(tags, 1) AS i FROM e) SELECT a.t AS t1, b.t AS t2, count(*) AS n FROM x a JOIN x b ON a.id = b.id AND a.i < b.i GROUP BY ALL")
def tag_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return tagstats.cooccurrence(_lists(spark, d))


# 82: the most frequent tags among themselves, both directions; other tags leave before pairs are made
@query(f"""WITH {_L}, top AS (SELECT tag FROM c ORDER BY n DESC, tag LIMIT 30), e AS (SELECT row_number() OVER () AS id, tags FROM l), x AS (SELECT * FROM (SELECT id, unnest(list_sort(tags)) AS t, generate_subscripts(tags, 1) AS i FROM e) WHERE t IN (SELECT tag FROM top)),
p AS (SELECT a.t AS t1, b.t AS t2, count(*) AS n FROM x a JOIN x b ON a.id = b.id AND a.i < b.i GROUP BY ALL) SELECT t1, t2, n FROM p UNION ALL SELECT t2, t1, n FROM p WHERE t1 <> t2""")
def cooccurrence_matrix(spark: SparkSession, d: str) -> DataFrame:
    top = [r[0] for r in _counts(spark, d).orderBy(F.desc("n"), "tag").limit(30).collect()]
    c = tagstats.cooccurrence(_lists(spark, d), top)
    return c.unionByName(c.where("t1 <> t2").select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), "n"))


# 83
@query(f"""WITH {_L} SELECT count(*) AS tags, min(n) AS low, max(n) AS high, median(n) AS median, round(avg(n), 8) AS mean, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n <= 5) AS up_to_5,
quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3, quantile_cont(n, 0.75) - quantile_cont(n, 0.25) AS iqr FROM c""")
def tag_statistics(spark: SparkSession, d: str) -> DataFrame:
    return tagstats.frequency_statistics(_counts(spark, d)).withColumn("mean", F.round("mean", 8))


# 84
@query(f"WITH {_L} SELECT len(tags) AS n_tags, count(*) AS n_docs FROM l GROUP BY ALL")
def tags_per_document(spark: SparkSession, d: str) -> DataFrame:
    return tagstats.per_document(_lists(spark, d))


# 85
@query(f"WITH {_L}, k AS (" + " UNION ALL ".join(f"SELECT '{c}' AS category, '{t}' AS tag" for c, ts in tagstats.CATEGORIES.items() for t in ts) + ") SELECT category, coalesce(sum(n), 0)::BIGINT AS n FROM k LEFT JOIN c USING (tag) GROUP BY category")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return tagstats.by_category(_counts(spark, d))


# 86, 196
@query("SELECT year(m.CreationDate)::INT AS year, b.TagId, count(*) AS n FROM (SELECT DISTINCT Id, CreationDate FROM metadata_merged_raw) m JOIN (SELECT DISTINCT DatasetId, TagId FROM dataset_tags) b ON b.DatasetId = m.Id WHERE TagId IS NOT NULL AND CreationDate IS NOT NULL GROUP BY ALL")
def yearly_tags(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "metadata_merged_raw").select(F.col("Id").alias("DatasetId"), F.year("CreationDate").alias("year"), "CreationDate").where("CreationDate is not null").distinct()
    b = table(spark, d, "dataset_tags").select("DatasetId", "TagId").where("TagId is not null").distinct()
    return m.join(b, "DatasetId").groupBy("year", "TagId").agg(F.count("*").alias("n"))


# 87
@query("""WITH t AS (SELECT DatasetId, count(DISTINCT TagId) AS num_tags FROM dataset_tags WHERE DatasetId IS NOT NULL GROUP BY DatasetId), s AS (SELECT DISTINCT Id, TotalViews, TotalDownloads FROM datasets)
SELECT num_tags, count(*) AS n, round(avg(TotalViews), 6) AS mean_views, median(TotalViews) AS median_views, round(avg(TotalDownloads), 6) AS mean_downloads, median(TotalDownloads) AS median_downloads FROM s JOIN t ON t.DatasetId = s.Id GROUP BY num_tags""")
def engagement_by_tags(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dataset_tags").where("DatasetId is not null").groupBy(F.col("DatasetId").alias("Id")).agg(F.count_distinct("TagId").alias("num_tags"))
    s = table(spark, d, "datasets").select("Id", "TotalViews", "TotalDownloads").distinct().join(t, "Id")
    s = materialise(s, "engagement")
    out = s.groupBy("num_tags").agg(F.count("*").alias("n"), F.round(F.avg("TotalViews"), 6).alias("mean_views"), F.round(F.avg("TotalDownloads"), 6).alias("mean_downloads"))
    for c, n in (("TotalViews", "median_views"), ("TotalDownloads", "median_downloads")):
        out = out.join(quantiles(s, ["num_tags"], c, {n: 0.5}), "num_tags", "left")
    return out


# 110
@query(f"WITH {_L} SELECT tag, n FROM c ORDER BY n DESC, tag LIMIT 30")
def most_common_tags(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).orderBy(F.desc("n"), "tag").limit(30)


# 111
@query(f"WITH {_L} SELECT tag, n, row_number() OVER w AS pos, round(sum(n) OVER (ORDER BY n DESC, tag ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 9) AS coverage FROM c WINDOW w AS (ORDER BY n DESC, tag)")
def cumulative_coverage(spark: SparkSession, d: str) -> DataFrame:
    return tagstats.cumulative_coverage(_counts(spark, d)).withColumn("coverage", F.round("coverage", 9))


@query(f"WITH {_L}, x AS (SELECT row_number() OVER (ORDER BY n DESC, tag) AS pos, sum(n) OVER (ORDER BY n DESC, tag ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS coverage FROM c) SELECT share, min(pos) AS tags FROM x, (VALUES (0.8), (0.9)) AS s(share) WHERE coverage >= share GROUP BY share")
def coverage_reached(spark: SparkSession, d: str) -> DataFrame:
    return tagstats.coverage_reached(tagstats.cumulative_coverage(_counts(spark, d)), [0.8, 0.9])


# 108
@query("SELECT Id, max(TotalDownloads) AS TotalDownloads FROM metadata_merged_raw WHERE Id IS NOT NULL GROUP BY Id ORDER BY 2 DESC NULLS LAST, Id LIMIT 50")
def most_downloaded(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "metadata_merged_raw").where("Id is not null").groupBy("Id").agg(F.max("TotalDownloads").alias("TotalDownloads"))
    return m.orderBy(F.desc("TotalDownloads"), "Id").limit(50)


# 190, 191
@query(TX.join(["WITH ", f" SELECT row, len(list_filter(regexp_extract_all(text, '[a-z0-9_]+'), lambda w: length(w) >= 2 AND w NOT IN ({', '.join(repr(w) for w in __import__('viewloom.functions.text', fromlist=['x']).STOP_WORDS)}))) AS n_new, len(list_filter(regexp_extract_all(text, '[a-z0-9]+'), lambda w: length(w) >= 2)) AS n_old FROM tx"]))
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return doc_texts(spark, d).select("row", F.size(tokens(F.col("text"))).alias("n_new"), F.size(tokens(F.col("text"), stop=False)).alias("n_old"))


# 204
@query(f"WITH {_L}, e AS (SELECT row_number() OVER () AS id, tags FROM l), x AS (SELECT DISTINCT id, unnest(tags) AS t FROM e), p AS (SELECT DISTINCT a.t AS t1, b.t AS t2 FROM x a JOIN x b ON a.id = b.id AND a.t < b.t) SELECT round(2.0 * count(*) / (SELECT count(DISTINCT t) FROM (SELECT t1 AS t FROM p UNION ALL SELECT t2 FROM p)), 8) AS average_degree FROM p")
def tag_network_degree(spark: SparkSession, d: str) -> DataFrame:
    p = materialise(tagstats.cooccurrence(_lists(spark, d)).where("t1 <> t2").select("t1", "t2"), "pairs")
    nodes = p.select(F.explode(F.array("t1", "t2")).alias("t")).agg(F.count_distinct("t").alias("n"))
    return p.agg(F.count("*").alias("e")).crossJoin(F.broadcast(nodes)).select(F.round(2 * F.col("e") / F.col("n"), 8).alias("average_degree"))
