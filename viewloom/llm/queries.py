"""Queries pN_ of this folder and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.llm import abuse, cooccur, encode, fuse, leaks, set_pairs, terms, topn
from viewloom.session import materialise
from viewloom.sources.tables import table


def _tag_sets(spark: SparkSession, d: str) -> DataFrame:
    return materialise(set_pairs.tag_sets(table(spark, d, "relevance_tag_docs"), "doc_idx", "tags", 5), "sets")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return set_pairs.expand(*set_pairs.similar_classes(_tag_sets(spark, d)))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: its class of equal tag sets and how many other classes are similar."""
    members, pairs = set_pairs.similar_classes(_tag_sets(spark, d))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return members.join(ends, "class_id", "left").select(F.col("id").alias("doc_idx"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    views = [table(spark, d, t) for t in ("s_fused3_symrow", "s_tabcontent_symrow")]
    return fuse.fuse_rankings(views, table(spark, d, "rank_requests").select(F.col("row_id").alias("row")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).where("rank = 1").select(F.col("row").alias("row_id"), F.col("col").alias("col_id"))


def p2_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select(F.col("row").alias("row_id"), F.col("col").alias("col_id"), "rank")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.far_above_chance(cooccur.associations(table(spark, d, "dataset_tags"), "DatasetId", "TagId"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"))


def p3_associations(spark: SparkSession, d: str) -> DataFrame:
    num = [F.round(c, 9).alias(c) for c in ("lift", "pmi", "npmi", "jaccard")]
    return _pairs(spark, d).select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"), "n", "n_a", "n_b", "n_ab", *num)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """What the mixture is sure of, within the stated limits of frequency; of the tags the one it is most sure of."""
    words = terms.distinctive_terms(table(spark, d, "metadata_merged_raw"), "Id", "Description", 3, 2, 0.02).where(F.col("score") >= terms.SURE)
    tags = terms.distinctive_tag(table(spark, d, "relevance_tag_docs"), table(spark, d, "relevance_tag_idf"))
    return words.select(F.lit("description").alias("kind"), F.col("id").alias("record_id"), "term").unionByName(
        tags.select(F.lit("tag").alias("kind"), F.col("id").alias("record_id"), "term")
    )


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every term that is more likely elite than not in a record."""
    return terms.distinctive_terms(table(spark, d, "metadata_merged_raw"), "Id", "Description").where("score >= 0.5").select(
        F.col("id").alias("record_id"), "term", "tf", "df", F.round("score", 6).alias("score")
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    edges = materialise(topn.clean_edges(table(spark, d, "s_fused3_symrow")), "edges")
    best = topn.top_n(edges, "row", "col", "val", 10)
    return best.select(F.col("row").alias("row_id"), F.col("col").alias("col_id"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return encode.round_trip(table(spark, d, "documents"), "doc_id", "text")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_spans(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("doc_id", "item_id").distinct()


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_coverage(_spans(spark, d), "doc_id")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return leaks.without_leaks(docs, "doc_id", "text", _spans(spark, d)).select("doc_id", F.size("words").alias("n_words"), "dropped")


def _abuse(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return abuse.score(docs, "doc_id", "text", abuse.fit(docs, "doc_id", "text", table(spark, d, "content_labels"), "is_toxic"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, abusive ones and their share per source (both spellings of a source together)."""
    source = F.coalesce(F.regexp_replace(F.lower(F.trim("source")), " ", "_"), F.lit("unknown")).alias("source")
    return abuse.rates(table(spark, d, "documents").select("doc_id", source), _abuse(spark, d), "doc_id", "source")


_SETS = r"""s AS (SELECT doc_idx, list_sort(list(DISTINCT t)) AS tags FROM (SELECT doc_idx, trim(regexp_replace(lower(unnest(tags)), '[ \t]+', ' ', 'g'), ' ') AS t
  FROM relevance_tag_docs WHERE doc_idx IS NOT NULL) WHERE t <> '' GROUP BY doc_idx)"""
P1_FOUND = f"""WITH {_SETS}, e AS (SELECT doc_idx, len(tags) AS n, unnest(tags) AS t FROM s WHERE len(tags) >= 5),
p AS (SELECT a.doc_idx AS doc_a, b.doc_idx AS doc_b, a.n AS n_a, b.n AS n_b, count(*) AS o FROM e a JOIN e b ON a.t = b.t AND a.doc_idx < b.doc_idx GROUP BY ALL)
SELECT doc_a, doc_b FROM p WHERE 5 * o >= 3 * (n_a + n_b - o)"""
P1_CLASSES = f"""WITH {_SETS}, k AS (SELECT tags, min(doc_idx) AS class_id FROM s WHERE len(tags) >= 5 GROUP BY tags), e AS (SELECT class_id, len(tags) AS n, unnest(tags) AS t FROM k),
p AS (SELECT a.class_id AS a, b.class_id AS b, a.n AS n_a, b.n AS n_b, count(*) AS o FROM e a JOIN e b ON a.t = b.t AND a.class_id <> b.class_id GROUP BY ALL),
l AS (SELECT a AS class_id, count(*) AS n_links FROM p WHERE 5 * o >= 3 * (n_a + n_b - o) GROUP BY a)
SELECT doc_idx, k.class_id, coalesce(n_links, 0) AS n_links FROM s JOIN k USING (tags) LEFT JOIN l USING (class_id)"""
_EDGES = "e AS (SELECT row, col, max(val) AS val FROM s_fused3_symrow WHERE row <> col AND val IS NOT NULL AND val::VARCHAR <> 'nan' GROUP BY row, col)"
P7_FOUND = f"WITH {_EDGES} SELECT row AS row_id, col AS col_id FROM e QUALIFY row_number() OVER (PARTITION BY row ORDER BY val DESC, col) <= 10"
_P3 = """WITH e AS (SELECT DISTINCT DatasetId AS d, TagId AS t FROM dataset_tags WHERE DatasetId IS NOT NULL AND TagId IS NOT NULL),
m AS (SELECT t, count(*) AS m FROM e GROUP BY t), tot AS (SELECT count(DISTINCT d) AS n FROM e),
p AS (SELECT a.t AS tag_a, b.t AS tag_b, count(*) AS n_ab FROM e a JOIN e b ON a.d = b.d AND a.t < b.t GROUP BY ALL),
q AS (SELECT tag_a, tag_b, n, x.m AS n_a, y.m AS n_b, n_ab FROM p JOIN m x ON x.t = tag_a JOIN m y ON y.t = tag_b CROSS JOIN tot
WHERE n_ab >= 5 AND 2000 * n_ab >= n AND n_ab * n >= 5 * x.m * y.m)
"""
P3_FOUND = _P3 + "SELECT tag_a, tag_b FROM q"
P3_ASSOCIATIONS = _P3 + """SELECT *, round(n_ab / (n_a::DOUBLE * n_b / n), 9) AS lift, round(ln(n_ab / (n_a::DOUBLE * n_b / n)), 9) AS pmi,
round(CASE WHEN n_ab < n THEN ln(n_ab / (n_a::DOUBLE * n_b / n)) / -ln(n_ab / n) ELSE 1 END, 9) AS npmi, round(n_ab / (n_a + n_b - n_ab), 9) AS jaccard FROM q"""
P6_FOUND = r"""WITH m AS (SELECT DISTINCT Id, lower(regexp_replace(regexp_replace(Description, '<[^>]+>', ' ', 'g'), 'https?://\S+', ' ', 'g')) AS x FROM metadata_merged_raw
  WHERE Id IS NOT NULL), w AS (SELECT Id, unnest(regexp_extract_all(x, '[a-z0-9_]+')) AS term, row_number() OVER () AS r FROM m),
t AS (SELECT Id, term, max(tf) AS tf FROM (SELECT Id, r, term, count(*) AS tf FROM w WHERE length(term) >= 2 GROUP BY ALL) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT count(DISTINCT Id) AS n FROM t),
g AS (SELECT DISTINCT doc_idx, trim(regexp_replace(lower(unnest(tags)), '[ \t]+', ' ', 'g'), ' ') AS tag FROM relevance_tag_docs WHERE doc_idx IS NOT NULL),
i AS (SELECT tag, max({'df': df, 'idf': idf}).idf AS idf FROM (SELECT trim(regexp_replace(lower(tag), '[ \t]+', ' ', 'g'), ' ') AS tag, df, idf FROM relevance_tag_idf
  WHERE df IS NOT NULL AND idf IS NOT NULL AND idf::VARCHAR <> 'nan' AND df::VARCHAR <> 'nan') WHERE tag <> '' GROUP BY tag)
SELECT 'description' AS kind, t.Id AS record_id, t.term FROM t JOIN df USING (term) CROSS JOIN n WHERE tf >= 3 AND df >= 2 AND df * 50 <= n
UNION ALL SELECT 'tag' AS kind, doc_idx AS record_id, tag AS term FROM (SELECT g.doc_idx, g.tag, count(*) OVER (PARTITION BY doc_idx) AS k,
  row_number() OVER (PARTITION BY doc_idx ORDER BY idf DESC, g.tag) AS rn FROM g JOIN i ON g.tag = i.tag) WHERE k >= 8 AND rn = 1"""

QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p2_ranking": p2_ranking,
    "p3_found": p3_found,
    "p3_associations": p3_associations,
    "p6_found": p6_found,
    "p6_scores": p6_scores,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p8_roundtrip": p8_roundtrip,
    "p9_found": p9_found,
    "p9_coverage": p9_coverage,
    "p9_clean": p9_clean,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}
ORACLES = {"p1_found": P1_FOUND, "p1_classes": P1_CLASSES, "p3_found": P3_FOUND, "p3_associations": P3_ASSOCIATIONS, "p6_found": P6_FOUND, "p7_found": P7_FOUND}
