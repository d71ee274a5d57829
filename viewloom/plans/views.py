"""The input views of the queries, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.operators.graph import max_duplicates
from viewloom.sources.tables import table


def doc_tags(spark: SparkSession, d: str) -> DataFrame:
    """(row, tag): distinct clean tags of each doc_idx."""
    t = table(spark, d, "relevance_tag_docs").select(F.col("doc_idx").alias("row"), F.explode("tags").alias("tag"))
    t = t.select("row", F.trim(F.regexp_replace(F.lower("tag"), r"\s+", " ")).alias("tag"))
    return t.where("row is not null and tag <> ''").distinct()


DT = r"""dt AS (SELECT DISTINCT row, tag FROM (SELECT doc_idx AS row, trim(regexp_replace(lower(t), '\s+', ' ', 'g')) AS tag
  FROM (SELECT doc_idx, unnest(tags) AS t FROM relevance_tag_docs WHERE doc_idx IS NOT NULL)) WHERE tag <> '')"""


def doc_texts(spark: SparkSession, d: str) -> DataFrame:
    """(row, text): cleaned title, subtitle and description per dataset; repeated Ids once."""
    from viewloom.functions.text import clean_text, joined_text

    m = table(spark, d, "metadata_merged_raw").where("Id is not null").select(F.col("Id").alias("row"), clean_text(joined_text("Title", "Subtitle", "Description")).alias("text"))
    return m.groupBy("row").agg(F.min("text").alias("text"))


TX = r"""tx AS (SELECT Id AS row, min(trim(regexp_replace(lower(regexp_replace(regexp_replace(coalesce(Title, '') || ' ' || coalesce(Subtitle, '') || ' ' || coalesce(Description, ''),
  '<[^>]+>', ' ', 'g'), 'https?://\S+', ' ', 'g')), '\s+', ' ', 'g'))) AS text FROM metadata_merged_raw WHERE Id IS NOT NULL GROUP BY Id)"""


def words(spark: SparkSession, d: str) -> DataFrame:
    """(row, term, tf)."""
    from viewloom.functions.text import tokens
    from viewloom.operators.weights import term_frequency

    return term_frequency(doc_texts(spark, d).select("row", tokens(F.col("text")).alias("tokens")), "row", "tokens")


def _stop() -> str:
    from viewloom.functions.text import STOP_WORDS

    return ", ".join(f"'{w}'" for w in STOP_WORDS)


TF = TX + f""", tok AS (SELECT row, unnest(regexp_extract_all(text, '[a-z0-9_]+')) AS term FROM tx),
tf AS (SELECT row, term, count(*) AS tf FROM tok WHERE length(term) >= 2 AND term NOT IN ({_stop()}) GROUP BY row, term)"""


def graph(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One edge per (row, col), the largest value; no self edges, NULL or NaN."""
    return max_duplicates(table(spark, d, name)).where("row <> col")


def graph_sql(alias: str, name: str) -> str:
    return f"""{alias} AS (SELECT row, col, max(val) AS val FROM {name} WHERE row IS NOT NULL AND col IS NOT NULL AND row <> col AND val IS NOT NULL AND val::VARCHAR <> 'nan' GROUP BY row, col)"""


def scaled(spark: SparkSession, d: str, name: str) -> DataFrame:
    """``graph`` symmetric by maximum, rows at sum 1."""
    from viewloom.operators.graph import symmetrise

    return symmetrise(graph(spark, d, name))


def scaled_sql(alias: str, name: str) -> str:
    return f"""{graph_sql(alias + '0', name)}, {alias}1 AS (SELECT row, col, CASE WHEN count(*) < 2 THEN greatest(max(val), 0.0) ELSE max(val) END AS val
  FROM (SELECT row, col, val FROM {alias}0 UNION ALL SELECT col, row, val FROM {alias}0) GROUP BY row, col),
{alias} AS (SELECT row, col, val / greatest(sum(val) OVER (PARTITION BY row), 1e-12) AS val FROM {alias}1 WHERE val <> 0 AND row <> col)"""


A, B = "s_fused3_symrow", "s_tabcontent_symrow"


def two_views(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"a": scaled(spark, d, A), "b": scaled(spark, d, B)}


TWO = scaled_sql("a", A) + ", " + scaled_sql("b", B) + ", v AS (SELECT 'a' AS view, row, col, val FROM a UNION ALL SELECT 'b', row, col, val FROM b)"


def creator_view(spark: SparkSession, d: str, views: dict[str, DataFrame], k: int) -> DataFrame:
    """The graph of the records of one creator at L1 rows, as far as the ``k`` best of its sum with ``views`` can need it."""
    from functools import reduce

    from viewloom.operators.similar import same_creator_among

    pairs = reduce(DataFrame.unionByName, [e.select("row", "col") for e in views.values()])
    return same_creator_among(owners(spark, d).select(F.col("doc").alias("id"), "owner"), pairs, k)


def owners(spark: SparkSession, d: str) -> DataFrame:
    """(doc, owner > 0): the least creator a doc_idx names."""
    b = table(spark, d, "beh_base").where("doc_idx is not null and CreatorUserId > 0")
    return b.groupBy(F.col("doc_idx").alias("doc")).agg(F.min("CreatorUserId").alias("owner"))


OW = "ow AS (SELECT doc_idx AS doc, min(CreatorUserId) AS owner FROM beh_base WHERE doc_idx IS NOT NULL AND CreatorUserId > 0 GROUP BY doc_idx)"


def organisations(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "beh_base").where("doc_idx is not null and OwnerOrganizationId > 0")
    return b.groupBy(F.col("doc_idx").alias("doc")).agg(F.min("OwnerOrganizationId").alias("owner"))


OG = OW.replace("ow AS", "og AS").replace("CreatorUserId", "OwnerOrganizationId")


def tag_idf(spark: SparkSession, d: str) -> DataFrame:
    """(tag, idf): ln((N + 1) / (df + 1)) over the documents."""
    from viewloom.operators.weights import inverse_frequency

    t = doc_tags(spark, d)
    n = t.agg(F.count_distinct("row").cast("double").alias("n"))
    df = t.groupBy("tag").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    return df.select("tag", inverse_frequency(F.col("df"), F.col("n"), "relevance").alias("idf"))


IDF = "idf AS (SELECT tag, ln(((SELECT count(DISTINCT row) FROM dt) + 1) / (count(*) + 1)) AS idf FROM dt GROUP BY tag)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
