"""Queries of the sections: sources, cleaning, joins (inventory numbers beside each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.functions import text
from viewloom.operators import clean, integrity
from viewloom.plans.views import OW, doc_tags, owners
from viewloom.session import scratch
from viewloom.sources import files
from viewloom.sources.tables import table

AS_OF = "2026-01-01"
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_RAW = ["DatasetId", "Slug", "TotalCompressedBytes", "VersionNumber", "Id"]


def _raw_csv(spark: SparkSession, d: str) -> str:
    """dataset_versions as raw CSV files with a header, and after every row whose Id is divisible by 10 a line with too many fields."""
    v = table(spark, d, "dataset_versions").where("Id is not null").select(*_RAW)
    good = files.quoted_line(v, ["Slug"])
    bad = v.where("Id % 10 = 0").select(F.concat_ws(",", F.lit("1"), F.lit("x"), F.lit("2"), F.lit("3"), F.col("Id"), F.lit("too"), F.lit("many")).alias("line"))
    path = scratch(spark, "csv")
    # every file has the header
    n = 4
    head = spark.createDataFrame([(i, 0, ",".join(_RAW)) for i in range(n)], "part int, at int, line string")
    rows = good.unionByName(bad).select(F.pmod(F.xxhash64("line"), F.lit(n)).cast("int").alias("part"), F.lit(1).alias("at"), "line")
    rows.unionByName(head).repartition(n, "part").sortWithinPartitions("part", "at", "line").select("part", "line").write.partitionBy("part").text(path)
    return path


# 1, 2: of a raw CSV the columns that exist, by its header; only these are parsed
@query("SELECT Id::VARCHAR AS Id, VersionNumber::VARCHAR AS VersionNumber FROM dataset_versions WHERE Id IS NOT NULL UNION ALL SELECT Id::VARCHAR, '3' FROM dataset_versions WHERE Id % 10 = 0")
def column_pruned_read(spark: SparkSession, d: str) -> DataFrame:
    return files.read_csv(spark, f"{_raw_csv(spark, d)}/part=*", need=["Id", "VersionNumber", "NoSuchColumn"])


# 3: typed, lines with a wrong number of fields left out
@query("SELECT Id, DatasetId, VersionNumber, nullif(Slug, '') AS Slug FROM dataset_versions WHERE Id IS NOT NULL")
def malformed_lines_dropped(spark: SparkSession, d: str) -> DataFrame:
    t = files.read_csv(spark, f"{_raw_csv(spark, d)}/part=*", "DatasetId bigint, Slug string, TotalCompressedBytes bigint, VersionNumber bigint, Id bigint", bad_rows="drop")
    return t.select("Id", "DatasetId", "VersionNumber", F.nullif("Slug", F.lit("")).alias("Slug"))


# 4: a table by its suffix, in Latin-1; every byte of the file decides the encoding
@query("SELECT Id, Title FROM (SELECT Id, 'caf' || chr(233) || ' ' || Id AS Title FROM dataset_versions WHERE Id IS NOT NULL)")
def latin1_table(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "latin1") + ".csv"
    t = table(spark, d, "dataset_versions").where("Id is not null").select("Id", F.concat(F.lit("caf\u00e9 "), "Id").alias("Title"))
    t.write.csv(path, header=True, encoding="ISO-8859-1")
    return files.read_table(spark, path).select(F.col("Id").cast("bigint").alias("Id"), "Title")


# 5
@query("""SELECT DatasetId AS key, arg_min(path, (-length, path)) AS path, max(length) AS length, '.csv' AS suffix FROM (SELECT DatasetId, Slug || '.csv' AS path,
  TotalCompressedBytes AS length FROM dataset_versions WHERE Slug IS NOT NULL AND TotalCompressedBytes IS NOT NULL AND DatasetId IS NOT NULL) GROUP BY DatasetId""")
def main_table(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "dataset_versions").where("Slug is not null and TotalCompressedBytes is not null and DatasetId is not null")
    listing = v.select(F.col("DatasetId").alias("key"), F.concat("Slug", F.lit(".csv")).alias("path"), F.col("TotalCompressedBytes").alias("length"))
    helpers = v.select(F.col("DatasetId").alias("key"), F.concat("Slug", F.lit("_codebook.csv")).alias("path"), F.lit(10**15).alias("length"))
    return files.main_tables(listing.unionByName(helpers), "key")


# 18
@query("""SELECT Id::VARCHAR || ',"' || replace(coalesce(Title, ''), '"', '""') || '","' || replace(coalesce(Slug, ''), '"', '""') || '",' || coalesce(VersionNumber::VARCHAR, '') AS line
FROM dataset_versions WHERE Id IS NOT NULL""")
def quoted_lines(spark: SparkSession, d: str) -> DataFrame:
    return files.quoted_line(table(spark, d, "dataset_versions").where("Id is not null").select("Id", "Title", "Slug", "VersionNumber"), ["Title", "Slug"])


# 22
@query("SELECT * FROM (SELECT Id, doc_idx, CreatorUserId FROM beh_base WHERE Id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY Id ORDER BY loaded_at, doc_idx, CreatorUserId) = 1)")
def first_per_id(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "beh_base").where("Id is not null")
    order = [F.asc("loaded_at"), F.asc("doc_idx"), F.asc_nulls_last("CreatorUserId")]
    return clean.keep_one(b, ["Id"], order).select("Id", "doc_idx", "CreatorUserId")


# 23
@query("SELECT Id, DatasetId, VersionNumber FROM dataset_versions WHERE Id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY Id ORDER BY loaded_at DESC, DatasetId, VersionNumber) = 1")
def last_per_id(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("loaded_at"), F.asc_nulls_last("DatasetId"), F.asc_nulls_last("VersionNumber")]
    return clean.keep_one(table(spark, d, "dataset_versions").where("Id is not null"), ["Id"], order).select("Id", "DatasetId", "VersionNumber")


# 24
@query("SELECT Id, row_number() OVER (ORDER BY Id) - 1 AS doc_idx FROM (SELECT DISTINCT Id FROM datasets WHERE Id IS NOT NULL)")
def dense_doc_index(spark: SparkSession, d: str) -> DataFrame:
    return clean.dense_index(table(spark, d, "datasets").select("Id").where("Id is not null").distinct(), [F.asc("Id")])


# 25, 26
@query(r"""SELECT DISTINCT Id, trim(regexp_replace(lower(regexp_replace(regexp_replace(coalesce(Title, '') || ' ' || coalesce(Subtitle, '') || ' ' || coalesce(Slug, '') || ' ' || coalesce(Description, ''),
  '<[^>]+>', ' ', 'g'), 'https?://\S+', ' ', 'g')), '\s+', ' ', 'g')) AS text_all FROM metadata_merged_raw""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "metadata_merged_raw")
    return m.select("Id", text.clean_text(text.joined_text("Title", "Subtitle", "Slug", "Description")).alias("text_all")).distinct()


# 27
@query(r"""SELECT DISTINCT Id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(Description, ''), '[\n\r]', ' ', 'g'), 'https?://\S+|www\.\S+', ' ', 'g'),
  '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[^\pL\pM\p{Nd}\p{Pc}\s\-#/@&]+', ' ', 'g'), '\s+', ' ', 'g'))) AS text_strict FROM metadata_merged_raw""")
def clean_text_strict(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "metadata_merged_raw").select("Id", text.clean_text_strict(F.col("Description")).alias("text_strict")).distinct()


# 28
@query(r"""SELECT DISTINCT Id, list_filter(list_transform(string_split(regexp_replace(coalesce(Tags, ''), '[\[\]"'']', '', 'g'), ','), lambda t: trim(t)), lambda t: t <> '') AS tags FROM metadata_merged_raw""")
def parsed_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "metadata_merged_raw").select("Id", text.parse_tags(F.col("Tags")).alias("tags")).distinct()


# 29
@query(r"""WITH t AS (SELECT DISTINCT Id, Tags FROM metadata_merged_raw), e AS (SELECT Id, Tags, unnest(string_split(lower(coalesce(Tags, '')), ',')) AS t, generate_subscripts(string_split(lower(coalesce(Tags, '')), ','), 1) AS i FROM t),
f AS (SELECT Id, Tags, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t, min(i) AS i FROM e GROUP BY ALL)
SELECT t.Id, coalesce(array_to_string(list(f.t ORDER BY f.i) FILTER (f.t <> ''), '|'), '') AS tags FROM t JOIN f ON t.Id = f.Id AND t.Tags IS NOT DISTINCT FROM f.Tags GROUP BY t.Id, t.Tags""")
def split_tags(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "metadata_merged_raw").select("Id", "Tags").distinct()
    return t.select("Id", F.array_join(text.split_tags(F.col("Tags")), "|").alias("tags"))


# 30
@query(r"""SELECT DISTINCT Id, array_to_string(list_filter(list_transform(string_split(CASE WHEN starts_with(trim(Tags), '[') THEN regexp_replace(regexp_replace(trim(Tags), '^\[|\]$', '', 'g'), '["'']', '', 'g')
  ELSE coalesce(Tags, '') END, ','), lambda t: trim(t)), lambda t: t <> ''), '|') AS tags FROM metadata_merged_raw""")
def ensured_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "metadata_merged_raw").select("Id", F.array_join(text.ensure_list(F.col("Tags")), "|").alias("tags")).distinct()


# 31, 32, 33
PRESETS = {10_000: {"tags": ["tabular", "classification", "regression"], "size_min": 100 * 1024, "size_max": 100 * 1024**2}, 100_000: {"tags": None, "size_min": 10 * 1024, "size_max": 1024**3}}


@query(r"""SELECT DISTINCT m.Id FROM metadata_merged_raw m JOIN dataset_versions v ON v.Id = m.CurrentDatasetVersionId WHERE m.TotalViews >= 10 AND v.TotalCompressedBytes BETWEEN 102400 AND 104857600
AND len(list_intersect(list_transform(string_split(lower(coalesce(m.Tags, '')), ','), lambda t: trim(regexp_replace(t, '\s+', ' ', 'g'))), ['tabular', 'classification', 'regression'])) > 0""")
def filtered_candidates(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "dataset_versions").select(F.col("Id").alias("CurrentDatasetVersionId"), "TotalCompressedBytes")
    m = table(spark, d, "metadata_merged_raw").select("Id", "CurrentDatasetVersionId", "Tags", "TotalViews").join(v, "CurrentDatasetVersionId")
    p = clean.pick_preset(PRESETS, 5_000)
    return clean.filter_candidates(m, p["tags"], "TotalCompressedBytes", p["size_min"], p["size_max"], "TotalViews", 10).select("Id").distinct()


# 34
@query("""WITH s AS (SELECT DISTINCT Id AS id, lower(trim(Slug)) AS slug, lower(trim(Title)) AS title FROM metadata_merged_raw WHERE Id IS NOT NULL AND Slug IS NOT NULL),
o AS (SELECT DISTINCT DatasetId AS id, Id AS pos, 'u' || (Id % 7) || '/' || CASE WHEN Id % 3 = 0 THEN coalesce(Slug, '') ELSE 'x' END AS ref, lower(trim(coalesce(Title, ''))) AS offer FROM dataset_versions),
m AS (SELECT s.id, s.slug, o.pos, o.ref, CASE WHEN ends_with(lower(trim(o.ref)), '/' || s.slug) THEN 1 WHEN s.title <> '' AND (contains(o.offer, s.title) OR contains(s.title, o.offer)) THEN 2 END AS kind FROM s LEFT JOIN o USING (id))
SELECT id, arg_min(ref, (kind, pos)) FILTER (kind IS NOT NULL) AS ref, CASE min(kind) WHEN 1 THEN 'exact' WHEN 2 THEN 'fuzzy' ELSE 'none' END AS confidence FROM m GROUP BY id""")
def matched_slugs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "metadata_merged_raw").where("Id is not null and Slug is not null").select(F.col("Id").alias("id"), F.col("Slug").alias("slug"), F.col("Title").alias("title")).distinct()
    ref = F.concat(F.lit("u"), F.col("Id") % 7, F.lit("/"), F.when(F.col("Id") % 3 == 0, F.coalesce("Slug", F.lit(""))).otherwise("x"))
    o = table(spark, d, "dataset_versions").select(F.col("DatasetId").alias("id"), F.col("Id").alias("pos"), ref.alias("ref"), F.col("Title").alias("title")).distinct()
    return clean.match_slugs(s, o)


# 35
@query("SELECT DISTINCT Id, coalesce(LastActivityDate, CreationDate) AS active_at FROM metadata_merged_raw WHERE Id IS NOT NULL")
def coalesced_dates(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "metadata_merged_raw").where("Id is not null")
    ts = lambda c: F.try_to_timestamp(F.col(c).cast("string")).cast("timestamp_ntz")
    return m.select("Id", F.coalesce(ts("LastActivityDate"), ts("CreationDate")).alias("active_at")).distinct()


# 36
@query("SELECT record_id, n FROM (SELECT record_id, try_cast(string_split(raw_text, ',')[1] AS BIGINT) AS n FROM raw_records WHERE regexp_full_match(string_split(raw_text, ',')[1], '[0-9]+')) WHERE n IS NOT NULL")
def coerced_numbers(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_records").select("record_id", F.split("raw_text", ",")[0].alias("t")).where(F.col("t").rlike(r"\A[0-9]+\z"))
    return r.select("record_id", F.expr("try_cast(t as bigint)").alias("n")).na.drop()


# 37
@query("""SELECT DISTINCT Id, greatest(coalesce(TotalViews, 0), 0) AS TotalViews, round(ln(1 + greatest(coalesce(TotalViews, 0), 0)), 9) AS TotalViews_log1p,
greatest(coalesce(TotalVotes, 0), 0) AS TotalVotes, round(ln(1 + greatest(coalesce(TotalVotes, 0), 0)), 9) AS TotalVotes_log1p FROM datasets""")
def counter_logs(spark: SparkSession, d: str) -> DataFrame:
    c = clean.counters(table(spark, d, "datasets").select("Id", "TotalViews", "TotalVotes"), ["TotalViews", "TotalVotes"])
    return c.select("Id", "TotalViews", F.round("TotalViews_log1p", 9).alias("TotalViews_log1p"), "TotalVotes", F.round("TotalVotes_log1p", 9).alias("TotalVotes_log1p")).distinct()


# 38
@query(f"""SELECT DISTINCT Id, date_diff('day', CreationDate::DATE, DATE '{AS_OF}')::INT AS age_days, date_diff('day', LastActivityDate::DATE, DATE '{AS_OF}')::INT AS recency_days,
date_diff('day', LastActivityDate::DATE, DATE '{AS_OF}') <= 30 AS active_30d FROM datasets""")
def activity_days(spark: SparkSession, d: str) -> DataFrame:
    return clean.activity(table(spark, d, "datasets"), "CreationDate", "LastActivityDate", AS_OF).select("Id", "age_days", "recency_days", "active_30d").distinct()


# 39
@query("SELECT DISTINCT Id, length(coalesce(Tags, '')) > 0 AS has_tags FROM metadata_merged_raw")
def has_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "metadata_merged_raw").select("Id", (F.length(F.coalesce("Tags", F.lit(""))) > 0).alias("has_tags")).distinct()


# 40
@query("""SELECT 'CreationDate' AS col_name, avg((try_cast(CreationDate::VARCHAR AS TIMESTAMP) IS NOT NULL)::INT) AS parsed, true AS is_date FROM metadata_merged_raw WHERE CreationDate IS NOT NULL
UNION ALL SELECT 'Title', 0.0, false UNION ALL SELECT 'Subtitle', 0.0, false""")
def date_like_columns(spark: SparkSession, d: str) -> DataFrame:
    return clean.date_like(table(spark, d, "metadata_merged_raw"), ["CreationDate", "Title", "Subtitle"])


# 41
@query("SELECT DISTINCT Title AS title, Id AS dataset_id FROM metadata_merged_raw")
def reordered_columns(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "metadata_merged_raw").drop("Description")
    return m.withColumnRenamed("Id", "dataset_id").withColumnRenamed("Title", "title").select("title", "dataset_id").distinct()


# 43, 44, 60
@query("""SELECT DISTINCT s.Id, t.tags FROM datasets s LEFT JOIN (SELECT DatasetId, string_agg(DISTINCT Name, ', ' ORDER BY Name) AS tags FROM dataset_tags b JOIN (SELECT DISTINCT Id, Name FROM tags) t ON b.TagId = t.Id
WHERE DatasetId IS NOT NULL GROUP BY DatasetId) t ON t.DatasetId = s.Id""")
def tags_per_dataset(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "tags").select(F.col("Id").alias("TagId"), "Name").distinct()
    bridge = table(spark, d, "dataset_tags").select("DatasetId", "TagId").distinct().join(names, "TagId", "left").where("DatasetId is not null and Name is not null")
    tags = bridge.groupBy(F.col("DatasetId").alias("Id")).agg(F.array_join(F.array_sort(F.collect_set("Name")), ", ").alias("tags"))
    return table(spark, d, "datasets").select("Id").distinct().join(tags, "Id", "left")


# 45
_V1 = "(SELECT * FROM dataset_versions WHERE Id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY Id ORDER BY loaded_at DESC, Title, Slug) = 1)"


@query(f"SELECT DISTINCT s.Id, v.Title, v.Slug FROM datasets s LEFT JOIN {_V1} v ON v.Id = s.CurrentDatasetVersionId")
def current_version(spark: SparkSession, d: str) -> DataFrame:
    v = clean.keep_one(table(spark, d, "dataset_versions").where("Id is not null"), ["Id"], [F.desc("loaded_at"), F.asc_nulls_last("Title"), F.asc_nulls_last("Slug")])
    v = v.select(F.col("Id").alias("CurrentDatasetVersionId"), "Title", "Slug")
    return table(spark, d, "datasets").select("Id", "CurrentDatasetVersionId").join(v, "CurrentDatasetVersionId", "left").select("Id", "Title", "Slug").distinct()


# 46, 48
@query("SELECT DISTINCT s.Id, b.doc_idx, s.Title FROM metadata_merged_raw s JOIN beh_base b ON b.Id = s.Id AND b.CreatorUserId = s.CreatorUserId WHERE s.Title <> ''")
def two_key_join(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "beh_base").select("Id", "CreatorUserId", "doc_idx")
    return table(spark, d, "metadata_merged_raw").select("Id", "CreatorUserId", "Title").join(b, ["Id", "CreatorUserId"]).where("Title <> ''").select("Id", "doc_idx", "Title").distinct()


# 47
@query("SELECT a.Id, a.TotalViews, b.TotalViews AS TotalViews_prof FROM (SELECT DISTINCT Id, TotalViews FROM datasets WHERE Id IS NOT NULL) a LEFT JOIN (SELECT DISTINCT Id, TotalViews FROM metadata_merged_raw) b ON a.Id = b.Id")
def suffixed_join(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "metadata_merged_raw").select("Id", F.col("TotalViews").alias("TotalViews_prof")).distinct()
    return table(spark, d, "datasets").select("Id", "TotalViews").where("Id is not null").distinct().join(b, "Id", "left")


# 49
@query("SELECT DISTINCT Id FROM datasets WHERE Id IS NOT NULL AND Id NOT IN (SELECT DatasetId FROM dataset_tags WHERE DatasetId IS NOT NULL)")
def untagged_datasets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dataset_tags").select(F.col("DatasetId").alias("Id")).distinct()
    return table(spark, d, "datasets").select("Id").where("Id is not null").distinct().join(t, "Id", "left_anti")


# 112, 61
@query("SELECT DatasetId, VersionNumber, Id FROM dataset_versions WHERE DatasetId IS NOT NULL AND VersionNumber IS NOT NULL QUALIFY row_number() OVER (PARTITION BY DatasetId ORDER BY VersionNumber DESC, Id) = 1")
def latest_versions(spark: SparkSession, d: str) -> DataFrame:
    return clean.latest_version(table(spark, d, "dataset_versions").where("DatasetId is not null"), "DatasetId", "VersionNumber", "Id").select("DatasetId", "VersionNumber", "Id")


# 119, 120
@query("""SELECT doc, 'left' AS side FROM (SELECT DISTINCT doc_idx AS doc FROM relevance_tag_docs WHERE doc_idx IS NOT NULL EXCEPT SELECT doc_idx FROM beh_base)
UNION ALL SELECT doc, 'right' FROM (SELECT DISTINCT doc_idx AS doc FROM beh_base WHERE doc_idx IS NOT NULL EXCEPT SELECT doc_idx FROM relevance_tag_docs)""")
def id_difference(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "relevance_tag_docs").where("doc_idx is not null").select(F.col("doc_idx").alias("doc"))
    b = table(spark, d, "beh_base").where("doc_idx is not null").select(F.col("doc_idx").alias("doc"))
    return integrity.symmetric_difference(a, b, "doc")


# 115
@query("SELECT src, count(*) AS n FROM (SELECT 'datasets' AS src FROM datasets UNION ALL SELECT 'versions' FROM dataset_versions UNION ALL SELECT 'tags' FROM tags) GROUP BY src")
def union_of_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(n).alias("src")) for t, n in (("datasets", "datasets"), ("dataset_versions", "versions"), ("tags", "tags"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("src").agg(F.count("*").alias("n"))


# 187
@query("""WITH c AS (SELECT Id, doc_idx FROM beh_base WHERE Id IS NOT NULL), t AS (SELECT DISTINCT DatasetId AS Id, Slug AS path FROM dataset_versions WHERE DatasetId IS NOT NULL), x AS (SELECT DISTINCT Id, doc_idx FROM beh_base WHERE Id IS NOT NULL)
SELECT 'count' AS check_name, abs(count(*) - 2000)::BIGINT AS n_bad FROM c
UNION ALL SELECT 'without_table', count(*) FROM (SELECT DISTINCT Id FROM c WHERE Id NOT IN (SELECT Id FROM t))
UNION ALL SELECT 'without_id', count(*) FROM (SELECT DISTINCT Id FROM t WHERE Id NOT IN (SELECT Id FROM c))
UNION ALL SELECT 'repeated', count(*) FROM (SELECT Id FROM c GROUP BY Id HAVING count(*) > 1)
UNION ALL SELECT 'empty_path', count(*) FROM t WHERE path IS NULL OR trim(path) = ''
UNION ALL SELECT 'other_index', count(*) FROM c JOIN x ON c.Id = x.Id WHERE c.doc_idx <> x.doc_idx""")
def integrity_checks(spark: SparkSession, d: str) -> DataFrame:
    chosen = table(spark, d, "beh_base").where("Id is not null").select("Id", "doc_idx")
    tables = table(spark, d, "dataset_versions").where("DatasetId is not null").select(F.col("DatasetId").alias("Id"), F.col("Slug").alias("path")).distinct()
    return integrity.check_selection(chosen, tables, chosen, 2000)


# 188, 114
@query("""WITH u AS (SELECT DISTINCT DatasetId AS Id FROM dataset_versions WHERE TotalCompressedBytes > 1000000), k AS (SELECT Id FROM (SELECT DISTINCT Id FROM beh_base WHERE Id IS NOT NULL AND Id % 3 = 0) JOIN u USING (Id)),
c AS (SELECT Id, CASE WHEN max(TotalVotes) > 5 THEN 1 ELSE 2 END AS tier, max(TotalDownloads) AS score FROM metadata_merged_raw WHERE Id IS NOT NULL GROUP BY Id),
f AS (SELECT Id, tier, row_number() OVER (ORDER BY tier, score DESC NULLS LAST, Id) AS rn FROM c WHERE Id IN (SELECT Id FROM u) AND Id NOT IN (SELECT Id FROM k))
SELECT Id, 'kept' AS source FROM k UNION ALL SELECT Id, 'tier' || tier FROM f WHERE rn <= 800 - (SELECT count(*) FROM k)""")
def refilled_selection(spark: SparkSession, d: str) -> DataFrame:
    usable = table(spark, d, "dataset_versions").where("TotalCompressedBytes > 1000000").select(F.col("DatasetId").alias("Id"))
    chosen = table(spark, d, "beh_base").where("Id is not null and Id % 3 = 0").select("Id")
    m = table(spark, d, "metadata_merged_raw").where("Id is not null").groupBy("Id").agg(F.max("TotalVotes").alias("v"), F.max("TotalDownloads").alias("score"))
    return integrity.refill(chosen, usable, m.select("Id", F.when(F.col("v") > 5, 1).otherwise(2).alias("tier"), "score"), 800)


# 50 with 104: neighbours of the requested rows only
@query("""SELECT row, count(DISTINCT col) AS n_nbrs FROM s_fused3_symrow WHERE row IN (SELECT row_id FROM rank_requests) AND row <> col AND val IS NOT NULL AND val::VARCHAR <> 'nan' GROUP BY row""")
def requested_neighbours(spark: SparkSession, d: str) -> DataFrame:
    from viewloom.plans.views import A, graph

    want = table(spark, d, "rank_requests").select(F.col("row_id").alias("row")).distinct()
    return graph(spark, d, A).join(want, "row", "left_semi").groupBy("row").agg(F.count("*").alias("n_nbrs"))


# 48, 78, 79
@query(f"WITH {OW} SELECT doc, owner, count(*) OVER (PARTITION BY owner) - 1 AS others FROM ow")
def owner_counts(spark: SparkSession, d: str) -> DataFrame:
    o = owners(spark, d)
    n = o.groupBy("owner").agg((F.count("*") - 1).alias("others"))
    return o.join(n, "owner").select("doc", "owner", "others")


__all__ = ["ORACLES", "QUERIES", "doc_tags", "query"]
