"""Queries p4_ and p5_: records that fail to parse, references that don't hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.operators.orphans import Reference, orphan_references, orphan_report
from viewloom.operators.rejects import LAYOUTS, load_records
from viewloom.sources.tables import table

REFERENCES = (
    (Reference("datasets", "Id", "CurrentDatasetVersionId", "Id"), "datasets", "dataset_versions"),
    (Reference("dataset_tags", "Id", "TagId", "Id"), "dataset_tags", "tags"),
    (Reference("beh_base", "doc_idx", "CreatorUserId", "Id", none=(0, -1)), "beh_base", "creator_users"),
)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return load_records(table(spark, d, "raw_records")).records.where("reason is not null").select("record_id", "reason").distinct()


def p4_valid_versions(spark: SparkSession, d: str) -> DataFrame:
    return load_records(table(spark, d, "raw_records")).valid("DatasetVersions.csv")


def p4_valid_datasets(spark: SparkSession, d: str) -> DataFrame:
    return load_records(table(spark, d, "raw_records")).valid("Datasets.csv")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    r = load_records(table(spark, d, "raw_records")).records.where("reason is not null")
    return r.groupBy("file_name", "reason", "bad_column", "bad_detail").agg(F.count("*").alias("n_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [orphan_references(table(spark, d, c), table(spark, d, p), r) for r, c, p in REFERENCES])


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [orphan_report(table(spark, d, c), table(spark, d, p), r) for r, c, p in REFERENCES])


_P5_PART = """
SELECT '{t}' AS table_name, strftime(c.loaded_at, '%Y-%m') AS period, c.{rec} AS record_id,
  CASE WHEN p.k IS NULL THEN 'missing' WHEN p.d <= c.loaded_at THEN 'deleted' WHEN p.l > c.loaded_at THEN 'late' END AS reason
FROM {t} c LEFT JOIN (SELECT Id AS k, min(deleted_at) AS d, min(loaded_at) AS l FROM {p} WHERE Id IS NOT NULL GROUP BY Id) p ON p.k = c.{key}
WHERE c.{key} IS NOT NULL {more}"""
_P5 = " UNION ALL ".join(
    _P5_PART.format(t=c, p=p, rec=r.record, key=r.key, more=f"AND c.{r.key} NOT IN ({', '.join(map(str, r.none))})" if r.none else "")
    for r, c, p in REFERENCES
)
P5_FOUND = f"SELECT DISTINCT * FROM ({_P5}) WHERE reason IS NOT NULL"
P5_REPORT = f"SELECT table_name, period, reason, count(*) AS n_records FROM ({P5_FOUND}) GROUP BY ALL"

_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_P4 = rf"""
WITH r AS (SELECT record_id, file_name, regexp_replace(raw_text, '(\r\n|\r|\n)\z', '') AS t FROM raw_records),
q AS (SELECT *, coalesce(regexp_full_match(t, '(?s){_FIELD}(,{_FIELD})*'), true) AS ok FROM r),
f AS (SELECT *, CASE WHEN ok THEN list_transform(regexp_extract_all(t || ',', '(?s)({_FIELD}),', 1),
        lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:length(x) - 1], '""', '"') ELSE x END) END AS v FROM q),
s AS (SELECT *, CASE WHEN NOT ok THEN 'quoting' WHEN coalesce(len(v) <> CASE file_name WHEN 'DatasetVersions.csv' THEN 8 WHEN 'Datasets.csv' THEN 5 END, true)
        THEN 'column_count' END AS structure FROM f),
c AS (SELECT record_id, file_name, v, structure, CASE WHEN structure IS NOT NULL THEN false WHEN file_name = 'DatasetVersions.csv'
        THEN bad(v[1], 1, false) OR bad(v[2], 1, false) OR bad(v[3], 1, false) OR bad(v[8], 0, true)
        ELSE bad(v[1], 1, false) OR bad(v[2], 1, true) OR bad(v[4], 1, true) OR bad(v[5], 0, true)
          OR NOT regexp_full_match(v[3], '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') OR try_strptime(v[3], '%m/%d/%Y %H:%M:%S') IS NULL END AS b FROM s)
"""
_P4_ROWS = "SELECT DISTINCT record_id, coalesce(structure, 'invalid_value') AS reason FROM c WHERE structure IS NOT NULL OR b"


def _detail_sql() -> str:
    """The first invalid field of each record: its column and what is wrong with it."""
    arms = []
    for f, cols in LAYOUTS.items():
        for i, (name, kind) in enumerate(cols, 1):
            if kind == "text":
                continue
            x = f"v[{i}]"
            number = rf"regexp_full_match({x}, '[0-9]{{1,19}}(\.0)?')"
            size = f"try_cast(replace({x}, '.0', '') AS HUGEINT)"
            time = f"(NOT regexp_full_match({x}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') OR try_strptime({x}, '%m/%d/%Y %H:%M:%S') IS NULL)"
            tests = [] if kind.startswith("opt_") else [(f"{x} = ''", "empty")]
            tests += [(time, "not a time")] if kind == "stamp" else [(f"{x} <> '' AND NOT {number}", "not a number"), (f"{x} <> '' AND {size} > 9223372036854775807", "too large")]
            tests += [(f"{x} <> '' AND {size} < 1", "below 1")] if kind.endswith("id") else []
            arms += [f"WHEN file_name = '{f}' AND {t} THEN {{'c': '{name}', 'd': '{d}'}}" for t, d in tests]
    return "CASE WHEN structure IS NOT NULL THEN NULL " + " ".join(arms) + " END"


def _valid_sql(f: str) -> str:
    kinds = {"id": "try_cast(replace({x}, '.0', '') AS BIGINT)", "stamp": "try_strptime({x}, '%m/%d/%Y %H:%M:%S')", "text": "{x}"}
    cols = [kinds[k.removeprefix("opt_").replace("count", "id")].format(x=f"v[{i}]") + f" AS {n}" for i, (n, k) in enumerate(LAYOUTS[f], 1)]
    return f"SELECT record_id, {', '.join(cols)} FROM c WHERE file_name = '{f}' AND structure IS NULL AND NOT b"


def _inline_bad(sql: str) -> str:
    """Replace bad(x, least, optional) by its expression: DuckDB gets one statement, without macros."""
    import re

    def one(m: re.Match) -> str:
        x, least, optional = m[1], m[2], m[3] == "true"
        test = rf"(NOT regexp_full_match({x}, '[0-9]{{1,19}}(\.0)?') OR coalesce(try_cast(replace({x}, '.0', '') AS HUGEINT) NOT BETWEEN {least} AND 9223372036854775807, true))"
        return f"({x} <> '' AND {test})" if optional else test

    return re.sub(r"bad\((v\[\d\]), (\d), (true|false)\)", one, sql)


_P4 = _inline_bad(_P4).rstrip()
P4_FOUND = _P4 + _P4_ROWS
P4_REPORT = _P4 + f", e AS (SELECT file_name, coalesce(structure, 'invalid_value') AS reason, {_detail_sql()} AS x FROM c WHERE structure IS NOT NULL OR b) SELECT file_name, reason, x.c AS bad_column, x.d AS bad_detail, count(*) AS n_records FROM e GROUP BY ALL"

QUERIES = {
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p4_valid_versions": p4_valid_versions,
    "p4_valid_datasets": p4_valid_datasets,
    "p5_found": p5_found,
    "p5_report": p5_report,
}
ORACLES = {"p4_found": P4_FOUND, "p4_report": P4_REPORT, "p4_valid_versions": _P4 + _valid_sql("DatasetVersions.csv"), "p4_valid_datasets": _P4 + _valid_sql("Datasets.csv"), "p5_found": P5_FOUND, "p5_report": P5_REPORT}
