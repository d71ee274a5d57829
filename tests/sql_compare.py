"""Compare a query with its SQL counterpart on a folder of parquet tables."""

import math
import os

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def have_data():
    return os.path.isdir(FOLDER)


def connect():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(FOLDER)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def assert_same(spark, query, sql):
    df = query(spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    r = connect().execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    expected = sorted(repr([plain(row[names.index(c)]) for c in cols]) for row in r.fetchall())
    assert got == expected
