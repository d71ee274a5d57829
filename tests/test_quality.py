import random
from datetime import datetime

import pytest

from viewloom.operators.orphans import Reference, orphan_references, orphan_report
from viewloom.operators.rejects import LAYOUTS, load_records

V, D = "DatasetVersions.csv", "Datasets.csv"


def parse(text):
    """Fields of a record, or None where the quoting is broken: one character at a time."""
    fields, i, n = [], 0, len(text)
    while True:
        if i < n and text[i] == '"':
            i, out = i + 1, []
            while True:
                if i >= n:
                    return None
                if text[i] == '"':
                    if i + 1 < n and text[i + 1] == '"':
                        out.append('"')
                        i += 2
                        continue
                    i += 1
                    break
                out.append(text[i])
                i += 1
            if i < n and text[i] != ",":
                return None
        else:
            j = text.find(",", i)
            j = n if j < 0 else j
            out = text[i:j]
            if '"' in out:
                return None
            i = j
        fields.append("".join(out))
        if i >= n:
            return fields
        i += 1


def valid(kind, v):
    if kind == "text" or (kind.startswith("opt_") and v == ""):
        return True
    base = kind.removeprefix("opt_")
    if base == "stamp":
        try:
            return len(v) == 19 and v[2] == v[5] == "/" and v.replace("/", "").replace(":", "").replace(" ", "").isdigit() and bool(datetime.strptime(v, "%m/%d/%Y %H:%M:%S"))
        except ValueError:
            return False
    d = v.removesuffix(".0")
    if not (d.isascii() and d.isdigit() and 1 <= len(d) <= 19):
        return False
    return (1 if base == "id" else 0) <= int(d) <= 2**63 - 1


def reason(name, text):
    if text is None:
        return "column_count"
    for end in ("\r\n", "\n", "\r"):
        if text.endswith(end):
            text = text[: -len(end)]
            break
    f = parse(text)
    if f is None:
        return "quoting"
    if name not in LAYOUTS or len(f) != len(LAYOUTS[name]):
        return "column_count"
    return None if all(valid(k, v) for (_, k), v in zip(LAYOUTS[name], f)) else "invalid_value"


def frame(spark, rows):
    # columns named like the operator's own
    return spark.createDataFrame([(i, f, t, "x", 1) for i, (f, t) in enumerate(rows)], "record_id long, file_name string, raw_text string, reason string, pos int")


FIXED = [
    (V, '1,2,3,t,s,,"d",5'),
    (V, '1,2,3,t,s,,"a ""b"", c\r\nd",\r\n'),
    (V, '1,2,3,t,s,,"open,5'),
    (V, '1,2,3,t,s,,"x"y,5'),
    (V, '1,2,3,t,s,,x"y",5'),
    (V, '"1","2","3","","","","",""'),
    (V, '"",2,3,t,s,,d,5'),
    (V, "1,2,3,t,s,,d,9223372036854775808"),
    (V, "1,2,3,t,s,,d,9223372036854775807.0\r"),
    (V, "1.0,2,0,t,s,,d,5"),
    (V, "1,2,3,t,s,,d,-5"),
    (V, "1,2,3,t,s,,d, 5"),
    (V, "1,2,3,t,s,,d,5\n\n"),
    (V, "1,2,3,t,s\x1f,,\x1f0\x1f1,5"),
    (D, "1,,02/29/2024 23:59:59,,"),
    (D, "1,,02/29/2023 23:59:59,,"),
    (D, "1,0,02/28/2023 23:59:59,,"),
    (D, "1,2,2/28/2023 23:59:59,3,4"),
    (D, "1,2,02/28/2023 24:00:00,3,4"),
    (D, "1,2,,3,4"),
    (D, "1,2,3"),
    (D, '""'),
    (D, '"""'),
    (D, '""""'),
    (D, ""),
    (D, None),
    ("Other.csv", "1"),
    (None, "1,2"),
    (V, "1,2,3,t,s,," + '"' + 'q""' * 20000 + '",5'),
]


def test_fixed_records(spark):
    got = {r.record_id: r.reason for r in load_records(frame(spark, FIXED)).records.collect()}
    assert got == {i: reason(*r) for i, r in enumerate(FIXED)}


def test_random_records_equal_a_plain_parser(spark):
    r = random.Random(4)
    parts = ["1", "7", "", '"', '""', ",", ",", "a", "\n", "0", ".0", '"x"', "01/02/2020 03:04:05"]
    rows = [(r.choice([V, D]), "".join(r.choice(parts) for _ in range(r.randint(0, 16)))) for _ in range(1500)]
    rows += [(D, f"{r.randint(0, 9)},{r.choice(['', '5', '0'])},{r.randint(1, 13):02d}/{r.randint(1, 32):02d}/2021 {r.randint(0, 25):02d}:00:00,,{r.choice(['1', 'x', ''])}") for _ in range(300)]
    got = {x.record_id: x.reason for x in load_records(frame(spark, rows)).records.collect()}
    assert got == {i: reason(*x) for i, x in enumerate(rows)}
    assert {*got.values()} == {None, "quoting", "column_count", "invalid_value"}


def test_valid_rows_are_typed(spark, same):
    loaded = load_records(frame(spark, FIXED))
    same(loaded.valid(D).select("Id", "CurrentDatasetVersionId", "CreationDate"), [(1, None, datetime(2024, 2, 29, 23, 59, 59))])
    assert loaded.valid(V).where("Description like '%\"b\", c%'").count() == 1
    assert loaded.rejected().where("record_id = 10").first().bad_column == "TotalCompressedBytes"


def test_null_and_repeated_record_ids(spark, same):
    good, bad = "1,,02/29/2024 23:59:59,,", "0,,02/29/2024 23:59:59,,"
    rows = [(None, bad), (None, good), (5, good), (5, bad), (6, good), (6, good), (7, bad), (7, bad)]
    loaded = load_records(spark.createDataFrame([(i, D, t, "x") for i, t in rows], "record_id long, file_name string, raw_text string, pos string"))
    same(loaded.valid(D).select("record_id", "Id"), [(None, 1), (5, 1), (6, 1), (6, 1)])
    same(loaded.rejected().select("record_id", "reason", "bad_column", "bad_detail", "raw_text"), [(i, "invalid_value", "Id", "below 1", bad) for i in (None, 5, 7, 7)])
    assert loaded.records.count() == 8


def test_a_value_that_is_most_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr("viewloom.operators.rejects.heavy_limit", lambda total: 50)
    rows = [(D, f"{'x' if i % 2 else i + 1},,02/29/2024 23:59:59,,")  for i in range(300)]
    got = load_records(frame(spark, rows)).records.where("bad_detail = 'not a number'").count()
    assert got == 150


def test_no_records(spark):
    loaded = load_records(frame(spark, []))
    assert loaded.rejected().count() == 0 and loaded.valid(V).count() == 0


REF = Reference("kids", "Id", "k", "Id", none=(0, -1))


def times(spark):
    t = [datetime(2024, m, 1) for m in range(1, 7)]
    parents = [(1, t[0], None), (1, t[3], t[4]), (2, t[3], None), (3, t[0], t[1]), (None, t[0], None)]
    kids = [(10, 1, t[2]), (11, 1, t[5]), (12, 2, t[1]), (12, 2, t[1]), (13, 3, t[1]), (14, 3, t[0]), (15, 9, t[2]), (16, None, t[2]), (17, 0, t[2]), (18, -1, t[2]), (19, 9, None), (20, 3, None)]
    p = spark.createDataFrame(parents, "Id long, loaded_at timestamp_ntz, deleted_at timestamp_ntz").selectExpr("*", "1 as n", "'x' as fk")
    c = spark.createDataFrame(kids, "Id long, k long, loaded_at timestamp_ntz").selectExpr("*", "1 as n", "'x' as reason", "'y' as fk")
    return c, p


EXPECTED = [("kids", "2024-06", 11, "deleted"), ("kids", "2024-02", 12, "late"), ("kids", "2024-02", 13, "deleted"), ("kids", "2024-03", 15, "missing"), ("kids", None, 19, "missing")]


@pytest.mark.parametrize("rows", [1, 10_000])
def test_orphans(spark, same, rows, monkeypatch):
    monkeypatch.setattr("viewloom.operators.orphans.heavy_limit", lambda total: rows)
    c, p = times(spark)
    same(orphan_references(c, p, REF), EXPECTED)


def test_orphan_report_and_empty_tables(spark, same):
    c, p = times(spark)
    same(orphan_report(c, p, REF).where("period = '2024-02'"), [("kids", "2024-02", "late", 1), ("kids", "2024-02", "deleted", 1)])
    assert orphan_references(c.limit(0), p, REF).count() == 0
    assert {r.reason for r in orphan_references(c, p.limit(0), REF).collect()} == {"missing"}
