"""Rows that fail to parse: structural checks plus a dictionary of invalid values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.operators.skew import heavy_limit, split_join
from viewloom.session import materialise

MAX_LONG = "9223372036854775807"

# The checked file layouts, as (column, kind). Kinds: id = number of at least 1, count = number of
# at least 0, a leading "opt_" = may be empty, stamp = MM/DD/YYYY HH:MM:SS, text = anything.
LAYOUTS: dict[str, list[tuple[str, str]]] = {
    "DatasetVersions.csv": [
        ("Id", "id"),
        ("DatasetId", "id"),
        ("VersionNumber", "id"),
        ("Title", "text"),
        ("Slug", "text"),
        ("Subtitle", "text"),
        ("Description", "text"),
        ("TotalCompressedBytes", "opt_count"),
    ],
    "Datasets.csv": [
        ("Id", "id"),
        ("CurrentDatasetVersionId", "opt_id"),
        ("CreationDate", "stamp"),
        ("CreatorUserId", "opt_id"),
        ("TotalViews", "opt_count"),
    ],
}

_MARK, _ESC, _SEP = "\x1f", "\x1f0", "\x1f1"


def _text_keys() -> list[Column]:
    """Two independent 64-bit hashes of a record's text: with record_id and file_name they name the record (equal ones share a verdict)."""
    return [F.xxhash64("raw_text").alias("h1"), F.xxhash64(F.lit(1), F.reverse("raw_text")).alias("h2")]


def _same_record(a: DataFrame, b: DataFrame) -> Column:
    return a["record_id"].eqNullSafe(b["record_id"]) & a["file_name"].eqNullSafe(b["file_name"]) & (a["h1"] == b["h1"]) & (a["h2"] == b["h2"])


@dataclass
class Loaded:
    """``records``: (record_id, file_name, reason, bad_column, bad_detail), one row per record (reason NULL = valid)."""

    raw: DataFrame
    verdicts: DataFrame
    layouts: dict[str, list[tuple[str, str]]]

    @property
    def records(self) -> DataFrame:
        return self.verdicts.drop("h1", "h2")

    def rejected(self) -> DataFrame:
        """The rejected records with their texts: only their keys meet the raw table again."""
        bad = self.verdicts.where(F.col("reason").isNotNull()).distinct()
        raw = self.raw.select("record_id", "file_name", "raw_text", *_text_keys())
        return raw.join(bad, _same_record(raw, bad)).select(raw["record_id"], raw["file_name"], "reason", "bad_column", "bad_detail", "raw_text")

    def valid(self, file_name: str) -> DataFrame:
        """Typed columns of the valid records of one file."""
        bad = self.verdicts.where(f"reason = 'invalid_value' and file_name = '{file_name}'").select("record_id", "file_name", "h1", "h2").distinct()
        parsed = _parsed(self.raw.where(F.col("file_name") == file_name), self.layouts).where("structure is null")
        kinds = {"id": "bigint", "count": "bigint"}
        out = [F.col("record_id")]
        for i, (name, kind) in enumerate(self.layouts[file_name]):
            v = F.col("fields")[i]
            base = kind.removeprefix("opt_")
            if base in kinds:
                v = F.expr(f"try_cast(regexp_replace(fields[{i}], '[.]0$', '') as bigint)")
            elif base == "stamp":
                v = F.try_to_timestamp(v, F.lit("MM/dd/yyyy HH:mm:ss"))
            out.append(v.alias(name))
        return parsed.join(bad, _same_record(parsed, bad), "left_anti").select(*out)


def _quoting_ok(parts: Column) -> Column:
    """``parts``: the record split at every quote. Even parts are outside of quotes, odd ones inside."""
    n = F.size(parts)
    first, last = parts[0], F.element_at(parts, -1)
    ends = (first == "") | first.endswith(",")
    starts = (last == "") | last.startswith(",")
    # the lambda sees its own element only: a reference to ``parts`` in it would split the text again for each
    between = F.transform(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), lambda p, i: (i % 2 == 0) | (p == "") | (p.startswith(",") & p.endswith(",")))
    return F.when(n == 1, F.lit(True)).otherwise((n % 2 == 1) & ends & starts & F.forall(between, lambda x: x))


def _fields(parts: Column) -> Column:
    """Fields of a record whose quoting holds: commas outside of quotes separate."""
    marked = F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(","), F.lit(_SEP))).otherwise(p))
    raw = F.split(F.array_join(marked, '"'), _SEP, -1)
    plain = F.transform(raw, lambda f: F.replace(f, F.lit(_ESC), F.lit(_MARK)))
    return F.transform(
        plain,
        lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, 2, F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f),
    )


def invalid_reason(kind: Column, value: Column) -> Column:
    """Why ``value`` isn't valid for ``kind``; NULL where it is."""
    optional, base = kind.startswith("opt_"), F.regexp_replace(kind, "^opt_", "")
    number = value.rlike(r"\A[0-9]{1,19}(\.0)?\z")
    digits = F.regexp_replace(value, r"\.0\z", "")
    size = F.when(number, digits).cast("decimal(20,0)")
    stamp = F.when(
        value.rlike(r"\A[0-9]{2}/[0-9]{2}/[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"),
        F.try_to_timestamp(value, F.lit("MM/dd/yyyy HH:mm:ss")),
    )
    return (
        F.when((base == "text") | (optional & (value == "")), None)
        .when(value == "", "empty")
        .when(base == "stamp", F.when(stamp.isNull(), "not a time"))
        .when(~number, "not a number")
        .when(size > F.lit(MAX_LONG).cast("decimal(20,0)"), "too large")
        .when((base == "id") & (size < 1), "below 1")
    )


def _parsed(raw: DataFrame, layouts: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """(record_id, file_name, h1, h2, fields, structure): structure is ``quoting``, ``column_count`` or NULL, fields as far as the quoting holds."""
    wide = F.create_map(*[x for f, cols in layouts.items() for x in (F.lit(f), F.lit(len(cols)))])
    text = F.regexp_replace("raw_text", r"(?:\r\n|\r|\n)\z", "")
    base = raw.select("record_id", "file_name", *_text_keys(), text.alias("text"))
    base = base.withColumn("parts", F.when(F.contains("text", F.lit('"')), F.split(F.replace(F.col("text"), F.lit(_MARK), F.lit(_ESC)), '"', -1)))
    # a text without quotes is split as it is
    plain = F.col("parts").isNull()
    base = base.withColumn("quoted", F.when(plain, F.col("text").isNotNull()).otherwise(_quoting_ok(F.col("parts"))))
    base = base.withColumn("fields", F.when(plain, F.split("text", ",", -1)).when(F.col("quoted"), _fields(F.col("parts"))))
    wrong = F.coalesce(F.size("fields") != wide[F.col("file_name")], F.lit(True))
    structure = F.when(F.col("parts").isNotNull() & ~F.col("quoted"), "quoting").when(F.col("fields").isNull() | wrong, "column_count")
    return base.select("record_id", "file_name", "h1", "h2", "fields", structure.alias("structure"))


def load_records(raw: DataFrame, layouts: dict[str, list[tuple[str, str]]] | None = None) -> Loaded:
    """Split raw CSV records into valid ones and rejected ones with the first reason that applies.

    ``raw`` has record_id, file_name and raw_text; further columns are ignored. Reasons: ``quoting``, ``column_count``,
    ``invalid_value`` (then bad_column and bad_detail name the first bad field). A NULL raw_text, an empty one or a
    file_name without layout has no right number of columns: ``column_count``. Texts of any length are split with
    linear string functions, without backtracking. NULL and repeated record_ids are records of their own; repeated records give
    repeated rows; empty input gives none.

    The texts are parsed once: verdicts on the structure and the checked fields (no free text) are written, with a number for each record.
    Every distinct value of a checked column is validated once; the dictionary of the invalid ones is joined back, frequent ones by broadcast.
    """
    layouts = layouts or LAYOUTS
    raw = raw.select("record_id", "file_name", "raw_text")
    checks = [(f, [(i, n, k) for i, (n, k) in enumerate(cols) if k != "text"]) for f, cols in layouts.items()]
    values = F.lit(None).cast("array<string>")
    for f, cols in checks:
        values = F.when(F.col("file_name") == f, F.array(*[F.col("fields")[i] for i, _, _ in cols])).otherwise(values)
    base = _parsed(raw, layouts).withColumn("vals", F.when(F.col("structure").isNull(), values)).drop("fields")
    base = materialise(base.withColumn("rid", F.monotonically_increasing_id()), "records")

    cells = base.where("structure is null").select("rid", "file_name", F.posexplode("vals").alias("at", "value"))
    layout = F.broadcast(raw.sparkSession.createDataFrame([(f, at, i, n, k) for f, cols in checks for at, (i, n, k) in enumerate(cols)], "file_name string, at int, pos int, col_name string, kind string"))
    distinct = cells.groupBy("file_name", "at", "value").agg(F.count("*").alias("n")).join(layout, ["file_name", "at"])
    bad = distinct.withColumn("detail", invalid_reason(F.col("kind"), F.col("value"))).where("detail is not null").drop("kind")
    bad = materialise(bad, "invalid")
    hits = split_join(cells, bad, ["file_name", "at", "value"], heavy_limit(bad.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    hits = hits.groupBy("rid").agg(F.min(F.struct("pos", "col_name", "detail")).alias("first_bad"))
    out = base.drop("vals").join(hits, "rid", "left").select(
        "record_id",
        "file_name",
        F.coalesce("structure", F.when(F.col("first_bad").isNotNull(), "invalid_value")).alias("reason"),
        F.col("first_bad.col_name").alias("bad_column"),
        F.col("first_bad.detail").alias("bad_detail"),
        "h1",
        "h2",
    )
    return Loaded(raw, out, layouts)
