"""Readers and writers of table files."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Suffixes of table files, and names of files that aren't a main table.
TABLE_SUFFIXES = (".csv", ".tsv", ".parquet", ".xlsx", ".xls")
NOT_MAIN = ("^sample_submission", "_submission", "_dictionary", "_codebook", "^README", "^LICENSE")


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, need: list[str] | None = None, bad_rows: str = "keep", sep: str = ",", encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """CSV with header, quotes doubled inside quotes. ``multi_line``: also line breaks inside quotes; then a file is one task, however large,
    without it files are split.

    Without ``schema`` all columns are read as text (no inference pass). ``need``: of these the columns that exist. ``bad_rows``: ``keep``
    (missing fields are NULL), ``drop`` or ``fail``: for these two all columns are parsed, as only then every line's fields are counted.
    """
    mode = {"keep": "PERMISSIVE", "drop": "DROPMALFORMED", "fail": "FAILFAST"}[bad_rows]
    r = spark.read.options(header=True, multiLine=multi_line, quote='"', escape='"', sep=sep, encoding=encoding, mode=mode, columnPruning=bad_rows == "keep")
    df = (r.schema(schema) if schema is not None else r).csv(path)
    return df.select(*[c for c in need if c in df.columns]) if need is not None else df


def read_table(spark: SparkSession, path: str, rows: int | None = None, multi_line: bool = True) -> DataFrame | None:
    """A table by its suffix; None for an unknown suffix or a file that can't be read.

    CSV and TSV are read as UTF-8, or as Latin-1 where a byte of the whole file (or of the first ``rows`` rows, if only these are wanted)
    doesn't fit: the lines are looked through first, in parallel. ``multi_line`` as in ``read_csv``. Excel files need pandas and an engine for them.
    """
    suffix = PurePosixPath(path).suffix.lower()
    try:
        if suffix in (".csv", ".tsv"):
            sep = "\t" if suffix == ".tsv" else ","
            lines = spark.read.text(path)
            lines = lines.limit(rows + 1) if rows is not None else lines
            fits = lines.where(~F.is_valid_utf8("value")).isEmpty()
            df = read_csv(spark, path, bad_rows="drop", sep=sep, encoding="UTF-8" if fits else "ISO-8859-1", multi_line=multi_line)
        elif suffix == ".parquet":
            df = spark.read.parquet(path)
        elif suffix in (".xlsx", ".xls"):
            df = spark.createDataFrame(pd.read_excel(path.removeprefix("file://"), nrows=rows))
        else:
            return None
        return df.limit(rows) if rows is not None else df
    except Exception as e:  # noqa: BLE001
        if type(e).__name__ in ("AnalysisException", "ParseException", "FileNotFoundError", "ImportError", "ValueError", "SparkRuntimeException"):
            return None
        raise


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")


def main_tables(files: DataFrame, key: str) -> DataFrame:
    """(key, path, length, suffix): the largest table file per key of (key, path, length); helper files don't count. Ties by path."""
    name = F.element_at(F.split("path", "/"), -1)
    stem, suffix = F.regexp_replace(name, r"\.[^.]*$", ""), F.lower(F.regexp_extract(name, r"\.[^.]*$", 0))
    ok = suffix.isin(*TABLE_SUFFIXES) & ~stem.rlike("(?i)" + "|".join(NOT_MAIN))
    best = files.where(ok).groupBy(key).agg(F.min(F.struct((-F.col("length")).alias("neg"), "path", suffix.alias("suffix"))).alias("b"))
    return best.select(key, F.col("b.path").alias("path"), (-F.col("b.neg")).alias("length"), F.col("b.suffix").alias("suffix"))


def quoted_line(df: DataFrame, text: list[str]) -> DataFrame:
    """(line): one CSV line per row; the ``text`` columns always quoted, the others never. NULL is empty."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(F.concat_ws(",", *[quote(c) if c in text else plain(c) for c in df.columns]).alias("line"))


def write_quoted_csv(df: DataFrame, path: str, text: list[str]) -> None:
    """Parts of quoted lines; the header is a file of its own named ``_header`` beside them."""
    quoted_line(df, text).write.mode("overwrite").text(path)
    df.sparkSession.createDataFrame([(",".join(df.columns),)], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/_header")


def write_metrics(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stage_table(spark: SparkSession, path: str, make, rows: int | None = None) -> DataFrame:
    """The table at ``path`` if it is complete (and has ``rows`` rows), else ``make()`` is written there: resumable stages."""
    if exists(spark, f"{path}/_SUCCESS"):
        df = spark.read.parquet(path)
        if rows is None or df.count() == rows:
            return df
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def to_latex(df: DataFrame, most: int = 200) -> str:
    """A LaTeX table of a small result (an error beyond ``most`` rows)."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    esc = lambda v: "" if v is None else re.sub(r"([&%$#_{}])", r"\\\1", f"{v:.4f}" if isinstance(v, float) else str(v))
    line = lambda vs: " & ".join(vs) + r" \\"
    body = [line([esc(c) for c in df.columns]), r"\midrule", *[line([esc(v) for v in r]) for r in rows]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\toprule", *body, r"\bottomrule", r"\end{tabular}"])
