"""The content view: tables to column profiles, sentences, vectors, and a graph of the tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewloom.operators import profile as pr
from viewloom.operators.graph import symmetrise
from viewloom.operators.similar import nearest, nearest_in_cells
from viewloom.session import materialise

#: Texts to unit vectors, one row each.
Encoder = Callable[[list[str]], np.ndarray]


def encode_texts(texts: DataFrame, keys: list[str], text: str, encoder: Encoder | None = None, dim: int = 64) -> DataFrame:
    """(keys..., v): a vector of each text. ``encoder`` runs over Arrow batches in the workers (it loads its model there, once).

    Without one, signed hashing of the words stands in its place (``profile.hashed_text_vectors``): texts without a word have no vector.
    """
    if encoder is None:
        return pr.hashed_text_vectors(texts, keys, text, dim)
    kinds = [f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(encoder([t or "" for t in b.column(len(keys)).to_pylist()]), dtype=float) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(v.tolist(), pa.list_(pa.float64()))], names=[*keys, "v"])

    return texts.select(*keys, text).mapInArrow(run, ", ".join([*kinds, "v array<double>"]))


def table_rows(df: DataFrame, keys: list[str], order: list, budgets: DataFrame) -> DataFrame:
    """``df`` under every budget (label, max_rows, max_cols) of the small table: the first ``max_rows`` rows by ``order`` of each table (keys)."""
    most = budgets.agg(F.max("max_rows")).first()[0]
    x = df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_at") <= most)
    return x.join(F.broadcast(budgets), F.col("_at") <= F.col("max_rows")).drop("_at", "max_rows")


def column_profiles(rows: DataFrame, keys: list[str], max_cols: str | int = 60) -> DataFrame:
    """(keys..., col_name, description, dtype, missing_pct, unique_pct): of each table the columns worth keeping, at most ``max_cols``
    (a number, or a column of ``rows`` that is part of ``keys``), with a sentence each."""
    long = materialise(pr.long_columns(rows, keys), "long")
    kept = pr.keep_columns_by(pr.profile(long, keys), keys, F.col(max_cols) if isinstance(max_cols, str) else F.lit(max_cols))
    kept = materialise(kept, "profiles")
    texts = pr.describe(kept, pr.top_values(long, 3, keys), keys)
    return texts.join(kept.select(*keys, "col_name", "dtype", "missing_pct", "unique_pct"), [*keys, "col_name"])


def table_vectors(columns: DataFrame, keys: list[str], encoder: Encoder | None = None, dim: int = 64) -> DataFrame:
    """(keys..., v): the weighted mean of the vectors of a table's column sentences, at length 1."""
    at = F.struct(*keys).alias("key")
    x = columns.select(at, "col_name", "description", "dtype", "missing_pct", "unique_pct")
    v = encode_texts(x, ["key", "col_name"], "description", encoder, dim)
    v = v.join(x.drop("description"), ["key", "col_name"])
    return pr.dataset_vectors(v, "key").select("key.*", "v")


def content_graph(vectors: DataFrame, k: int, in_cells: bool = True) -> DataFrame:
    """(row, col, val): symmetric rows of the ``k`` nearest tables by cosine, from (id, v). ``in_cells``: the search whose cells grow with the number
    of tables (recall 0.95), else the exact one."""
    near = nearest_in_cells(vectors, k, positive_only=True) if in_cells else nearest(vectors, k, positive_only=True)
    return symmetrise(near)
