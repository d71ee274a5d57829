"""References to records that do not exist, are deleted or arrive later."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.operators.skew import heavy_limit, split_join


@dataclass(frozen=True)
class Reference:
    """A column of a child table that names keys of a parent table.

    ``none``: values that, like NULL, refer to nothing. ``deleted``: the parent's deletion time, if it has one.
    """

    table: str
    record: str
    key: str
    parent_key: str
    none: tuple[int, ...] = field(default=())
    deleted: str | None = "deleted_at"
    loaded: str = "loaded_at"


def orphan_references(children: DataFrame, parents: DataFrame, ref: Reference) -> DataFrame:
    """(table_name, period, record_id, reason) of the child rows whose reference doesn't hold; distinct.

    reason, the first that applies: ``missing`` (no such key), ``deleted`` (the key's earliest deletion is at or
    before the child's arrival), ``late`` (the key's earliest arrival is after the child's). period is the month of
    the child's arrival. A child without arrival time has a NULL period and can only be ``missing``. A parent row with
    a NULL key is ignored; repeated parent rows count once with their earliest times.

    Plan: the distinct keys of the children (pre-aggregated, with count and range of arrival) meet the parents once;
    only keys that can give a finding are joined back, heavy ones by broadcast, light ones by shuffle.
    """
    kids = children.select(
        F.col(ref.record).alias("record_id"), F.col(ref.key).alias("fk"), F.col(ref.loaded).alias("at")
    ).where(F.col("fk").isNotNull() & ~F.col("fk").isin(*ref.none) if ref.none else F.col("fk").isNotNull())
    keys = kids.groupBy("fk").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    deleted = F.min(ref.deleted) if ref.deleted else F.lit(None).cast("timestamp_ntz")
    known = (
        parents.where(F.col(ref.parent_key).isNotNull())
        .groupBy(F.col(ref.parent_key).alias("fk"))
        .agg(deleted.alias("deleted_at"), F.min(ref.loaded).alias("loaded_at"))
    )
    missing = keys.join(known, "fk", "left_anti").select(
        "fk", "n", F.lit(True).alias("missing"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"), F.lit(None).cast("timestamp_ntz").alias("loaded_at")
    )
    doubtful = keys.join(known, "fk").where("deleted_at <= last_at or loaded_at > first_at").select(
        "fk", "n", F.lit(False).alias("missing"), F.col("deleted_at").cast("timestamp_ntz"), F.col("loaded_at").cast("timestamp_ntz")
    )
    limit = heavy_limit(children.count())
    joined = split_join(kids, missing.unionByName(doubtful), "fk", limit)
    reason = F.when(F.col("missing"), "missing").when(F.col("deleted_at") <= F.col("at"), "deleted").when(F.col("loaded_at") > F.col("at"), "late")
    return (
        joined.select(
            F.lit(ref.table).alias("table_name"),
            F.date_format("at", "yyyy-MM").alias("period"),
            "record_id",
            reason.alias("reason"),
        )
        .where(F.col("reason").isNotNull())
        .distinct()
    )


def orphan_report(children: DataFrame, parents: DataFrame, ref: Reference) -> DataFrame:
    """(table_name, period, reason, n_records): distinct records per table, month and reason."""
    return orphan_references(children, parents, ref).groupBy("table_name", "period", "reason").agg(F.count("*").alias("n_records"))
