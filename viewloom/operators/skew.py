"""Joins that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of all rows on, so at most 1 / HEAVY_SHARE keys are heavy.
HEAVY_SHARE = 1e-5
#: ... and from this many rows on.
HEAVY_ROWS = 10_000


def heavy_limit(total: int, rows: int = HEAVY_ROWS, share: float = HEAVY_SHARE) -> int:
    """Row count from which a key is heavy; at most ``min(total / rows, 1 / share)`` keys reach it."""
    return max(rows, int(total * share))


def split_join(facts: DataFrame, dim: DataFrame, key: str | list[str], limit: int, count: str = "n") -> DataFrame:
    """Inner join of ``facts`` with ``dim`` (one row per ``key``), split by weight of the key.

    ``dim`` has the number of fact rows per key in ``count``. Keys with ``limit`` rows or more are joined by
    broadcast (their number is bounded by total / limit), so no task gets a heavy key; the others
    are shuffled. NULL keys match nothing.
    """
    keys = [key] if isinstance(key, str) else key
    heavy = F.broadcast(dim.where(F.col(count) >= limit))
    hot = facts.join(heavy, keys)
    cold = facts.join(F.broadcast(dim.where(F.col(count) >= limit).select(*keys)), keys, "left_anti").join(
        dim.where(F.col(count) < limit), keys
    )
    return hot.unionByName(cold)
