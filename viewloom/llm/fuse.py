"""One ranking from several differently-scaled scores: a rank-walk Markov chain per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewloom.llm.topn import clean_edges
from viewloom.operators.clean import running_total
from viewloom.session import broadcast_if_small, discard, materialise

#: Share of steps that follow a score; the rest jump anywhere. Strong damping keeps an item that leads one score only
#: from absorbing the walk.
DAMPING = 0.3
#: The error left is below DAMPING ** STEPS.
STEPS = 24
#: Groups of up to this many items are solved in one task; larger ones by distributed prefix sums.
GROUP_ITEMS = 200_000
CUTS = 64


def rank_walks(scores: np.ndarray, group: np.ndarray, damping: float = DAMPING, steps: int = STEPS) -> np.ndarray:
    """Stationary probabilities of the items (rows) of many groups (``group``: ascending numbers) under the scores (columns,
    NaN = the item lacks this score), summing to 1 in each group.

    From an item: pick a score, then jump uniformly to an item of the group that ranks higher by it; to any item if none does.
    An item that lacks the score ranks below all that have it; a score that no item of the group has isn't picked. With
    probability 1 - ``damping`` jump to any item. Only the order within a score counts, so unit, offset and spread
    don't. Each step is one prefix sum per score over the sorted items of all groups at once.
    """
    _, g = np.unique(group, return_inverse=True)
    n_groups = int(g.max()) + 1 if len(g) else 0
    size = np.bincount(g, minlength=n_groups).astype(float)
    views, count = [], np.zeros(n_groups)
    for v in range(scores.shape[1]):
        s = scores[:, v]
        have = np.flatnonzero(~np.isnan(s))
        if not len(have):
            continue
        have = have[np.lexsort((-s[have], g[have]))]  # best first within each group
        gh, sh = g[have], s[have]
        new_group = np.r_[True, gh[1:] != gh[:-1]]
        new_level = new_group | np.r_[True, sh[1:] != sh[:-1]]
        level = np.cumsum(new_level) - 1
        at = np.arange(len(have))
        first = np.flatnonzero(new_group)[np.cumsum(new_group) - 1]  # where the item's group begins
        higher = at[new_level][level] - first
        n_have = np.bincount(gh, minlength=n_groups).astype(float)
        count += n_have > 0
        last = np.r_[np.flatnonzero(new_level)[1:] - 1, len(have) - 1]  # last item of each level
        lack = np.flatnonzero(np.isnan(s) & (n_have[g] > 0))
        views.append((have, gh, higher, last[level], lack, n_have))
    p = 1 / size[g] if len(g) else np.zeros(0)
    if not views:
        return p
    for _ in range(steps):
        q = np.zeros(len(g))
        for have, gh, higher, last, lack, n_have in views:
            mass = p[have]
            flow = np.where(higher > 0, mass / np.maximum(higher, 1), 0.0)
            run = np.cumsum(flow)
            total = np.bincount(gh, flow, n_groups)
            before = np.cumsum(total) - total
            below = total[gh] - (run[last] - before[gh])
            absent = np.bincount(g[lack], p[lack], n_groups)
            q[have] += below + (absent / np.maximum(n_have, 1))[gh]
            q += (np.bincount(gh, np.where(higher == 0, mass, 0.0), n_groups) / size)[g]
        used = np.maximum(count, 1)[g]
        p = (1 - damping) / size[g] + damping * np.where(count[g] > 0, q / used, 1 / size[g])
    return p


def rank_walk(scores: np.ndarray, damping: float = DAMPING, steps: int = STEPS) -> np.ndarray:
    """``rank_walks`` of one group."""
    return rank_walks(scores, np.zeros(len(scores), dtype=np.int64), damping, steps)


def _solve(views: list[str], steps: int):
    """Whole groups from sorted batches: rows of the last group of a batch wait for the next batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf["row"].iloc[-1]
            closed, tail = pdf[pdf["row"] != last], pdf[pdf["row"] == last]
            if rest and rest[0]["row"].iloc[0] == last:
                rest.append(tail)
                continue
            done = pd.concat([*rest, closed])
            rest = [tail]
            if len(done):
                yield solved(done)
        if rest:
            yield solved(pd.concat(rest))

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        p = rank_walks(pdf[views].to_numpy(dtype=float), pdf["row"].to_numpy(), steps=steps)
        return pd.DataFrame({"row": pdf["row"].to_numpy(), "col": pdf["col"].to_numpy(), "p": p})

    return run


def _cuts_under(cuts: str, value: str) -> Column:
    return F.size(F.filter(cuts, lambda c: c < F.col(value)))


def _walk_large(items: DataFrame, views: list[str], steps: int, damping: float) -> DataFrame:
    """The same chain for groups of any size: score ranges per view, range totals plus a window within each range.

    Cut points and range totals are small tables (groups x CUTS rows; the groups number at most items / GROUP_ITEMS).
    """
    cuts = items.groupBy("row").agg(
        F.count("*").alias("n"),
        *[F.count(v).alias(f"n_{v}") for v in views],
        *[F.approx_percentile(v, [k / CUTS for k in range(1, CUTS)], 1000).alias(f"cuts_{v}") for v in views],
    )
    live = sum((F.col(f"n_{v}") > 0).cast("int") for v in views)
    x = items.join(F.broadcast(cuts.withColumn("views", live)), "row")
    for v in views:
        x = x.withColumn(f"b_{v}", F.when(F.col(v).isNotNull(), _cuts_under(f"cuts_{v}", v))).drop(f"cuts_{v}")

    def beyond(df: DataFrame, v: str, what: str, upward: bool, out: str) -> DataFrame:
        """Sum of ``what`` over the items strictly above (or below) in view ``v``: equal scores are one level, added up before the shuffle."""
        levels = df.where(F.col(v).isNotNull()).groupBy("row", f"b_{v}", v).agg(F.sum(what).alias("t"))
        tot = levels.groupBy("row", f"b_{v}").agg(F.sum("t").alias("t"))
        w = Window.partitionBy("row").orderBy(F.desc(f"b_{v}") if upward else F.asc(f"b_{v}"))
        tot = tot.withColumn("other", F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("t")
        inner = Window.partitionBy("row", f"b_{v}").orderBy(F.desc(v) if upward else F.asc(v)).rowsBetween(Window.unboundedPreceding, -1)
        levels = levels.join(F.broadcast(tot), ["row", f"b_{v}"]).withColumn(out, F.col("other") + F.coalesce(F.sum("t").over(inner), F.lit(0.0)))
        return df.join(levels.select("row", v, out), ["row", v], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))

    x = x.withColumn("one", F.lit(1.0))
    for v in views:
        x = beyond(x, v, "one", True, f"h_{v}")
        x = x.withColumn(f"h_{v}", F.when(F.col(v).isNotNull(), F.round(f"h_{v}")))
    x = x0 = materialise(x.drop("one").withColumn("p", 1 / F.col("n")), "walk")
    for _ in range(steps):
        flow = F.lit(0.0)
        lack = [F.sum(F.when(F.col(v).isNull(), F.col("p")).otherwise(0.0)).alias(f"l_{v}") for v in views]
        lead = [F.sum(F.when(F.col(f"h_{v}") == 0, F.col("p")).otherwise(0.0)).alias(f"l_top_{v}") for v in views]
        lost = x.groupBy("row").agg(*lack, *lead)
        x = x.join(F.broadcast(lost), "row")
        for v in views:
            x = x.withColumn("w", F.when(F.col(v).isNotNull() & (F.col(f"h_{v}") > 0), F.col("p") / F.col(f"h_{v}")).otherwise(0.0))
            x = beyond(x, v, "w", False, f"f_{v}")
            flow = flow + F.when(F.col(v).isNotNull(), F.col(f"f_{v}") + F.col(f"l_{v}") / F.col(f"n_{v}")).otherwise(0.0)
            flow = flow + F.col(f"l_top_{v}") / F.col("n")
        keep = [c for c in x.columns if c != "p" and c != "w" and c[:2] not in ("l_", "f_")]
        x = x.withColumn("p", (1 - damping) / F.col("n") + damping * F.when(F.col("views") > 0, flow / F.col("views")).otherwise(1 / F.col("n")))
        before, x = x0, materialise(x.select(*keep, "p"), "walk")
        discard(before)
        x0 = x
    return x.select("row", "col", "p")


def fuse_rankings(views: list[DataFrame], requests: DataFrame, group_items: int = GROUP_ITEMS, steps: int = STEPS) -> DataFrame:
    """(row, col, p, rank): for each row of ``requests`` (row) the cols of all views in one ranking.

    ``views``: edges (row, col, val). NULL, NaN and self edges don't count, of a repeated (row, col) the largest val does.
    Rank by stationary probability (rounded to 12 digits), then col. Requested rows without edges give no result; repeated and NULL
    requests count once and not at all.
    """
    names = [f"v{k}" for k in range(len(views))]
    want = broadcast_if_small(requests.where("row is not null").select("row").distinct())
    edges = None
    for name, df in zip(names, views, strict=True):
        part = clean_edges(df.select("row", "col", "val").join(want, "row", "left_semi")).withColumn("view", F.lit(name))
        edges = part if edges is None else edges.unionByName(part)
    items = edges.groupBy("row", "col").agg(*[F.max(F.when(F.col("view") == n, F.col("val"))).alias(n) for n in names])
    items = materialise(items, "items")
    large = materialise(items.groupBy("row").count().where(F.col("count") > group_items).select("row"), "large")
    light = items.join(F.broadcast(large), "row", "left_anti")
    light = light.select("row", "col", *names).repartition("row").sortWithinPartitions("row", "col")
    out = light.mapInPandas(_solve(names, steps), "row long, col long, p double")
    order = [F.desc(F.round("p", 12)), F.asc("col")]
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order)))
    if large.isEmpty():
        return out
    # the rank of a large group: its place in one order over all large groups, less the items of the groups before
    p = _walk_large(items.join(F.broadcast(large), "row", "left_semi"), names, steps, DAMPING)
    p = materialise(running_total(p, [F.asc("row"), *order], F.lit(1).cast("long"), "place"), "places")
    first = p.groupBy("row").agg(F.min("place").alias("first"))
    p = p.join(F.broadcast(first), "row").select("row", "col", "p", (F.col("place") - F.col("first") + 1).cast("int").alias("rank"))
    return out.unionByName(p)
