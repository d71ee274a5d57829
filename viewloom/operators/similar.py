"""Neighbours: inverted-index cosine, exact and cell-based nearest vectors, creator and engagement graphs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewloom.operators.clean import running_total
from viewloom.operators.graph import top_edges
from viewloom.session import materialise

#: Vectors per block of the exact search, and numbers up to which all vectors are broadcast (128 MB).
BLOCK, SHARED_NUMBERS = 4096, 16_000_000


def anchored_cosine(edges: DataFrame, k: int, anchors: int = 3, postings: int = 200, df_cap: int = 10_000, mode: str = "cosine") -> DataFrame:
    """(row, col, val): the ``k`` rows most similar to each row, candidates from the inverted index.

    Each row's ``anchors`` strongest terms (those in at most ``df_cap`` rows) meet the ``postings`` strongest rows of the
    term. cosine: sum of products over the shared anchors / product of the rows' lengths; binary: shared anchors / root of the product of the rows' degrees. These
    limits are part of the definition and bound the join: at most anchors * postings candidates per row. Ties by id.
    """
    size = F.sqrt(F.sum(F.col("val") * F.col("val"))) if mode == "cosine" else F.sqrt(F.count("*"))
    rows = edges.groupBy("row").agg(F.greatest(size, F.lit(1e-12)).alias("size"))
    df = edges.groupBy("col").agg(F.count("*").alias("df")).where(F.col("df") <= df_cap).select("col")
    weight = F.col("val") / F.col("size") if mode == "cosine" else 1 / F.col("size")
    strongest = edges.withColumn("rn", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("val"), F.asc("col")))).where(F.col("rn") <= anchors)
    mine = strongest.join(df, "col", "left_semi").join(rows, "row").select("row", F.col("col").alias("term"), weight.alias("w1"))
    theirs = edges.withColumn("rn", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("val"), F.asc("row")))).where(F.col("rn") <= postings)
    theirs = theirs.join(rows, "row").select(F.col("row").alias("other"), F.col("col").alias("term"), weight.alias("w2"))
    # one exchange of each side by term (a term has at most df_cap rows here), one of the candidates by row. With a stated number
    # AQE doesn't merge partitions whose work is far larger than their bytes
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = mine.repartition(parts, "term").join(theirs, "term").where("row <> other").repartition(parts, "row")
    sims = pairs.groupBy("row", "other").agg(F.round(F.sum(F.col("w1") * F.col("w2")), 9).alias("val"))
    return top_edges(sims.select("row", F.col("other").alias("col"), "val"), k).drop("rank")


def nearest(vectors: DataFrame, k: int, queries: DataFrame | None = None, positive_only: bool = False, block: int = BLOCK) -> DataFrame:
    """(row, col, val): the ``k`` vectors of largest cosine for each query (default: all), itself excluded; exact.

    ``vectors`` is (id, v); zero vectors have cosine 0. Both sides are cut into blocks by hash; every block pair is one task of matrix products that
    keeps k per query, and the k best of all blocks remain: no pair leaves a task but a block's best. Up to SHARED_NUMBERS numbers the
    vectors are broadcast instead and a task compares its queries with all of them. Ties (to 9 digits) by id.
    """
    queries = vectors if queries is None else queries
    n, first = vectors.count(), vectors.select(F.size("v")).first()
    if first and n * first[0] <= SHARED_NUMBERS:
        return _nearest_shared(vectors, k, queries, positive_only, 2 * block)
    blocks = max(1, -(-n // block))
    side = lambda df, count, tag: df.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias(tag))
    stack = F.collect_list(F.struct("id", "v"))
    left = side(queries, max(1, -(-queries.count() // block)), "qb").groupBy("qb").agg(stack.alias("q"))
    right = side(vectors, blocks, "vb").groupBy("vb").agg(stack.alias("x"))
    tasks = left.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(right, "vb").repartition(F.col("qb"), F.col("vb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q, x in zip(pdf["q"], pdf["x"], strict=True):
                qi, xi = np.array([r["id"] for r in q]), np.array([r["id"] for r in x])
                a, b = (np.array([np.asarray(r["v"], dtype=float) for r in s]) for s in (q, x))
                for mat in (a, b):
                    size = np.linalg.norm(mat, axis=1, keepdims=True)
                    mat /= np.where(size > 0, size, 1)
                order = np.argsort(xi, kind="stable")
                xi, b = xi[order], b[order]
                for s in range(0, len(qi), 512):
                    sim = np.round(a[s : s + 512] @ b.T, 9) + 0.0
                    sim[qi[s : s + 512, None] == xi[None, :]] = -np.inf
                    best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                    row, val = np.repeat(qi[s : s + 512], best.shape[1]), np.take_along_axis(sim, best, 1).ravel()
                    ok = val > (0 if positive_only else -np.inf)
                    yield pd.DataFrame({"row": row[ok], "col": xi[best.ravel()][ok], "val": val[ok]})

    return top_edges(tasks.select("q", "x").mapInPandas(run, "row long, col long, val double"), k).drop("rank")


def _nearest_shared(vectors: DataFrame, k: int, queries: DataFrame, positive_only: bool, block: int) -> DataFrame:
    """``nearest`` over broadcast vectors. Products in single precision find what can be among a query's best, with room for their error;
    the values are computed in double precision."""
    typed = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    spark = vectors.sparkSession

    def units(v) -> np.ndarray:
        x = np.array(v.flatten().to_numpy(zero_copy_only=False)).reshape(len(v), -1) if len(v) else np.zeros((0, 1))
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x /= np.where(size > 0, size, 1)
        return x

    t = typed(vectors).orderBy("id").toArrow()
    b = units(t["v"].combine_chunks())
    t = t["id"]
    shared = spark.sparkContext.broadcast((np.asarray(t), b, b.astype(np.float32)))
    # unit vectors: the products of a pair differ by less than (dimensions + 2) roundings
    room = (b.shape[1] + 8) * 1.2e-7 + 1e-9

    def best(qi: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
        ids, x, x32 = shared.value
        a32 = a.astype(np.float32)
        least = np.full(len(a), 0.0 if positive_only else -np.inf)
        at, place, val = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        for s in range(0, len(x), block):
            sim = a32 @ x32[s : s + block].T
            if not s and sim.shape[1] > k + 1:
                # itself may be among the k + 1
                np.maximum(least, np.partition(sim, -(k + 1), axis=1)[:, -(k + 1)] - room, out=least)
            # far faster over one dimension than over two
            q, p = np.divmod(np.flatnonzero(sim >= (least - room).astype(np.float32)[:, None]), sim.shape[1])
            p = p + s
            other = ids[p] != qi[q]
            q, p = q[other], p[other]
            if not len(q):
                continue
            v = np.concatenate([np.round(np.einsum("ij,ij->i", a[q[i : i + 100_000]], x[p[i : i + 100_000]]), 9) for i in range(0, len(q), 100_000)]) + 0.0
            ok = v > 0 if positive_only else np.ones(len(v), dtype=bool)
            at, place, val = np.append(at, q[ok]), np.append(place, p[ok]), np.append(val, v[ok])
            order = np.lexsort((place, -val, at))
            at, place, val = at[order], place[order], val[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            full = rank == k - 1
            least[at[full]] = np.maximum(least[at[full]], val[full])
            at, place, val = at[rank < k], place[rank < k], val[rank < k]
        return pa.RecordBatch.from_arrays([pa.array(qi[at]), pa.array(ids[place]), pa.array(val)], names=["row", "col", "val"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            qi, a = np.asarray(r.column(0)), units(r.column(1))
            for s in range(0, len(qi), 256):
                yield best(qi[s : s + 256], a[s : s + 256])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return typed(queries).repartition(parts).mapInArrow(run, "row long, col long, val double")


def nearest_in_boxes(vectors: DataFrame, k: int, leaf: int = 1024, sample: int = 50_000) -> DataFrame:
    """(row, col, val): the same rows as ``nearest`` of all vectors, for vectors of few dimensions; exact.

    Equal vectors are one point with its ``k`` + 1 least ids. The points are cut into boxes of about ``leaf`` by median splits (found on a sample,
    which decides the balance only); the k-th best point of its own box bounds what a point needs, and it is compared with the boxes that can hold such a
    value. Ties (to 9 digits) by id.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    first = v.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_n") <= k + 1)
    points = materialise(first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "points")
    splits = _median_splits(_units(points.orderBy(F.xxhash64("v")).limit(sample).toPandas()["v"]), max(0, int(np.ceil(np.log2(max(1, points.count()) / leaf)))))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                u = _units(pdf["v"])
                yield pd.DataFrame({"key": pdf["ids"].str[0], "leaf": _leaves(u, splits), "v": pdf["v"], "u": list(u), "ids": pdf["ids"]})

    placed = materialise(points.mapInPandas(place, "key long, leaf int, v array<double>, u array<double>, ids array<long>"), "placed")
    size = len(placed.select("u").first()[0]) if placed.limit(1).count() else 0
    ends = [f(F.col("u")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(size)]
    boxes = placed.groupBy("leaf").agg(F.count("*").alias("n"), *ends).orderBy("leaf").toPandas()
    low, high = (boxes[[f"{n}{i}" for i in range(size)]].to_numpy() for n in ("low", "high"))

    def visits(pdf: pd.DataFrame) -> pd.DataFrame:
        u, out = np.stack(pdf["u"]), []
        for s in range(0, len(u), 256):
            a = u[s : s + 256]
            sim = a @ u.T
            # the point itself is among the k + 1; rounding to 9 digits moves a value by half a digit at most
            least = np.partition(sim, -(k + 1), axis=1)[:, -(k + 1)] - 2e-9 if len(u) > k else np.full(len(a), -np.inf)
            most = np.minimum(a, 0) @ low.T + np.maximum(a, 0) @ high.T
            if pdf["leaf"].iloc[0] >= 0:
                far = np.zeros((len(a), len(low)))
                for i in range(size):
                    far += np.maximum(np.maximum(low[:, i] - a[:, i, None], a[:, i, None] - high[:, i]), 0) ** 2
                most = np.minimum(most, np.where(boxes["leaf"].to_numpy() >= 0, 1 - far / 2, most) + 1e-12)
            at, box = np.nonzero(most >= least[:, None])
            out.append(pd.DataFrame({"at": at + s, "box": boxes["leaf"].to_numpy()[box], "least": least[at]}))
        x = pd.concat(out)
        return pd.DataFrame({"key": pdf["key"].to_numpy()[x["at"]], "leaf": x["box"], "least": x["least"], "u": pdf["u"].to_numpy()[x["at"]]})

    asked = materialise(placed.groupBy("leaf").applyInPandas(visits, "key long, leaf int, least double, u array<double>"), "visits")

    def search(key, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        a, b = np.stack(q["u"]) if len(q) else np.zeros((0, size)), np.stack(x["u"])
        many = x["ids"].str.len().to_numpy()
        start, flat, out = np.cumsum(many) - many, np.concatenate(x["ids"].to_list()), []
        for s in range(0, len(a), 256):
            sim = a[s : s + 256] @ b.T
            at, p = np.nonzero(sim >= q["least"].to_numpy()[s : s + 256, None])
            val = np.round(sim[at, p], 9) + 0.0
            n = many[p]
            ids = flat[np.repeat(start[p] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            at, val = np.repeat(at, n), np.repeat(val, n)
            order = np.lexsort((ids, -val, at))
            at, val, ids = at[order], val[order], ids[order]
            keep = np.arange(len(at)) - np.searchsorted(at, at) <= k
            out.append(pd.DataFrame({"key": q["key"].to_numpy()[s : s + 256][at[keep]], "col": ids[keep], "val": val[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"key": [], "col": [], "val": []})

    found = asked.groupBy("leaf").cogroup(placed.select("leaf", "u", "ids").groupBy("leaf")).applyInPandas(search, "key long, col long, val double")
    best = found.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("val"), "col"))).where(F.col("_n") <= k + 1)
    best = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("val")).alias("neg"), "col"))).alias("l"))
    best = placed.select("key", "v").join(best, "key").select("v", "l")
    others = F.slice(F.filter("l", lambda e: e["col"] != F.col("id")), 1, k)
    return v.join(best, "v").select(F.col("id").alias("row"), F.explode(others).alias("e")).select("row", F.col("e.col").alias("col"), (F.lit(0.0) - F.col("e.neg")).alias("val"))


def _units(v: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(r, dtype=float) for r in v])
    size = np.linalg.norm(x, axis=1, keepdims=True) if len(x) else np.ones((0, 1))
    return x / np.where(size > 0, size, 1)


def _median_splits(x: np.ndarray, depth: int) -> list[list[tuple[int, float]]]:
    """Per level the (dimension, value) of each node's split: the widest dimension at its median."""
    groups, out = [x], []
    for _ in range(depth):
        level, below = [], []
        for g in groups:
            d = int(np.argmax(np.ptp(g, axis=0))) if len(g) else 0
            at = float(np.median(g[:, d])) if len(g) else 0.0
            level.append((d, at))
            below += [g[g[:, d] <= at], g[g[:, d] > at]] if len(g) else [g, g]
        out.append(level)
        groups = below
    return out


def _leaves(x: np.ndarray, splits: list[list[tuple[int, float]]]) -> np.ndarray:
    """The number of each row's leaf; zero vectors have their own, -1."""
    node = np.zeros(len(x), dtype=np.int32)
    for level in splits:
        d, at = np.array([n[0] for n in level]), np.array([n[1] for n in level])
        node = 2 * node + (x[np.arange(len(x)), d[node]] > at[node])
    return np.where(x.any(axis=1), node, -1).astype(np.int32)


@dataclass
class Cells:
    """``centres``: unit vectors; ``probes``: cells a query searches."""

    centres: np.ndarray
    probes: int


def fit_cells(vectors: DataFrame, k: int, cells: int | None = None, recall: float = 0.95, sample: int = 20_000, steps: int = 10, seed: int = 7) -> Cells:
    """Centres of spherical k-means on at most ``sample`` vectors (chosen by hash), by default about the root of the number of all vectors.

    ``probes`` is the least number of cells that hold ``recall`` (and half a percent more) of the ``k`` nearest neighbours among the sampled
    vectors, for up to 500 of them as queries. Neighbours in a sample lie farther apart than among all vectors, so the number is on the safe side.
    Vectors without structure need most cells: then no partition of the space can spare work.
    """
    rows = vectors.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("v").collect()
    if not rows:
        return Cells(np.zeros((1, 1)), 1)
    x = np.array([r[0] for r in rows], dtype=float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    cells = min(len(x), cells or max(4, int(np.ceil(np.sqrt(vectors.count())))))
    c = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(steps):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        some = np.bincount(own, minlength=cells) > 0
        c[some] = sums[some]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    own, ask = (x @ c.T).argmax(axis=1), np.arange(len(x))[:500]
    sim = x[ask] @ x.T
    sim[ask, ask] = -np.inf
    near = np.argsort(-sim, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(x[ask] @ c.T), axis=1, kind="stable"), axis=1)
    found = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    probes = int(found[min(len(found) - 1, int(np.ceil((recall + 0.005) * len(found))))]) + 1 if len(found) else 1
    return Cells(c, probes)


def nearest_in_cells(vectors: DataFrame, k: int, cells: Cells | None = None, queries: DataFrame | None = None, positive_only: bool = False, part: int = 2048) -> DataFrame:
    """Approximate ``nearest``: every vector lies in the cell of its nearest centre, a query searches its nearest cells.

    Cells are cut into parts of about ``part`` vectors, so a crowded cell is many tasks. ``cells`` defaults to ``fit_cells``.
    """
    cells = cells or fit_cells(vectors, k)
    centres = vectors.sparkSession.sparkContext.broadcast(cells.centres)
    queries = vectors if queries is None else queries

    def assign(n: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = np.array([np.asarray(v, dtype=float) for v in pdf["v"]])
                    best = np.argsort(-(x @ centres.value.T), axis=1, kind="stable")[:, :n]
                    out = pdf.loc[pdf.index.repeat(best.shape[1])].copy()
                    out["cell"] = best.ravel()
                    yield out[["id", "v", "cell"]]

        return run

    schema = "id long, v array<double>, cell int"
    typed = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    stored = materialise(typed(vectors).mapInPandas(assign(1), schema), "cells")
    sizes = materialise(stored.groupBy("cell").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")), "sizes")
    stored = stored.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    asked = typed(queries).mapInPandas(assign(cells.probes), schema).join(F.broadcast(sizes), "cell")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def search(key, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"row": [], "col": [], "val": []})
        x = x.sort_values("id")
        a, b = (np.array([np.asarray(v) for v in s["v"]]) for s in (q, x))
        for mat in (a, b):
            mat /= np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-12)
        out = []
        for s in range(0, len(q), 512):
            qi, xi = q["id"].to_numpy()[s : s + 512], x["id"].to_numpy()
            sim = np.round(a[s : s + 512] @ b.T, 9) + 0.0
            sim[qi[:, None] == xi[None, :]] = -np.inf
            best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
            row, val = np.repeat(qi, best.shape[1]), np.take_along_axis(sim, best, 1).ravel()
            out.append(pd.DataFrame({"row": row, "col": xi[best.ravel()], "val": val})[val > least])
        return pd.concat(out)

    least = 0 if positive_only else -np.inf
    found = asked.groupBy("cell", "part").cogroup(stored.groupBy("cell", "part")).applyInPandas(search, "row long, col long, val double")
    return top_edges(found, k).drop("rank")


def same_creator(owners: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(row, col, val 1.0): records (id, owner) of one owner, all pairs, or those whose row is in ``queries`` (id). NULL owners have none.

    A large owner's pairs grow with the square of its records: prefer ``owner_classes``, or state the queries.
    """
    o = owners.where(F.col("owner").isNotNull()).select("id", "owner").distinct()
    rows = o if queries is None else o.join(queries.select("id").distinct(), "id", "left_semi")
    return rows.select(F.col("id").alias("row"), "owner").join(o.select(F.col("id").alias("col"), "owner"), "owner").where("row <> col").select("row", "col", F.lit(1.0).alias("val"))


def owner_classes(owners: DataFrame) -> DataFrame:
    """(id, class_id, n_links): the records of owners with two or more of them; the class is the owner's least record, the links are the
    owner's other records. NULL owners have none."""
    o = owners.where(F.col("owner").isNotNull()).select("id", "owner").distinct()
    n = o.groupBy("owner").agg(F.min("id").alias("class_id"), (F.count("*") - 1).alias("n_links")).where("n_links > 0")
    return o.join(n, "owner").select("id", "class_id", "n_links")


def owner_members(owners: DataFrame) -> DataFrame:
    """(id, owner, n, rank): the records of owners with ``n`` > 1 of them, numbered from 1 in order of id. NULL owners have none.

    Numbered over sorted ranges of all records, so a large owner isn't sorted in one task.
    """
    o = owners.where(F.col("owner").isNotNull()).select("id", "owner").distinct()
    o = materialise(running_total(o, [F.asc("owner"), F.asc("id")], F.lit(1).cast("long"), "place"), "places")
    n = o.groupBy("owner").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1")
    return o.join(n, "owner").select("id", "owner", "n", (F.col("place") - F.col("first") + 1).cast("int").alias("rank"))


def same_creator_among(owners: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(row, col, val): the edges of ``same_creator`` at L1 rows that can be among a row's ``k`` best in a sum with ``edges``.

    All edges of a row have the value 1 / (n - 1), so those in ``edges`` and the row's first ``k`` others by col are enough, whatever
    the weights; (id, owner) needs no expanded pairs. ``edges`` (row, col) holds the pairs of all other views.
    """
    m = materialise(owner_members(owners), "members")
    a, b = m.select(F.col("id").alias("row"), "owner", "n"), m.select(F.col("id").alias("col"), F.col("owner").alias("_owner"))
    inside = edges.select("row", "col").where("row <> col").distinct().join(a, "row").join(b, "col").where("owner = _owner").select("row", "col", "n")
    inside = materialise(inside, "inside")
    # itself and the edges in hand may stand among the first
    last = F.least(F.col("n"), F.coalesce("_in", F.lit(0)) + k + 1)
    first = a.join(inside.groupBy("row").agg(F.count("*").alias("_in")), "row", "left").select("row", "owner", "n", F.explode(F.sequence(F.lit(1).cast("long"), last)).alias("rank"))
    first = first.join(m.select("owner", F.col("rank").cast("long").alias("rank"), F.col("id").alias("col")), ["owner", "rank"]).where("row <> col")
    return first.select("row", "col", "n").unionByName(inside).distinct().select("row", "col", (F.lit(1.0) / (F.col("n") - 1)).alias("val"))


def item_cosine(uses: DataFrame) -> DataFrame:
    """(row, col, val): cosine of items over users, from (user, item, w); both directions, no diagonal."""
    w = uses.groupBy("user", "item").agg(F.sum("w").alias("w"))
    n = w.groupBy("item").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    w = w.join(n, "item").select("user", "item", (F.col("w") / F.col("len")).alias("w"))
    a, b = w.select("user", F.col("item").alias("row"), F.col("w").alias("w1")), w.select("user", F.col("item").alias("col"), F.col("w").alias("w2"))
    return a.join(b, "user").where("row <> col").groupBy("row", "col").agg(F.sum(F.col("w1") * F.col("w2")).alias("val"))


def engagement_vectors(df: DataFrame, record: str, features: list[str], eps: float = 1e-9) -> DataFrame:
    """(id, v): the features as z-scores over all records (population deviation); NULL and NaN count as 0."""
    clean = df.select(F.col(record).alias("id"), *[F.coalesce(F.nanvl(F.col(f), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features])
    stats = clean.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features])
    z = F.array(*[(F.col(f) - F.col(f"m_{f}")) / (F.col(f"s_{f}") + eps) for f in features])
    return clean.crossJoin(F.broadcast(stats)).select("id", z.alias("v"))
