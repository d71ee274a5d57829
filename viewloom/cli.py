"""Command line: ``python -m viewloom.cli COMMAND --help``.

train, neighbours, content, fuse and evaluate are the stages from an edge table to an evaluated graph, each from files to files; query
runs a registered query (all experiments are among them: weight_sweep, dilution_sizes, four_view_grid, k_sweep, content_ablation, ...).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.config import ContentConfig, EvalConfig, NeighbourConfig, TrainConfig, add_flags, from_flags


def _session() -> SparkSession:
    """The session of spark-submit, else a local one."""
    from viewloom.session import build_session

    return SparkSession.getActiveSession() or build_session("viewloom")


def _edges(spark: SparkSession, path: str) -> DataFrame:
    """``folder::prefix::k`` of a manifest, or a folder of triplets."""
    from viewloom.sources.edges import load_edges, load_graph

    folder, *rest = path.split("::")
    return load_graph(spark, folder, rest[0], int(rest[1]))[0] if rest else load_edges(spark, folder)


def train(args: argparse.Namespace) -> None:
    from viewloom.operators import walks as wk
    from viewloom.operators.graph import degree
    from viewloom.session import materialise

    c, spark = from_flags(args, TrainConfig), _session()
    e = _edges(spark, args.edges).where("val > 0")
    w = materialise(wk.random_walks(e, wk.WalkParams(walks=c.walks, length=c.length, restart=c.restart, seed=c.seed)), "walks")
    pairs = wk.skip_gram_pairs(w, c.window, c.seed, c.keep).select("center", "context")
    ids = degree(e).select(F.col("row").alias("id"), "deg")
    wk.train_sgns(pairs, ids, c.dim, c.epochs, c.negatives, c.lr, seed=c.seed).write.mode("overwrite").parquet(args.out)


def neighbours(args: argparse.Namespace) -> None:
    from viewloom.operators import similar
    from viewloom.operators.graph import symmetrise
    from viewloom.sources.edges import save_edges

    c, spark = from_flags(args, NeighbourConfig), _session()
    v = spark.read.parquet(args.vectors).select("id", "v")
    near = similar.nearest(v, c.k) if c.kind == "exact" else similar.nearest_in_cells(v, c.k, similar.fit_cells(v, c.k, recall=c.recall))
    save_edges(symmetrise(near), args.out, args.prefix, c.k, v.count(), part_rows=c.part_rows)


def content(args: argparse.Namespace) -> None:
    """A table whose rows belong to many small tables, named by ``--key``."""
    from viewloom.operators import content as co
    from viewloom.session import materialise
    from viewloom.sources.edges import save_edges

    c, spark = from_flags(args, ContentConfig), _session()
    df = spark.read.parquet(args.table).where(F.col(args.key).isNotNull())
    budget = spark.createDataFrame([("all", c.max_rows, c.max_cols)], "label string, max_rows int, max_cols int")
    keys = ["label", "max_cols", args.key]
    flat = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "binary")]
    rows = co.table_rows(df, [args.key], [F.asc(x) for x in flat], budget)
    v = co.table_vectors(co.column_profiles(rows, keys, "max_cols"), keys, dim=c.dim).select(F.col(args.key).alias("id"), "v")
    v = materialise(v, "vectors")
    save_edges(co.content_graph(v, c.k), args.out, args.prefix, c.k, v.count())


def fuse(args: argparse.Namespace) -> None:
    from viewloom.operators import fusion as fu
    from viewloom.session import materialise
    from viewloom.sources.edges import save_edges

    spark = _session()
    views = {n: materialise(_edges(spark, p), "view") for n, p in (x.split("=", 1) for x in args.view)}
    if args.method == "adaptive":
        e = fu.fuse_adaptive(views, args.k)
    elif args.method == "ranks":
        e = fu.reciprocal_ranks(views, args.k)
    else:
        e = fu.comb_sum(views, args.k)
    save_edges(e, args.out, args.prefix, args.k, 0)


def evaluate(args: argparse.Namespace) -> None:
    from viewloom.operators import evaluate as ev
    from viewloom.session import materialise
    from viewloom.sources.files import write_metrics

    c, spark = from_flags(args, EvalConfig), _session()
    tops = materialise(ev.top_lists({n: _edges(spark, p) for n, p in (x.split("=", 1) for x in args.view)}, c.k), "tops")
    m = ev.query_metrics(ev.owner_gains(tops, spark.read.parquet(args.owners).select("doc", "owner")), ["method", "row"], "total", k=c.k)
    means = [F.avg(x).alias(x) for x in ("ndcg", "ap", "mrr", "precision", "recall", "hit")]
    write_metrics(m.groupBy("method").agg(F.count("*").alias("n"), *means).orderBy("method"), args.out)


def query(args: argparse.Namespace) -> None:
    from viewloom.plans.registry import QUERIES

    if args.name not in QUERIES:
        raise SystemExit("queries: " + " ".join(sorted(QUERIES)))
    QUERIES[args.name](_session(), args.data).write.mode("overwrite").parquet(args.out)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="viewloom", description=__doc__)
    commands = parser.add_subparsers(required=True)

    def command(run, kind: type | None, **flags: dict) -> None:
        p = commands.add_parser(run.__name__, help=run.__doc__)
        for name, options in flags.items():
            p.add_argument(f"--{name}", **({"required": True} | options))
        p.add_argument("--out", required=True)
        if kind:
            add_flags(p, kind)
        p.set_defaults(run=run)

    view = {"action": "append", "help": "name=folder of triplets, or name=folder::prefix::k of a manifest"}
    prefix = {"default": "S", "required": False}
    command(train, TrainConfig, edges={"help": "folder of (row, col, val), or folder::prefix::k of a manifest"})
    command(neighbours, NeighbourConfig, vectors={"help": "parquet (id, v)"}, prefix=prefix)
    command(content, ContentConfig, table={"help": "parquet"}, key={"help": "column that names the small tables"}, prefix=prefix)
    command(fuse, None, view=view, method={"choices": ["adaptive", "ranks", "sum"], "default": "adaptive", "required": False}, k={"type": int, "default": 50, "required": False}, prefix=prefix)
    command(evaluate, EvalConfig, view=view, owners={"help": "parquet (doc, owner)"})
    command(query, None, name={}, data={"help": "folder of the tables"})
    args = parser.parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main()
