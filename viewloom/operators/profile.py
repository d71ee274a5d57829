"""Column profiles: type, missing values, statistics, description, quality, dataset vectors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewloom.operators.clean import quantiles

# Shares and lengths that decide a column's type, and what an id column is called.
NUMERIC_SHARE, TIME_SHARE, TEXT_LENGTH, ID_SHARE = 0.95, 0.90, 30, 0.95
ID_NAME = re.compile(r"^(unnamed|index|id)$|_id$|_idx$", re.IGNORECASE)
# Weight of a column by its type.
TYPE_WEIGHT = {"numeric": 1.0, "categorical": 1.0, "datetime": 0.8, "text": 1.2}


def long_columns(df: DataFrame, keys: list[str] | None = None, cols: list[str] | None = None) -> DataFrame:
    """(keys..., col_name, value as text): columns of arrays, maps and structs take no part."""
    keys = keys or []
    flat = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "binary") and f.name not in keys]
    cols = [c for c in (cols or flat) if c in flat]
    return df.select(*keys, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(keys, cols, "col_name", "value")


def profile(long: DataFrame, keys: list[str] | None = None, exact: bool = True) -> DataFrame:
    """One row per (keys..., col_name): dtype, missing_pct, n_unique, unique_pct and the statistics of its type.

    One pass: type by cascade numeric >= .95, datetime >= .9, text with mean length >= 30, else categorical. An all-NULL column
    is categorical with n_unique 0. std is the sample deviation (0 for one value).

    ``exact``: exact distinct counts, and exact medians by a second pass over sorted ranges (``clean.quantiles``); False: a mergeable
    quantile sketch and HyperLogLog++ in the one pass (relative error 0.0001 and about 1 %).
    """
    keys = [*(keys or []), "col_name"]
    num, at = F.expr("try_cast(value as double)"), F.try_to_timestamp("value")
    some = F.col("value").isNotNull()
    x = long.withColumn("num", num).withColumn("at", at)
    g = x.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count("value").alias("n_ok"),
        (F.count_distinct("value") if exact else F.approx_count_distinct("value", 0.01)).alias("n_unique"),
        F.count("num").alias("n_num"),
        F.count("at").alias("n_at"),
        F.min("num").alias("num_min"),
        F.max("num").alias("num_max"),
        *([] if exact else [F.approx_percentile("num", 0.5, 10_000).alias("num_median")]),
        F.avg("num").alias("num_mean"),
        F.coalesce(F.stddev_samp("num"), F.lit(0.0)).alias("num_std"),
        F.min("at").alias("earliest"),
        F.max("at").alias("latest"),
        F.avg(F.when(some, F.length("value"))).alias("avg_len"),
        F.max(F.length("value")).alias("max_len"),
        F.min("value").alias("sample_text"),
    )
    if exact:
        g = g.join(quantiles(x, keys, "num", {"num_median": 0.5}), keys, "left")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n_ok")), F.lit(0.0))
    kind = (
        F.when(F.col("n_ok") == 0, "categorical")
        .when(share("n_num") >= NUMERIC_SHARE, "numeric")
        .when(share("n_at") >= TIME_SHARE, "datetime")
        .when(F.col("avg_len") >= TEXT_LENGTH, "text")
        .otherwise("categorical")
    )
    g = g.withColumn("dtype", kind)
    only = lambda t, c: F.when(F.col("dtype") == t, c)
    return g.select(
        *keys,
        "dtype",
        ((F.col("n") - F.col("n_ok")) / F.col("n") * 100).alias("missing_pct"),
        "n_unique",
        F.coalesce(F.try_divide(F.col("n_unique") * 100.0, F.col("n_ok")), F.lit(0.0)).alias("unique_pct"),
        *[only("numeric", F.col(c)).alias(c) for c in ("num_min", "num_max", "num_median", "num_mean", "num_std")],
        *[only("datetime", F.col(c).cast("date")).alias(c) for c in ("earliest", "latest")],
        only("datetime", F.date_diff("latest", "earliest")).alias("span_days"),
        *[only("text", F.col(c)).alias(c) for c in ("avg_len", "max_len")],
        only("text", F.substring("sample_text", 1, 200)).alias("sample_text"),
    )


def top_values(long: DataFrame, k: int = 5, keys: list[str] | None = None) -> DataFrame:
    """(keys..., col_name, value, n, rank): the most frequent values, ties by value."""
    keys = [*(keys or []), "col_name"]
    c = long.where("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)


def keep_columns(profiles: DataFrame, max_cols: int = 60) -> DataFrame:
    """(col_name, score): columns worth keeping: not all-NULL, not constant, not an id (by name and nearly unique values), the
    ``max_cols`` best by unique share * filled share."""
    rows = 1 - F.col("missing_pct") / 100
    unique = F.col("unique_pct") / 100 * rows
    p = profiles.where((F.col("n_unique") > 1) & ~(F.col("col_name").rlike("(?i)" + ID_NAME.pattern) & (unique > ID_SHARE)))
    return p.select("col_name", (unique * rows).alias("score")).orderBy(F.desc("score"), "col_name").limit(max_cols)


def keep_columns_by(profiles: DataFrame, keys: list[str], max_cols: Column) -> DataFrame:
    """The profiles of the columns that ``keep_columns`` keeps, of each table (keys)."""
    rows = 1 - F.col("missing_pct") / 100
    unique = F.col("unique_pct") / 100 * rows
    p = profiles.where((F.col("n_unique") > 1) & ~(F.col("col_name").rlike("(?i)" + ID_NAME.pattern) & (unique > ID_SHARE)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(unique * rows), "col_name"))
    return p.withColumn("_rank", rank).where(F.col("_rank") <= max_cols).drop("_rank")


def sample_table(df: DataFrame, max_rows: int = 1024, max_cols: int = 60) -> DataFrame:
    """The first ``max_rows`` rows and the columns worth keeping; the column list is decided by one small aggregate."""
    head = df.limit(max_rows)
    keep = [r[0] for r in keep_columns(profile(long_columns(head)), max_cols).collect()]
    return head.select(*[c for c in df.columns if c in keep])


def describe(profiles: DataFrame, tops: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys..., col_name, description): one English sentence per column, by its type."""
    keys = [*(keys or []), "col_name"]
    t = tops.where("rank <= 3").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat("value", F.lit(" ("), "n", F.lit(")")).alias("s")))), lambda x: x["s"]), ", ").alias("top"))
    p = profiles.join(t, keys, "left")
    f = lambda c, d: F.format_string(f"%.{d}f", F.round(c, d))
    missing = F.concat(f("missing_pct", 1), F.lit("% missing."))
    # The sentences below
    head = F.concat(F.lit('Column "'), F.col("col_name"), F.lit('": '))
    text = (
        F.when(F.col("dtype") == "numeric", F.concat(F.lit("numeric, range ["), "num_min", F.lit(", "), "num_max", F.lit("], median="), "num_median", F.lit(", mean="), f("num_mean", 2), F.lit(", std="), f("num_std", 2), F.lit(", "), missing))
        .when(F.col("dtype") == "datetime", F.concat(F.lit("datetime from "), F.col("earliest").cast("string"), F.lit(" to "), F.col("latest").cast("string"), F.lit(", spanning "), "span_days", F.lit(" days. "), missing))
        .when(F.col("dtype") == "text", F.concat(F.lit("free text, avg length "), f("avg_len", 0), F.lit(' chars. Sample: "'), F.substring("sample_text", 1, 100), F.lit('". '), missing))
        .otherwise(F.concat(F.lit("categorical with "), "n_unique", F.lit(" unique values ("), f("unique_pct", 1), F.lit("% unique). Top values: "), F.coalesce("top", F.lit("")), F.lit(". "), missing))
    )
    return p.select(*keys, F.concat(head, text).alias("description"))


def quality(profiles: DataFrame, key: str) -> DataFrame:
    """(key, quality, n_cols, numeric_ratio, mean_missing, mean_unique): columns * numeric share (.1 at least) * filled share * unique share (.01 to .95)."""
    g = profiles.groupBy(key).agg(
        F.count("*").alias("n_cols"),
        F.avg((F.col("dtype") == "numeric").cast("int")).alias("numeric_ratio"),
        (F.avg("missing_pct") / 100).alias("mean_missing"),
        F.least(F.avg("unique_pct") / 100, F.lit(0.95)).alias("mean_unique"),
    )
    q = F.col("n_cols") * F.greatest("numeric_ratio", F.lit(0.1)) * (1 - F.col("mean_missing")) * F.greatest("mean_unique", F.lit(0.01))
    return g.withColumn("quality", q)


def column_weight(dtype: Column, missing_pct: Column, unique_pct: Column) -> Column:
    w = F.create_map(*[x for t, v in TYPE_WEIGHT.items() for x in (F.lit(t), F.lit(v))])
    return F.coalesce(w[dtype], F.lit(1.0)) * F.greatest((1 - missing_pct / 100) * F.least(unique_pct / 100, F.lit(0.95)), F.lit(1e-6))


def dataset_vectors(columns: DataFrame, key: str) -> DataFrame:
    """(key, v): weighted mean of the columns' vectors (key, v, dtype, missing_pct, unique_pct) at length 1; missing dimensions don't occur."""
    from viewloom.functions.vector import unit

    w = column_weight(F.col("dtype"), F.col("missing_pct"), F.col("unique_pct"))
    x = columns.select(key, w.alias("w"), F.posexplode("v").alias("pos", "e"))
    x = x.groupBy(key, "pos").agg((F.sum(F.col("w") * F.col("e")) / F.sum("w")).alias("e"))
    lists = x.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "e"))), lambda s: s["e"]).alias("v"))
    return lists.select(key, unit(F.col("v")).alias("v"))


def hashed_text_vectors(texts: DataFrame, key: list[str], text: str, dim: int = 64) -> DataFrame:
    """(key..., v): signed hashing of the words of a text into ``dim`` numbers at length 1 — the place of a sentence encoder, which needs
    a model file; any (key, v) table can take its place."""
    from viewloom.functions.text import tokens
    from viewloom.functions.vector import unit

    x = texts.select(*key, F.explode(tokens(F.col(text))).alias("w"))
    h = F.xxhash64("w")
    x = x.groupBy(*key, F.pmod(h, F.lit(dim)).cast("int").alias("pos")).agg(F.sum(F.when(F.pmod(F.shiftright(h, 20), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("e"))
    m = x.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "e"))).alias("m"))
    v = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return m.select(*key, unit(v).alias("v"))
