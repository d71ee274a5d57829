"""How distinctive a term is per record: a two-Poisson mixture per term, and the rarest weighted tag."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.llm.set_pairs import normal_tag
from viewloom.operators.skew import heavy_limit, split_join
from viewloom.session import broadcast_if_small, materialise

# Mark-up, addresses and terms of a description.
TAG = re.compile(r"<[^>]+>")
ADDRESS = re.compile(r"https?://\S+")
TERM = re.compile(r"[a-z0-9_]{2,}")
#: Partial counts a task keeps before it passes them on.
FLUSH = 300_000
STEPS = 40
#: A term is surely elite in a record from this posterior probability on.
SURE = 0.99

_COUNTS = "id long, term string, tf int, n long"


def terms_of(text: str) -> list[str]:
    """Longest runs of a-z, 0-9 and _ of 2 or more characters, after mark-up and addresses became blanks."""
    return TERM.findall(ADDRESS.sub(" ", TAG.sub(" ", text)).lower())


def _counter(keep_tf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("term", pa.string()), ("tf", pa.int32()), ("n", pa.int64())])
        part: Counter = Counter()
        for batch in batches:
            ids, names, tfs = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = Counter(terms_of(text)) if text else {}
                if counts:
                    part["", 0] += 1
                for term, tf in counts.items():
                    if tf >= keep_tf:
                        ids.append(i)
                        names.append(term)
                        tfs.append(tf)
                    else:
                        part[term, tf] += 1
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names), pa.array(tfs, pa.int32()), pa.array([1] * len(ids), pa.int64())], schema=schema)
            if len(part) >= FLUSH:
                yield _flush(part, schema)
                part.clear()
        if part:
            yield _flush(part, schema)

    return run


def _flush(part: Counter, schema: pa.Schema) -> pa.RecordBatch:
    keys = list(part)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(len(keys), pa.int64()), pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(part.values()), pa.int64())],
        schema=schema,
    )


def term_counts(df: DataFrame, record: str, text: str, keep_tf: int = 1) -> DataFrame:
    """(id, term, tf, n): rows with tf >= ``keep_tf`` by record (n = 1), the others only as partial counts (id NULL).

    The term '' counts the records that have a term. Rows without record are left out; NULL, empty and long texts are fine.
    A record that comes several times counts once: each distinct text is counted, and its largest tf per term holds.
    """
    rows = df.where(F.col(record).isNotNull()).select(F.col(record).cast("long").alias("id"), F.col(text).alias("text"))
    repeated = broadcast_if_small(rows.groupBy("id").count().where("count > 1").select("id"))
    once = rows.join(repeated, "id", "left_anti").mapInArrow(_counter(keep_tf), _COUNTS)
    more = rows.join(repeated, "id", "left_semi").distinct().mapInArrow(_counter(1), _COUNTS).where("id is not null")
    more = more.groupBy("id", "term").agg(F.max("tf").alias("tf"), F.lit(1).cast("long").alias("n"))
    more = more.select(F.when(F.col("tf") >= keep_tf, F.col("id")).alias("id"), "term", "tf", "n").unionByName(
        more.groupBy().agg(F.count_distinct("id").alias("n")).select(F.lit(None).cast("long").alias("id"), F.lit("").alias("term"), F.lit(0).alias("tf"), "n")
    )
    return once.unionByName(more.select("id", "term", "tf", "n"))


def fit_two_poisson(total: np.ndarray, df: np.ndarray, tf: np.ndarray, n: np.ndarray, start: np.ndarray, steps: int = STEPS, known: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(share, elite, base) of each term by expectation-maximisation on its frequency histogram.

    The histogram of term j is tf[start[j]:start[j + 1]] with counts n, and total - df records at 0. ``known``: base rates that are
    given and not fitted; then an elite record holds the term once at least.
    """
    owner = np.repeat(np.arange(len(df)), np.diff(np.append(start, len(tf))))
    zero = np.maximum(total - df, 0).astype(float)
    mass = np.bincount(owner, tf * n, len(df))
    elite = np.maximum(mass / df, 1.0) + 0.5
    base = np.maximum(mass / total * 0.1, 1e-9) if known is None else known
    share = np.clip(df / total * 0.5, 1e-9, 0.5)
    for _ in range(steps):
        up = np.log(share)[owner] + tf * np.log(elite)[owner] - elite[owner]
        down = np.log1p(-share)[owner] + tf * np.log(base)[owner] - base[owner]
        post = 1 / (1 + np.exp(np.clip(down - up, -700, 700)))
        at0 = 1 / (1 + np.exp(np.clip(np.log1p(-share) - base - np.log(share) + elite, -700, 700)))
        r = np.bincount(owner, post * n, len(df)) + at0 * zero
        rt = np.bincount(owner, post * n * tf, len(df))
        share = np.clip(r / total, 1e-12, 1 - 1e-12)
        elite = np.maximum(rt / np.maximum(r, 1e-12), 1e-9)
        if known is None:
            base = np.minimum(np.maximum((mass - rt) / np.maximum(total - r, 1e-12), 1e-9), elite)
        else:
            elite = np.maximum(elite, 1.0)
    return share, elite, base


def log_odds(tf: Column, share: Column, elite: Column, base: Column) -> Column:
    """Of the elite component against the base one, for a term that occurs ``tf`` times."""
    return F.log(share) - F.log1p(-share) + tf * (F.log(elite) - F.log(base)) - elite + base


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        hist = b.column("hist")
        start = np.asarray(hist.offsets)[:-1] - np.asarray(hist.offsets)[0]
        flat = hist.flatten()
        tf, n = (np.asarray(flat.field(k), dtype=float) for k in ("tf", "n"))
        share, elite, base = fit_two_poisson(np.asarray(b.column("total"), dtype=float), np.asarray(b.column("df"), dtype=float), tf, n, start)
        cols = [b.column("term"), b.column("df"), b.column("total"), pa.array(share), pa.array(elite), pa.array(base)]
        yield pa.RecordBatch.from_arrays(cols, names=["term", "df", "total", "share", "elite", "base"])


def distinctive_terms(df: DataFrame, record: str, text: str, keep_tf: int = 1, min_df: int = 1, max_share: float = 1.0) -> DataFrame:
    """(id, term, tf, df, total, score): every term a record holds ``keep_tf`` times or more, in ``min_df`` records or more
    and in at most ``max_share`` of the ``total`` records that have a term.

    score is the posterior probability of the elite component, given tf. All counts and fits cover all records. One
    pass over the texts and one fit per term; low counts leave a task pre-aggregated as (term, tf, n). Empty input gives an empty result.
    """
    counts = materialise(term_counts(df, record, text, keep_tf), "terms")
    total = counts.where("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hist = counts.where("term <> ''").groupBy("term", "tf").agg(F.sum("n").alias("n"))
    hist = hist.groupBy("term").agg(F.sum("n").alias("df"), F.collect_list(F.struct("tf", "n")).alias("hist"))
    limits = F.lit(max_share).cast("decimal(10,6)") * F.lit(total)
    hist = hist.where((F.col("df") >= min_df) & (F.col("df") <= limits)).withColumn("total", F.lit(total).cast("long"))
    fits = hist.select("term", "df", "total", "hist").mapInArrow(_fit, "term string, df long, total long, share double, elite double, base double")
    fits = materialise(fits, "fits")
    rows = counts.where("term <> '' and id is not null").select("id", "term", "tf")
    joined = split_join(rows, fits, "term", heavy_limit(total), "df")
    odds = log_odds(F.col("tf"), F.col("share"), F.col("elite"), F.col("base"))
    return joined.select("id", "term", "tf", "df", "total", (1 / (1 + F.exp(-odds))).alias("score"))


def tag_weights(idf: DataFrame) -> DataFrame:
    """(tag, idf): of the rows of a tag (normalised) without NULL or NaN the one with the largest df; of those the largest idf."""
    clean = idf.select(normal_tag(F.col("tag")).alias("tag"), F.col("df").cast("double").alias("df"), F.col("idf").cast("double").alias("idf"))
    clean = clean.where("tag <> '' and df is not null and idf is not null and not isnan(df) and not isnan(idf)")
    return clean.groupBy("tag").agg(F.max(F.struct("df", "idf")).alias("best")).select("tag", F.col("best.idf").alias("idf"))


def tag_scores(docs: DataFrame, idf: DataFrame, min_tags: int = 8) -> DataFrame:
    """(id, term, k, idf, odds, score): the tags with idf of each doc_idx that has ``min_tags`` (``k``) of them or more, by the two-Poisson mixture.

    A tag stands once or not at all in a record, so its own histogram can't tell two rates apart. The base rate comes from the larger
    collection the weights were counted over, exp(-idf); share and elite rate are fitted by EM on the histogram of all tags together.
    score is the posterior probability of the elite component, odds its log odds, which grow with idf. Tags count once per
    doc_idx, also over repeated rows; NULL and blank ones and those without idf don't count. Empty input gives an empty result.
    """
    tags = docs.where("doc_idx is not null").select(F.col("doc_idx").alias("id"), F.explode("tags").alias("tag"))
    tags = tags.select("id", normal_tag(F.col("tag")).alias("term")).where("term <> ''")
    weights = materialise(tag_weights(idf).withColumnRenamed("tag", "term"), "idf")
    sets = tags.join(broadcast_if_small(weights), "term").groupBy("id").agg(F.collect_set(F.struct("term", "idf")).alias("set"))
    sets = materialise(sets.withColumn("k", F.size("set")), "tags")
    pairs, records = sets.agg(F.coalesce(F.sum("k"), F.lit(0)), F.count("*")).first()
    rates = weights.agg(F.count("*"), F.avg(F.exp(-F.col("idf")))).first()
    if not pairs:
        share = elite = 0.5
    else:
        one = np.array([1.0])
        fit = fit_two_poisson(one * records * rates[0], one * pairs, one, one * pairs, np.array([0]), known=one * rates[1])
        share, elite = float(fit[0][0]), float(fit[1][0])
    out = sets.where(F.col("k") >= min_tags).select("id", "k", F.explode("set").alias("s")).select("id", "k", "s.term", "s.idf")
    out = out.withColumn("odds", log_odds(F.lit(1), F.lit(share), F.lit(elite), F.exp(-F.col("idf"))))
    return out.select("id", "term", "k", "idf", "odds", (1 / (1 + F.exp(-F.col("odds")))).alias("score"))


def distinctive_tag(docs: DataFrame, idf: DataFrame, min_tags: int = 8) -> DataFrame:
    """(id, term, weight, score): of the ``tag_scores`` of each doc_idx the tag with the largest odds; odds that are equal to 6 digits by
    idf, then the first by name."""
    best = F.min(F.struct((-F.round("odds", 6)).alias("odds"), (-F.col("idf")).alias("neg"), "term", "score"))
    out = tag_scores(docs, idf, min_tags).groupBy("id").agg(best.alias("b"))
    return out.select("id", "b.term", (-F.col("b.neg")).alias("weight"), "b.score")
