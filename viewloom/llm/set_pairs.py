"""All similar pairs between set-valued records, by pigeonhole partitioning of the token universe."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.session import materialise

#: A token is hot from this share of the distinct sets on; at most (mean set size / HOT_SHARE) tokens are.
HOT_SHARE = 0.005
#: Sets a salt of a hot key stands for.
SALT_SETS = 200_000


def normal_tag(tag: Column) -> Column:
    """Lower case, runs of blanks and tabs as one blank, trimmed."""
    low = F.lower(tag)
    return F.trim(F.when(F.contains(low, F.lit("\t")) | F.contains(low, F.lit("  ")), F.regexp_replace(low, "[ \t]+", " ")).otherwise(low))


def tag_sets(df: DataFrame, record: str, tags: str, min_size: int = 1) -> DataFrame:
    """(id, tokens, n): the distinct normalised tags of each record, sorted; repeated records are united.

    NULL records are dropped, NULL and blank tags don't count, sets under ``min_size`` are left out.
    """
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(F.col(tags), normal_tag), lambda t: t.isNotNull() & (t != ""))))
    sets = df.where(F.col(record).isNotNull()).select(F.col(record).alias("id"), clean.alias("part")).where(F.size("part") > 0)
    sets = sets.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("part")))).alias("tokens"))
    return sets.withColumn("n", F.size("tokens")).where(F.col("n") >= min_size)


def _group(n: Column, ratio: float) -> Column:
    return F.floor(F.log(n) / F.lit(math.log(ratio))).cast("int")


def _upper(g: Column, ratio: float) -> Column:
    """At least the largest length of group ``g``."""
    return F.ceil(F.exp((g + 1) * F.lit(math.log(ratio)))).cast("int")


def _segments(h: Column, m: Column) -> Column:
    """The token hashes of a set in ``m`` segments of the universe, with each segment's XOR."""
    cut = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.struct(i.alias("i"), F.filter(h, lambda t: F.pmod(t, m.cast("long")) == i).alias("seg")))
    return F.transform(cut, lambda s: F.struct(s.i.alias("i"), s.seg.alias("seg"), F.aggregate(s.seg, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(t)).alias("x")))


def similar_pairs(sets: DataFrame, num: int = 3, den: int = 5, two_sided: bool = False) -> DataFrame:
    """(a, b) of ``sets`` (id, side, tokens, n; ids distinct per side, sets distinct per side) with Jaccard >= num / den.

    With one side, each unordered pair once; ``two_sided``: pairs across the sides only.

    A pair of sizes s <= l differs in at most H = floor((s + l)(den - num) / (den + num)) tokens. Lengths are grouped by powers of den / num,
    so a set can only be similar to longer ones of its own group and the next. The universe is split,
    by the group of the longer set, into m segments. The longer set gives every segment (E) and every segment
    less one token (D). The shorter one gives each segment a budget of 0, 1 (match E exactly) or 2 (also one token
    more or less), H + 1 in all: if every segment differed by its budget or more, the sets would differ by H + 1. Segments that
    are empty or hold only hot tokens get 0 where the others can take their share; such keys are salted from SALT_SETS sets on. A 64-bit sketch
    drops nearly all false candidates inside the join; the rest is verified exactly.
    """
    n_sets = sets.count()
    hashed = sets.select("id", "side", "n", F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"))
    tokens = hashed.select(F.explode("h").alias("t")).groupBy("t").count()
    hot = [r.t for r in tokens.where(F.col("count") > max(1, n_sets * HOT_SHARE)).collect()]
    one = F.lit(1).cast("long")
    hashed = hashed.withColumn("bits", F.aggregate("h", F.lit(0).cast("long"), lambda a, t: a.bitwiseOR(F.call_function("shiftleft", one, F.pmod(F.shiftright(t, 7), F.lit(64)).cast("int")))))

    spread = lambda total: F.floor(total * F.lit(den - num) / F.lit(den + num)).cast("int")
    ratio = max(den / num, 1.1)
    parts = lambda u: F.floor(spread(2 * u) / 2).cast("int") + 2
    salts = -(-n_sets // SALT_SETS)
    weight = lambda seg: F.size(F.filter(seg, lambda t: ~t.isin(hot))) if hot else F.size(seg)
    # a key is hot if its tokens all are (or it has none): its sets are spread over the salts and its probes go to all of them
    plain = lambda seg: weight(seg) == 0
    less = lambda seg, t: weight(F.filter(seg, lambda x: x != t)) == 0
    salted = lambda x, salt: F.xxhash64(x, salt) if salts > 1 else x
    key = lambda g, i, kind, x: F.xxhash64(g, i, F.lit(kind), x)
    own = lambda x, is_hot: salted(x, F.when(is_hot, F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(0)) if salts > 1 else x
    every = lambda x, is_hot: F.transform(F.sequence(F.lit(0), F.when(is_hot, salts - 1).otherwise(0)), lambda n: salted(x, n.cast("long"))) if salts > 1 else F.array(x)

    longer = hashed.withColumn("g", _group(F.col("n"), ratio)).withColumn("m", parts(_upper(F.col("g"), ratio)))
    longer = longer.withColumn("s", _segments(F.col("h"), F.col("m")))
    g = F.col("g")
    index = longer.select(
        F.col("id").alias("b"), F.col("side").alias("side_b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"),
        F.explode(F.flatten(F.transform("s", lambda s: F.concat(
            F.array(own(key(g, s.i, 0, s.x), plain(s.seg))), F.transform(s.seg, lambda t: own(key(g, s.i, 1, s.x.bitwiseXOR(t)), less(s.seg, t))))))).alias("k"),
    )

    reach = F.floor(F.col("n") * F.lit(den) / F.lit(num)).cast("int")
    shorter = hashed.withColumn("g", F.explode(F.sequence(_group(F.col("n"), ratio), _group(reach, ratio))))
    shorter = shorter.withColumn("m", parts(_upper(g, ratio))).withColumn("need", spread(F.col("n") + F.least(_upper(g, ratio), reach)) + 1)
    shorter = shorter.withColumn("s", F.transform(_segments(F.col("h"), F.col("m")), lambda s: F.struct((-weight(s.seg)).alias("w"), s.i.alias("i"), s.seg.alias("seg"), s.x.alias("x"))))
    shorter = shorter.withColumn("s", F.array_sort("s"))
    m, need = F.col("m"), F.col("need")
    bad = F.size(F.filter("s", lambda s: s.w == 0))
    shorter = shorter.withColumn("skip", F.greatest(m - need, F.least(bad, m - F.ceil(need / 2).cast("int"))))
    shorter = shorter.withColumn("two", F.greatest(F.lit(0), need - (m - F.col("skip"))))
    used = F.slice(F.col("s"), F.lit(1), F.col("m") - F.col("skip"))
    probe = shorter.select(
        F.col("id").alias("a"), F.col("side").alias("side_a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"),
        F.explode(F.flatten(F.transform(used, lambda s, at: F.when(at >= F.col("two"), every(key(g, s.i, 0, s.x), plain(s.seg))).otherwise(F.concat(
            every(key(g, s.i, 0, s.x), plain(s.seg)), every(key(g, s.i, 1, s.x), plain(s.seg)), F.flatten(F.transform(s.seg, lambda t: every(key(g, s.i, 0, s.x.bitwiseXOR(t)), less(s.seg, t))))))))).alias("k"),
    )

    total = F.col("n_a") + F.col("n_b")
    differ = total - 2 * F.ceil(total * F.lit(num) / F.lit(num + den)).cast("int")
    order = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & ((F.col("side_a") < F.col("side_b")) if two_sided else (F.col("a") < F.col("b"))))
    if two_sided:
        order = order & (F.col("side_a") != F.col("side_b"))
    near = (
        probe.join(index, "k")
        .where(order & (F.col("n_b") * num <= F.col("n_a") * den) & (F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= differ))
        .select("a", "side_a", "b", "side_b")
        .distinct()
    )
    texts = sets.select("id", "side", "tokens")
    checked = near.join(texts.select(F.col("id").alias("a"), F.col("side").alias("side_a"), F.col("tokens").alias("ta")), ["a", "side_a"]).join(
        texts.select(F.col("id").alias("b"), F.col("side").alias("side_b"), F.col("tokens").alias("tb")), ["b", "side_b"]
    )
    shared = F.size(F.array_intersect("ta", "tb"))
    checked = checked.withColumn("shared", shared).withColumn("joint", F.size("ta") + F.size("tb") - F.col("shared"))
    checked = checked.where(F.col("shared") * den >= F.col("joint") * num)
    if two_sided:
        first = F.col("side_a") < F.col("side_b")
        return checked.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), "shared", "joint")
    return checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", "joint")


def similar_classes(sets: DataFrame, num: int = 3, den: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) for sets (id, tokens, n): equal sets form a class named by its least id.

    members: (id, class_id). pairs: (a, b, shared, joint) between different classes. A group of exact copies costs one
    class, whatever its size. Empty input gives empty results.
    """
    classes = materialise(sets.groupBy("tokens").agg(F.min("id").alias("class_id"), F.first("n").alias("n")), "classes")
    members = sets.join(classes.select("tokens", "class_id"), "tokens").select("id", "class_id")
    return members, similar_pairs(classes.select(F.col("class_id").alias("id"), F.lit(0).alias("side"), "tokens", "n"), num, den)


def similar_between(left: DataFrame, right: DataFrame, num: int = 3, den: int = 5) -> DataFrame:
    """(a, b, shared, joint): pairs of a set of ``left`` and a set of ``right`` (id, tokens, n), copies included."""
    sides = [(left, 0), (right, 1)]
    classes = [materialise(df.groupBy("tokens").agg(F.min("id").alias("class_id"), F.first("n").alias("n")), "classes") for df, _ in sides]
    members = [df.join(c.select("tokens", "class_id"), "tokens").select("id", "class_id") for (df, _), c in zip(sides, classes, strict=True)]
    both = classes[0].withColumn("side", F.lit(0)).unionByName(classes[1].withColumn("side", F.lit(1)))
    pairs = similar_pairs(both.select(F.col("class_id").alias("id"), "side", "tokens", "n"), num, den, True)
    a = members[0].select(F.col("id").alias("id_a"), F.col("class_id").alias("a"))
    b = members[1].select(F.col("id").alias("id_b"), F.col("class_id").alias("b"))
    return pairs.join(a, "a").join(b, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "shared", "joint")


def expand(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_a, doc_b) of all members: across similar classes and within a class."""
    a = members.select(F.col("id").alias("x"), F.col("class_id").alias("a"))
    b = members.select(F.col("id").alias("y"), F.col("class_id").alias("b"))
    across = pairs.select("a", "b").join(a, "a").join(b, "b")
    within = a.join(b.withColumnRenamed("b", "a"), "a").where("x < y")
    both = across.select("x", "y").unionByName(within.select("x", "y"))
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
