import random

import pytest

from viewloom.llm import set_pairs as sp

SCHEMA = "doc_idx long, tags array<string>, n int, tokens string"


def frame(spark, rows):
    # the extra columns clash with the operator's own names
    return spark.createDataFrame([(i, t, 9, "x") for i, t in rows], SCHEMA)


def brute(rows, least=5):
    sets = {}
    for i, tags in rows:
        if i is None:
            continue
        clean = {" ".join(t.replace("\t", " ").split(" ")).strip() for t in ()}
        for t in tags or ():
            if t is not None:
                t = " ".join(x for x in t.lower().replace("\t", " ").split(" ") if x)
                if t:
                    clean.add(t)
        sets.setdefault(i, set()).update(clean)
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    ids = sorted(sets)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]


def run(spark, rows):
    return sp.expand(*sp.similar_classes(sp.tag_sets(frame(spark, rows), "doc_idx", "tags", 5)))


@pytest.mark.parametrize("seed, per_salt", [(1, 200_000), (2, 200_000), (3, 20)])
def test_equals_brute_force(spark, same, monkeypatch, seed, per_salt):
    monkeypatch.setattr(sp, "SALT_SETS", per_salt)
    r = random.Random(seed)
    words = ["tabular"] + [f"tag {k}" for k in range(40)]
    rows = []
    for i in range(90):
        base = rows[r.randrange(len(rows))][1] if rows and r.random() < 0.6 else r.sample(words, r.randint(4, 18))
        s = [t for t in base if r.random() > 0.1] + r.sample(words, r.randint(0, 2))
        rows.append((i, s + ["tabular"] * (r.random() < 0.7)))
    if per_salt < 100:  # hot tokens beyond half of the sets only
        monkeypatch.setattr(sp, "HOT_SHARE", 0.3)
    same(run(spark, rows), brute(rows))


def test_spelling_nulls_repeats_and_copies(spark, same):
    five = ["a", "b", "c", "d", "e"]
    rows = [(1, five), (2, ["E", " d ", "c\t", "B", "a", "a", None, " "]), (3, five[:4]), (4, None), (5, []), (None, five), (6, ["a  x", "b", "c"]), (6, ["a\t x", "d", "e"]), (7, five + ["f", "g", "h"]), (8, five + ["f", "g", "h", "i"])]
    same(run(spark, rows), brute(rows))
    assert (1, 2) in brute(rows)


def test_long_sets_and_many_copies(spark, same):
    long = [f"w{k}" for k in range(300)]
    rows = [(1, long), (2, long[:200]), (3, long[:170])] + [(10 + k, ["p", "q", "r", "s", "t"]) for k in range(12)]
    same(run(spark, rows), brute(rows))


def test_empty(spark):
    assert run(spark, []).count() == 0


def test_two_tables(spark, same):
    r = random.Random(5)
    words = [f"t{k}" for k in range(25)]
    a = [(i, r.sample(words, r.randint(5, 12))) for i in range(40)]
    b = [(i, r.sample(a[i][1], len(a[i][1]) - 1) + ["zz"] if i % 2 else r.sample(words, 8)) for i in range(40)]
    left, right = (sp.tag_sets(frame(spark, x), "doc_idx", "tags", 5) for x in (a, b))
    expected = [(i, j) for i, s in a for j, t in b if len(set(s)) >= 5 and len(set(t)) >= 5 and 5 * len(set(s) & set(t)) >= 3 * len(set(s) | set(t))]
    same(sp.similar_between(left, right).select("a", "b"), expected)
