import random

import numpy as np
import pytest

from viewloom.llm import abuse

BASE = "you are a pathetic parasite go cry somewhere else the table has rows and columns people everyone here knows it your back brainless imbecile what a waste of space keep them away from our forum watch".split()


@pytest.fixture(scope="module")
def speller():
    return abuse.Speller.train({w: 50 for w in BASE})


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("p a t h e t i c p*r4site", "pathetic parasite"),
        ("c.r.y $0m3wh3r3 else", "cry somewhere else"),
        ("yоu аre brаinless", "you are brainless"),
        ("waaaaste of spa​ce", "waste of space"),
        ("wacth your back", "watch your back"),
        ("WHAT A PATHÉTIC imbecile!!!", "what a pathetic imbecile"),
        ("<b>keep</b> &amp; **forum** 2004", "keep forum 0"),
        ("таблица", "таблица"),
        ("你好 ok", "你 好 ok"),
    ],
)
def test_restored(speller, text, words):
    assert " ".join(speller.words(text)) == words


def test_words_of_another_script_stay(speller):
    """Russian words made only of letters that look like Latin ones."""
    assert speller.words("пора нет топор сор") == ["пора", "нет", "топор", "сор"]
    assert abuse.Speller.train({"cop": 9}).words("сор") == ["cop"]


def test_long_words_are_counted(spark):
    word = "donaudampfschifffahrtsgesellschaftskapitän"
    df = spark.createDataFrame([(i, f"{word} x") for i in range(5)], "doc_id long, text string")
    assert abuse.word_counts(df, "text")[abuse.fold(word)] == 5


def test_nothing_to_restore(speller):
    assert speller.words(None) == speller.words("") == speller.words(" \n") == []


def corpus(n, seed):
    r = random.Random(seed)
    plain = ["the table has many rows", "column names are in the readme", "thanks for sharing the data", "if you name the owner you may use it", "my model reaches a good score"]
    bad = ["you pathetic imbecile go away", "what a brainless parasite you are", "watch your back i am coming for you"]
    docs = []
    for i in range(n):
        s = r.sample(plain, 3)
        y = r.random() < 0.3
        if y:
            b = r.choice(bad)
            s.insert(r.randint(0, 3), "".join(c + r.choice(["", "", "", "​"]) if r.random() < 0.2 else c for c in b))
        docs.append((i, ". ".join(s), y))
    return docs


def test_held_out_accuracy(spark):
    r = random.Random(9)
    docs = corpus(400, 1)
    labels = [(i, int(y) if r.random() > 0.08 else 1 - int(y)) for i, _, y in docs if i < 300] + [(None, 1), (3, None)]
    df = spark.createDataFrame([(i, t, 5) for i, t, _ in docs] + [(1000, None, 5), (1001, "", 5), (1002, "word " * 20000, 5)], "doc_id long, text string, score int")
    lab = spark.createDataFrame(labels, "doc_id long, is_toxic int")
    model = abuse.fit(df, "doc_id", "text", lab, "is_toxic")
    got = {x.doc_id: x.score for x in abuse.score(df, "doc_id", "text", model).collect()}
    test = [(got[i] >= abuse.THRESHOLD) == y for i, _, y in docs if i >= 300]
    assert np.mean(test) > 0.95
    assert got[1000] == got[1001] == 0 and got[1002] < abuse.THRESHOLD


def test_seeds_alone_give_a_model(spark):
    df = spark.createDataFrame([(1, "shut up you moron"), (2, "the rows are sorted by date")], "doc_id long, text string")
    model = abuse.fit(df, "doc_id", "text", spark.createDataFrame([], "doc_id long, is_toxic int"), "is_toxic")
    got = {x.doc_id: x.score for x in abuse.score(df, "doc_id", "text", model).collect()}
    assert got[1] > got[2]


def test_rates(spark, same):
    s = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, source string")
    p = spark.createDataFrame([(1, 0.9, "x"), (2, 0.1, "x"), (3, 0.0, None)], "doc_id long, score double, worst string")
    same(abuse.rates(s, p, "doc_id", "source"), [("a", 2, 1, 0.5), ("b", 1, 0, 0.0)])
