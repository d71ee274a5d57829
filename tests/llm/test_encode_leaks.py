import base64
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from viewloom.llm import encode as en
from viewloom.llm import leaks

HAVE = os.path.exists(f"{en.FOLDER}/{en.NAME}.json")
TEXTS = [None, "", " ", "Hello world", "naïve café 日本語 😀👩‍👩‍👧", "<|endoftext|> is text", "a\x00b​c\r\n\t", "word " * 20000, "é", "🏳️‍🌈" * 50]


@pytest.mark.skipif(not HAVE, reason="no vocabulary files")
def test_round_trip_and_other_library(spark):
    import tiktoken
    import public_tokenizers

    lines = open(f"{en.FOLDER}/{en.NAME}.tiktoken", "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids array<int>")
    enc = en.encode(df, "doc_id", "text")
    got = {r.doc_id: r.ids for r in enc.collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == (other.encode_ordinary(t) if t else [])
    back = {r.doc_id: (r.text, r.whole) for r in en.decode(enc, "doc_id").collect()}
    assert back == {i: (t or "", True) for i, t in enumerate(TEXTS)}
    assert en.round_trip(df, "doc_id", "text").first().n_differ == 0


@pytest.mark.skipif(not HAVE, reason="no vocabulary files")
def test_split_characters_and_offsets(spark):
    df = spark.createDataFrame([(1, "x😀y")], "doc_id long, text string")
    r = en.encode(df, "doc_id", "text", offsets=True).first()
    assert all(0 <= a < b <= 3 for a, b in zip(r.starts, r.ends))
    assert len(r.ids) > 3  # the emoji takes several tokens, each at the same place
    part = spark.createDataFrame([(1, r.ids[:2]), (2, None), (3, []), (4, [99999999])], "doc_id long, ids array<int>")
    got = {x.doc_id: (x.text, x.whole) for x in en.decode(part, "doc_id").collect()}
    assert got[1][1] is False and "�" in got[1][0] and got[1][0].startswith("x")
    assert got[2] == (None, None) and got[3] == ("", True) and got[4][1] is False


def test_byte_table():
    t = en.byte_table()
    assert len(set(t)) == 256 and t[32] == "Ġ" and t[65] == "A"


def brute(items, docs, least):
    grams = {}
    for i, t in items:
        w = leaks.words_of(t)
        for k in range(len(w) - least + 1):
            grams.setdefault(tuple(w[k : k + least]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leaks.words_of(t)
        for k in range(len(w) - least + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + least]), ())}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_equal_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = ["ab", "c", "d", "e"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(3, 30)))) for i in range(25)]
    docs = [(d, " ".join(r.choice(vocab + ["x"]) for _ in range(80))) for d in range(15)]
    docs += [(100 + k, f"intro {items[k][1]} outro") for k in range(10)] + [(200, None), (201, ""), (202, " ")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame(items + [(None, "ab c d e"), (77, None)], "item_id long, text string")
    for shard in (10**6, 40):
        got = {(x.doc_id, x.item_id) for x in leaks.leaked_spans(df, "doc_id", "text", it, least=6, shard_words=shard).collect()}
        assert got == brute(items, docs, 6)


def test_layout_is_levelled(spark):
    item = "Straße und Café: ﬁnd the 12 big_words of &amp; every Kind, isn't it over now"
    doc = "X <b>STRASSE</b> UND&nbsp;CAFÉ - find  THE 12\nbig words of every kind isn t it over, now!"
    df = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    it = spark.createDataFrame([(5, item)], "item_id long, text string")
    spans = leaks.leaked_spans(df, "doc_id", "text", it)
    r = spans.collect()
    assert [(x.doc_id, x.item_id, x.first_word, x.last_word) for x in r] == [(1, 5, 1, 16)]
    assert leaks.leaked_coverage(spans, "doc_id").first().longest == 16
    kept = leaks.without_leaks(df, "doc_id", "text", spans, max_coverage=1.0).first()
    assert kept.words == ["x"] and kept.dropped is False
    assert leaks.without_leaks(df, "doc_id", "text", spans).first().dropped is True


def test_no_items(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    it = spark.createDataFrame([], "item_id long, text string")
    assert leaks.leaked_spans(df, "doc_id", "text", it).count() == 0


def test_passages_of_the_tables_equal_windows(spark):
    """Every window of 12 words of the items, looked up in every window of the documents."""
    from sql_compare import FOLDER, have_data

    from viewloom.llm.queries import p9_found

    if not have_data():
        pytest.skip("no test tables")
    docs, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "eval_items"))
    rows = [tuple(r) for r in items.select("item_id", "text").collect()], [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in p9_found(spark, FOLDER).select("doc_id", "item_id").collect()} == brute(*rows, 12)


def test_automaton_survives_pickling():
    import pickle

    a = leaks.build([(1, list("abcabd")), (2, list("xbcab"))], 3)
    b = pickle.loads(pickle.dumps(a))
    assert [(e, n, b.items(s)) for e, n, s in b.matches(list("zbcabq"))] == [(3, 3, (1, 2)), (4, 4, (1, 2))]
