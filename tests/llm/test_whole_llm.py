import pytest

from viewloom.llm import abuse, queries


def test_p6_scores_have_terms_used_once(spark, tmp_path):
    rows = [(i, f"a plain text{i % 5} of words" + " quokka" * {3: 1, 4: 2}.get(i, 0)) for i in range(2_000)]
    spark.createDataFrame(rows, "Id long, Description string").write.parquet(str(tmp_path / "metadata_merged_raw.parquet"))
    got = queries.p6_scores(spark, str(tmp_path)).where("term = 'quokka'").collect()
    assert {(x.record_id, x.tf, x.df) for x in got} == {(3, 1, 2), (4, 2, 2)} and all(x.score > 0.9 for x in got)


@pytest.fixture(scope="module")
def speller():
    counts = {"the": 4000, "you": 3000, "are": 2500, "an": 2000, "and": 3500, "idiot": 60, "pig": 40, "stupid": 60, "should": 900, "leave": 300, "this": 2500, "place": 500, "right": 600, "now": 900}
    return abuse.Speller.train(counts)


@pytest.mark.parametrize(
    "text, words",
    [
        ("you idi" + "o" * 60 + "t", "you idiot"),
        ("st" + "u" * 5000 + "p1d", "stupid"),
        ("y o u a r e a n i d i o t", "you are an idiot"),
        (" ".join("youareanidiotandyoushouldleavethisplacerightnow"), "you are an idiot and you should leave this place right now"),
        (".".join("youareanidiotandyoushouldleavethisplacerightnow"), "you are an idiot and you should leave this place right now"),
        ("youareanidi0tandyoushouldle@vethisplacerightnow", "you are an idiot and you should leave this place right now"),
        ("the i d i o t", "the idiot"),
    ],
)
def test_long_disguises_are_restored(speller, text, words):
    assert " ".join(speller.words(text)) == words


def test_long_strings_without_words_stay(speller):
    blob = "qzkxvjwqpzmxkqvj" * 4
    assert speller.words(blob) == [blob]
    assert len(speller.words(blob * 200)) == 1
