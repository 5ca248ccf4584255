"""The published method on its own examples and on hand-computed ones."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hemline import valence as V
from hemline.functions.sentiment import lexicon_sentiment, sentiment_words
from hemline.operators.lexicon import score_with_lexicon_table

SAMPLE = [
    ("Relaxed fit overshirt. Lapel collar and long sleeves with buttoned cuffs. Side hidden in-seam pockets. "
     "Front button closure.", 0.6908),
    ("Straight fit blazer. Notched lapel collar and long sleeves with buttoned cuffs. Flap pockets at hip. "
     "Interior pocket. Central back vent at hem. Front button closure.", 0.5267),
    ("Puffer jacket with high collar and adjustable hood. Long sleeves with interior rib cuffs.", 0.0),
]


def normalized(total):
    return pytest.approx(round(total / math.sqrt(total * total + 15), 4), abs=1.01e-4)


def compound(values, texts, **options):
    return [s["compound"] for s in values(lambda c: lexicon_sentiment(c, **options), texts)]


def test_sample_products(values):
    assert compound(values, [" " + text for text, _ in SAMPLE]) == [score for _, score in SAMPLE]


def test_words(values):
    got = values(sentiment_words, ["Good, (bad) :) a don't, 'quoted' wow!!! ...", "", None])
    assert got == [["Good", "(bad)", ":)", "don't,", "'quoted'", "wow", "..."], [], None]


RULES = [
    ("The book was good.", 1.9),
    ("The book was very good.", 1.9 + V.BOOST),
    ("The book was kinda good.", 1.9 - V.BOOST),
    ("It was VERY bad there", -2.5 - V.BOOST - V.CAPITALS_BOOST),
    ("It was GOOD there", 1.9 + V.CAPITALS_BOOST),
    ("ALL OF IT GOOD", 1.9),
    ("good!!!!!!", 0.0),                                   # too many marks to be taken off the word
    ("It was good !!! !!!", 1.9 + 4 * V.EXCLAMATION_WEIGHT),
    ("Was it good ???", 1.9 + 3 * V.QUESTION_WEIGHT),
    ("Was it good ?????", 1.9 + V.QUESTION_MAXIMUM),
    ("Was it good ?", 1.9),
    ("It is not good", 1.9 * V.NEGATION_FACTOR),
    ("It isn't that good", 1.9 * V.NEGATION_FACTOR),
    ("It was never so good", (1.9 + V.BOOST) * 1.5 * 1.25),
    ("The least good thing", 1.9 * V.NEGATION_FACTOR),
    ("At least good things", 1.9),
    ("The plot was good, but the dialog is not great.", 1.9 * 0.5 + 3.1 * V.NEGATION_FACTOR * 1.5),
    ("It is very of good things", 1.9 + V.BOOST * 0.95),
    ("The very and of good things", 1.9 + V.BOOST * 0.9),
    ("kind of good movie", 1.9),
    ("kind of odd, be kind", 0.0),
    ("This is just kind of good", 1.9 - V.BOOST),
    ("He is kind to all", 2.4),
    ("That is a bad ass shirt", -2.5),
    ("This one is the bad ass", 1.5),
    ("no words of the kind", 2.4 - 1.2),
]


def test_rules(values):
    got = compound(values, [text for text, _ in RULES])
    for score, (text, total) in zip(got, RULES):
        assert score == normalized(total), text


def test_repeated_word_context(values):
    text = "not good and then a good thing"
    first, own = (values(lambda c: lexicon_sentiment(c, first_context=f), [text])[0]["compound"] for f in (True, False))
    assert first == normalized(2 * 1.9 * V.NEGATION_FACTOR)
    assert own == normalized(1.9 * V.NEGATION_FACTOR + 1.9)


def test_shares(values):
    good, blank, null, neutral = values(lexicon_sentiment, ["The book was good.", "  ", None, "plain words here"])
    assert (good["neg"], good["neu"], good["pos"]) == (0.0, 0.508, 0.492)
    assert tuple(blank) == tuple(null) == (0.0, 0.0, 0.0, 0.0)
    assert tuple(neutral) == (0.0, 1.0, 0.0, 0.0)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(
    ["good", "BAD", "not", "very", "but", "never", "so", "this", "least", "at", "kind", "of", "great!!", "x", "?",
     ":)", "no", "isn't", "the", "bomb", "Good,"]), max_size=12).map(" ".join), min_size=20, max_size=20))
def test_bounds_and_lexicon_table(spark, texts):
    """Scores stay in range, and a lexicon table gives what the mapping gives."""
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    table = spark.createDataFrame(list(V.DEFAULT_LEXICON.items()), "term string, valence double")
    direct = rows.select("id", "body", lexicon_sentiment("body").alias("direct"))
    for row in score_with_lexicon_table(direct, "body", table).collect():
        assert row["direct"] == row["sentiment"]
        score = row["direct"]
        assert -1.0 <= score["compound"] <= 1.0
        words = [w for w in row["body"].split() if len(w) > 1]
        assert score["neg"] + score["neu"] + score["pos"] == (pytest.approx(1.0, abs=2e-3) if words else 0.0)


def test_lexicon_table_however_large(spark):
    """Held by the tasks or joined: repeated rows, terms and null ids change nothing."""
    rows = spark.createDataFrame(
        [(1, "good " * 50), (2, "bad"), (2, "bad"), (None, "good"), (3, None), (4, "plain text")], "id int, body string")
    terms = [*V.DEFAULT_LEXICON.items(), *V.DEFAULT_LEXICON.items(), (None, 1.0), ("plain", None)]
    table = spark.createDataFrame(terms, "term string, valence double")
    for held in (10**6, 10):
        df = score_with_lexicon_table(rows, "body", table, held_terms=held)
        got = sorted(((r["id"], r["c"]) for r in df.select("id", F.col("sentiment.compound").alias("c")).collect()), key=str)
        assert [i for i, _ in got] == [1, 2, 2, 3, 4, None]
        assert got[0][1] > 0.99 and got[1][1] == got[2][1] == normalized(-2.5) and got[3][1] == got[4][1] == 0.0
        assert got[5][1] == normalized(1.9)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert ("Join" in plan) == (held == 10)


def test_mapping_of_any_size(values):
    mapping = {f"w{i}": 1.0 for i in range(60_000)}
    assert values(lambda c: lexicon_sentiment(c, mapping)["compound"], ["w59999 x"]) == [normalized(1.0)]


def test_long_text_is_scored_whole(values):
    """Many repeats and a last word that decides: nothing is cut, and time stays linear."""
    filler = "word " * 100_000 + "good bad " * 50_000
    plain, decided = values(lambda c: lexicon_sentiment(c)["compound"], [filler, filler + " perfect" * 20_000])
    assert plain == normalized(50_000 * (1.9 - 2.5)) and decided == normalized(50_000 * -0.6 + 20_000 * 2.7)


def test_marks_at_the_edges_of_words(values):
    marks = ["", ".", "!!", "?!?", "..", "(", "é", "#"]
    texts = [f"{a}word{b} {a}x{b} {a}{b}" for a in marks for b in marks]

    def cut(word):
        core = word.strip(V.PUNCTUATION)
        one_edge = word in [core + m for m in V.WORD_EDGES] + [m + core for m in V.WORD_EDGES]
        plain = len(core) > 1 and not set(core) & set(V.PUNCTUATION)
        return core if core != word and one_edge and plain else word

    assert values(sentiment_words, texts) == [[cut(w) for w in t.split() if len(w) > 1] for t in texts]
