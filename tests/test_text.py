"""Scalar text functions."""

import pytest
from pyspark.sql import functions as F

from inkloom.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("One is here. Two is there! Is three? Yes.", ["One is here.", "Two is there!", "Is three?", "Yes."]),
        ("Dr. Low met Mrs. High, e.g. at noon. They left.", ["Dr. Low met Mrs. High, e.g. at noon.", "They left."]),
        ("It cost 3.50 in all. then it rose", ["It cost 3.50 in all. then it rose"]),
        ('He said "stop." Then he left.', ['He said "stop."', "Then he left."]),
        ("Wait... and see?! now", ["Wait...", "and see?!", "now"]),
        ("J. Smith came. No. 5 won", ["J. Smith came.", "No. 5 won"]),
        ("  \n ", []),
        ("", []),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, text, T.sentences) == want


def test_words_are_ascii(spark):
    assert one(spark, "été don't well-known 3rd", T.words) == ["t", "don't", "well-known", "3rd"]


@pytest.mark.parametrize(("word", "n"), [("cat", 1), ("table", 2), ("wanted", 1), ("yellow", 2), ("", 0), ("banana", 3)])
def test_syllables(spark, word, n):
    assert one(spark, word, T.syllables) == n


def test_grade_needs_enough_text(spark):
    g = lambda s, w, y: spark.range(1).select(T.grade(F.lit(s), F.lit(w), F.lit(y))).first()[0]
    assert g(2, 100, 150) is None and g(3, 29, 40) is None
    assert g(4, 40, 60) == pytest.approx(0.39 * 10 + 11.8 * 1.5 - 15.59)


def test_strip_inline(spark):
    assert one(spark, "A [link](http://x) and `code`, **bold** _it_ <b>t</b> ![p](q)  end", T.strip_inline) == "A link and code, bold it t p end"


def test_tokens_and_snippet(spark):
    assert one(spark, "x" * 8, T.estimate_tokens) == 3
    long = "word " * 40
    s = one(spark, long, T.snippet)
    assert len(s) <= 90 and s.endswith("…")
    assert one(spark, long, lambda c: T.snippet(c, F.lit(50))).startswith("…")


def test_matches_give_places(spark):
    got = one(spark, "ab a\nab", lambda c: T.matches(c, "ab?"))
    assert [(r["hit"], r["at"]) for r in got] == [("ab", 0), ("a", 3), ("ab", 5)]
    r = spark.createDataFrame([("ab a\nab",)], "t string").select(*T.place(F.col("t"), F.lit(5), F.lit(7))).first()
    assert tuple(r) == (8, 1)


def test_phrase_pattern(spark):
    p = T.phrase_pattern(["don't", "side room"])
    assert one(spark, "I don’t like the Side\nroom, not a side rooms or mid-side room", lambda c: F.regexp_extract_all(c, F.lit(p), F.lit(0))) == ["don’t", "Side\nroom"]


def test_null_text(spark):
    assert one(spark, None, T.sentences) is None and one(spark, None, T.snippet) is None
