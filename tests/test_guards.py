"""Guards of prose, each on its own cases."""

import pytest
from pyspark.sql import functions as F

from statloom.functions import guards


def said(spark, make, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("t"))).collect()]


@pytest.mark.parametrize(
    "text,broken",
    [("A short hook", None), (" ".join(["w"] * 12), None), (" ".join(["w"] * 13), "hook_max_words"), ("Now: this", "hook_colon"), ("Really?", "hook_question_mark"), (" ".join(["a:?"] * 13), "hook_max_words"), ("a: b?", "hook_colon"), ("", None), (None, None)],
)
def test_hooks(spark, text, broken):
    assert said(spark, guards.hook_violation, text) == [broken]


def test_phrases(spark):
    found = said(spark, lambda c: guards.first_phrase(c, guards.MOMENTUM), "It ISN’T a surge.", "the engine room of midfield", "A stéady band", None, "the numbers say, the tape calls this")
    assert found == ["isn't a surge", None, "steady band", None, "the tape calls this"]
    assert said(spark, lambda c: guards.first_phrase(c, guards.READING), "Sentiment (30/100)", "**bold**", "clean") == ["sentiment", "**", None]
    assert said(spark, lambda c: guards.first_exact(c, ("CARD", "Mood")), "a card", "a CARD", "the Mood CARD", None) == [None, "CARD", "CARD", None]


def test_peers_and_digits(spark):
    assert said(spark, guards.named_peers, "The Analyst and the analyst's friend the Scout", "scout said", None) == [2, 0, 0]
    assert said(spark, guards.has_digit, "no", "30", "٣", None) == [False, True, False, False]
