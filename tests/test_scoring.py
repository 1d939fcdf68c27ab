"""Scorers, error labels, intervals and classes."""

import math

import pytest
from pyspark.sql import functions as F

from evalloom.functions import scoring
from evalloom.functions.text import format_general
from evalloom.operators import evaluate as ev

CASES = [
    ("exact_match", " Foo ", "foo", dict(correct=True, score=1.0)),
    ("exact_match", None, "foo", dict(correct=False, score=0.0)),
    ("set_member", "b", "A, B,", dict(correct=True, score=1.0)),
    ("set_member", "", "A,,B", dict(correct=False, score=0.0)),
    ("integer_distance", "7", "5", dict(correct=False, score=1 / 3, error=2, abs_error=2)),
    ("integer_distance", " +5", "5", dict(correct=True, score=1.0, error=0, abs_error=0)),
    ("integer_distance", "7.0", "7", dict(correct=False, score=0.0, error=None, abs_error=None)),
    ("integer_distance", None, "7", dict(correct=False, score=0.0, error=None)),
    ("row_col", "3,4", "3, 5", dict(correct=False, score=0.5, row_correct=True, col_correct=False)),
    ("row_col", "3,4,5", "3,4", dict(correct=False, score=0.0, row_correct=False)),
    ("row_col", "a,4", "3,4", dict(correct=False, score=0.0, col_correct=False)),
    ("set_match", "a, B,b", "b,A", dict(correct=True, score=1.0, precision=1.0, recall=1.0)),
    ("set_match", "a", "a,b", dict(correct=False, score=2 / 3, precision=1.0, recall=0.5)),
    ("set_match", "", "", dict(correct=True, score=1.0, precision=1.0, recall=1.0)),
    ("set_match", "a", "", dict(correct=False, score=0.0, precision=0.0, recall=1.0)),
    ("set_match", "", "None", dict(correct=False, score=0.0, precision=0.0, recall=0.0)),
    ("set_match", None, "a", dict(correct=False, score=0.0, precision=0.0, recall=0.0)),
    ("unheard_of", "a", "a", dict(correct=False, score=0.0)),
]


def test_scorers(spark):
    rows = [(i, s, a, t) for i, (s, a, t, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, scorer string, parsed_answer string, ground_truth string")
    for row in ev.score_answers(df).collect():
        for name, value in CASES[row["i"]][3].items():
            if isinstance(value, float):
                assert row[name] == pytest.approx(value), (CASES[row["i"]], name)
            else:
                assert row[name] == value, (CASES[row["i"]], name)


def test_none_can_mean_empty(spark):
    df = spark.createDataFrame([("set_match", "", "None")], "scorer string, parsed_answer string, ground_truth string")
    registry = {"set_match": scoring.set_match_scorer(treat_none_as_empty=True)}
    assert ev.score_answers(df, registry).first()["correct"] is True


def test_rows_that_cannot_be_judged(spark):
    df = spark.createDataFrame(
        [("integer", "exact_match", None, "3"), ("integer", "exact_match", "{3}", None), ("integer", "exact_match", "{3}", "3")],
        "parser string, scorer string, raw_response string, ground_truth string",
    )
    got = [(r["error_message"], r["parsed_answer"], r["correct"]) for r in ev.evaluate(df).collect()]
    assert got == [("missing response", None, False), ("missing ground truth", None, False), (None, "3", True)]


ERRORS = [
    ("counting_grid", "exact_match", "5,8", "3,9", "rows over by 2; cols under by 1"),
    ("x", "exact_match", "1,2,3", "1,1,1", "d1 over by 1; d2 over by 2"),
    ("x", "exact_match", None, "3", "Parse failure"),
    ("x", "exact_match", "None", "3", "Parse failure"),
    ("x", "exact_match", "7", "5", "Overcount (+2)"),
    ("x", "exact_match", "1,200", "1500", "Undercount (-300)"),
    ("x", "exact_match", "2.5", "3", "Undercount (-0.5)"),
    ("x", "exact_match", "3000000", "0", "Overcount (+3e+06)"),
    ("dense_text", "exact_match", "zzzz", "abcd", "Hallucination"),
    ("dense_text", "exact_match", "abzz", "abcd", "Major char errors"),
    ("dense_text", "exact_match", "abcdefghi!", "abcdefghij", "Minor char error"),
    ("venn", "set_match", "A, C", "a,b", "extra: c; missing: b"),
    ("x", "exact_match", "foo", "b" * 30, "Wrong (GT=" + "b" * 25 + "..., got=foo)"),
    ("x", "exact_match", "Foo", "foo", "Unknown"),
]


def test_error_labels(spark):
    df = spark.createDataFrame([(i, *e[:4]) for i, e in enumerate(ERRORS)], "i int, t string, s string, a string, g string")
    label = scoring.error_type(F.col("t"), F.col("s"), F.col("a"), F.col("g"))
    got = {r["i"]: r["e"] for r in df.select("i", label.alias("e")).collect()}
    assert [(ERRORS[i], got[i]) for i in got if got[i] != ERRORS[i][4]] == []


@pytest.mark.parametrize("value", [0.0, 2.0, -0.5, 1234.5678, 0.00012345678, 0.00001234, 999999.6, 1e6, 1234567.0, -2.5e-7])
def test_general_format(spark, value):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(format_general(F.col("v"))).first()[0] == f"{value:g}"


@pytest.mark.parametrize("k, n", [(0, 0), (0, 5), (5, 5), (3, 10), (93, 176)])
def test_interval(spark, k, n):
    df = spark.createDataFrame([(k, n)], "k long, n long")
    low, high = scoring.wilson_interval(F.col("k"), F.col("n"))
    got = df.select(low, high).first()
    if n == 0:
        assert tuple(got) == (0.0, 0.0)
        return
    z, p = 1.96, k / n
    scale = 1 + z * z / n
    half = z / scale * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    centre = (p + z * z / (2 * n)) / scale
    assert got[0] == pytest.approx(max(0, centre - half)) and got[1] == pytest.approx(min(1, centre + half))
    assert 0 <= got[0] <= got[1] <= 1


@pytest.mark.parametrize(
    "image, text, kind",
    [(None, 0.9, "insufficient_data"), (0.9, 0.1, "not_a_failure"), (0.5, 0.9, "perceptual"),
     (0.3, 0.35, "reasoning"), (0.3, 0.6, "mixed"), (0.78, 0.85, "reasoning")],
)
def test_failure_class(spark, image, text, kind):
    df = spark.createDataFrame([(image, text)], "i double, t double")
    assert df.select(scoring.failure_class(F.col("i"), F.col("t"))).first()[0] == kind
