"""Answer dialects, restated as small tables."""

import re

import pytest
from pyspark.sql import functions as F

from evalloom.functions import directives, extract
from evalloom.operators import evaluate as ev
from evalloom.plans import answer_queries

CASES = [
    ("integer", "It holds {12} of 30", "12"),
    ("integer", "{$7$}", "7"),
    ("integer", "first 3, then 5", "5"),
    ("integer", "about 3.5", "5"),
    ("integer", "1,256 in all", "256"),
    ("integer", "x9y", None),
    ("integer", "réponse4é 8", "8"),
    ("yes_no", "YES!", "Yes"),
    ("yes_no", "No, yes it does", "Yes"),
    ("yes_no", "nothing", "No"),
    ("yes_no", "one two three (yes)", "Yes"),
    ("yes_no", "perhaps", None),
    ("yes_no", "\n\t yes", "Yes"),
    ("letter", "{q}", "Q"),
    ("letter", "it is b, so the answer is c", "C"),
    ("letter", "this a", "A"),
    ("letter", "I think K.", "K"),
    ("letter", "I", "I"),
    ("letter", "12", None),
    ("row_col", "Rows: {4}  cols = 9", "4,9"),
    ("row_col", "7 × 3 then 2x2", "7,3"),
    ("row_col", "rows=4", None),
    ("mc4", "{$b$}", "B"),
    ("mc4", "maybe (c)", "C"),
    ("mc4", "answer: d", "D"),
    ("mc4", "**a**", "A"),
    ("mc4", "I pick \"B\".", "B"),
    ("mc4", "none", None),
    ("exact_string", " \n ", None),
    ("exact_string", "so {$ab$}", "ab"),
    ("exact_string", "{$5}", "$5"),
    ("exact_string", "it says “hello there” ok", "hello there"),
    ("exact_string", "The answer is: Foo Bar.", "Foo Bar"),
    ("exact_string", "It reads Z..", "Z"),
    ("exact_string", "one two three", "one two three"),
    ("exact_string", "one two three four five six.\nmore", "one two three four five six"),
    ("csv_words", "{}", ""),
    ("csv_words", "{ None }", ""),
    ("csv_words", "{pear, Apple, fig}", "Apple,fig,pear"),
    ("csv_words", "{b, B, a}", "a,b,B"),
    ("csv_words", "Items: Fig, Apple", "Apple,Fig"),
    ("csv_words", "{,}", None),
    ("csv_letters", "{b, A,b}", "A,B"),
    ("csv_letters", "take c, a", "A,C"),
    ("csv_letters", "I see (d) and E.", "D,E"),
    ("csv_letters", "I", None),
    ("csv_cell_labels", "{b2, A10, a2}", "A10,A2,B2"),
    ("csv_cell_labels", "{none} but C3", "C3"),
    ("csv_cell_labels", "none", None),
    ("unheard_of", "{3}", None),
    ("integer", None, None),
]


def test_dialects(spark):
    rows = [(i, p, r) for i, (p, r, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, parser string, raw_response string")
    got = {r["i"]: r["parsed_answer"] for r in ev.extract_answers(df).collect()}
    wrong = [(CASES[i], got[i]) for i in got if got[i] != CASES[i][2]]
    assert not wrong


ODD = [
    ("yes_no", "\x1c yes\x1f", "Yes"),
    ("yes_no", "I say YES\x1c", "Yes"),
    ("yes_no", "I say no\x1cx or yes", "Yes"),
    ("yes_no", "I say ye\u017f, no", "No"),
    ("yes_no", "a b c yes", "Yes"),
    ("yes_no", "a b no c yes", "No"),
    ("exact_string", "\x1c\u3000", None),
    ("exact_string", "{ $ $ }", ""),
    ("exact_string", "{$$}", "$$"),
    ("exact_string", "{$ a\nb $}", "a\nb"),
    ("exact_string", "\xa0the  answer is", ""),
    ("exact_string", "a b c d e \x1c", "a b c d e"),
    ("exact_string", "a b c\nd e \x1c f", "a b c"),
    ("exact_string", "...", ""),
    ("csv_words", "{ \n\x1c}", ""),
    ("csv_words", "{No Items} {a}", ""),
    ("csv_words", "{no item\u017f}", "no item\u017f"),
    ("csv_words", "{,\n, a }", "a"),
    ("csv_words", "{, ,}: Fig, Apple", "Apple,Fig"),
    ("csv_words", "{none: Fig, Apple", "Apple,Fig"),
    ("csv_letters", "{b\xa0,\nA}", "A,B"),
    ("csv_letters", "so b , a , then", "A,B"),
]


def test_odd_spaces_and_letters(spark):
    rows = [(i, p, r) for i, (p, r, _) in enumerate(ODD)]
    df = spark.createDataFrame(rows, "i int, parser string, raw_response string")
    got = {r["i"]: r["parsed_answer"] for r in ev.extract_answers(df).collect()}
    assert not [(ODD[i], got[i]) for i in got if got[i] != ODD[i][2]]


def test_patterns_are_matched_once_a_row(spark, capsys):
    """In the arms of a CASE every mention of a pattern is one more search of the text."""
    df = spark.createDataFrame([("integer", "{2}")], "parser string, raw_response string")
    ev.extract_answers(df).explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    once = [
        extract.BRACED_INT, extract.BRACED_LETTER, extract.ANY_LETTER, extract.ROWS_VALUE, extract.CHOICE_BRACED,
        extract.CHOICE_BOLD, extract.QUOTED_TEXT, extract.BRACED_ANY, extract.CAPITAL_LIST, extract.LETTER_SET,
        extract.LETTER_LIST, extract.LONE_LETTER_WORD, extract.BARE_CELL_LABEL,
    ]
    assert {p: plan.count(f", {p}, ") for p in once} == dict.fromkeys(once, 1)


def test_texts_of_all_parsers_are_compiled(spark, sf_dir, capsys):
    """The JVM does not compile methods of more than 8,000 bytes."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else no code is made before the run
    try:
        answer_queries.jn10(spark, sf_dir).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000


def test_last_size(spark):
    df = spark.createDataFrame(
        [("rows=11 - 1 so rows=10 columns=3 columns=4",), ("2x2 then 3 x 5",), ("none",)], "r string"
    )
    got = [r[0] for r in df.select(extract.final_row_col(F.col("r"))).collect()]
    assert got == ["10,4", "3,5", None]


def test_registered_parser_is_used(spark):
    registry = dict(extract.PARSERS)
    registry["shout"] = lambda response: F.upper(response)
    df = spark.createDataFrame([("shout", "a"), ("integer", "{2}")], "parser string, raw_response string")
    got = [r["parsed_answer"] for r in ev.extract_answers(df, registry).collect()]
    assert got == ["A", "2"]


@pytest.mark.parametrize(
    "reply, action, value, args",
    [
        ('TOOL(crop_and_enhance, "center")', "tool", "crop_and_enhance", {"region": "center"}),
        ("TOOL(count_line_transitions, axis=horizontal, n=2)", "tool", "count_line_transitions",
         {"axis": "horizontal", "n": "2"}),
        ("TOOL(other, x)", "tool", "other", {"arg": "x"}),
        ("TOOL(t, a=1, a=2)", "tool", "t", {"a": "2"}),
        ("TOOL(detect_boxes)", "tool", "detect_boxes", {}),
        ("so ANSWER: 5\nrows ", "answer", "5\nrows", None),
        ("  plain ", "unknown", "plain", None),
    ],
)
def test_directives(spark, reply, action, value, args):
    df = spark.createDataFrame([(reply,)], "r string")
    d = df.select(directives.directive(F.col("r")).alias("d")).first()["d"]
    assert (d["action"], d["value"], d["args"]) == (action, value, args)


def test_code_block(spark):
    df = spark.createDataFrame([("x\n```python\nprint(1)\n```\n```\ny\n```",), (" y = 2 ",)], "r string")
    got = [r[0] for r in df.select(directives.code_text(F.col("r"))).collect()]
    assert got == ["print(1)", "y = 2"]


def test_questions_are_split(spark):
    df = spark.createDataFrame(
        [("a", "x", "How many rows are shown and how many columns are shown?"),
         ("b", "x", "Is it A and B"), ("c", "counting_grid", "anything")],
        "sample_id string, task_name string, prompt string",
    )
    got = sorted((r["sample_id"], r["number"], r["question"]) for r in directives.explode_questions(df).collect())
    assert got[:3] == [
        ("a", 1, "How many rows are shown?"), ("a", 2, "how many columns are shown?"),
        ("b", 1, "Is it A and B"),
    ]
    assert len(got) == 5
