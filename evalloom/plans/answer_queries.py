"""Queries over response texts: extraction, scoring, dispatch and directives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom import dims
from evalloom.functions import directives, extract, prompts, scoring
from evalloom.functions import text as tx
from evalloom.operators import evaluate as ev
from evalloom.operators import failures as fl
from evalloom.plans import fixtures as fx
from evalloom.plans.catalog import query
from evalloom.plans.fixtures import NL, choose, text

# Texts per parser, put together from order rows. ``n`` is the order key.
_N, _A, _B = "o_orderkey", "chr(CAST(65 + o_orderkey % 26 AS INT))", "chr(CAST(97 + o_custkey % 26 AS INT))"
_D = "chr(CAST(65 + o_custkey % 4 AS INT))"
_ROWS, _COLS = text("3 + o_custkey % 23"), text("3 + o_orderkey % 23")


def _mixed(*arms: str) -> str:
    body = " ".join(f"WHEN {i} THEN {arm}" for i, arm in enumerate(arms))
    return f"CASE o_orderkey % {len(arms)} {body} END"


TEXTS = {
    "integer": _mixed(
        f"'The answer is {{' || {_ROWS} || '}} of 99'", f"'I see ' || {_ROWS} || ' here and ' || {_COLS}",
        f"'{{$' || {_COLS} || '$}}'", "'none at all'", f"'about 3.' || {_ROWS}", f"'x' || {_ROWS} || 'y'",
    ).replace("{{", "{").replace("}}", "}"),
    "yes_no": _mixed(
        "'Yes.'", "' No, they do not'", "'I think yes it is'", "'Well I no longer know'",
        "'the circles are touching each other: yes'", "'nothing like that'",
        "'I cannot say whether they are. (no)'", "'unclear'", "'No, yes it is'",
    ),
    "letter": _mixed(
        f"'{{' || {_B} || '}}'", f"'The answer is ' || {_B} || ' or so'", f"'go to box ' || {_A}",
        f"'I think ' || {_A} || '.'", "'A'", f"'reach ' || {_B} || ' then reach ' || {_A}", "'123'",
        f"'maybe ' || {_A} || ' here, I guess'", f"'this ' || {_B}",
    ).replace("{{", "{").replace("}}", "}"),
    "row_col": _mixed(
        f"'rows=' || {_ROWS} || ' columns=' || {_COLS}", f"'Rows: {{' || {_ROWS} || '}} Col: ' || {_COLS} || ' rows=1'",
        f"'it is ' || {_ROWS} || ' x ' || {_COLS} || ' and 2x2'", f"'(' || {_ROWS} || ', ' || {_COLS} || ')'",
        "'no size'", f"'row=' || {_ROWS}",
    ).replace("{{", "{").replace("}}", "}"),
    "mc4": _mixed(
        f"'{{' || {_D} || '}}'", f"'(' || {_D} || ') is best'", f"'The answer: ' || lower({_D}) || ' I guess'",
        f"'so **' || {_D} || '**'", f"'I pick \"' || {_D} || '\".'", "'none of them'", f"'{{$' || {_D} || '$}} or (A)'",
    ).replace("{{", "{").replace("}}", "}"),
    "exact_string": _mixed(
        f"'so { ' || {_A} || {_B} || ' }'", f"'{{$' || {_B} || ' 5$}}'", f"'it reads \"' || {_A} || 'x\" there'",
        f"'The answer is: ' || {_A} || {_B} || '.'", f"'It says ' || {_B}", f"{_A} || ' and ' || {_B} || '.'",
        f"'One two three four five ' || {_A} || '.' || {NL} || 'second line'", "'  '", "'{$5}'",
    ).replace("{{", "{").replace("}}", "}"),
    "csv_words": _mixed(
        "'{pear, Apple,fig }'", f"'{{' || {_A} || ', ' || {_B} || ',' || {_A} || '}}'", "'{}'", "'{None}'",
        f"'They are: Lemon, Apple, Fig'", "'just words'", "'{,}'", "'Fig, Apple and more'",
    ).replace("{{", "{").replace("}}", "}"),
    "csv_letters": _mixed(
        f"'{{' || {_A} || ', ' || {_B} || '}}'", f"'options ' || {_A} || ', ' || {_B} || ',c'", f"'I see (' || {_A} || ') and ' || {_B} || '.'",
        "'I do'", f"'{{' || {_B} || '}}'",
    ).replace("{{", "{").replace("}}", "}"),
    "csv_cell_labels": _mixed(
        "'{B2, a1,A10}'", f"'cells ' || {_A} || '1, ' || {_B} || '22'", "'{none} or C3'", "'no cells'", f"'{{' || {_A} || '7 and ' || {_A} || '7}}'",
    ).replace("{{", "{").replace("}}", "}"),
}


def texts(spark, sf_dir, parser):
    return fx.table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS sample_id", f"{TEXTS[parser]} AS raw_response", f"'{parser}' AS parser"
    )


def texts_sql(parser: str) -> str:
    return f"texts AS (SELECT CAST(o_orderkey AS STRING) AS sample_id, {TEXTS[parser]} AS x FROM orders)"


def _first(pattern: str, group: int = 1, column: str = "x") -> str:
    return f"nullif(regexp_extract({column}, '{pattern}', {group}), '')"


def _last(pattern: str, group: int = 1, column: str = "x") -> str:
    return f"regexp_extract_all({column}, '{pattern}', {group})[-1]"


_TOKENS = "string_split_regex(trim(x), '\\s+')"
_ROW, _COL = r"(?i)rows?\s*[=:]\s*\{?(\d+)\}?", r"(?i)col(?:umn)?s?\s*[=:]\s*\{?(\d+)\}?"
_PAIR = r"(\d+)\s*[x×,]\s*(\d+)"
_INNER = "trim(regexp_extract(x, '\\{([^}]*)\\}', 1))"
_ITEMS = "[w for w in [trim(v) for v in string_split({0}, ',')] if w <> '']"


def _sorted_words(column: str) -> str:
    items = _ITEMS.format(column)
    keyed = f"list_transform({items}, lambda w, i: {{'k': lower(w), 'i': i, 'v': w}})"
    return f"array_to_string([s.v for s in list_sort({keyed})], ',')"


def _labels(found: str) -> str:
    return f"nullif(array_to_string(list_sort(list_distinct([upper(w) for w in {found}])), ','), '')"


_LISTED = r"(?m)(?:^|:)\s*([A-Z][a-z]+(?:\s*,\s*[A-Z][a-z]+)+)"
_STRIPPED = "trim(w, '.,;:!?()[]{}\"''*')"

PARSE_SQL = {
    "integer": fx.parse_integer_sql("x"),
    "yes_no": f"""(CASE WHEN starts_with(lower(trim(x)), 'yes') OR list_contains(string_split_regex(lower(trim(x)), '\\s+')[1:3], 'yes') THEN 'Yes'
        WHEN starts_with(lower(trim(x)), 'no') OR list_contains(string_split_regex(lower(trim(x)), '\\s+')[1:3], 'no') THEN 'No'
        WHEN regexp_matches(lower(x), '\\byes\\b') THEN 'Yes' WHEN regexp_matches(lower(x), '\\bno\\b') THEN 'No' END)""",
    "letter": f"""upper(coalesce({_first('\\{([A-Za-z])\\}')}, {_last('(?i)(?:answer\\s+is|is|box|reach)\\s+([A-Za-z])\\b')},
        rtrim([w for w in {_TOKENS} if regexp_full_match(w, '[A-Za-z]\\.?') AND upper(rtrim(w, '.')) NOT IN ('I', 'A')][-1], '.'),
        {_first('\\b([A-Za-z])\\b')}))""",
    "row_col": f"coalesce({_first(_ROW)} || ',' || {_first(_COL)}, {_first(_PAIR)} || ',' || {_first(_PAIR, 2)})",
    "mc4": f"""upper(coalesce({_first('\\{\\$?([A-Da-d])\\$?\\}')}, {_first('\\(([A-Da-d])\\)')},
        {_first('(?i)(?:answer\\s*(?:is|:)\\s*)([A-Da-d])\\b')}, {_first('\\*\\*([A-Da-d])\\*\\*')},
        [{_STRIPPED} for w in {_TOKENS} if regexp_full_match({_STRIPPED}, '[A-Da-d]')][-1]))""",
    "exact_string": f"""(CASE WHEN trim(x) = '' THEN NULL
        WHEN regexp_matches(x, '\\{{([^}}]+)\\}}') THEN (CASE WHEN regexp_matches(trim(regexp_extract(x, '\\{{([^}}]+)\\}}', 1)), '^\\$.+\\$$')
          THEN trim(trim(regexp_extract(x, '\\{{([^}}]+)\\}}', 1))[2:-2]) ELSE trim(regexp_extract(x, '\\{{([^}}]+)\\}}', 1)) END)
        WHEN regexp_matches(x, '["“]([^"”]+)["”]') THEN trim(regexp_extract(x, '["“]([^"”]+)["”]', 1))
        WHEN regexp_matches(trim(x), '(?i)^(?:the\\s+)?(?:answer|value|text|number|word)\\s+is\\s*:?\\s*')
          THEN rtrim(trim(regexp_replace(trim(x), '(?i)^(?:the\\s+)?(?:answer|value|text|number|word)\\s+is\\s*:?\\s*', '')), '.')
        WHEN regexp_matches(trim(x), '(?i)^(?:it\\s+(?:says?|reads?)\\s*:?\\s*)') THEN rtrim(trim(regexp_replace(trim(x), '(?i)^(?:it\\s+(?:says?|reads?)\\s*:?\\s*)', '')), '.')
        WHEN len({_TOKENS}) <= 5 THEN rtrim(trim(x), '.') ELSE rtrim(trim(string_split(trim(x), chr(10))[1]), '.') END)""",
    "csv_words": f"""(CASE WHEN regexp_matches(x, '\\{{([^}}]*)\\}}') AND ({_INNER} = '' OR lower({_INNER}) IN ('none', 'n/a', 'empty', 'no items')) THEN ''
        WHEN regexp_matches(x, '\\{{([^}}]*)\\}}') AND len({_ITEMS.format(_INNER)}) > 0 THEN {_sorted_words(_INNER)}
        WHEN {_first(_LISTED)} IS NOT NULL THEN {_sorted_words(_first(_LISTED))} END)""",
    "csv_letters": f"""coalesce({_labels("regexp_extract_all(" + _first('\\{([A-Za-z](?:\\s*,\\s*[A-Za-z])*)\\}') + ", '[A-Za-z]')")},
        {_labels("regexp_extract_all(" + _first('\\b([A-Za-z]\\s*(?:,\\s*[A-Za-z]\\s*)+)\\b') + ", '[A-Za-z]')")},
        {_labels("[v for v in [trim(w, '.,;:!?()[]') for w in " + _TOKENS + "] if regexp_full_match(v, '[A-Za-z]') AND upper(v) NOT IN ('I', 'A')]")})""",
    "csv_cell_labels": f"""coalesce({_labels("regexp_extract_all(" + _first('\\{([^}]+)\\}') + ", '[A-Za-z]\\d+')")},
        {_labels("regexp_extract_all(x, '\\b([A-Za-z]\\d+)\\b', 1)")})""",
}


def _parse_query(key: str, parser: str) -> None:
    def run(spark, sf_dir):
        parsed = ev.extract_answers(texts(spark, sf_dir, parser))
        return parsed.select("sample_id", "parsed_answer")

    query(key, f"WITH {texts_sql(parser)} SELECT sample_id, {PARSE_SQL[parser]} AS parsed_answer FROM texts")(run)


for _i, _parser in enumerate(
    ["integer", "yes_no", "letter", "row_col", "mc4", "exact_string", "csv_words", "csv_letters", "csv_cell_labels"]
):
    _parse_query(f"par{_i + 1}", _parser)


@query("par10", f"""WITH {texts_sql('row_col')} SELECT sample_id, coalesce({_last(_ROW)} || ',' || {_last(_COL)},
   {_last(_PAIR)} || ',' || {_last(_PAIR, 2)}) AS parsed_answer FROM texts""")
def par10(spark, sf_dir):
    return texts(spark, sf_dir, "row_col").select(
        "sample_id", extract.final_row_col(F.col("raw_response")).alias("parsed_answer")
    )


_ALL_SQL = "WITH " + ", ".join(
    f"t_{p} AS (SELECT '{p}' AS parser, CAST(o_orderkey AS STRING) AS sample_id, {TEXTS[p]} AS x FROM orders)" for p in TEXTS
) + ", parsed AS (" + " UNION ALL ".join(
    f"SELECT sample_id, parser, {PARSE_SQL[p]} AS parsed_answer FROM t_{p}" for p in TEXTS
) + " UNION ALL SELECT sample_id, 'nobody_knows', NULL FROM t_integer)"


def mixed_answers(spark, sf_dir):
    """All parsers in one table, and one name that is not registered."""
    # a table per parser, as in the SQL: one CASE of all texts is a method too long for the JVM to compile
    known = [texts(spark, sf_dir, parser) for parser in TEXTS]
    unknown = texts(spark, sf_dir, "integer").withColumn("parser", F.lit("nobody_knows"))
    return reduce(DataFrame.unionByName, [*known, unknown])


@query("jn10", _ALL_SQL + " SELECT parser, count(*) AS n, count(parsed_answer) AS n_parsed, count(DISTINCT parsed_answer) AS answers FROM parsed GROUP BY parser")
def jn10(spark, sf_dir):
    return ev.extract_answers(mixed_answers(spark, sf_dir)).groupBy("parser").agg(
        F.count("*").alias("n"), F.count("parsed_answer").alias("n_parsed"),
        F.count_distinct("parsed_answer").alias("answers"),
    )


@query("udf1", f"WITH {texts_sql('integer')} SELECT sample_id, length(trim(x))::VARCHAR AS parsed_answer FROM texts")
def udf1(spark, sf_dir):
    """A parser of the user's own in a registry of their own."""
    registry = {"integer": lambda response: F.length(tx.strip(response)).cast("string")}
    return ev.extract_answers(texts(spark, sf_dir, "integer"), registry).select("sample_id", "parsed_answer")


# ---------------------------------------------------------------- scoring

_L = [f"chr(CAST(65 + (o_orderkey * {m} + {a}) % 7 AS INT))" for m, a in ((1, 0), (3, 1), (5, 2))]
PAIRS = {
    "exact_match": (_mixed(f"' ' || {_A}", _B, "'x y '", "''"), _mixed(f"lower({_A})", f"upper({_B})", "'X Y'", "'None'", _A)),
    "set_member": (_mixed(_L[0], f"' ' || lower({_L[1]})", "''"), f"{_L[0]} || ', ' || lower({_L[2]}) || ',,B'"),
    "integer_distance": (_mixed(_ROWS, f"' ' || {_COLS}", "'x'", "'+5'", "'7.0'", "''"), _mixed(_COLS, _ROWS, "'4'", "'5'", "'bad'")),
    "row_col": (
        _mixed(f"{_ROWS} || ',' || {_COLS}", f"{_ROWS} || ', ' || {_ROWS}", "'1,2,3'", "'7'", "'a,4'", f"{_COLS} || ',' || {_COLS}"),
        _mixed(f"{_ROWS} || ',' || {_COLS}", f"{_ROWS} || ',' || {_COLS}", f"{_COLS} || ',' || {_COLS}"),
    ),
    "set_match": (
        _mixed(f"{_L[0]} || ',' || lower({_L[1]})", f"{_L[0]}", "''", f"{_L[2]} || ', ,' || {_L[1]} || ',' || {_L[2]}", "'None'"),
        _mixed(f"{_L[0]} || ', ' || {_L[1]}", f"{_L[0]} || ', ' || {_L[2]} || ',' || {_L[1]}", "''", "'None'"),
    ),
}


def pairs(spark, sf_dir, scorer):
    """Answer and truth pairs; every thirteenth answer is missing."""
    answer, truth = PAIRS[scorer]
    return fx.table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS sample_id",
        f"CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE {answer} END AS parsed_answer",
        f"{truth} AS ground_truth", f"'{scorer}' AS scorer",
    )


def pairs_sql(scorer: str) -> str:
    answer, truth = PAIRS[scorer]
    return f"""pairs AS (SELECT CAST(o_orderkey AS STRING) AS sample_id,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE {answer} END AS a, {truth} AS g FROM orders)"""


def _whole(column: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({column}), '[+-]?\\d+') THEN CAST(trim({column}) AS BIGINT) END"


_SET = "list_distinct([upper(w) for w in [trim(v) for v in string_split({0}, ',')] if w <> ''])"
_GOT, _WANT = _SET.format("a"), _SET.format("g")
_HIT = f"len(list_intersect({_GOT}, {_WANT}))"
_P = f"CASE WHEN a IS NULL THEN 0 WHEN len({_WANT}) = 0 THEN (len({_GOT}) = 0)::INT WHEN len({_GOT}) = 0 THEN 0 ELSE {_HIT}::DOUBLE / len({_GOT}) END"
_RC = f"CASE WHEN a IS NULL THEN 0 WHEN len({_WANT}) = 0 THEN 1 WHEN len({_GOT}) = 0 THEN 0 ELSE {_HIT}::DOUBLE / len({_WANT}) END"
_PARTS = "string_split({0}, ',')"


def _part(column: str, i: int) -> str:
    return "(" + _whole(f"string_split({column}, ',')[{i}]") + ")"


_ROWOK = (f"coalesce(len(string_split(a, ',')) = 2 AND len(string_split(g, ',')) = 2 AND {_part('a', 1)} IS NOT NULL AND {_part('a', 2)} IS NOT NULL "
          f"AND {_part('g', 1)} IS NOT NULL AND {_part('g', 2)} IS NOT NULL AND {{0}}, false)")
_RK, _CK = _ROWOK.format(f"{_part('a', 1)} = {_part('g', 1)}"), _ROWOK.format(f"{_part('a', 2)} = {_part('g', 2)}")

SCORE_SQL = {
    "exact_match": ("coalesce(lower(trim(a)) = lower(trim(g)), false) AS correct",
                    "coalesce((lower(trim(a)) = lower(trim(g)))::INT, 0)::DOUBLE AS score"),
    "set_member": (f"coalesce(list_contains({_WANT}, upper(trim(a))), false) AS correct",
                   f"coalesce(list_contains({_WANT}, upper(trim(a)))::INT, 0)::DOUBLE AS score"),
    "integer_distance": (f"coalesce({_whole('a')} = {_whole('g')}, false) AS correct",
                         f"coalesce(1.0::DOUBLE / (1 + abs(({_whole('a')}) - ({_whole('g')}))), 0) AS score",
                         f"({_whole('a')}) - ({_whole('g')}) AS error", f"abs(({_whole('a')}) - ({_whole('g')})) AS abs_error"),
    "row_col": (f"{_RK} AND {_CK} AS correct", f"({_RK}::INT + {_CK}::INT) / 2.0::DOUBLE AS score", f"{_RK} AS row_correct", f"{_CK} AS col_correct"),
    "set_match": (f"coalesce(len({_GOT}) = {_HIT} AND len({_WANT}) = {_HIT}, false) AS correct",
                  f"""CASE WHEN a IS NULL THEN 0 WHEN len({_WANT}) = 0 THEN (len({_GOT}) = 0)::INT WHEN ({_P}) + ({_RC}) > 0
                  THEN round(2 * ({_P}) * ({_RC}) / (({_P}) + ({_RC})), 9) ELSE 0 END::DOUBLE AS score""",
                  f"round(({_P})::DOUBLE, 9) AS precision", f"round(({_RC})::DOUBLE, 9) AS recall"),
}


def _score_query(key: str, scorer: str) -> None:
    names = [part.rsplit(" AS ", 1)[1] for part in SCORE_SQL[scorer]]

    def run(spark, sf_dir):
        scored = ev.score_answers(pairs(spark, sf_dir, scorer))
        if scorer == "set_match":
            scored = scored.withColumns({c: F.round(c, 9) for c in ("score", "precision", "recall")})
        return scored.select("sample_id", *names)

    query(key, f"WITH {pairs_sql(scorer)} SELECT sample_id, {', '.join(SCORE_SQL[scorer])} FROM pairs")(run)


for _i, _scorer in enumerate(["exact_match", "set_member", "integer_distance", "row_col", "set_match"]):
    _score_query(f"sco{_i + 1}", _scorer)


@query("sco5_none", f"""WITH {pairs_sql('set_match')}, cleaned AS (SELECT sample_id, CASE WHEN a = 'None' THEN '' ELSE a END AS a,
   CASE WHEN g = 'None' THEN '' ELSE g END AS g FROM pairs) SELECT sample_id, {SCORE_SQL['set_match'][0]} FROM cleaned""")
def sco5_none(spark, sf_dir):
    registry = {"set_match": scoring.set_match_scorer(treat_none_as_empty=True)}
    return ev.score_answers(pairs(spark, sf_dir, "set_match"), registry).select("sample_id", "correct")


@query("udf2", f"WITH {pairs_sql('exact_match')} SELECT sample_id, coalesce(length(a) = length(g), false) AS correct FROM pairs")
def udf2(spark, sf_dir):
    def same_length(answer, truth):
        same = F.coalesce(F.length(answer) == F.length(truth), F.lit(False))
        return scoring.score_struct(correct=same, score=same.cast("int"))

    return ev.score_answers(pairs(spark, sf_dir, "exact_match"), {"exact_match": same_length}).select("sample_id", "correct")


@query("sco6", "WITH " + fx.RESULTS_SQL + """ SELECT sample_id, CASE WHEN line_no % 9 = 0 THEN NULL ELSE parsed_answer END AS parsed_answer,
   CASE WHEN line_no % 9 = 0 OR line_no % 10 = 0 THEN false ELSE correct END AS correct, CASE WHEN line_no % 9 = 0 OR line_no % 10 = 0 THEN 0.0::DOUBLE ELSE score END AS score,
   CASE WHEN line_no % 9 = 0 THEN 'missing response' END AS error_message FROM results""")
def sco6(spark, sf_dir):
    """Some rows lack a response and some name an unknown scorer."""
    rows = fx.responses(spark, sf_dir).withColumns(
        {
            "raw_response": F.when(F.col("line_no") % 9 != 0, F.col("raw_response")),
            "scorer": F.when(F.col("line_no") % 10 == 0, "unheard_of").otherwise(F.col("scorer")),
        }
    )
    return ev.evaluate(rows).select("sample_id", "parsed_answer", "correct", "score", "error_message")


# ---------------------------------------------------------------- error types

_ETASK = "CASE o_orderkey % 5 WHEN 0 THEN 'counting_grid' WHEN 1 THEN 'pie_chart' WHEN 2 THEN 'text_degradation' WHEN 3 THEN 'venn_diagram' ELSE 'bar_chart_value' END"
_EGOT = (f"CASE WHEN o_orderkey % 31 = 0 THEN '' WHEN o_orderkey % 37 = 0 THEN 'None' ELSE CASE o_orderkey % 5 "
         f"WHEN 0 THEN {_ROWS} || ',' || {text('3 + o_custkey % 7')} || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ',4' END "
         f"WHEN 1 THEN '1,' || {text('200 + o_custkey % 5')} WHEN 2 THEN 'total ' || {_B} || {_A} || {_B} || ' sum' "
         f"WHEN 3 THEN {_L[0]} || ', ' || {_L[1]} ELSE 'a fairly long answer of ' || {_A} || ' letters' END END")
_EWANT = (f"CASE o_orderkey % 5 WHEN 0 THEN {_COLS} || ',' || {text('3 + o_orderkey % 7')} || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ',5' END "
          f"WHEN 1 THEN {text('1200 + o_orderkey % 3')} || CASE WHEN o_orderkey % 2 = 0 THEN '.5' ELSE '' END WHEN 2 THEN 'Total ' || {_B} || 'aa' || ' sums' "
          f"WHEN 3 THEN {_L[0]} || ',' || {_L[2]} ELSE 'a fairly long answer of ' || {_B} || ' letters' END")
_ESCORER = "CASE WHEN o_orderkey % 5 = 3 THEN 'set_match' ELSE 'exact_match' END"


def labelled_pairs(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS sample_id", f"{_ETASK} AS task_name", f"{_ESCORER} AS scorer",
        f"{_EGOT} AS parsed_answer", f"{_EWANT} AS ground_truth",
    )


_SETE = "list_distinct([trim(v) for v in string_split(lower({0}), ',')])"
_SIZES = """CASE WHEN contains(a, ',') AND contains(g, ',') AND task_name = 'counting_grid' THEN nullif(array_to_string([CASE WHEN z.e <> 0 THEN z.d
   || CASE WHEN z.e > 0 THEN ' over by ' ELSE ' under by ' END || abs(z.e)::VARCHAR END for z in
   [{'d': CASE WHEN len(string_split(a, ',')) <> 2 THEN 'd' || (i - 1)::VARCHAR WHEN i = 1 THEN 'rows' ELSE 'cols' END,
     'e': string_split(a, ',')[i]::BIGINT - string_split(g, ',')[i]::BIGINT} for i in range(1, len(string_split(a, ',')) + 1)]], '; '), '') END"""
_NUM = "CASE WHEN regexp_full_match(replace({0}, ',', ''), '[+-]?(\\d+\\.?\\d*|\\.\\d+)') THEN CAST(replace({0}, ',', '') AS DOUBLE) END"
_SHOWN = "CASE WHEN d = floor(d) THEN d::BIGINT::VARCHAR ELSE d::VARCHAR END"


@query("sco8", f"""WITH p AS (SELECT CAST(o_orderkey AS STRING) AS sample_id, {_ETASK} AS task_name, {_ESCORER} AS scorer, {_EGOT} AS a, {_EWANT} AS g FROM orders),
  q AS (SELECT *, CASE WHEN task_name <> 'counting_grid' OR a = g THEN ({_NUM.format('a')}) - ({_NUM.format('g')}) ELSE NULL END AS d,
    {_SIZES} AS sizes, list_sort(list_filter({_SETE.format('a')}, lambda v: NOT list_contains({_SETE.format('g')}, v))) AS extra,
    list_sort(list_filter({_SETE.format('g')}, lambda v: NOT list_contains({_SETE.format('a')}, v))) AS missing,
    list_sum([(lower(a)[i] = lower(g)[i])::INT for i in range(1, least(length(a), length(g)) + 1)])::DOUBLE / greatest(length(a), length(g), 1) AS same FROM p)
  SELECT sample_id, CASE WHEN a IN ('', 'None') THEN 'Parse failure' WHEN sizes IS NOT NULL THEN sizes
    WHEN d > 0 THEN 'Overcount (+' || {_SHOWN} || ')' WHEN d < 0 THEN 'Undercount (' || {_SHOWN} || ')'
    WHEN task_name = 'text_degradation' THEN CASE WHEN same < 0.3 THEN 'Hallucination' WHEN same < 0.8 THEN 'Major char errors' ELSE 'Minor char error' END
    WHEN scorer = 'set_match' AND len(extra) + len(missing) > 0 THEN concat_ws('; ', CASE WHEN len(extra) > 0 THEN 'extra: ' || array_to_string(extra, ',') END,
      CASE WHEN len(missing) > 0 THEN 'missing: ' || array_to_string(missing, ',') END)
    WHEN lower(a) <> lower(g) THEN 'Wrong (GT=' || CASE WHEN length(g) > 25 THEN substr(g, 1, 25) || '...' ELSE g END || ', got='
      || CASE WHEN length(a) > 25 THEN substr(a, 1, 25) || '...' ELSE a END || ')' ELSE 'Unknown' END AS error_type FROM q""")
def sco8(spark, sf_dir):
    return fl.label_errors(labelled_pairs(spark, sf_dir)).select("sample_id", "error_type")


# ---------------------------------------------------------------- directives, plans, prompts

_REPLY = _mixed(
    f"'Let me TOOL(crop_and_enhance, \"center\") now'", f"'TOOL(count_line_transitions, axis=' || lower({_A}) || ', n=' || {_ROWS} || ')'",
    f"'Done. ANSWER: ' || {_ROWS} || {NL} || 'bye'", "'  plain words '", f"'TOOL(detect_boxes)'", f"'ANSWER' || {_A}", f"'TOOL(other_tool, ' || {_B} || ')'",
)


@query("par11", f"""WITH t AS (SELECT CAST(o_orderkey AS STRING) AS sample_id, o_orderkey % 7 AS k, {_REPLY} AS x, {_A} AS u, {_B} AS l, {_ROWS} AS r FROM orders)
   SELECT sample_id, CASE WHEN k IN (0, 1, 4, 6) THEN 'tool' WHEN k IN (2, 5) THEN 'answer' ELSE 'unknown' END AS action,
   CASE k WHEN 0 THEN 'crop_and_enhance' WHEN 1 THEN 'count_line_transitions' WHEN 2 THEN r || chr(10) || 'bye' WHEN 3 THEN 'plain words' WHEN 4 THEN 'detect_boxes' WHEN 5 THEN u ELSE 'other_tool' END AS value,
   CASE k WHEN 0 THEN 'region=center' WHEN 1 THEN 'axis=' || lower(u) || ';n=' || r WHEN 4 THEN '' WHEN 6 THEN 'arg=' || l END AS args FROM t""")
def par11(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS STRING) AS sample_id", f"{_REPLY} AS x")
    d = directives.directive(F.col("x"))
    shown = F.array_join(
        F.transform(F.array_sort(F.map_entries("d.args")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"
    )
    return rows.select("sample_id", d.alias("d")).select("sample_id", "d.action", "d.value", shown.alias("args"))


_CODE = _mixed(
    f"'Here:' || {NL} || '```python' || {NL} || 'print(' || {_ROWS} || ')' || {NL} || '```' || {NL} || 'ok'",
    f"'```' || {NL} || 'x = ' || {_ROWS} || {NL} || 'y' || {NL} || '```' || {NL} || '```' || {NL} || 'z' || {NL} || '```'", f"' print(' || {_COLS} || ') '",
)


@query("par12", f"""WITH t AS (SELECT CAST(o_orderkey AS STRING) AS sample_id, {_CODE} AS x FROM orders) SELECT sample_id,
   CASE WHEN regexp_matches(x, '(?s)```(?:python)?\\s*\\n(.*?)```') THEN trim(regexp_extract(x, '(?s)```(?:python)?\\s*\\n(.*?)```', 1), chr(10) || ' ') ELSE trim(x) END AS code FROM t""")
def par12(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS STRING) AS sample_id", f"{_CODE} AS x")
    return rows.select("sample_id", directives.code_text(F.col("x")).alias("code"))


_ASK_TASK = "CASE WHEN o_orderkey % 3 = 0 THEN " + choose("o_orderkey % 12", fx.TASKS[:9] + ["edge_crossing", "bar_chart_value", "x"]) + " ELSE 'unlisted' END"
_ASK = _mixed(
    "'How many squares are there?'", "'Read the text of line ' || " + _ROWS, "'Is node A linked to node B and is it the largest node of all?'",
    "'What percentage is it?'", "'How deep is the tree and so on'", "'Count rows in the grid AND name the color of the grid?'", "'Look'",
    "'Which path goes to B?'", "'What is the y-value at 4?'", "'How many?'",
)


def asked(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS sample_id", f"{_ASK_TASK} AS task_name", f"{_ASK} AS prompt"
    )


_ASKED_SQL = f"asked AS (SELECT CAST(o_orderkey AS STRING) AS sample_id, {_ASK_TASK} AS task_name, {_ASK} AS prompt FROM orders)"
_PLAN_ARMS = " ".join(f"WHEN task_name = '{t}' THEN 'task:{t}|{s}'" for t, s in dims.TASK_PLANS.items()) + " " + " ".join(
    f"WHEN regexp_matches(lower(prompt), '{p}') THEN '{c}|{s}'" for p, c, s in dims.PLAN_RULES
) + f" ELSE '{dims.FALLBACK_PLAN[0]}|{dims.FALLBACK_PLAN[1]}'"


@query("par13", f"""WITH {_ASKED_SQL}, p AS (SELECT sample_id, CASE {_PLAN_ARMS} END AS v FROM asked)
   SELECT sample_id, string_split(v, '|')[1] AS category, string_split(v, '|')[2] AS steps FROM p""")
def par13(spark, sf_dir):
    p = directives.plan(F.col("prompt"), F.col("task_name"))
    return asked(spark, sf_dir).select("sample_id", p.alias("p")).select("sample_id", "p.*")


_SPLIT_ARMS = " ".join(
    "WHEN task_name = '" + t + "' THEN [" + ", ".join("'" + q + "'" for q in qs) + "]" for t, qs in dims.QUESTION_SPLITS.items()
)


@query("par14", f"""WITH {_ASKED_SQL}, s AS (SELECT sample_id, task_name, CASE {_SPLIT_ARMS}
     WHEN contains(lower(prompt), ' and ') AND contains(prompt, '?') THEN [rtrim(w, '?') || '?' for w in [trim(v) for v in string_split_regex(prompt, '(?i)\\band\\b')] if length(w) > 10]
     ELSE [prompt] END AS qs FROM asked)
   SELECT sample_id, task_name, unnest(range(1, len(qs) + 1))::INTEGER AS number, unnest(qs) AS question FROM s""")
def par14(spark, sf_dir):
    return directives.explode_questions(asked(spark, sf_dir))


def _fill_sql(template: str, **values: str) -> str:
    out = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, value in values.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


_P12 = fx.RESULTS_SQL
_CRITIQUE = "CASE task_name " + " ".join("WHEN '" + t + "' THEN '" + c.replace("'", "''") + "'" for t, c in dims.CRITIQUES.items()) + f" ELSE '{dims.DEFAULT_CRITIQUE}' END"


@query("fld12", f"""WITH {_P12} SELECT sample_id, CASE WHEN task_name = 'hierarchy_depth' THEN {_fill_sql(dims.VERIFY_LEVELS_PROMPT, question='prompt', answer='parsed_answer')}
     ELSE {_fill_sql(dims.VERIFY_PROMPT, question='prompt', answer='parsed_answer')} END AS verify_prompt,
   {_fill_sql(dims.CONSENSUS_PROMPT, question='prompt', answer='parsed_answer')} AS consensus_prompt,
   {_fill_sql(dims.DECOMPOSE_PROMPT, question='prompt', history="'Observation 1: ' || raw_response || chr(10) || 'Observation 2: ' || ground_truth")} AS decompose_prompt,
   {_fill_sql(dims.REFINE_PROMPT, question='prompt', rounds="'2'", critique=_CRITIQUE, history="'  Round 1: ' || raw_response || chr(10) || '  Round 2: ' || ground_truth")} AS refine_prompt FROM results""")
def fld12(spark, sf_dir):
    rows = fx.results(spark, sf_dir)
    task, question, answer = F.col("task_name"), F.col("prompt"), F.col("parsed_answer")
    said = F.array("raw_response", "ground_truth")
    return rows.select(
        "sample_id",
        prompts.verify(task, question, answer).alias("verify_prompt"),
        prompts.check_consensus(question, answer).alias("consensus_prompt"),
        prompts.decompose_final(question, said).alias("decompose_prompt"),
        prompts.refine(task, question, said).alias("refine_prompt"),
    )


_FIND = "chr(10) || 'Sub-Q{0}: ' || {1} || chr(10) || '  Primitives used: detect_boxes' || chr(10) || '  Findings: ' || {2} || chr(10)"


@query("fld13", f"""WITH {fx.RESPONSES_SQL} SELECT sample_id, {_fill_sql(dims.SKETCH_PROMPT, question='prompt', round="'1'",
   menu="'" + dims.SKETCH_TOOL_MENU.replace(chr(10), "' || chr(10) || '") + "'",
   history=_FIND.format(1, 'task_name', 'raw_response') + ' || ' + _FIND.format(2, 'parser', 'ground_truth'))} AS sketch_prompt FROM responses""")
def fld13(spark, sf_dir):
    def finding(question, found):
        return F.struct(
            F.col(question).alias("question"), F.lit("detect_boxes").alias("steps"), F.col(found).alias("text")
        )

    found = F.array(finding("task_name", "raw_response"), finding("parser", "ground_truth"))
    return fx.responses(spark, sf_dir).select(
        "sample_id", prompts.sketch(F.col("prompt"), found, F.lit(1)).alias("sketch_prompt")
    )
