"""Answer extraction: one Column per answer dialect, chosen by the row's parser name.

A missing answer is null; the empty string is a real answer (an empty set).

Inside the arms of a ``CASE`` Spark computes an expression again wherever it is repeated, so a dialect
names costly parts once where it can, and tests the text as it is rather than a stripped or lower-cased copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalloom.functions import text as tx

ColumnParser = Callable[[Column], Column]

PARSERS: dict[str, ColumnParser] = {}


def register_parser(name: str) -> Callable[[ColumnParser], ColumnParser]:
    """Add a parser under a name. A parser maps a text Column to a text Column;
    it may wrap a ``pandas_udf`` when the built-in functions cannot express it."""

    def keep(parser: ColumnParser) -> ColumnParser:
        PARSERS[name] = parser
        return parser

    return keep


# --- fixed values: the answer patterns of each dialect -----------------------
_SPACE = r"[\s\x1c-\x1f]"  # with (?U): what ``tx.strip`` removes
_START, _END = rf"(?U)^{_SPACE}*+", rf"{_SPACE}*\z"
BRACED_INT = r"\{\$?(\d+)\$?\}"
BARE_INT = r"(?U)\b(\d+)\b"
_YES, _NO = "[Yy][Ee][Ss]", "[Nn][Oo]"
# the text starts with it, or it is among the first three words; anywhere
YES_OR_NO = [
    (rf"{_START}(?:{word}|(?:\S++\s++){{1,2}}{word}(?=\s|{_END}))", rf"(?U)\b{word}\b") for word in (_YES, _NO)
]
BRACED_LETTER = r"\{([A-Za-z])\}"
STATED_LETTER = r"(?iU)(?:answer\s+is|is|box|reach)\s+([A-Za-z])\b"
LONE_LETTER_NOT_IA = r"(?U)(?<!\S)([B-HJ-Zb-hj-z])\.?(?!\S)"
ANY_LETTER = r"(?U)\b([A-Za-z])\b"
ROWS_VALUE = r"(?iU)rows?\s*[=:]\s*\{?(\d+)\}?"
COLS_VALUE = r"(?iU)col(?:umn)?s?\s*[=:]\s*\{?(\d+)\}?"
SIZE_PAIR = r"(?U)(\d+)\s*[x×,]\s*(\d+)"
CHOICE_BRACED = r"\{\$?([A-Da-d])\$?\}"
CHOICE_PAREN = r"\(([A-Da-d])\)"
CHOICE_STATED = r"(?iU)answer\s*(?:is|:)\s*([A-Da-d])\b"
CHOICE_BOLD = r"\*\*([A-Da-d])\*\*"
CHOICE_WORD = r"""(?U)(?<!\S)[.,;:!?()\[\]{}"'*]*([A-Da-d])[.,;:!?()\[\]{}"'*]*(?!\S)"""
BRACED_TEXT = r"\{([^}]+)\}"
DOLLARS = r"(?s)^\$(.+)\$\z"
BRACED_ANY = r"\{([^}]*)\}"
QUOTED_TEXT = "[\"“]([^\"”]+)[\"”]"
PREAMBLES = (
    rf"(?i){_START}(?:the\s+)?(?:answer|value|text|number|word)\s+is\s*:?\s*",
    rf"(?i){_START}it\s+(?:says?|reads?)\s*:?\s*",
)
BLANK = rf"{_START}\z"
UP_TO_FIVE_WORDS = rf"{_START}\S++(?:\s++\S++){{0,4}}+{_END}"
EMPTY_SET_WORDS = ("none", "n/a", "empty", "no items")
# of the first braces; letters are compared without regard to case in ASCII only, so white space is listed
EMPTY_BRACES = rf"(?i)^[^{{]*+\{{[{tx.WHITESPACE}]*+(?:{'|'.join(EMPTY_SET_WORDS)})?+[{tx.WHITESPACE}]*+\}}"
WITH_ITEM = r"(?sU)^.*[^\s,].*\z"
CAPITAL_LIST = r"(?mU)(?:^|:)\s*([A-Z][a-z]+(?:\s*,\s*[A-Z][a-z]+)+)"
LETTER_SET = r"(?U)\{([A-Za-z](?:\s*,\s*[A-Za-z])*)\}"
LETTER_LIST = r"(?U)\b([A-Za-z]\s*(?:,\s*[A-Za-z]\s*)+)\b"
LONE_LETTER_WORD = r"(?U)(?<!\S)[.,;:!?()\[\]]*([B-HJ-Zb-hj-z])[.,;:!?()\[\]]*(?!\S)"
CELL_LABEL = r"(?U)([A-Za-z]\d+)"
BARE_CELL_LABEL = r"(?U)\b([A-Za-z]\d+)\b"
# -----------------------------------------------------------------------------


@register_parser("integer")
def integer(response: Column) -> Column:
    """A braced number, else the last bare number."""
    return F.coalesce(tx.first_match(response, BRACED_INT), tx.last_match(response, BARE_INT))


@register_parser("yes_no")
def yes_no(response: Column) -> Column:
    (yes_first, yes), (no_first, no) = YES_OR_NO
    return (
        F.when(tx.has(response, yes_first), "Yes")
        .when(tx.has(response, no_first), "No")
        .when(tx.has(response, yes), "Yes")
        .when(tx.has(response, no), "No")
    )


@register_parser("letter")
def letter(response: Column) -> Column:
    return F.upper(
        F.coalesce(
            tx.first_match(response, BRACED_LETTER),
            tx.last_match(response, STATED_LETTER),
            tx.last_match(response, LONE_LETTER_NOT_IA),
            tx.first_match(response, ANY_LETTER),
        )
    )


def _size(response: Column, pick: Callable[[Column, str, int], Column]) -> Column:
    # concat is null when either side is, so the pair form is tried next
    named = F.concat(pick(response, ROWS_VALUE, 1), F.lit(","), pick(response, COLS_VALUE, 1))
    paired = F.concat(pick(response, SIZE_PAIR, 1), F.lit(","), pick(response, SIZE_PAIR, 2))
    return F.coalesce(named, paired)


@register_parser("row_col")
def row_col(response: Column) -> Column:
    """``rows,cols`` from the first stated size."""
    return _size(response, tx.first_match)


def final_row_col(response: Column) -> Column:
    """``rows,cols`` from the last stated size (worked answers state several)."""
    return _size(response, tx.last_match)


@register_parser("mc4")
def mc4(response: Column) -> Column:
    return F.upper(
        F.coalesce(
            tx.first_match(response, CHOICE_BRACED),
            tx.first_match(response, CHOICE_PAREN),
            tx.first_match(response, CHOICE_STATED),
            tx.first_match(response, CHOICE_BOLD),
            tx.last_match(response, CHOICE_WORD),
        )
    )


@register_parser("exact_string")
def exact_string(response: Column) -> Column:
    braced = tx.strip(tx.first_match(response, BRACED_TEXT))
    unwrapped = tx.strip(F.regexp_replace(braced, DOLLARS, "$1"))
    quoted = tx.strip(tx.first_match(response, QUOTED_TEXT))
    plain = F.when(tx.has(response, BLANK), F.lit(None).cast("string"))
    for pattern in PREAMBLES:
        plain = plain.when(tx.has(response, pattern), F.regexp_replace(response, pattern, ""))
    first_line = F.substring_index(tx.strip(response), "\n", 1)
    plain = plain.when(tx.has(response, UP_TO_FIVE_WORDS), response).otherwise(first_line)
    return F.coalesce(unwrapped, quoted, tx.rstrip_dots(tx.strip(plain)))


@register_parser("csv_words")
def csv_words(response: Column) -> Column:
    """Comma list sorted without regard to case; ``""`` for a stated empty set."""
    inner = tx.strip(F.regexp_extract(response, BRACED_ANY, 1))
    listed = F.coalesce(tx.first_match(inner, WITH_ITEM, 0), tx.first_match(response, CAPITAL_LIST))
    items = F.array_remove(F.split(listed, r"(?U)\s*,\s*"), "")
    return F.when(tx.has(response, EMPTY_BRACES), "").otherwise(F.array_join(tx.sort_ignoring_case(items), ","))


def _sorted_labels(labels: Column) -> Column:
    """Upper-cased distinct labels in string order; null when there are none."""
    # joining before upper-casing avoids a per-element lambda
    upper = F.split(F.upper(F.array_join(labels, ",")), ",")
    return tx.non_empty(F.array_join(F.sort_array(F.array_distinct(upper)), ","))


@register_parser("csv_letters")
def csv_letters(response: Column) -> Column:
    def letters_of(text: Column) -> Column:
        upper = F.split(F.upper(F.regexp_replace(text, r"(?U)\s+", "")), ",")
        return F.array_join(F.sort_array(F.array_distinct(upper)), ",")

    return F.coalesce(
        letters_of(tx.first_match(response, LETTER_SET)),
        letters_of(tx.first_match(response, LETTER_LIST)),
        _sorted_labels(tx.all_matches(response, LONE_LETTER_WORD)),
    )


@register_parser("csv_cell_labels")
def csv_cell_labels(response: Column) -> Column:
    braced = tx.first_match(response, BRACED_TEXT)
    return F.coalesce(
        _sorted_labels(tx.all_matches(braced, CELL_LABEL)),
        _sorted_labels(tx.all_matches(response, BARE_CELL_LABEL)),
    )


def parse_by_name(
    parser: Column, response: Column, registry: dict[str, ColumnParser] | None = None
) -> Column:
    """Apply the parser each row names; unknown names give null."""
    chain: Column | None = None
    for name, build in (registry or PARSERS).items():
        answer = build(response)
        chain = F.when(parser == name, answer) if chain is None else chain.when(parser == name, answer)
    return F.lit(None).cast("string") if chain is None else chain
