"""Small string helpers shared by the extraction, scoring and reward columns.

All of them return plain Column expressions, so they stay inside the JVM.
Patterns carry ``(?U)`` where ``\\b``, ``\\s`` or ``\\w`` meet free text, because
answers are written in many languages and Java is ASCII-only by default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a Unicode-aware strip removes (Spark's trim removes only U+0020).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once.

    An expression used inside a higher-order function is computed again for every
    element, unless it is bound to a variable first; a one-element ``transform`` does that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(key: Column, values: dict[str, str], default: str) -> Column:
    """Value of a key in a small fixed table; the key expression is used once."""
    table = F.create_map(*[F.lit(v) for pair in values.items() for v in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def strip(text: Column) -> Column:
    """Trim Unicode white space from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def strip_chars(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def rstrip_dots(text: Column) -> Column:
    return F.rtrim(text, F.lit("."))


def has(text: Column, pattern: str) -> Column:
    """True when the pattern occurs anywhere in the text."""
    return F.rlike(text, F.lit(pattern))


def non_empty(text: Column) -> Column:
    """The text, null where it is empty; the text is computed once (``nullif`` does so twice inside a CASE)."""
    return F.get(F.array_remove(F.array(text), ""), F.lit(0))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group that cannot be empty; null when absent."""
    return non_empty(F.regexp_extract(text, pattern, group))


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Last match of a group; null when absent."""
    return F.try_element_at(all_matches(text, pattern, group), F.lit(-1))


def words(text: Column) -> Column:
    """Tokens between runs of white space (no empty tokens)."""
    return F.array_remove(F.split(strip(text), r"(?U)\s+"), "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def shorten(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, the last three being dots when cut."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    ).otherwise(text)


def clip(text: Column, limit: int) -> Column:
    """Keep ``limit`` characters and add dots after them when cut."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)


def csv_items(text: Column) -> Column:
    """Upper-cased, trimmed, distinct, non-blank parts of a comma list."""
    parts = F.split(F.upper(strip(text)), r"(?U)\s*,\s*")
    return F.array_distinct(F.array_remove(parts, ""))


def to_int(text: Column) -> Column:
    """Integer value of a text, null when it is not a plain integer."""
    return strip(text).try_cast("bigint")


def sort_ignoring_case(items: Column) -> Column:
    """Stable, case-insensitive sort of an array of strings."""
    keyed = F.transform(
        items, lambda item, i: F.struct(F.lower(item).alias("k"), i.alias("i"), item.alias("v"))
    )
    return F.transform(F.sort_array(keyed), lambda s: s["v"])


def format_general(number: Column) -> Column:
    """Six significant digits, no trailing zeros, exponent beyond 1e6 or below 1e-4."""
    size = F.abs(number)
    rough = F.when(size == 0, F.lit(0)).otherwise(F.floor(F.log10(size)).cast("int"))
    # 999999.6 rounds up to the next power of ten
    carried = F.round(size / F.pow(F.lit(10.0), rough), 5) >= 10
    exponent = F.when(carried, rough + 1).otherwise(rough)

    def plain(value: Column) -> Column:
        return F.regexp_replace(value.try_cast("decimal(38,10)").cast("string"), r"\.?0+$", "")

    power = F.pow(F.lit(10.0), F.lit(5) - exponent)
    fixed = F.round(number * power) / power
    scaled = F.round(number / F.pow(F.lit(10.0), exponent), 5)
    scientific = F.concat(
        plain(scaled),
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    whole = (number == F.floor(number)) & (size < 1000000)
    return (
        F.when(whole, number.try_cast("bigint").cast("string"))
        .when((exponent >= -4) & (exponent < 6), plain(fixed))
        .otherwise(scientific)
    )
