"""Adding costly columns so that they are computed once per row."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_struct(df: DataFrame, made: Column, names: list[str]) -> DataFrame:
    """Add the fields of a struct column, which filters and projections must not copy.

    The optimizer moves a filter below a projection by putting the column's whole
    expression into the predicate. For answer extraction and scoring, which build on each
    other, that repeats long expressions many times. A one-element ``inline`` is a
    boundary filters do not cross, and it stays inside generated code. The struct itself
    is made in a projection, where Spark computes repeated parts once.
    """
    kept = [c for c in df.columns if c not in names]
    staged = df.select(*kept, made.alias("_made"))
    return staged.select(*kept, F.inline(F.array("_made")))


def with_fields(df: DataFrame, **fields: Column) -> DataFrame:
    """``with_struct`` for columns given by name."""
    made = F.struct(*[column.alias(name) for name, column in fields.items()])
    return with_struct(df, made, list(fields))


_BUILT: WeakKeyDictionary = WeakKeyDictionary()


def remembered(df: DataFrame, key: Hashable, build: Callable[[], Column]) -> Column:
    """``build()``, made once per Spark context and key.

    A column of thousands of expressions, each a call to the JVM, takes a second to build. It names its inputs
    only, so one and the same column serves every table that has them.
    """
    held = _BUILT.setdefault(df.sparkSession.sparkContext, {})
    if key not in held:
        held[key] = build()
    return held[key]
