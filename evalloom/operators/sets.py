"""Set questions over tables of (set, item) rows, and over two tables of results.

Membership is folded into one row per item before the shuffle, so a table is read once however many sets
are asked about, and an item that is in all sets of a large table stays one small row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _memberships(members: DataFrame, names: list[str], set_col: str, item_col: str) -> tuple[DataFrame, list[Column]]:
    """A row per item of any of the sets, and for each set whether the item is in it."""
    flags = [F.max(F.col(set_col) == name).alias(f"_in{i}") for i, name in enumerate(names)]
    rows = members.where(F.col(set_col).isin(*names)).groupBy(item_col).agg(*flags)
    return rows, [F.col(f"_in{i}") for i in range(len(names))]


def in_all(members: DataFrame, names: list[str], set_col: str = "set", item_col: str = "item") -> DataFrame:
    """Items that are in every one of the sets."""
    rows, flags = _memberships(members, names, set_col, item_col)
    return rows.where(reduce(lambda a, b: a & b, flags)).select(item_col)


def in_first_only(members: DataFrame, first: str, others: list[str], set_col: str = "set", item_col: str = "item") -> DataFrame:
    """Items of the first set that are in none of the others."""
    rows, flags = _memberships(members, [first, *others], set_col, item_col)
    return rows.where(reduce(lambda a, b: a & ~b, flags)).select(item_col)


def in_one_only(members: DataFrame, set_col: str = "set", item_col: str = "item") -> DataFrame:
    """``item, only_set`` of items that are in a single set: the first and last name of its sets agree."""
    ends = members.groupBy(item_col).agg(F.min(set_col).alias("_a"), F.max(set_col).alias("only_set"))
    return ends.where(F.col("_a") == F.col("only_set")).select(item_col, "only_set")


def common_tasks(first: DataFrame, second: DataFrame) -> DataFrame:
    """Tasks that both results have; each side is reduced to its tasks before they meet."""
    return first.select("task_name").intersect(second.select("task_name"))


def counts_of_either(first: DataFrame, second: DataFrame, key: str = "key") -> DataFrame:
    """``key, p, q``: the sums of ``n`` in two tables of counts, over the union of their keys; absent counts as 0."""
    a = first.groupBy(key).agg(F.sum("n").alias("p"))
    b = second.groupBy(key).agg(F.sum("n").alias("q"))
    return a.join(b, key, "full").select(key, F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q"))
