"""Repeatable sampling: the order inside a class is a hash of the row's id and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.operators.ranking import smallest_hashes, top_k_per_group
from evalloom.storage import stored


def hash_text(seed: int | str, *columns: Column) -> Column:
    """Hex digest of the columns and a seed; the same in every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def hash_number(seed: int | str, *columns: Column) -> Column:
    """32-bit number from ``hash_text``."""
    return F.conv(F.substring(hash_text(seed, *columns), 1, 8), 16, 10).cast("bigint")


def pick(n: Column | int, seed: int | str, *columns: Column) -> Column:
    """Repeatable number in ``[0, n)``."""
    size = F.lit(n) if isinstance(n, int) else n
    return F.pmod(hash_number(seed, *columns), size)


def balanced_sample(
    rows: DataFrame, by: list[str], max_per_class: int = 20, seed: int = 42,
    id_column: str = "sample_id",
) -> DataFrame:
    """At most ``max_per_class`` rows of every class."""
    order = [hash_text(seed, F.col(id_column)), F.col(id_column)]
    return top_k_per_group(rows, by, order, max_per_class, "rank", salt_on=id_column)


def leading_per_file(rows: DataFrame, n: int, per_file: int = 2, order: str = "line_no") -> DataFrame:
    """The first rows of every file, in file order, until ``n`` are taken."""
    leading = top_k_per_group(
        rows, ["file"], [F.col(order), F.col("sample_id")], per_file, "rank"
    )
    return leading.orderBy("file", "rank").limit(n)


def coverage_sample(combos: DataFrame, keep: Column | int, seed: int = 42) -> DataFrame:
    """Keep ``keep`` parameter combinations per task so that every axis value occurs.

    ``combos`` has ``task_name, combo, params`` (map) and ``axes`` (names). Each value of
    each axis names the combination of lowest hash that holds it; those come first, in
    axis and value order, and the rest fills up by hash. ``keep`` may be a column that differs by task.
    About ``keep`` rows of a task are shuffled, found by a histogram of their hashes.
    """
    order = hash_text(seed, F.col("task_name"), F.col("combo"))
    hashed = combos.withColumn("_h", order)
    values = hashed.select(
        "task_name", "combo", "_h", "params", F.posexplode("axes").alias("axis_no", "axis")
    ).withColumn("value", F.try_element_at("params", F.col("axis")))
    # the combination is carried as its entries, since maps have no order
    chosen = F.min(F.struct("_h", "combo", F.map_entries("params").alias("entries")))
    named = (
        values.groupBy("task_name", "axis_no", "value").agg(chosen.alias("c"))
        .groupBy("task_name", "c")
        .agg(F.min(F.struct("axis_no", "value")).alias("covers"))
        .select("task_name", "c.combo", F.map_from_entries("c.entries").alias("params"), "c._h", "covers")
    )
    named = stored(named, "named-combos")
    # the first ``keep`` by hash hold enough others to fill up with, so no more rows are shuffled
    near = smallest_hashes(hashed, ["task_name"], "_h", keep).select("task_name", "combo", "params", "_h", "_keep")
    limits = near.groupBy("task_name").agg(F.max("_keep").alias("_keep"))
    others = near.drop("_keep").join(named.select("task_name", "combo"), ["task_name", "combo"], "left_anti")
    either = named.unionByName(others.withColumn("covers", F.lit(None).cast(named.schema["covers"].dataType))).join(limits, "task_name")
    turn = [F.col("covers").isNull(), F.col("covers"), F.col("_h")]
    ranked = either.withColumn("pick", F.row_number().over(Window.partitionBy("task_name").orderBy(*turn)))
    return ranked.where(F.col("pick") <= F.col("_keep")).select(
        "task_name", "combo", "params", F.col("covers").isNotNull().alias("for_coverage")
    )
