"""Top-k per group without sending a whole group through one task, and without shuffling what cannot be kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.storage import stored

DEFAULT_SALTS = 64


def top_k_per_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
    rank_name: str = "rank",
    salt_on: str = "sample_id",
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """The first ``k`` rows of every group under ``order``, with their rank.

    A group may hold a third of the table, so it is ranked twice: each group is split
    into ``salts`` parts that keep their own first ``k`` rows, and the survivors
    (at most ``salts * k`` per group) are ranked again. The answer is exact, because
    a row among the first k of the group is among the first k of its part. Rows of
    a part never exceed the part, and Spark also drops rows before the shuffle
    (window group limit).
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_part_rank", F.row_number().over(part))
        .where(F.col("_part_rank") <= k)
        .drop("_part_rank", "_salt")
        .withColumn(rank_name, F.row_number().over(whole))
        .where(F.col(rank_name) <= k)
    )


#: Steps of the histogram that finds a group's threshold; one holds about as many rows as are kept.
STEPS = 16


def smallest_hashes(df: DataFrame, keys: list[str], hashed: str, keep: Column | int) -> DataFrame:
    """Rows that may be among the ``keep`` smallest hashes of their group, and few others; adds ``_keep``.

    ``hashed`` is a column of hexadecimal digests. ``keep`` may differ by group (the largest of its rows counts).
    A group's size says how wide a step of hashes holds about ``keep`` rows; a histogram over the first steps,
    combined before its shuffle, gives the step at which ``keep`` rows are reached, and rows beyond it stay
    where they are. So about ``keep`` to twice as many rows of a group are left in all, whatever its
    size. Where the histogram ends too early, as digests are not even, the whole group is left.
    """
    keep = F.lit(keep) if isinstance(keep, int) else keep
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.coalesce(F.max(keep), F.lit(0)).cast("bigint").alias("_keep"))
    sizes = stored(sizes, "group-sizes")
    place = F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") / float(16**13)
    stepped = df.join(sizes, keys).withColumn("_step", F.floor(F.least(place * F.col("_n") / F.greatest(F.col("_keep"), F.lit(1)), F.lit(float(STEPS)))))
    counts = stepped.groupBy(*keys, "_step").agg(F.count("*").alias("_c"), F.max("_keep").alias("_keep"))
    reached = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_step"))
    enough = F.min(F.when((F.col("_reached") >= F.col("_keep")) & (F.col("_step") < STEPS), F.col("_step")))
    last = counts.withColumn("_reached", reached).groupBy(*keys).agg(F.coalesce(enough, F.lit(STEPS)).alias("_last"))
    near = stepped.join(stored(last, "group-thresholds"), keys).where((F.col("_step") <= F.col("_last")) & (F.col("_keep") > 0))
    return near.drop("_n", "_step", "_last")
