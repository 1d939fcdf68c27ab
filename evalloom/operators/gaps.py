"""Image tasks against their text controls: gaps, failure classes and their roll-ups.

All functions work on per-task aggregates, so after the tally nothing is larger than
the list of tasks. The taxonomy (34 fixed rows) is the only broadcast table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom import dims
from evalloom.functions import scoring
from evalloom.operators.accuracy import TEXT_SUFFIX, ratio, tally


def _by_base(acc: DataFrame) -> DataFrame:
    """A task and its text control side by side, from one small group-by on the base name.

    A ``_text`` name is a control only when its base task is present; otherwise it is a
    task of its own. No self-join is needed, so the results are read once.
    """
    is_text = F.endswith("task_name", F.lit(TEXT_SUFFIX))
    named = acc.withColumn("_text", is_text).withColumn(
        "base", F.regexp_replace("task_name", TEXT_SUFFIX + "$", "")
    )

    def side(column: str, text: bool) -> Column:
        return F.max(F.when(F.col("_text") if text else ~F.col("_text"), F.col(column)))

    both = named.groupBy("base").agg(
        side("acc", False).alias("i_acc"), side("n", False).alias("i_n"),
        side("acc", True).alias("t_acc"), side("n", True).alias("t_n"),
    )
    alone = F.col("i_n").isNull()
    return both.select(
        F.when(alone, F.concat("base", F.lit(TEXT_SUFFIX))).otherwise(F.col("base")).alias("task_name"),
        F.coalesce("i_acc", "t_acc").alias("image_acc"),
        F.coalesce("i_n", "t_n").alias("image_n"),
        F.when(~alone, F.col("t_acc")).alias("text_acc"),
        F.when(~alone, F.col("t_n")).alias("text_n"),
    ).withColumn("gap", F.col("text_acc") - F.col("image_acc"))


def control_pairs(counts: DataFrame) -> DataFrame:
    """``(task_name, text_task)`` for every task of a tally whose control is present too."""
    acc = counts.select("task_name", "n", F.lit(0.0).alias("acc"))
    return _by_base(acc).where(F.col("text_n").isNotNull()).select(
        "task_name", F.concat("task_name", F.lit(TEXT_SUFFIX)).alias("text_task")
    )


def split_tasks(counts: DataFrame) -> DataFrame:
    """Mark the text controls of a tally: ``_text`` names whose base task is present."""
    acc = counts.select("task_name", "n", F.lit(0.0).alias("acc"))
    paired = _by_base(acc).select(
        F.explode(
            F.array_compact(
                F.array(
                    F.struct("task_name", F.lit(False).alias("is_control")),
                    F.when(
                        F.col("text_n").isNotNull(),
                        F.struct(
                            F.concat("task_name", F.lit(TEXT_SUFFIX)).alias("task_name"),
                            F.lit(True).alias("is_control"),
                        ),
                    ),
                )
            )
        ).alias("t")
    )
    return paired.select("t.*")


def split_by_registry(counts: DataFrame, registry: DataFrame) -> DataFrame:
    """Mark text controls whose base task is in a task registry, present here or not."""
    bases = registry.select(
        F.concat("task_name", F.lit(TEXT_SUFFIX)).alias("task_name"), F.lit(True).alias("_control")
    )
    return counts.join(bases, "task_name", "left").select(
        "task_name", F.coalesce("_control", F.lit(False)).alias("is_control")
    )


def with_taxonomy(tasks: DataFrame, default: str) -> DataFrame:
    joined = tasks.join(F.broadcast(dims.taxonomy(tasks.sparkSession)), "task_name", "left")
    for column in ("perception", "reasoning", "category"):
        joined = joined.withColumn(column, F.coalesce(column, F.lit(default)))
    return joined


def full_diagnostic(results: DataFrame) -> DataFrame:
    """Per image task: both accuracies, gap, failure class, demands and category."""
    acc = tally(results, "task_name").select(
        "task_name", "n", ratio("n_correct", "n").alias("acc")
    )
    return with_taxonomy(_by_base(acc), "—").select(
        "task_name", "image_acc", "text_acc", "gap",
        scoring.failure_class(F.col("image_acc"), F.col("text_acc")).alias("failure_class"),
        "perception", "reasoning", "category",
    )


def worst_by_class(diagnostic: DataFrame, k: int = 10) -> DataFrame:
    """Up to ``k`` worst tasks of each failing class, ranked by that class's own key."""
    kind = F.col("failure_class")
    key = (
        F.when(kind == "perceptual", -F.col("gap"))
        .when(kind == "reasoning", F.col("text_acc"))
        .otherwise(F.col("image_acc"))
    )
    order = Window.partitionBy("failure_class").orderBy(key, "task_name")
    return (
        diagnostic.where(kind.isin("perceptual", "reasoning", "mixed"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("failure_class", "rank", "task_name", "image_acc", "text_acc", "gap")
    )


def category_summary(tasks: DataFrame) -> DataFrame:
    """Number of tasks and mean of task means per category."""
    return tasks.groupBy("category").agg(
        F.count("*").alias("n_tasks"),
        F.avg("image_acc").alias("mean_image"),
        F.avg("text_acc").alias("mean_text"),
        (F.avg("text_acc") - F.avg("image_acc")).alias("mean_gap"),
    )


def paired_percent(results: DataFrame) -> DataFrame:
    """Paired tasks only, accuracies in percent, with demands and category."""
    acc = tally(results, "task_name").select(
        "task_name", "n", (ratio("n_correct", "n") * 100).alias("acc")
    )
    return with_taxonomy(_by_base(acc).where(F.col("text_acc").isNotNull()), "?").select(
        "task_name", "image_acc", "text_acc", "gap", "image_n", "text_n",
        "perception", "reasoning", "category",
    )


def gap_ranking(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "task_name", "gap", scoring.gap_class(F.col("gap")).alias("gap_class")
    ).orderBy(F.desc("gap"), "task_name")


def largest_gaps(pairs: DataFrame, k: int = 10) -> DataFrame:
    return pairs.orderBy(F.desc("gap"), "task_name").limit(k)


def demand_box(pairs: DataFrame) -> DataFrame:
    """Five-number summary of the gap per perception demand."""
    known = pairs.where(F.col("perception").isin(*dims.DEMAND_LEVELS))
    level = F.array_position(
        F.array(*[F.lit(v) for v in dims.DEMAND_LEVELS]), F.col("perception")
    )
    points = F.percentile("gap", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return (
        known.groupBy("perception")
        .agg(F.count("*").alias("n"), points.alias("q"))
        .select(
            "perception", level.alias("level"), "n",
            *[F.col("q")[i].alias(name) for i, name in
              enumerate(("min", "q1", "median", "q3", "max"))],
        )
        .orderBy("level")
    )


def demand_grid(pairs: DataFrame) -> DataFrame:
    """Mean image accuracy and the tasks of every perception x reasoning cell.

    ``running_acc`` halves towards each next task in name order instead of averaging;
    it reproduces published grids. The lists hold task names, at most the taxonomy.
    """
    listed = F.array_sort(F.collect_list(F.struct("task_name", "image_acc")))
    cells = (
        pairs.where(
            F.col("perception").isin(*dims.DEMAND_LEVELS)
            & F.col("reasoning").isin(*dims.DEMAND_LEVELS)
        )
        .groupBy("perception", "reasoning")
        .agg(F.avg("image_acc").alias("mean_acc"), listed.alias("tasks"))
    )

    def halve(so_far: Column, task: Column) -> Column:
        return F.coalesce((so_far + task["image_acc"]) / 2, task["image_acc"])

    running = F.aggregate("tasks", F.lit(None).cast("double"), halve)
    return cells.select(
        "perception", "reasoning", "mean_acc", running.alias("running_acc"),
        F.array_join(F.col("tasks.task_name"), ",").alias("tasks"),
    )


def error_type_split(pairs: DataFrame) -> DataFrame:
    """Tasks by error type; the first two may overlap, the third is the remainder."""
    perceptual = F.count_if(F.col("gap") > 15)
    reasoning = F.count_if((F.col("text_acc") < 50) & (F.col("image_acc") < 50))
    return pairs.agg(
        perceptual.alias("perceptual"), reasoning.alias("reasoning"),
        (F.count("*") - perceptual - reasoning).alias("mixed"),
    )


def reasoning_failures(pairs: DataFrame) -> DataFrame:
    return (
        pairs.where(F.col("text_acc") < 50)
        .select("task_name", "image_acc", "text_acc")
        .orderBy("image_acc", "task_name")
    )
