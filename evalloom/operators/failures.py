"""Picking and labelling wrong answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions import text as tx
from evalloom.functions.scoring import error_type
from evalloom.operators.accuracy import image_tasks_only, is_correct, ratio
from evalloom.operators.columns import with_fields
from evalloom.operators.ranking import top_k_per_group
from evalloom.storage import stored

AMBIGUOUS_SLICE_POINTS = 5


def wrong_rows(results: DataFrame) -> DataFrame:
    return results.where(~is_correct())


def worst_rows(results: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` wrong rows with the lowest scores; a missing ``correct`` counts as right."""
    wrong = results.where(~F.coalesce(F.col("correct"), F.lit(True)))
    return wrong.orderBy(F.coalesce(F.col("score"), F.lit(0.0)), "sample_id").limit(n)


def is_artifact() -> Column:
    """A pie-chart failure with another slice within 5 points of the target.

    Slices equal to the target are all left out of the comparison, as is the target.
    """
    shares = F.from_json(F.get_json_object("params", "$.percentages"), "array<double>")
    target = F.coalesce(F.get_json_object("params", "$.target_pct").try_cast("double"), F.lit(0.0))

    def near(t: Column) -> Column:
        return F.exists(shares, lambda p: (p != t) & (F.abs(p - t) <= AMBIGUOUS_SLICE_POINTS))

    return (F.col("task_name") == "pie_chart") & F.coalesce(tx.let(target, near), F.lit(False))


def label_errors(results: DataFrame) -> DataFrame:
    label = error_type(
        F.col("task_name"), F.col("scorer"), F.col("parsed_answer"), F.col("ground_truth")
    )
    return with_fields(results, error_type=label)


def adjusted_ranking(results: DataFrame, k: int = 10) -> DataFrame:
    """The worst image tasks, with accuracy before and after artifacts are taken out."""
    artifact = ~is_correct() & is_artifact()
    counts = image_tasks_only(results).groupBy("task_name").agg(
        F.count("*").alias("n"),
        F.count_if(is_correct()).alias("n_correct"),
        F.count_if(artifact).alias("n_artifacts"),
    )
    return (
        counts.where(F.col("n_correct") < F.col("n"))
        .select(
            "task_name", "n", (F.col("n") - F.col("n_correct")).alias("n_fail"), "n_artifacts",
            (ratio("n_correct", "n") * 100).alias("raw_acc"),
            (F.try_divide(F.col("n_correct") + F.col("n_artifacts"), F.col("n")) * 100)
            .alias("adjusted_acc"),
        )
        .orderBy("raw_acc", "task_name")
        .limit(k)
    )


def diverse_failures(results: DataFrame, k: int = 5, order: str = "line_no") -> DataFrame:
    """Per task, up to ``k`` failures taken in turn from the error types, biggest type first.

    Ties between types go to the type seen first. A sample is used once per task: of several
    wrong rows with its id the first in ``order`` stands for it. The labelled rows are
    stored, so the answers are read and labelled once. Every ranking is a two-step top-k,
    so one dominant task or error type is never ranked in one task.
    """
    wrong = label_errors(wrong_rows(image_tasks_only(results)).where(~is_artifact()))
    wrong = wrong.select("task_name", "error_type", "sample_id", "parsed_answer", "ground_truth", order)
    same = Window.partitionBy("task_name", "sample_id").orderBy(F.col(order), "error_type", "parsed_answer", "ground_truth")
    wrong = wrong.withColumn("_turn", F.row_number().over(same)).where("_turn = 1").drop("_turn")
    wrong = stored(wrong, "failures")
    types = wrong.groupBy("task_name", "error_type").agg(
        F.count("*").alias("type_n"), F.min(order).alias("first_seen")
    )
    turns = top_k_per_group(
        wrong, ["task_name", "error_type"], [F.col(order), F.col("sample_id")], k, "turn"
    ).join(types, ["task_name", "error_type"])
    # the first k types are enough: each gives its first failure before any second turn
    return top_k_per_group(
        turns, ["task_name"],
        [F.col("turn"), F.desc("type_n"), F.col("first_seen"), F.col("error_type")],
        k, "pick",
    ).select(
        "task_name", "pick", "error_type", "type_n", "sample_id", "parsed_answer", "ground_truth"
    )


def first_failures(results: DataFrame, order: str = "line_no") -> DataFrame:
    """The first wrong row of each task, by an aggregate that combines before the shuffle."""
    first = F.min(F.struct(order, "sample_id", "ground_truth", "parsed_answer"))
    return wrong_rows(results).groupBy("task_name").agg(first.alias("f")).select(
        "task_name", "f.sample_id",
        *[
            F.when(F.length(F.col(f"f.{c}")) > 40, F.concat(F.substring(F.col(f"f.{c}"), 1, 37), F.lit("...")))
            .otherwise(F.col(f"f.{c}")).alias(c)
            for c in ("ground_truth", "parsed_answer")
        ],
    )


def leading_failures(results: DataFrame, rates: DataFrame, k: int = 4, order: str = "line_no") -> DataFrame:
    """The first ``k`` failures of every failing task with its failure rate."""
    picked = top_k_per_group(
        wrong_rows(results).select("task_name", "sample_id", order),
        ["task_name"], [F.col(order), F.col("sample_id")], k,
    )
    return picked.join(rates.select("task_name", "fail_rate"), "task_name").select(
        "task_name", "fail_rate", "rank", "sample_id"
    )
