"""Comparisons across strategies, runs and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom import dims
from evalloom.functions import text as tx
from evalloom.operators.accuracy import image_tasks_only, is_correct, ratio, tally


def _percent(results: DataFrame, *keys: str) -> DataFrame:
    return tally(results, *keys).select(
        *keys, "n", "n_correct", (ratio("n_correct", "n") * 100).alias("acc")
    )


def task_matrix(
    results: DataFrame, across: str, names: list[str], missing: float | None = None
) -> DataFrame:
    """One row per image task, one accuracy column per strategy or model.

    The names are given, so no extra job finds them; a name in the data that is not among
    them fails the job instead of going unseen. ``missing`` fills empty cells.
    """
    unlisted = F.raise_error(F.concat(F.lit(f"not a listed {across}: "), F.col(across)))
    known = F.when(F.col(across).isNull() | F.col(across).isin(*names), F.col(across)).otherwise(unlisted)
    wide = (
        _percent(image_tasks_only(results), "task_name", across).withColumn(across, known)
        .groupBy("task_name").pivot(across, names).agg(F.max("acc"))
    )
    return wide if missing is None else wide.fillna(missing, names)


def best_strategies(results: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Best strategy per image task; ties go to the earlier name. Delta against baseline.

    Strategies that are not among the names take part too, behind them in ties.
    """
    ranks = F.broadcast(dims.strategy_ranks(results.sparkSession, names))
    acc = _percent(image_tasks_only(results).where("strategy IS NOT NULL"), "task_name", "strategy").join(ranks, "strategy", "left")
    acc = acc.withColumn("rank", F.coalesce("rank", F.lit(len(names or dims.STRATEGIES))))
    best = F.max(F.struct("acc", (-F.col("rank")).alias("order"), "strategy"))
    baseline = F.max(F.when(F.col("strategy") == "baseline", F.col("acc")))
    return (
        acc.groupBy("task_name")
        .agg(best.alias("b"), F.coalesce(baseline, F.lit(0.0)).alias("baseline_acc"))
        .select(
            "task_name", F.col("b.strategy").alias("best_strategy"),
            F.col("b.acc").alias("best_acc"),
            (F.col("b.acc") - F.col("baseline_acc")).alias("delta"),
        )
    )


def _with_baseline_delta(means: DataFrame) -> DataFrame:
    """Add the difference to the baseline row.

    ``means`` has one row per strategy, so all of it fits one short list, which is
    opened again with the baseline taken out of it.
    """
    listed = means.agg(F.collect_list(F.struct("strategy", "mean_acc")).alias("all"))
    base = F.get(F.filter("all", lambda s: s["strategy"] == "baseline"), F.lit(0))["mean_acc"]
    opened = listed.select(F.explode("all").alias("s"), base.alias("base"))
    return opened.select("s.*", (F.col("s.mean_acc") - F.col("base")).alias("delta"))


def strategy_means(results: DataFrame) -> DataFrame:
    """Record-level mean per strategy, text controls left out."""
    means = _percent(image_tasks_only(results), "strategy").select(
        "strategy", F.col("acc").alias("mean_acc")
    )
    delta = F.col("delta")
    arrow = F.when(delta > 0, "↑").when(delta < 0, "↓").when(delta == 0, "→")
    return _with_baseline_delta(means).withColumn("direction", arrow)


def strategy_task_means(
    results: DataFrame, tasks: list[str], names: list[str]
) -> DataFrame:
    """Mean over a fixed task list per strategy; a missing task counts as 0.

    Listed strategies without results get 0, and strategies with results need not be listed.
    """
    acc = _percent(results.where(F.col("task_name").isin(*tasks)), "task_name", "strategy")
    sums = acc.groupBy("strategy").agg((F.sum("acc") / len(tasks)).alias("mean_acc"))
    listed = dims.strategy_ranks(results.sparkSession, names)
    means = listed.join(sums.where("strategy IS NOT NULL"), "strategy", "full").select(
        "strategy", F.coalesce("mean_acc", F.lit(0.0)).alias("mean_acc")
    )
    return _with_baseline_delta(means).orderBy("delta", "strategy")


def oracle_mean(best: DataFrame) -> DataFrame:
    """Mean over tasks of the best strategy's accuracy."""
    return best.agg(F.avg("best_acc").alias("oracle_mean"), F.count("*").alias("n_tasks"))


def routing_gain(
    results: DataFrame, tasks: list[str], routes: dict[str, str] | None = None
) -> DataFrame:
    """Baseline against adaptive per task; gains of 3 points or more are labelled."""
    acc = _percent(
        results.where(
            F.col("task_name").isin(*tasks) & F.col("strategy").isin("baseline", "adaptive")
        ),
        "task_name", "strategy",
    )

    def side(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("strategy") == name, F.col("acc"))), F.lit(0.0))

    routed = tx.lookup(F.col("task_name"), routes or dims.ROUTES, dims.DEFAULT_ROUTE)
    both = acc.groupBy("task_name").agg(
        side("baseline").alias("baseline_acc"), side("adaptive").alias("adaptive_acc")
    )
    delta = F.col("adaptive_acc") - F.col("baseline_acc")
    return both.select(
        "task_name", "baseline_acc", "adaptive_acc", delta.alias("delta"),
        routed.alias("route"),
        (F.abs(delta) >= 3).alias("labelled"),
    )


def _side_by_side(results: DataFrame, first: str, second: str, base: str) -> DataFrame:
    """``task_name, a, b, c``: who is right on each sample and task of the base run."""
    model = F.col("model")

    def right(name: str) -> Column:
        return F.coalesce(F.max(F.when(model == name, is_correct())), F.lit(False))

    # the task is a key, so that only flags are aggregated
    return (
        results.where(model.isin(first, second, base))
        .groupBy("sample_id", "task_name")
        .agg(F.count_if(model == base).alias("n_base"), right(first).alias("a"), right(second).alias("b"), right(base).alias("c"))
        .where(F.col("n_base") > 0)
    )


def right_answers(results: DataFrame, first: str, second: str, base: str) -> DataFrame:
    """How many of the base run's samples each of two other runs has right, per task."""
    return _side_by_side(results, first, second, base).groupBy("task_name").agg(
        F.count_if("a").alias("a_right"), F.count_if("b").alias("b_right"), F.count("*").alias("n")
    )


def model_agreement(results: DataFrame, first: str, second: str, base: str) -> DataFrame:
    """Who is right on the same sample: two models of one family against a base model.

    The runs are folded by sample and task with conditional aggregates of flags, which is
    one shuffle in place of two joins. A sample missing in a run counts as wrong there;
    samples missing in the base run are left out. ``rest`` are the samples the base
    model shares with exactly one of the two.
    """
    per_sample = _side_by_side(results, first, second, base)
    a, b, c = F.col("a"), F.col("b"), F.col("c")

    def share(condition: Column) -> Column:
        return F.avg(condition.cast("int")) * 100

    return per_sample.groupBy("task_name").agg(
        F.count("*").alias("n"),
        share(a & b & c).alias("all_correct"),
        share((a | b) & ~c).alias("family_only"),
        share(c & ~a & ~b).alias("base_only"),
        share(~a & ~b & ~c).alias("all_wrong"),
        share(c & (a != b)).alias("rest"),
    )
