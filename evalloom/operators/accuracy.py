"""Accuracy tables. Every table starts from one partial-aggregated tally of the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom import dims
from evalloom.functions import scoring
from evalloom.operators.evaluate import normalise_reasoning, without_reasoning
from evalloom.storage import stored

TEXT_SUFFIX = "_text"


def is_correct() -> Column:
    return F.coalesce(F.col("correct"), F.lit(False))


def ratio(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part), F.col(whole))


def tally(results: DataFrame, *keys: str) -> DataFrame:
    """Counts per group: rows, right answers, missing answers, summed and counted errors.

    The one pass over the results. Sums are combined before the shuffle, so a task
    holding a third of the rows reaches the reducer as one row per input partition.
    """
    errors = F.col("error") if "error" in results.columns else F.lit(None).cast("bigint")
    answer = F.col("parsed_answer") if "parsed_answer" in results.columns else F.lit("")
    return results.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(is_correct()).alias("n_correct"),
        F.count_if(answer.isNull()).alias("n_unparsed"),
        F.sum(errors).alias("error_sum"),
        F.count(errors).alias("error_n"),
    )


def _with_interval(counts: DataFrame) -> DataFrame:
    low, high = scoring.wilson_interval(F.col("n_correct"), F.col("n"))
    return (
        counts.withColumn("accuracy", ratio("n_correct", "n"))
        .withColumn("ci_lo", low)
        .withColumn("ci_hi", high)
    )


def accuracy_summary(results: DataFrame) -> DataFrame:
    """Accuracy with interval, parse-failure rate and mean error per task, and a total row."""
    rolled = (
        tally(results, "task_name")
        .rollup("task_name")
        .agg(
            *[
                F.sum(c).alias(c)
                for c in ("n", "n_correct", "n_unparsed", "error_sum", "error_n")
            ]
        )
        .withColumn("task_name", F.coalesce("task_name", F.lit("TOTAL")))
    )
    return _with_interval(rolled.where(F.col("n") > 0)).select(
        "task_name", "n", F.col("n_correct").alias("correct"), "accuracy", "ci_lo", "ci_hi",
        ratio("n_unparsed", "n").alias("parse_fail_rate"),
        ratio("error_sum", "error_n").alias("mean_error"),
    )


def task_stats(results: DataFrame) -> DataFrame:
    """Accuracy per task with the widths of its error bars and its tier."""
    stats = _with_interval(tally(results, "task_name"))
    return stats.select(
        "task_name", "n", "n_correct", "accuracy", "ci_lo", "ci_hi",
        F.greatest(F.col("accuracy") - F.col("ci_lo"), F.lit(0.0)).alias("err_lo"),
        F.greatest(F.col("ci_hi") - F.col("accuracy"), F.lit(0.0)).alias("err_hi"),
        scoring.accuracy_tier(F.col("accuracy")).alias("tier"),
    )


def _side_by_side(counts: DataFrame, key: str, flag: Column, left: str, right: str) -> DataFrame:
    """Conditional sums in place of a join: one row per key with both sides."""

    def side(value: str, name: str, wanted: bool) -> Column:
        chosen = flag if wanted else ~flag
        return F.coalesce(F.sum(F.when(chosen, F.col(value))), F.lit(0)).alias(name)

    return counts.groupBy(key).agg(
        side("n", f"n_{left}", False), side("n_correct", f"correct_{left}", False),
        side("n", f"n_{right}", True), side("n_correct", f"correct_{right}", True),
    )


def reasoning_comparison(results: DataFrame) -> DataFrame:
    """Accuracy with and without reasoning per task; delta only where both exist.

    The total row's delta takes an empty side as 0.
    """
    counts = tally(normalise_reasoning(results), "task_name", "reasoning_mode")
    per_task = _side_by_side(counts, "task_name", F.col("reasoning_mode"), "plain", "reasoning")
    rolled = per_task.rollup("task_name").agg(
        *[F.sum(c).alias(c) for c in per_task.columns if c != "task_name"]
    )
    plain, reasoned = ratio("correct_plain", "n_plain"), ratio("correct_reasoning", "n_reasoning")
    zero = F.lit(0.0)
    return rolled.where(F.col("n_plain").isNotNull()).select(
        F.coalesce("task_name", F.lit("TOTAL")).alias("task_name"),
        "n_plain", plain.alias("acc_plain"), "n_reasoning", reasoned.alias("acc_reasoning"),
        F.when(
            F.col("task_name").isNull(), F.coalesce(reasoned, zero) - F.coalesce(plain, zero)
        ).otherwise(reasoned - plain).alias("delta"),
    )


def strategy_label(results: DataFrame) -> DataFrame:
    """The single strategy name of a run, or ``strategy`` when there is none or several."""
    return results.agg(
        F.when(F.min("strategy") == F.max("strategy"), F.max("strategy"))
        .otherwise("strategy").alias("label")
    )


def image_tasks_only(results: DataFrame) -> DataFrame:
    return results.where(~F.endswith("task_name", F.lit(TEXT_SUFFIX)))


def strategy_comparison(baseline: DataFrame, strategy: DataFrame) -> DataFrame:
    """Both accuracies, delta and status per image task found in both runs, and a total row.

    Both runs are tallied first, so only one small row per task is joined.
    """
    both = (
        tally(image_tasks_only(baseline), "task_name")
        .select("task_name", F.col("n").alias("n_base"), F.col("n_correct").alias("correct_base"))
        .join(
            tally(image_tasks_only(strategy), "task_name").select(
                "task_name", F.col("n").alias("n_strategy"),
                F.col("n_correct").alias("correct_strategy"),
            ),
            "task_name",
        )
    )
    rolled = both.rollup("task_name").agg(
        *[F.sum(c).alias(c) for c in both.columns if c != "task_name"]
    )
    base, strat = ratio("correct_base", "n_base"), ratio("correct_strategy", "n_strategy")
    return (
        rolled.where(F.col("n_base").isNotNull())
        .select(
            "task_name", "n_base", base.alias("acc_base"),
            "n_strategy", strat.alias("acc_strategy"), (strat - base).alias("delta"),
        )
        .withColumn(
            "status",
            F.when(F.col("task_name").isNull(), F.lit(None).cast("string"))
            .when(F.col("delta") > 0.005, "improved")
            .when(F.col("delta") < -0.005, "regressed")
            .otherwise("same"),
        )
        .withColumn("task_name", F.coalesce("task_name", F.lit("TOTAL")))
    )


def status_counts(comparison: DataFrame) -> DataFrame:
    return comparison.agg(
        F.count_if(F.col("status") == "improved").alias("improved"),
        F.count_if(F.col("status") == "regressed").alias("regressed"),
        F.count_if(F.col("status") == "same").alias("unchanged"),
    )


def count_bias(results: DataFrame, by: str = "task_name") -> DataFrame:
    """Mean signed error and the shares counted too many, too few and exactly."""
    known = results.where(F.col("error").isNotNull())

    def share(condition: Column) -> Column:
        return F.try_divide(F.count_if(condition), F.count("*"))

    error = F.col("error")
    return known.groupBy(by).agg(
        F.try_divide(F.sum(error), F.count("*")).alias("mean_error"),
        share(error > 0).alias("overcount_rate"),
        share(error < 0).alias("undercount_rate"),
        share(error == 0).alias("exact_rate"),
    )


def _accuracy_pairs(results: DataFrame, spark: SparkSession, extended: bool) -> DataFrame:
    acc = tally(results, "task_name").select("task_name", ratio("n_correct", "n").alias("acc"))
    pairs = F.broadcast(dims.clutter_pairs(spark, extended))
    clean = acc.select(F.col("task_name").alias("clean_task"), F.col("acc").alias("clean_acc"))
    business = acc.select(
        F.col("task_name").alias("business_task"), F.col("acc").alias("business_acc")
    )
    return (
        pairs.join(clean, "clean_task", "left").join(business, "business_task", "left")
        .select(
            "clean_task", "business_task", "primitive", "clean_acc", "business_acc",
            (F.col("business_acc") - F.col("clean_acc")).alias("gap"),
        )
    )


def clutter_tax(results: DataFrame) -> DataFrame:
    """Clean task against the same skill in a business picture, without reasoning rows."""
    return _accuracy_pairs(without_reasoning(results), results.sparkSession, False)


def clutter_tax_all(results: DataFrame) -> DataFrame:
    """All rows, one more pair, and only pairs that have both sides."""
    return _accuracy_pairs(results, results.sparkSession, True).where(F.col("gap").isNotNull())


def family_accuracy(results: DataFrame) -> DataFrame:
    """Record-level accuracy per task family and per task within it."""
    counts = tally(results, "task_name").join(
        F.broadcast(dims.families(results.sparkSession)), "task_name", "left"
    )
    counts = counts.withColumn("category", F.coalesce("category", F.lit("Other")))
    return (
        counts.groupingSets(
            [["category"], ["category", "task_name"]], "category", "task_name"
        )
        .agg(F.sum("n").alias("n"), F.sum("n_correct").alias("n_correct"))
        .select("category", "task_name", "n", "n_correct", ratio("n_correct", "n").alias("accuracy"))
    )


def failure_rates(results: DataFrame) -> DataFrame:
    return (
        tally(results, "task_name")
        .select("task_name", (F.col("n") - F.col("n_correct")).alias("n_fail"),
                F.col("n").alias("n_total"))
        .where(F.col("n_fail") > 0)
        .withColumn("fail_rate", ratio("n_fail", "n_total"))
    )


def overview(results: DataFrame) -> DataFrame:
    """Rows, failures, failure rate and number of tasks, from the per-task tally."""
    return tally(results, "task_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.col("n") - F.col("n_correct")).alias("n_failures"),
        F.try_divide(F.sum(F.col("n") - F.col("n_correct")), F.sum("n")).alias("failure_rate"),
        F.count("task_name").alias("n_tasks"),
    )


def error_profile(results: DataFrame, size: Column) -> DataFrame:
    """Correlation of size with absolute error, and the directions of the count errors."""
    error = F.col("error")
    known = F.count(error)
    x = F.when(error.isNotNull(), size.cast("double"))
    y = F.when(x.isNotNull(), F.abs(error).cast("double"))
    # corr() itself fails on a constant side; here that gives null
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(y)
    return results.groupBy("task_name").agg(
        F.try_divide(F.covar_pop(x, y), spread).alias("size_error_corr"),
        F.try_divide(F.count_if(error > 0), known).alias("over_share"),
        F.try_divide(F.count_if(error < 0), known).alias("under_share"),
    )


def echo_rate(results: DataFrame, value: Column) -> DataFrame:
    """Share of failures that answer with a given parameter's value."""
    failed = results.where(~is_correct())
    return failed.groupBy("task_name").agg(
        F.count("*").alias("n_fail"),
        F.try_divide(
            F.count_if(F.col("parsed_answer") == value.cast("string")), F.count("*")
        ).alias("echo_share"),
    )


def wording_profile(results: DataFrame, phrases: list[str]) -> DataFrame:
    """Hedging in failures, and mean thinking length of right and wrong answers."""
    text = F.lower("thinking_text")
    hedged = F.lit(False)
    for phrase in phrases:
        hedged = hedged | F.coalesce(F.contains(text, F.lit(phrase)), F.lit(False))
    wrong = ~is_correct()
    length = F.length("thinking_text")
    return results.groupBy("task_name").agg(
        F.try_divide(F.count_if(wrong & hedged), F.count_if(wrong)).alias("hedge_share"),
        F.avg(F.when(is_correct(), length)).alias("mean_len_correct"),
        F.avg(F.when(wrong, length)).alias("mean_len_wrong"),
    )


def pass_at_k(attempts: DataFrame, by: list[str], k: int) -> DataFrame:
    """pass@1 and pass@k per group over samples; ``keep`` when pass@k exceeds 20 percent."""
    idx = F.col("attempt_idx")
    per_sample = attempts.groupBy(*by, "sample_id").agg(
        F.max((is_correct() & (idx < 1)).cast("int")).alias("p1"),
        F.max((is_correct() & (idx < k)).cast("int")).alias("pk"),
    )
    return (
        per_sample.groupBy(*by)
        .agg(
            F.count("*").alias("n_samples"),
            F.avg("p1").alias("pass_at_1"),
            F.avg("pk").alias("pass_at_k"),
        )
        .withColumn("keep", F.col("pass_at_k") > 0.20)
    )


def confusion(results: DataFrame) -> DataFrame:
    """Counts per task of (predicted, truth) for integer answers, with the marginals.

    Only cells that occur are listed; ``confusion_table`` has the square. Tasks with fewer than 5 pairs or a non-integer
    truth or answer are left out.
    """
    answered = F.col("answered")
    cells = results.select(
        "task_name",
        F.col("parsed_answer").isNotNull().alias("answered"),
        F.col("parsed_answer").try_cast("bigint").alias("predicted"),
        F.col("ground_truth").try_cast("bigint").alias("truth"),
    ).groupBy("task_name", "predicted", "truth").agg(
        F.count_if(answered).alias("n"),
        F.count_if(F.col("truth").isNull() | (answered & F.col("predicted").isNull())).alias("bad"),
    )
    fit = cells.groupBy("task_name").agg(F.sum("n").alias("pairs"), F.sum("bad").alias("bad"))
    fit = fit.where((F.col("pairs") >= 5) & (F.col("bad") == 0)).select("task_name")
    # both sides use both counts, so Spark aggregates the rows once
    counted = cells.where((F.col("n") > 0) & (F.col("bad") == 0)).drop("bad")
    return counted.join(fit, "task_name", "left_semi")


#: Labels of a block of a square table.
LABELS = 1_024


def confusion_table(results: DataFrame, block: int = LABELS) -> DataFrame:
    """Square table per task in long form: every pair of its labels, zero where nothing was counted.

    The labels of a task are all that occur in it, as truth or as prediction. They are dealt into blocks of
    about ``block``, and one pair of blocks is filled at a time, so no task holds the labels of a whole
    table; a task of few labels is one block.
    """
    cells = stored(confusion(results).select("task_name", "predicted", "truth", "n"), "confusion")
    labels = cells.select("task_name", F.explode(F.array("predicted", "truth")).alias("label")).distinct()
    dealt = labels.join(labels.groupBy("task_name").agg(F.ceil(F.count("*") / block).alias("_blocks")), "task_name")
    own = F.pmod(F.xxhash64("label"), F.col("_blocks"))
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))
    down = dealt.select("task_name", F.col("label").alias("predicted"), own.alias("_i"), each.alias("_j"))
    across = dealt.select("task_name", F.col("label").alias("truth"), own.alias("_j"), each.alias("_i"))
    square = down.join(across, ["task_name", "_i", "_j"]).drop("_i", "_j")
    return square.join(cells, ["task_name", "predicted", "truth"], "left").select(
        "task_name", "predicted", "truth", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )
