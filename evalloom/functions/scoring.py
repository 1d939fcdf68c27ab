"""Scoring columns: one struct of score fields per scorer, chosen by scorer name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalloom.functions import text as tx

ColumnScorer = Callable[[Column, Column], Column]

SCORERS: dict[str, ColumnScorer] = {}

# Every scorer yields the same struct so that rows of all scorers share columns.
SCORE_FIELDS = {
    "correct": "boolean",
    "score": "double",
    "error": "bigint",
    "abs_error": "bigint",
    "row_correct": "boolean",
    "col_correct": "boolean",
    "precision": "double",
    "recall": "double",
}


def register_scorer(name: str) -> Callable[[ColumnScorer], ColumnScorer]:
    """Add a scorer ``(answer, truth) -> score_struct(...)`` under a name."""

    def keep(scorer: ColumnScorer) -> ColumnScorer:
        SCORERS[name] = scorer
        return scorer

    return keep


def score_struct(**fields: Column) -> Column:
    """Struct of all score fields; the ones not given are null."""
    return F.struct(
        *[
            fields.get(name, F.lit(None)).cast(kind).alias(name)
            for name, kind in SCORE_FIELDS.items()
        ]
    )


def _unit(correct: Column) -> Column:
    return F.when(correct, F.lit(1.0)).otherwise(F.lit(0.0))


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


@register_scorer("exact_match")
def exact_match(answer: Column, truth: Column) -> Column:
    correct = _yes(F.lower(tx.strip(answer)) == F.lower(tx.strip(truth)))
    return score_struct(correct=correct, score=_unit(correct))


@register_scorer("set_member")
def set_member(answer: Column, truth: Column) -> Column:
    correct = _yes(F.array_contains(tx.csv_items(truth), F.upper(tx.strip(answer))))
    return score_struct(correct=correct, score=_unit(correct))


@register_scorer("integer_distance")
def integer_distance(answer: Column, truth: Column) -> Column:
    """Signed error (positive = counted too many) and a score that decays with it."""
    # the difference is named once: in generated code Spark computes it once per row
    error = tx.to_int(answer) - tx.to_int(truth)
    return score_struct(
        correct=_yes(error == 0),
        score=F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.abs(error)), F.lit(0.0)),
        error=error,
        abs_error=F.abs(error),
    )


@register_scorer("row_col")
def row_col(answer: Column, truth: Column) -> Column:
    def read(text: Column) -> Column:
        # null unless there are exactly two integers
        parts = F.transform(F.split(text, ","), tx.to_int)
        return tx.let(
            parts, lambda p: F.when((F.array_size(p) == 2) & ~F.exists(p, lambda v: v.isNull()), p)
        )

    def judge(pair: Column) -> Column:
        rows = _yes(pair["got"][0] == pair["want"][0])
        cols = _yes(pair["got"][1] == pair["want"][1])
        return score_struct(
            correct=rows & cols,
            score=(rows.cast("int") + cols.cast("int")) / F.lit(2.0),
            row_correct=rows,
            col_correct=cols,
        )

    return tx.let(F.struct(read(answer).alias("got"), read(truth).alias("want")), judge)


def set_match_scorer(treat_none_as_empty: bool = False) -> ColumnScorer:
    """Unordered set comparison with precision and recall.

    Answer keys of set questions spell an empty set ``None``, which does not equal
    an empty answer. ``treat_none_as_empty`` makes the two equal.
    """

    def scorer(answer: Column, truth: Column) -> Column:
        got, want = tx.csv_items(answer), tx.csv_items(truth)
        if treat_none_as_empty:
            got, want = F.array_remove(got, "NONE"), F.array_remove(want, "NONE")
        sizes = tx.let(
            F.struct(got.alias("got"), want.alias("want")),
            lambda s: F.struct(
                F.array_size(s["got"]).alias("n_got"),
                F.array_size(s["want"]).alias("n_want"),
                F.array_size(F.array_intersect(s["got"], s["want"])).alias("hits"),
            ),
        )
        return tx.let(sizes, judge)

    def judge(sizes: Column) -> Column:
        n_got, n_want, hits = sizes["n_got"], sizes["n_want"], sizes["hits"]
        missing, zero, one = n_got.isNull(), F.lit(0.0), F.lit(1.0)
        empty = _unit(n_got == 0)
        precision = (
            F.when(missing, zero).when(n_want == 0, empty).when(n_got == 0, zero)
            .otherwise(F.try_divide(hits, n_got))
        )
        recall = (
            F.when(missing, zero).when(n_want == 0, one).when(n_got == 0, zero)
            .otherwise(F.try_divide(hits, n_want))
        )
        # the harmonic mean of hits/n_got and hits/n_want
        f1 = F.coalesce(F.try_divide(F.lit(2.0) * precision * recall, precision + recall), zero)
        return score_struct(
            correct=_yes(~missing & (hits == n_got) & (hits == n_want)),
            score=F.when(missing, zero).when(n_want == 0, empty).otherwise(f1),
            precision=precision,
            recall=recall,
        )

    return scorer


set_match = register_scorer("set_match")(set_match_scorer())


def score_by_name(
    scorer: Column,
    answer: Column,
    truth: Column,
    registry: dict[str, ColumnScorer] | None = None,
) -> Column:
    """Apply the scorer each row names; unknown names are wrong with score 0."""
    wrong = score_struct(correct=F.lit(False), score=F.lit(0.0))
    chain: Column | None = None
    for name, build in (registry or SCORERS).items():
        fields = build(answer, truth)
        chain = F.when(scorer == name, fields) if chain is None else chain.when(scorer == name, fields)
    return wrong if chain is None else chain.otherwise(wrong)


# --- fixed values: tasks whose wrong answers are compared letter by letter -----
READING_TASKS = ("text_degradation", "dense_text", "rotated_text", "highlighted_text")
PLAIN_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
# -------------------------------------------------------------------------------


def _number(text: Column) -> Column:
    bare = tx.strip(F.regexp_replace(text, ",", ""))
    return F.when(tx.has(bare, PLAIN_NUMBER), bare.try_cast("double"))


def _size_errors(answer: Column, truth: Column) -> Column:
    """``rows over by 2; cols under by 1`` for comma lists of integers, else null."""
    got, want = F.split(answer, ","), F.split(truth, ",")
    whole = F.forall(F.concat(got, want), lambda v: tx.to_int(v).isNotNull())
    n = F.least(F.array_size(got), F.array_size(want))
    errors = F.zip_with(
        F.slice(got, F.lit(1), n), F.slice(want, F.lit(1), n),
        lambda a, g: tx.to_int(a) - tx.to_int(g),
    )

    def label(e: Column, i: Column, size: Column) -> Column:
        axis = (
            F.when(size != 2, F.concat(F.lit("d"), i.cast("string")))
            .when(i == 0, "rows").otherwise("cols")
        )
        way = F.when(e > 0, " over by ").otherwise(" under by ")
        return F.when(e != 0, F.concat(axis, way, F.abs(e).cast("string")))

    labels = tx.let(
        errors, lambda es: F.transform(es, lambda e, i: label(e, i, F.array_size(es)))
    )
    both = F.contains(truth, F.lit(",")) & F.contains(answer, F.lit(","))
    return F.when(both & whole, F.nullif(F.array_join(labels, "; "), F.lit("")))


def _reading_error(answer: Column, truth: Column) -> Column:
    """Share of positions with the same letter, as a severity."""
    pairs = F.zip_with(
        F.split(F.lower(truth), ""), F.split(F.lower(answer), ""),
        lambda a, b: (a == b).cast("int"),
    )
    same = F.aggregate(pairs, F.lit(0), lambda total, v: total + F.coalesce(v, F.lit(0)))
    ratio = same / F.greatest(F.length(truth), F.length(answer), F.lit(1))
    return tx.let(
        ratio,
        lambda r: F.when(r < 0.3, "Hallucination").when(r < 0.8, "Major char errors")
        .otherwise("Minor char error"),
    )


def _set_errors(answer: Column, truth: Column) -> Column:
    def items(text: Column) -> Column:
        return F.array_distinct(F.split(F.lower(tx.strip(text)), r"(?U)\s*,\s*"))

    def listed(name: str, found: Column) -> Column:
        return F.when(
            F.array_size(found) > 0,
            F.concat(F.lit(name + ": "), F.array_join(F.array_sort(found), ",")),
        )

    extra = listed("extra", F.array_except(items(answer), items(truth)))
    missing = listed("missing", F.array_except(items(truth), items(answer)))
    return F.nullif(F.concat_ws("; ", extra, missing), F.lit(""))


def error_type(task: Column, scorer: Column, answer: Column, truth: Column) -> Column:
    """Short label saying how a wrong answer is wrong."""
    got = F.coalesce(answer, F.lit(""))
    want = F.coalesce(truth, F.lit(""))

    def direction(diff: Column) -> Column:
        amount = tx.format_general(diff)
        return (
            F.when(diff > 0, F.concat(F.lit("Overcount (+"), amount, F.lit(")")))
            .when(diff < 0, F.concat(F.lit("Undercount ("), amount, F.lit(")")))
        )

    count_error = tx.let(_number(got) - _number(want), direction)
    reading = F.when(task.isin(*READING_TASKS) & (want != ""), _reading_error(got, want))
    sets = F.when(scorer == "set_match", _set_errors(got, want))
    other = F.when(
        F.lower(want) != F.lower(got),
        F.concat(
            F.lit("Wrong (GT="), tx.clip(want, 25), F.lit(", got="), tx.clip(got, 25), F.lit(")")
        ),
    ).otherwise("Unknown")
    return F.when((got == "") | (got == "None"), "Parse failure").otherwise(
        F.coalesce(_size_errors(got, want), count_error, reading, sets, other)
    )


def failure_class(image_acc: Column, text_acc: Column) -> Column:
    """Why a task fails, from its image accuracy and its text control's accuracy."""
    gap = text_acc - image_acc
    return (
        F.when(image_acc.isNull() | text_acc.isNull(), "insufficient_data")
        .when(image_acc > 0.80, "not_a_failure")
        .when((text_acc > 0.80) & (gap > 0.15), "perceptual")
        .when((gap < 0.10) & (text_acc < 0.80), "reasoning")
        .when(gap >= 0.10, "mixed")
        .otherwise("reasoning")
    )


def gap_class(gap_points: Column) -> Column:
    """Gap in percentage points, text control minus image."""
    return (
        F.when(gap_points > 15, "perceptual").when(gap_points < -15, "reasoning")
        .otherwise("mixed")
    )


def accuracy_tier(accuracy: Column) -> Column:
    return (
        F.when(accuracy >= 0.95, "strong").when(accuracy >= 0.80, "good")
        .when(accuracy >= 0.60, "weak").otherwise("poor")
    )


def wilson_interval(correct: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper Wilson bounds of a proportion, clamped to [0, 1]; n = 0 gives (0, 0)."""
    n = total.cast("double")
    share = correct.cast("double") / n
    spread = F.lit(z * z)
    scale = F.lit(1.0) + spread / n
    centre = (share + spread / (F.lit(2.0) * n)) / scale
    half = (F.lit(z) / scale) * F.sqrt(
        share * (F.lit(1.0) - share) / n + spread / (F.lit(4.0) * n * n)
    )
    nonzero = total > 0
    low = F.when(nonzero, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0)
    high = F.when(nonzero, F.least(F.lit(1.0), centre + half)).otherwise(0.0)
    return low, high
