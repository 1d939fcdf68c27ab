"""Reward columns for grid-size answers: outcome, worked steps and tool use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalloom.functions import text as tx
from evalloom.functions.extract import final_row_col

RewardColumn = Callable[[Column, Column], Column]

REWARDS: dict[str, RewardColumn] = {}


def register_reward(name: str) -> Callable[[RewardColumn], RewardColumn]:
    """Add a reward ``(response, truth) -> double Column`` under a name."""

    def keep(reward: RewardColumn) -> RewardColumn:
        REWARDS[name] = reward
        return reward

    return keep


# --- fixed values: patterns of worked steps and of tool blocks -----------------
LINES_TO_CELLS = (
    r"(?iU)(\d+)\s+(?:horizontal\s+|vertical\s+)?lines?"
    r"\s*(?:→|->|,\s*so|means?|make|gives?|creates?)\s*(\d+)\s+(?:rows?|columns?)"
)
MINUS_ONE = r"(?U)(\d+)\s*-\s*1\s*=\s*(\d+)"
LINES_THEN_CELLS = (
    r"(?isU)(\d+)\s+(?:horizontal\s+|vertical\s+)?lines?.{0,80}?(?:rows?|columns?)\s*=\s*(\d+)"
)
LINES_TO_DIMENSION = (
    r"(?iU)(\d+)\s+(?:horizontal\s+)?lines?"
    r"\s*(?:→|->|,\s*so|means?|make|gives?|creates?)\s*(\d+)\s+(rows?|columns?)"
)
MINUS_ONE_TAIL = r"(?U)(\d+)\s*-\s*1\s*=\s*(\d+)(?=([\s\S]{0,60}))"
CODE_BLOCK = r"(?i)```python"
OUTPUT_BLOCK = r"(?i)```output"
OUTPUT_TEXT = r"(?isU)```output\s*\n(.*?)```"
OUTPUT_ROWS = r"(?iU)(\d+)\s+rows?"
OUTPUT_COLS = r"(?iU)(\d+)\s+columns?"
OUTPUT_SIZE = r"(?U)(\d+)\s*[x×]\s*(\d+)"
SHOWS_SUBTRACTION = r"(?U)\d+\s*-\s*1\s*=\s*\d+"
SHOWS_LINES_TO_CELLS = r"(?iU)\d+\s+lines?\s*(?:→|->|,\s*so|means?)\s*\d+\s+(?:rows?|columns?)"
MAX_DISTANT_DIFFERENCE = 2
# -------------------------------------------------------------------------------


def line_cell_pairs(response: Column) -> Column:
    """Array of ``(lines, cells)`` structs stated in the worked steps."""

    def pairs(pattern: str) -> Column:
        # the text is searched once; the groups are read off the short matches
        return F.transform(
            tx.all_matches(response, pattern, 0),
            lambda m: F.struct(
                F.regexp_extract(m, pattern, 1).try_cast("bigint").alias("lines"),
                F.regexp_extract(m, pattern, 2).try_cast("bigint").alias("cells"),
            ),
        )

    distant = F.filter(
        pairs(LINES_THEN_CELLS),
        lambda p: F.abs(p["lines"] - p["cells"]) <= MAX_DISTANT_DIFFERENCE,
    )
    return F.concat(pairs(LINES_TO_CELLS), pairs(MINUS_ONE), distant)


@register_reward("outcome")
def outcome(response: Column, truth: Column) -> Column:
    """1 when the last stated size equals the truth."""
    return F.when(final_row_col(response) == truth, F.lit(1.0)).otherwise(F.lit(0.0))


def last_dimension_values(response: Column) -> Column:
    """Struct of the last ``row`` and ``col`` value derived in the worked steps (null if none)."""
    stated = F.transform(
        tx.all_matches(response, LINES_TO_DIMENSION, 0),
        lambda m: F.struct(
            F.regexp_extract(m, LINES_TO_DIMENSION, 2).alias("value"),
            F.lower(F.substring(F.regexp_extract(m, LINES_TO_DIMENSION, 3), 1, 3)).alias("axis"),
        ),
    )

    def nearest(tail: Column) -> Column:
        row_at = F.instr(F.lower(tail), F.lit("row"))
        col_at = F.instr(F.lower(tail), F.lit("col"))
        return F.when((row_at > 0) & ((col_at == 0) | (row_at < col_at)), "row").when(
            col_at > 0, "col"
        )

    derived = F.zip_with(
        tx.all_matches(response, MINUS_ONE_TAIL, 2),
        tx.all_matches(response, MINUS_ONE_TAIL, 3),
        lambda v, tail: F.struct(v.alias("value"), nearest(tail).alias("axis")),
    )

    def last(found: Column, axis: str) -> Column:
        chosen = F.filter(found, lambda s: s["axis"] == axis)
        return F.try_element_at(chosen, F.lit(-1))["value"].alias(axis)

    return tx.let(
        F.concat(stated, derived), lambda found: F.struct(last(found, "row"), last(found, "col"))
    )


def consistency(response: Column) -> Column:
    """0 when the last derived row or column value contradicts the final answer, else 1."""
    final = F.split(final_row_col(response), ",")

    def differs(value: Column, i: int) -> Column:
        # compared as numbers: "011" and "11" are the same count
        return F.coalesce(
            value.try_cast("bigint").cast("string") != F.get(final, F.lit(i)), F.lit(False)
        )

    return tx.let(
        last_dimension_values(response),
        lambda v: F.when(differs(v["row"], 0) | differs(v["col"], 1), F.lit(0.0)).otherwise(F.lit(1.0)),
    )


@register_reward("process")
def process(response: Column, truth: Column) -> Column:
    """Outcome plus a bonus for steps that apply cells = lines - 1 and match the answer."""
    won = outcome(response, truth)

    def share(pairs: Column) -> Column:
        good = F.array_size(F.filter(pairs, lambda p: p["cells"] == p["lines"] - 1))
        return F.try_divide(good, F.array_size(pairs))

    # without pairs the share is null and so is the bonus: the outcome is left
    bonus = F.lit(0.2) * tx.let(line_cell_pairs(response), share) * consistency(response)
    return F.greatest(won, F.lit(0.8) * won + bonus)


def has_code(response: Column) -> Column:
    return tx.has(response, CODE_BLOCK)


def fabricated(response: Column) -> Column:
    """Code was written but no output block follows."""
    return has_code(response) & ~tx.has(response, OUTPUT_BLOCK)


def tool_output_check(response: Column, truth: Column) -> Column:
    """Whether the first output block that states a size agrees with the truth; null if none."""
    want = F.split(truth, ",")
    want_rows, want_cols = F.get(want, F.lit(0)), F.get(want, F.lit(1))

    def verdict(block: Column) -> Column:
        rows, cols = tx.first_match(block, OUTPUT_ROWS), tx.first_match(block, OUTPUT_COLS)
        a, b = tx.first_match(block, OUTPUT_SIZE, 1), tx.first_match(block, OUTPUT_SIZE, 2)
        return F.when(
            rows.isNotNull() & cols.isNotNull(), (rows == want_rows) & (cols == want_cols)
        ).when(a.isNotNull(), (a == want_rows) & (b == want_cols))

    verdicts = F.transform(tx.all_matches(response, OUTPUT_TEXT), verdict)
    return F.get(F.array_compact(verdicts), F.lit(0))


@register_reward("tool_use")
def tool_use(response: Column, truth: Column) -> Column:
    """Outcome, lowered for made-up tool output and part-paid for a misread one."""
    won = outcome(response, truth)
    check = tool_output_check(response, truth)
    return (
        F.when(~has_code(response), won)
        .when(fabricated(response), won * F.lit(0.7))
        .when(check.isNull() | (won == 1.0), won)
        .when(check, F.lit(0.5))
        .otherwise(F.lit(0.0))
    )


def shows_subtraction(response: Column) -> Column:
    return tx.has(response, SHOWS_SUBTRACTION) | tx.has(response, SHOWS_LINES_TO_CELLS)
