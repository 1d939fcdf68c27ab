"""Building manifests, multiple-choice prompts and worked-answer training rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom import dims
from evalloom.functions import text as tx
from evalloom.functions.prompts import fill
from evalloom.operators import cot_text
from evalloom.operators.sampling import hash_number, hash_text, pick


#: Combinations that one row opens into.
RANGE = 4_096


def sweep_axes(config: DataFrame) -> DataFrame:
    """Sweep rows ``(task_name, axis, axis_no, value, value_no)`` as one array of axes per task.

    A sweep is configuration: one row per axis value.
    """
    axis = config.groupBy("task_name", "axis_no", "axis").agg(
        F.array_sort(F.collect_set(F.struct("value_no", "value"))).alias("v")
    )
    entry = F.struct("axis_no", "axis", F.col("v.value").alias("values"))
    return axis.groupBy("task_name").agg(F.array_sort(F.collect_list(entry)).alias("axes"))


def sweep_combos(axes: DataFrame) -> DataFrame:
    """Every combination of a task's axis values over its defaults.

    A combination is numbered and its values are read off the number, digit by digit,
    so the product needs no join. Numbers are opened by ranges of ``RANGE``, which are spread
    before they are opened themselves, so a task with a large product is made by many
    tasks. The last axis changes fastest. ``axes`` may carry ``defaults`` (map); a task without axes gives its defaults once.
    """
    size = F.aggregate(
        "axes", F.lit(1).cast("bigint"), lambda acc, a: acc * F.array_size(a["values"])
    )
    ranges = axes.withColumn("n_combos", size).withColumn(
        "_range", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_combos") - 1) / RANGE)))
    ).where("n_combos > 0")
    first = F.col("_range") * RANGE
    combos = ranges.repartition("task_name", "_range").withColumn(
        "combo", F.explode(F.sequence(first, F.least(first + RANGE, F.col("n_combos")) - 1))
    )

    def value(axis: Column, i: Column) -> Column:
        later = F.slice("axes", i + 2, F.array_size("axes"))
        stride = F.aggregate(
            later, F.lit(1).cast("bigint"), lambda acc, a: acc * F.array_size(a["values"])
        )
        at = F.pmod(F.floor(F.col("combo") / stride), F.array_size(axis["values"])).cast("int")
        return F.struct(axis["axis"].alias("k"), F.get(axis["values"], at).alias("v"))

    names = F.col("axes.axis")
    params = F.map_from_entries(F.transform("axes", value))
    if "defaults" in axes.columns:
        kept = F.map_filter("defaults", lambda k, _: ~F.array_contains(names, k))
        params = F.map_concat(kept, params)
    made = combos.select(
        "task_name", "combo", "n_combos", names.alias("axis_names"), params.alias("params")
    )
    return made.withColumnsRenamed({"axis_names": "axes"})


def replicas(n_combos: Column, min_samples: int = 50, max_per: int = 20) -> Column:
    """Samples per combination: enough for the minimum, at least 1, at most ``max_per``."""
    return F.least(
        F.greatest(F.lit(1), F.ceil(F.lit(float(min_samples)) / n_combos)), F.lit(max_per)
    ).cast("bigint")


def combos_to_keep(n_combos: Column, n_per: Column, max_total: int) -> Column:
    """Combinations left after capping a task's rows."""
    return F.when(
        n_combos * n_per > max_total,
        F.greatest(F.lit(1), F.floor(F.lit(max_total) / n_per)),
    ).otherwise(n_combos).cast("bigint")


def expand_replicas(combos: DataFrame, n_per: Column) -> DataFrame:
    """``n_per`` rows per combination with a repeatable id and seed."""
    rows = combos.withColumn(
        "replica", F.explode(F.sequence(F.lit(0).cast("bigint"), n_per - 1))
    )
    key = (F.col("task_name"), F.col("combo"), F.col("replica"))
    return rows.withColumn(
        "sample_id", F.substring(hash_text("sample", *key), 1, 8)
    ).withColumn("seed", F.pmod(hash_number("seed", *key), F.lit(2**31)))


def drop_repeats(rows: DataFrame) -> DataFrame:
    """For renderers without a seed: one row per (parameters, truth), the lowest id."""
    params = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("params")),
            lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))),
        ),
        ";",
    )
    return (
        rows.groupBy("task_name", params.alias("params_key"), "ground_truth")
        .agg(F.min("sample_id").alias("sample_id"))
    )


def distractors(
    key: Column, correct: Column, others: Column, n: int = 3, spacing: float = 0.15,
    seed: int = 42,
) -> Column:
    """Up to ``n`` wrong values, each well away from the right one and from each other.

    Candidates are, in turn: the other values shown, shares of the right value, and
    steps away from it. ``others`` is the short list of values in one picture.
    """
    everything = F.concat(F.array(correct), others)

    def spanned(values: Column) -> Column:
        return F.when(F.array_size(others) > 0, F.array_max(values) - F.array_min(values)).otherwise(
            F.coalesce(F.nullif(F.abs(correct), F.lit(0.0)), F.lit(10.0))
        )

    def shuffled(values: Column, salt: str) -> Column:
        keyed = F.transform(
            values,
            lambda v, i: F.struct(hash_text(f"{seed}{salt}", key, i).alias("h"), v.alias("v")),
        )
        return F.sort_array(keyed)["v"]

    offsets = F.array(*[F.lit(o) for o in dims.DISTRACTOR_OFFSETS])
    moved = F.transform(
        shuffled(offsets, "offset"),
        lambda o: F.bround(F.when(correct != 0, correct * (o + 1)).otherwise(o * 10)),
    )
    candidates = F.concat(shuffled(others, "other"), moved)

    def choose(limit: Column, step: Column) -> Column:
        def take(chosen: Column, v: Column) -> Column:
            fits = (F.array_size(chosen) <= n) & F.forall(chosen, lambda e: F.abs(v - e) >= limit)
            return F.when(fits, F.array_append(chosen, v)).otherwise(chosen)

        steps = F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.lit(19)),
                lambda d: F.array(correct + d * step, correct - d * step),
            )
        )
        # the steps are made only where the others do not give enough
        return tx.let(
            F.aggregate(candidates, F.array(correct), take),
            lambda found: F.when(F.array_size(found) > n, found).otherwise(F.aggregate(steps, found, take)),
        )

    def with_gap(gap: Column) -> Column:
        limits = F.struct(
            F.greatest(gap, F.lit(1.0)).alias("least"), F.greatest(F.floor(gap), F.lit(2)).cast("double").alias("step")
        )
        return tx.let(limits, lambda of: choose(of["least"], of["step"]))

    return F.slice(tx.let(tx.let(everything, spanned) * spacing, with_gap), 2, n)


def _shown(value: Column) -> Column:
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(
        value.cast("string")
    )


def money(value: Column) -> Column:
    """Dollars with thousands, to the nearest even dollar."""
    return F.concat(F.when(value < 0, F.lit("$-")).otherwise(F.lit("$")), F.format_number(F.bround(F.abs(value), 0), 0))


def choice_prompt(
    key: Column, question: Column, correct: Column, wrong: Column, seed: int = 42,
    value_format: Callable[[Column], Column] = _shown,
) -> Column:
    """Struct ``(prompt, letter)`` with the options in hashed order, each shown by ``value_format``."""
    options = F.concat(
        F.array(F.struct(correct.alias("value"), F.lit(True).alias("right"))),
        F.transform(
            F.slice(wrong, 1, 3), lambda v: F.struct(v.alias("value"), F.lit(False).alias("right"))
        ),
    )
    mixed = F.sort_array(
        F.transform(
            options,
            lambda o, i: F.struct(
                hash_text(f"{seed}choice", key, i).alias("h"), o["value"].alias("value"),
                o["right"].alias("right"),
            ),
        )
    )
    letters = F.array(*[F.lit(v) for v in "ABCD"])

    def shown(mixed: Column) -> Column:
        lines = F.transform(
            mixed,
            lambda o, i: F.concat(F.lit("("), F.get(letters, i), F.lit(") "), value_format(o["value"])),
        )
        at = F.array_position(mixed["right"], True) - 1
        return F.struct(
            F.concat_ws("\n", F.array(question), lines, F.array(F.lit(dims.CHOICE_CLOSING))).alias("prompt"),
            F.get(letters, at.cast("int")).alias("letter"),
        )

    return tx.let(mixed, shown)


def seed_split(seed: Column) -> Column:
    """Which split a seed belongs to; null between the ranges."""
    name = F.lit(None).cast("string")
    for split, low, high in dims.SEED_SPLITS:
        inside = (seed >= low) if high is None else (seed >= low) & (seed < high)
        name = F.when(inside, split).otherwise(name)
    return name


def sft_strategy(seed: Column) -> Column:
    name = F.lit(None).cast("string")
    for strategy, low, high in dims.SFT_SEED_RANGES:
        name = F.when((seed >= low) & (seed < high), strategy).otherwise(name)
    return name


def seed_leaks(rows: DataFrame) -> DataFrame:
    """Seeds that occur in more than one declared split (min and max differ)."""
    return (
        rows.groupBy("seed")
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
        .where(F.col("first_split") != F.col("last_split"))
    )


def grid_sketch(rows: Column, cols: Column, limit: int = 8) -> Column:
    """Text picture of a grid, cut at ``limit`` rows and columns with dots."""
    wide = F.when(cols > limit, " ...").otherwise("")
    shown_cols = F.least(cols, F.lit(limit)).cast("int")
    shown_rows = F.least(rows, F.lit(limit)).cast("int")
    bar = F.concat(F.lit("+"), F.repeat(F.lit("---+"), shown_cols), wide)
    cells = F.concat(F.lit("|"), F.repeat(F.lit("   |"), shown_cols), wide)
    body = F.array_repeat(F.concat(cells, F.lit("\n"), bar), shown_rows)
    tail = F.when(rows > limit, F.array(F.lit("  ..."))).otherwise(F.array().cast("array<string>"))
    return F.concat_ws("\n", F.array(bar), body, tail)


def fill_worked_answer(template: Column, rows: Column, cols: Column) -> Column:
    """Put the numbers of a grid into a worked-answer template; doubled braces become single."""
    values = {
        "rows": rows, "cols": cols, "h_lines": rows + 1, "v_lines": cols + 1,
        "h_interior": rows - 1, "v_interior": cols - 1,
    }
    text = template
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    text = F.replace(text, F.lit("{ascii_sketch}"), grid_sketch(rows, cols))
    return F.replace(F.replace(text, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))


def insert_correction(text: Column, rows: Column) -> Column:
    """Add a self-correction after the first line naming the horizontal line count."""
    count = (rows + 1).cast("string")
    note = fill(cot_text.CORRECTION, h_lines=count, rows=rows.cast("string"))

    def place(lines: Column) -> Column:
        names_count = F.filter(
            F.transform(
                lines,
                lambda line, i: F.when(
                    F.contains(F.lower(line), F.lit("horizontal")) & F.contains(line, count), i + 1
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return tx.let(F.get(names_count, F.lit(0)), lambda at: insert(lines, at))

    def insert(lines: Column, at: Column) -> Column:
        rest = F.slice(lines, at + 1, F.array_size(lines))
        with_note = F.concat(F.slice(lines, F.lit(1), at), F.array(note), rest)
        return F.array_join(F.coalesce(with_note, lines), "\n")

    return tx.let(F.split(text, "\n"), place)


def training_rows(seeds: DataFrame) -> DataFrame:
    """Worked-answer rows from ``(seed, strategy)``; every choice is a hash of the seed."""
    seed, strategy = F.col("seed"), F.col("strategy")
    start = F.lit(0)
    for name, low, _ in dims.SFT_SEED_RANGES:
        start = F.when(strategy == name, low).otherwise(start)
    skip = (strategy == "tool_use") & (seed - start < 200)
    kind = F.when(skip, "tool_use_skip").otherwise(strategy)
    low, size = F.lit(None).cast("int"), F.lit(None).cast("int")
    for name, (a, b) in dims.GRID_RANGES.items():
        low = F.when(kind == name, a).otherwise(low)
        size = F.when(kind == name, b - a + 1).otherwise(size)
    cell = pick(size * size, "size", seed)
    staged = seeds.select(
        "seed", "strategy", skip.alias("is_skip"), kind.alias("kind"),
        (low + F.floor(cell / size)).cast("bigint").alias("rows"),
        (low + F.pmod(cell, size)).cast("bigint").alias("cols"),
    )
    dense = F.greatest("rows", "cols") > 15
    resolution = F.when(
        dense, F.get(F.array(*[F.lit(v) for v in (512, 768, 1024)]), pick(3, "resolution", seed).cast("int"))
    ).otherwise(
        F.get(F.array(*[F.lit(v) for v in (384, 512, 768)]), pick(3, "resolution", seed).cast("int"))
    )
    stretch = [
        F.round(0.85 + pick(3001, f"stretch{i}", seed) / 10000, 4).alias(f"stretch_{i}")
        for i in ("width", "height")
    ]
    template = F.lit(None).cast("string")
    for name, texts in cot_text.TEMPLATES.items():
        chosen = F.get(
            F.array(*[F.lit(t) for t in texts]), pick(len(texts), "template", seed).cast("int")
        )
        template = F.when(F.col("kind") == name, chosen).otherwise(template)
    corrected = (strategy == "direct") & (pick(100, "correct", seed) < 20)
    filled = staged.withColumn(
        "steps", fill_worked_answer(template, F.col("rows"), F.col("cols"))
    ).withColumn("self_correction", corrected)
    answer = F.concat(
        F.lit("rows="), F.col("rows").cast("string"), F.lit(" columns="),
        F.col("cols").cast("string"),
    )
    return filled.select(
        "seed", "strategy", "is_skip", F.lit(cot_text.QUESTION).alias("prompt"),
        F.when(F.col("self_correction"), insert_correction(F.col("steps"), F.col("rows")))
        .otherwise(F.col("steps")).alias("chain_of_thought"),
        answer.alias("answer"),
        F.concat_ws(",", F.col("rows").cast("string"), F.col("cols").cast("string")).alias("ground_truth"),
        "rows", "cols", resolution.cast("bigint").alias("resolution"),
        (pick(3, "line", seed) + 1).alias("line_width"),
        *[pick(31, f"pad{side}", seed).alias(f"pad_{side}") for side in ("top", "right", "bottom", "left")],
        pick(4, "background", seed).alias("background"), *stretch, "self_correction",
    )
