"""Geometry and ordered-series operators whose groups may be very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.storage import stored

# --- fixed values: how far inside both segments a crossing must lie --------------
INNER_LOW, INNER_HIGH = 0.05, 0.95
PARALLEL = 1e-10
# ---------------------------------------------------------------------------------
_SLACK = 1e-7
#: Segments of a cell that are compared with each other.
CELL = 64
#: Bands of a group that are ordered together.
STRETCH = 4_096


def _within(low: Column, high: Column) -> tuple[Column, Column, Column]:
    """The part of a segment over an x-range: its x from, and its least and greatest y there."""
    x_low, x_high = F.least("x1", "x2"), F.greatest("x1", "x2")
    slope = F.try_divide(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))

    def height(x: Column) -> Column:
        at = F.col("y1") + slope * (F.least(F.greatest(x, x_low), x_high) - F.col("x1"))
        return F.least(F.greatest(at, F.least("y1", "y2")), F.greatest("y1", "y2"))

    upright = slope.isNull()
    a = F.when(upright, F.col("y1")).otherwise(height(low))
    b = F.when(upright, F.col("y2")).otherwise(height(high))
    return F.least(a, b), F.greatest(a, b), (a + b) / 2


def _slack() -> Column:
    """How far off a computed place on a segment may be."""
    size = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    return _SLACK * size + 1e-12 * F.greatest(F.abs("x1"), F.abs("x2"), F.abs("y1"), F.abs("y2"))


def _split(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of ``rows`` cut at quartiles of what lies in them, and every segment in the parts it passes through."""
    low, high = F.greatest(F.least("x1", "x2"), F.col("from_x")), F.least(F.greatest("x1", "x2"), F.col("to_x"))
    _, _, mid_y = _within(low, high)
    mid_y = F.least(F.greatest(mid_y, F.col("from_y")), F.col("to_y"))
    quartiles = [F.lit(q) for q in (0.25, 0.5, 0.75)]
    cuts = rows.groupBy(*keys, "cell").agg(
        F.array_distinct(F.percentile_approx((low + high) / 2, F.array(*quartiles))).alias("cuts_x"),
        F.array_distinct(F.percentile_approx(mid_y, F.array(*quartiles))).alias("cuts_y"),
    )

    def part(value: Column, cuts: str) -> Column:
        return F.size(F.filter(cuts, lambda c: c <= value))

    def parts(first: Column, last: Column, cuts: str) -> Column:
        return F.explode(F.sequence(part(F.least(first, last) - _slack(), cuts), part(F.greatest(first, last) + _slack(), cuts)))

    def bounds(at: str, cuts: str, start: str, end: str) -> tuple[Column, Column]:
        i = F.col(at)
        return F.when(i == 0, F.col(start)).otherwise(F.get(cuts, i - 1)), F.coalesce(F.get(cuts, i), F.col(end))

    across = rows.join(cuts, [*keys, "cell"]).withColumn("_i", parts(low, high, "cuts_x"))
    from_x, to_x = bounds("_i", "cuts_x", "from_x", "to_x")
    across = across.withColumns({"from_x": from_x, "to_x": to_x})
    least, greatest, _ = _within(F.col("from_x") - _slack(), F.col("to_x") + _slack())
    least, greatest = F.greatest(least, F.col("from_y")), F.least(greatest, F.col("to_y"))
    down = across.withColumn("_j", parts(least, greatest, "cuts_y"))
    from_y, to_y = bounds("_j", "cuts_y", "from_y", "to_y")
    cell = F.concat("cell", F.hex(F.col("_i") * 4 + F.col("_j")))
    return down.withColumns({"from_y": from_y, "to_y": to_y, "cell": cell, "before": F.col("n")}).drop("cuts_x", "cuts_y", "_i", "_j", "n")


def _sized(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``n``, how many segments are in the cell."""
    return rows.join(rows.groupBy(*keys, "cell").agg(F.count("*").alias("n")), [*keys, "cell"])


def cells_of(segments: DataFrame, keys: list[str], most: int = CELL) -> DataFrame:
    """Every segment in the cells it passes through: ``cell``, its bounds, and ``n``, how many segments are in it at most.

    A figure is one cell without bounds at first. Cells of more than ``most`` segments are cut in up to
    sixteen at quartiles of what is in them, so a far outlier only gets a cell of its own, and
    the parts are looked at again, a stored round each. A cell that its cuts have left nearly as full, as
    many segments meet in one place there, stays as it is.
    """
    named = segments.select(*keys, "edge", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    far = F.lit(float("inf"))
    rows = named.select(
        "*", F.lit("").alias("cell"), (-far).alias("from_x"), far.alias("to_x"), (-far).alias("from_y"), far.alias("to_y"),
        F.lit(1 << 62).alias("before"),
    )
    done: DataFrame | None = None
    full = (F.col("n") > most) & (F.col("n") <= 0.8 * F.col("before"))
    while True:
        sizes = rows.groupBy(*keys, "cell").agg(F.count("*").alias("n"), F.max("before").alias("before"))
        fullest = sizes.agg(F.max("n").alias("n"), F.count_if(full).alias("full")).first()
        if not fullest["full"]:
            bounded = (fullest["n"] or 0) <= most
            last = rows.withColumn("n", F.lit(fullest["n"] or 0).cast("bigint")) if bounded else _sized(rows, keys)
            return last if done is None else done.unionByName(last)
        held = stored(_sized(rows, keys), "segment-cells")
        small = held.where(~full)
        done = small if done is None else done.unionByName(small)
        rows = stored(_split(held.where(full), keys), "segment-parts")


def crossing_segments(segments: DataFrame, keys: list[str], most: int = CELL) -> DataFrame:
    """Pairs of segments of one figure that cross well inside both.

    ``segments``: keys, ``edge`` (number), ``x1, y1, x2, y2``. Only segments of one cell (``cells_of``) are
    compared, so a figure with a third of all segments is spread over its cells. A pair is
    kept in the one cell that holds its crossing point, which makes the result free of repeats. Cells that
    could not be made small are dealt into blocks of ``most``, and a task compares two blocks.
    """
    cells = cells_of(segments, keys, most)
    blocks = F.ceil(F.col("n") / most)
    cells = cells.withColumns({"block": F.pmod(F.xxhash64("edge"), blocks), "other": F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))})
    a, b = cells.alias("a"), cells.select(*keys, "cell", "block", "other", "edge", "x1", "y1", "x2", "y2").alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "cell")]
    same += [F.col("a.block") == F.col("b.other"), F.col("a.other") == F.col("b.block")]
    dx1, dy1 = F.col("a.x1") - F.col("a.x2"), F.col("a.y1") - F.col("a.y2")
    dx2, dy2 = F.col("b.x1") - F.col("b.x2"), F.col("b.y1") - F.col("b.y2")
    ox, oy = F.col("a.x1") - F.col("b.x1"), F.col("a.y1") - F.col("b.y1")
    turn = dx1 * dy2 - dy1 * dx2
    t = F.try_divide(ox * dy2 - oy * dx2, turn)
    u = -F.try_divide(dx1 * oy - dy1 * ox, turn)
    pairs = a.join(b, [*same, F.col("a.edge") < F.col("b.edge")]).select(
        *[F.col(f"a.{k}").alias(k) for k in keys],
        F.col("a.edge").alias("edge_a"), F.col("b.edge").alias("edge_b"),
        "from_x", "to_x", "from_y", "to_y",
        turn.alias("turn"), t.alias("t"), u.alias("u"),
        (F.col("a.x1") - t * dx1).alias("x"), (F.col("a.y1") - t * dy1).alias("y"),
    )
    inner = (F.abs("turn") >= PARALLEL) & (F.col("t") > INNER_LOW) & (F.col("t") < INNER_HIGH) \
        & (F.col("u") > INNER_LOW) & (F.col("u") < INNER_HIGH)
    at_home = (F.col("x") >= F.col("from_x")) & (F.col("x") < F.col("to_x")) & (F.col("y") >= F.col("from_y")) & (F.col("y") < F.col("to_y"))
    return pairs.where(inner & at_home).select(*keys, "edge_a", "edge_b", "x", "y")


def adjacent(pairs: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs ``(a, b)`` that are an edge in either direction.

    Both sides are put in one order, so one equi-join answers both directions.
    """

    def ordered(df: DataFrame, x: str, y: str) -> DataFrame:
        return df.withColumns({"lo": F.least(x, y), "hi": F.greatest(x, y)})

    known = ordered(edges, "src", "dst").select(*keys, "lo", "hi")
    return ordered(pairs, "a", "b").join(known, [*keys, "lo", "hi"], "left_semi").drop("lo", "hi")


def covering_merge(cells: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """The merged rectangle covering each (row, col).

    Rectangles of a table do not overlap, so they hold at most the table's cells. They
    are opened into cells and matched by equality in place of a range join.
    """
    opened = (
        merges.withColumn("row", F.explode(F.sequence(F.col("r"), F.col("r") + F.col("sr") - 1)))
        .withColumn("col", F.explode(F.sequence(F.col("c"), F.col("c") + F.col("sc") - 1)))
        .select(*keys, "row", "col", "label")
    )
    return cells.join(opened, [*keys, "row", "col"])


def sign_changes(series: DataFrame, keys: list[str], position: str, value: str, stretch: int) -> DataFrame:
    """Number of sign changes along each series; zeros carry the sign before them.

    A series is cut into stretches of ``stretch`` positions that are counted on their
    own; the stretches' first and last signs then settle the seams. No task holds a
    whole series, only one row per stretch.
    """
    signed = series.select(
        *keys, F.col(position).alias("p"), F.signum(value).alias("s"),
        F.floor(F.col(position) / stretch).alias("part"),
    ).where(F.col("s") != 0)
    inside = Window.partitionBy(*keys, "part").orderBy("p")
    parts = (
        signed.withColumn("before", F.lag("s").over(inside))
        .groupBy(*keys, "part")
        .agg(
            F.count_if(F.col("before") != F.col("s")).alias("changes"),
            F.min_by("s", "p").alias("head"), F.max_by("s", "p").alias("tail"),
        )
    )
    along = Window.partitionBy(*keys).orderBy("part")
    return (
        parts.withColumn("seam", F.lag("tail").over(along) != F.col("head"))
        .groupBy(*keys)
        .agg((F.sum("changes") + F.count_if("seam")).alias("sign_changes"))
    )


def cluster_levels(boxes: DataFrame, keys: list[str], floor: float = 15.0) -> DataFrame:
    """Levels of boxes: a new one starts where the gap between centres exceeds the limit.

    The limit is half the mean height of the group, at least ``floor``. Centres in one
    band of that width can never be a limit apart, so bands are aggregated first and
    only bands are ordered, by stretches of ``STRETCH`` bands. Returns one row per level with its count and extent.
    """
    limits = boxes.groupBy(*keys).agg(
        F.greatest(F.avg("height") * 0.5, F.lit(floor)).alias("limit")
    )
    bands = (
        boxes.join(limits, keys)
        .withColumn("band", F.floor(F.col("y") / F.col("limit")))
        .groupBy(*keys, "band")
        .agg(
            F.min("y").alias("low"), F.max("y").alias("high"), F.count("*").alias("n"),
            F.first("limit").alias("limit"),
        )
    )
    # bands are settled within stretches of them, and stretches at their seams
    bands = bands.withColumn("stretch", F.floor(F.col("band") / STRETCH))
    order = Window.partitionBy(*keys, "stretch").orderBy("band")
    starts = F.coalesce(F.col("low") - F.lag("high").over(order) > F.col("limit"), F.lit(False))
    bands = bands.withColumn("starts", starts.cast("bigint"))
    parts = bands.groupBy(*keys, "stretch").agg(
        F.sum("starts").alias("inside"), F.min("low").alias("head"), F.max("high").alias("tail"), F.first("limit").alias("wide")
    )
    along = Window.partitionBy(*keys).orderBy("stretch")
    seam = F.coalesce(F.col("head") - F.lag("tail").over(along) > F.col("wide"), F.lit(True)).cast("bigint")
    parts = parts.withColumn("seam", seam)
    so_far = F.sum(F.col("inside") + F.col("seam")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = parts.select(*keys, "stretch", (so_far - F.col("inside")).alias("first_level"))
    inner = F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        bands.withColumn("step", inner).join(parts, [*keys, "stretch"])
        .withColumn("level", F.col("first_level") + F.col("step"))
        .groupBy(*keys, "level")
        .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    )


def height_up_to(segments: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Stacked height of each bar up to and including its target segment.

    Only the sum to the target is needed, so it is a conditional sum that combines
    before the shuffle, not a running total over the whole bar.
    """
    upto = F.when(F.col("segment") <= F.col("target"), F.col("value")).otherwise(0)
    return (
        segments.join(targets, keys).groupBy(*keys, "target").agg(F.sum(upto).alias("height"))
    )


def peak_series(values: DataFrame, keys: list[str]) -> DataFrame:
    """The series with the highest value per figure; ties go to the first name."""
    peaks = values.groupBy(*keys, "series").agg(F.max("value").alias("peak"))
    best = F.min(F.struct((-F.col("peak")).alias("order"), "series", "peak"))
    return peaks.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.series", "b.peak")
