"""Recomputing answer keys from the payload a manifest row stores in ``params``.

One row's payload is one picture's content (a dozen edges, items or cells), so these
are row-local columns: no shuffle, whatever the size of the manifest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions import text as tx
from evalloom.functions.extract import PARSERS
from evalloom.functions.scoring import SCORERS
from evalloom.operators.columns import with_fields

KEYS: dict[str, Callable[[], Column]] = {}


def answer_key(*tasks: str) -> Callable[[Callable[[], Column]], Callable[[], Column]]:
    """Register a column that recomputes the key of the named tasks."""

    def keep(build: Callable[[], Column]) -> Callable[[], Column]:
        for task in tasks:
            KEYS[task] = build
        return build

    return keep


def payload(name: str, kind: str = "string") -> Column:
    value = F.get_json_object("params", f"$.{name}")
    if kind == "string":
        return value
    if kind.startswith(("array", "map", "struct")):
        return F.from_json(value, kind)
    return value.try_cast(kind)


def _ask(pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract("prompt", pattern, group), F.lit(""))


def terminals(edges: Column, start: Column) -> Column:
    """Dead-end nodes reachable from a start, sorted; the start itself without out-edges.

    ``edges`` is an array of ``[from, to]``. Each step adds the targets of everything
    reached so far; as many steps as edges are always enough, and a cycle does no harm.
    """

    def walk(es: Column) -> Column:
        def grow(reached: Column, _: Column) -> Column:
            onward = F.filter(es, lambda e: F.array_contains(reached, e[0]))
            return F.array_union(reached, F.transform(onward, lambda e: e[1]))

        reached = F.aggregate(es, F.array(start), grow)
        return F.array_sort(F.array_except(reached, F.transform(es, lambda e: e[0])))

    return tx.let(edges, walk)


@answer_key("arrow_following")
def arrow_key() -> Column:
    return F.array_join(terminals(payload("edges", "array<array<string>>"), payload("start_box")), ",")


def members(regions: Column, wanted: Callable[[Column], Column]) -> Column:
    """Sorted items of an item-to-region map whose set names satisfy a condition."""
    chosen = F.map_filter(regions, lambda _, region: wanted(F.split(region, " ∩ ")))
    return F.array_sort(F.map_keys(chosen))


@answer_key("venn_diagram", "venn_diagram_text")
def venn_key() -> Column:
    regions = payload("item_regions", "map<string,string>")
    kind = payload("question_type")

    def asked(pattern: str, *groups: int) -> Column:
        return F.array(*[_ask(pattern, i) for i in groups])

    both = tx.let(
        asked(r"in BOTH (.+?) AND (.+?)\?", 1, 2),
        lambda q: members(
            regions, lambda s: F.array_contains(s, q[0]) & F.array_contains(s, q[1])
        ),
    )
    only = tx.let(
        asked(r"ONLY in (.+?) and not", 1), lambda q: members(regions, lambda s: s == q)
    )
    minus = tx.let(
        asked(r"are in (.+?) but NOT in (.+?)\?", 1, 2),
        lambda q: members(
            regions, lambda s: F.array_contains(s, q[0]) & ~F.array_contains(s, q[1])
        ),
    )
    items = (
        F.when(kind == "intersection", both).when(kind == "exclusive", only)
        .when(kind == "union_minus", minus)
    )
    return F.when(F.array_size(items) > 0, F.array_join(items, ", ")).when(
        items.isNotNull(), "None"
    )


def crossings(a: Column, b: Column) -> Column:
    """Sign changes of ``a - b``; zeros carry the sign before them."""
    signs = F.filter(F.zip_with(a, b, lambda x, y: F.signum(x - y)), lambda s: s != 0)
    size = F.array_size(signs)
    pairs = F.zip_with(
        F.slice(signs, F.lit(1), F.greatest(size - 1, F.lit(0))),
        F.slice(signs, F.lit(2), F.greatest(size - 1, F.lit(0))),
        lambda x, y: x != y,
    )
    return F.array_size(F.filter(pairs, lambda changed: changed))


@answer_key("line_chart_crossing")
def crossing_key() -> Column:
    return crossings(
        payload("series_a", "array<double>"), payload("series_b", "array<double>")
    ).cast("string")


@answer_key("counting_grid", "counting_grid_text")
def grid_key() -> Column:
    rows, cols = payload("rows", "bigint"), payload("cols", "bigint")
    merges = payload("merges", "array<array<bigint>>")
    absorbed = F.aggregate(
        merges, F.lit(0).cast("bigint"), lambda acc, m: acc + m[2] * m[3] - 1
    )
    kind = payload("question_type")
    return (
        F.when(kind == "grid_size", F.concat(rows.cast("string"), F.lit(","), cols.cast("string")))
        .when(kind == "total_cells", (rows * cols - absorbed).cast("string"))
        .when(kind == "merged_count", F.array_size(merges).cast("string"))
    )


@answer_key("table_cell_read")
def cell_key() -> Column:
    table = payload("table", "array<array<string>>")
    row, col = payload("target_row", "int"), payload("target_col", "int")
    return F.try_element_at(F.try_element_at(table, row), col)


@answer_key("merged_cell_read")
def merged_key() -> Column:
    """Label of the merged region the prompt points at (counted from 1 in the prompt)."""
    merges = payload("merges", "array<struct<r:int,c:int,sr:int,sc:int,label:string>>")
    row = F.coalesce(_ask(r"in row (\d+)", 1), _ask(r"spans rows (\d+)-", 1)).try_cast("int") - 1
    col = F.coalesce(_ask(r"spans columns (\d+)-", 1), _ask(r"in column (\d+)", 1)).try_cast("int") - 1

    def covering(cell: Column) -> Column:
        row_no, col_no = cell["row"], cell["col"]
        return F.filter(
            merges,
            lambda m: (row_no >= m["r"]) & (row_no < m["r"] + m["sr"])
            & (col_no >= m["c"]) & (col_no < m["c"] + m["sc"]),
        )

    asked = F.struct(row.alias("row"), col.alias("col"))
    return F.get(tx.let(asked, covering), F.lit(0))["label"]


def _sorted_words(name: str) -> Column:
    return F.array_join(tx.sort_ignoring_case(payload(name, "array<string>")), ",")


@answer_key("form_checkboxes")
def checkbox_key() -> Column:
    return F.array_join(F.array_sort(payload("checked_letters", "array<string>")), ",")


@answer_key("color_coded_cells")
def colour_key() -> Column:
    return F.array_join(F.array_sort(payload("target_cells", "array<string>")), ",")


@answer_key("highlighted_text")
def highlight_key() -> Column:
    return _sorted_words("highlighted_words")


@answer_key("strikethrough")
def strike_key() -> Column:
    return _sorted_words("struck_words")


@answer_key("colored_paths_text")
def path_key() -> Column:
    """Paths that run from the first queried station to the second."""
    paths = payload("path_details", "array<struct<color:string,`from`:string,`to`:string>>")
    a = _ask(r"direct paths connect (.+?) to (.+?)\?", 1)
    b = _ask(r"direct paths connect (.+?) to (.+?)\?", 2)
    ends = F.struct(a.alias("a"), b.alias("b"))
    direct = tx.let(
        ends, lambda q: F.filter(paths, lambda p: (p["from"] == q["a"]) & (p["to"] == q["b"]))
    )
    return F.array_size(direct).cast("string")


@answer_key("touching_circles")
def touching_key() -> Column:
    return F.when(payload("distance", "double") <= 0, "Yes").otherwise("No")


@answer_key("edge_crossing")
def adjacency_key() -> Column:
    """Whether the queried pair is an edge, in either direction."""
    edges = payload("edges", "array<array<string>>")
    query = payload("query", "array<string>")
    linked = F.array_contains(edges, query) | F.array_contains(edges, F.reverse(query))
    return F.when(linked, "Yes").otherwise("No")


def whole_percentages(raw: Column) -> Column:
    """Integer shares of an array of amounts, the rounding remainder put on the first."""

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: acc + v)

    shares = tx.let(
        total(raw), lambda t: F.transform(raw, lambda v: F.bround(v / t * 100).cast("bigint"))
    )
    return tx.let(
        shares,
        lambda s: F.concat(F.array(s[0] + 100 - total(s)), F.slice(s, 2, F.array_size(s))),
    )


def percentages_add_up() -> Column:
    shares = payload("percentages", "array<bigint>")
    return F.aggregate(shares, F.lit(0).cast("bigint"), lambda acc, v: acc + v) == 100


def audit_manifest(manifest: DataFrame) -> DataFrame:
    """Add ``expected`` (null where no rule applies) and ``matches``."""
    chain: Column | None = None
    for task, build in KEYS.items():
        here = F.col("task_name") == task
        chain = F.when(here, build()) if chain is None else chain.when(here, build())
    return with_fields(manifest, expected=chain).withColumn(
        "matches", F.col("expected") == F.col("ground_truth")
    )


def row_problems(manifest: DataFrame) -> DataFrame:
    """Rows without a prompt, or with a parser or scorer that is not registered."""
    problems = F.array_compact(
        F.array(
            F.when(F.col("prompt").isNull(), "no prompt"),
            F.when(~F.coalesce(F.col("parser").isin(*PARSERS), F.lit(False)), "unknown parser"),
            F.when(~F.coalesce(F.col("scorer").isin(*SCORERS), F.lit(False)), "unknown scorer"),
        )
    )
    return manifest.select("sample_id", "task_name", problems.alias("problems")).where(
        F.array_size("problems") > 0
    )


def class_balance(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("task_name", "ground_truth").agg(F.count("*").alias("n"))


def repeated_ids(manifest: DataFrame) -> DataFrame:
    return (
        manifest.groupBy("sample_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    )
