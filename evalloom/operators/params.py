"""Task parameters: flattening, typed filters and accuracy by parameter value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions import text as tx
from evalloom.operators.accuracy import is_correct

_NOT_SCALAR = ("STRING", "ARRAY", "OBJECT")


_OBJECT = "map<string,variant>"


def leaves(params: Column) -> Column:
    """``array<struct<param, value>>`` of a JSON text: its leaves by name, nested names joined by dots.

    Values stay variants, so their JSON type is kept. Objects are opened at every level, however deep, and
    lists stay whole. How many levels a text has is read off its own shape, so deep texts cost
    their own rows more and nobody else's. A null value is a leaf, an empty object one without a
    value; a text that is no object or cannot be read has none.
    """

    def entries(value: Column, prefix: Column | None) -> Column:
        name = lambda key: key if prefix is None else F.concat(prefix, F.lit("."), key)
        return F.transform(F.map_entries(F.try_variant_get(value, "$", _OBJECT)), lambda e: F.struct(name(e["key"]).alias("param"), e["value"].alias("value")))

    def opened(leaf: Column) -> Column:
        empty = F.array(F.struct(leaf["param"].alias("param"), F.lit(None).cast("variant").alias("value")))
        return tx.let(
            entries(leaf["value"], leaf["param"]),  # null for all that is no object
            lambda inside: F.when(inside.isNull(), F.array(leaf)).when(F.size(inside) > 0, inside).otherwise(empty),
        )

    def found(v: Column, shape: Column) -> Column:
        top = F.when(F.startswith(shape, F.lit("OBJECT")), entries(v, None))
        # the number of objects in the shape bounds their depth
        objects = ((F.length(shape) - F.length(F.replace(shape, F.lit("OBJECT<"), F.lit("")))) / 7).cast("int")
        deep = F.aggregate(F.sequence(F.lit(2), objects), top, lambda held, _: F.flatten(F.transform(held, opened)))
        return F.when(objects > 1, deep).otherwise(top)

    return tx.let(F.try_parse_json(params), lambda v: tx.let(F.schema_of_variant(v), lambda shape: found(v, shape)))


def flatten_params(results: DataFrame) -> DataFrame:
    """Long form of ``params``: one row per leaf (``leaves``), opened within its row; one pass, no join."""
    return results.withColumn("_leaves", leaves(F.col("params"))).select(*results.columns, F.inline("_leaves"))


def param_strings(results: DataFrame) -> DataFrame:
    """``flatten_params`` with the value as text and its JSON type beside it."""
    flat = flatten_params(results)
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    return flat.withColumn("value_type", kind).withColumn(
        "value", F.col("value").try_cast("string")
    )


def list_length(results: DataFrame, name: str) -> DataFrame:
    """Length of a list parameter; null when it is absent or not a list."""
    value = F.get_json_object("params", f"$.{name}")
    return results.withColumn(f"{name}_length", F.json_array_length(value))


def accuracy_by_param(results: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows and accuracy per (task, parameter, value).

    A parameter of a task is reported when none of its values is a string, list or
    object and it takes more than one value. ``pairs`` restricts to listed curves.
    """
    flat = param_strings(results.select("task_name", "correct", "params"))
    if pairs is not None:
        wanted = F.concat_ws("|", "task_name", "param").isin(*[f"{t}|{p}" for t, p in pairs])
        flat = flat.where(wanted)
    # texts and lists only disqualify their parameter: they need no groups of their own
    other = F.col("value_type").isin(*_NOT_SCALAR)
    flat = flat.withColumns({"other": other, "value": F.when(~other, F.col("value"))})
    cells = flat.groupBy("task_name", "param", "value").agg(
        F.count("*").alias("n"),
        F.count_if(is_correct()).alias("n_correct"),
        F.count_if("other").alias("n_other"),
        F.count("value").alias("n_value"),
    )
    # both sides of the join use all four counts, so Spark aggregates the rows once
    whole = cells.groupBy("task_name", "param").agg(
        F.sum("n").alias("param_n"),
        F.try_divide(F.sum("n_correct"), F.sum("n")).alias("param_accuracy"),
        F.sum("n_other").alias("others"),
        F.count_if(F.col("n_value") > 0).alias("values"),
    )
    return (
        cells.join(whole, ["task_name", "param"])
        .where((F.col("others") == 0) & (F.col("values") > 1))
        .where((F.col("n_value") > 0) & (F.col("n_other") == 0))
        .select(
            "task_name", "param", "value", "n",
            F.try_divide("n_correct", "n").alias("accuracy"), "param_n", "param_accuracy",
        )
    )


def accuracy_by_two(results: DataFrame, x: str, y: str) -> DataFrame:
    """Rows and accuracy per (task, value of x, value of y)."""
    picked = results.select(
        "task_name", "correct",
        F.get_json_object("params", f"$.{x}").alias("x_value"),
        F.get_json_object("params", f"$.{y}").alias("y_value"),
    ).where(F.col("x_value").isNotNull() & F.col("y_value").isNotNull())
    return picked.groupBy("task_name", "x_value", "y_value").agg(
        F.count("*").alias("n"),
        F.try_divide(F.count_if(is_correct()), F.count("*")).alias("accuracy"),
    )
