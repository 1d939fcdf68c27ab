"""Writing results, traces, manifests and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from evalloom.batches import Batches
from evalloom.operators.diagnostics import report_json, size_table
from evalloom.operators.evaluate import trace
from evalloom.operators.failures import worst_rows


def append_results(results: DataFrame, path: str, file_format: str = "json", batch_id: str | None = None) -> bool:
    """Append rows; whether anything was written.

    With a ``batch_id`` the append can be repeated: the rows are a batch of ``path`` (``batches``), written and
    committed once, and the same id again writes nothing. ``readers.read_batches`` reads such a path.
    Without one, repeating an append doubles its rows.
    """
    if batch_id is not None:
        return Batches(results.sparkSession, path, file_format).add(results, batch_id)
    results.write.mode("append").format(file_format).save(path)
    return True


def write_trace(results: DataFrame, path: str) -> None:
    """Narrow trace log; absent values are left out of each line."""
    trace(results).write.mode("append").option("ignoreNullFields", "true").json(path)


def combine_manifests(manifests: list[DataFrame]) -> DataFrame:
    """All rows of several manifests; columns one of them lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), manifests)


def write_failures(results: DataFrame, path: str, n: int = 20) -> None:
    """The ``n`` worst rows as one small file."""
    worst_rows(results, n).coalesce(1).write.mode("overwrite").json(path)


def write_by_task(rows: DataFrame, path: str, by: str = "task_name", batch_id: str | None = None) -> None:
    """One directory per task or strategy, so later reads prune.

    Rows are rebalanced by task first: otherwise every task of the job would leave a small
    file in every directory. Adaptive execution splits a dominant task over several files.
    What was at ``path`` is replaced; with a ``batch_id`` the rows are added as a batch, once.
    """
    rows = rows.hint("rebalance", by)
    if batch_id is not None:
        Batches(rows.sparkSession, path, "json").add(rows, batch_id, [by])
    else:
        rows.write.mode("overwrite").partitionBy(by).json(path)


def write_report(prof: DataFrame, path: str, sizes_path: str | None = None) -> None:
    """The report as one line of JSON; the accuracies of all sizes beside it, where a place is given."""
    if sizes_path is not None:
        size_table(prof).write.mode("overwrite").json(sizes_path)
    report_json(prof).coalesce(1).write.mode("overwrite").text(path)
