"""Where intermediate tables go: the shared folder the cluster names."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    A session that does not name one gets a folder in its warehouse. On a cluster that must be in a store
    which executors and driver share: a warehouse in a machine's own files is refused there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme()
    if store == "file" and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one written table, deleted by ``release`` at the latest on exit."""
    path = f"{shared_folder(spark)}/evalloom/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Used where several later steps read one intermediate table: it is computed once, its
    plan ends there, and losing an executor does not bring the work back.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete every table written so far; frames that read them are of no use afterwards."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        jvm = getattr(spark.sparkContext, "_jvm", None)
        if jvm is None or spark.sparkContext._jsc is None:
            continue
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _release_on_exit() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001  the session has ended before; nothing can be deleted then
        _WRITTEN.clear()
