"""Scoring raw responses as they arrive, once per sample."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalloom import schemas
from evalloom.operators.evaluate import evaluate

#: Ids seen live in RocksDB on the executors and only what a batch changes is uploaded, so a batch costs what it brings.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def scored(spark: SparkSession, sink: str) -> DataFrame | None:
    """All scored rows with their ``batch_id``; None before the first batch."""
    try:
        return spark.read.parquet(sink)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def score_stream(
    spark: SparkSession, source: str, sink: str, checkpoint: str, repeats_within: str | None = None, **trigger
) -> StreamingQuery:
    """Extract and score new response files once per ``sample_id``.

    The ids of earlier batches are keyed state of the stream (``STATE`` is set on the session), so a
    batch looks up its own ids and reads nothing that was written before, whatever the
    history. Every batch overwrites its own ``batch_id`` directory: one that is run again after a failure
    starts from the state before it, and nothing is stored twice. Of several rows of one id in
    one batch any one is kept. Null ids count as one id.

    Ids are kept for ever, as responses carry no event time. With ``repeats_within`` (such as ``"30 days"``)
    files count from their modification time, and an id is forgotten so long after it came; files
    older than that when they are found are left out.

    A sink belongs to one checkpoint. Started with another one, a stream would know none of
    the sink's ids and overwrite its first batches, so that is an error.
    """
    if not _exists(spark, f"{checkpoint}/offsets") and scored(spark, sink) is not None:
        raise ValueError(f"{sink} has batches that the checkpoint {checkpoint} does not know")
    for name, value in STATE.items():
        spark.conf.set(name, value)

    def handle(batch: DataFrame, batch_id: int) -> None:
        evaluate(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    responses = spark.readStream.schema(schemas.RESPONSES).json(source)
    if repeats_within is None:
        once = responses.dropDuplicates(["sample_id"])
    else:
        arrived = responses.select("*", F.col("_metadata.file_modification_time").alias("_arrived"))
        once = arrived.withWatermark("_arrived", repeats_within).dropDuplicatesWithinWatermark(["sample_id"]).drop("_arrived")
    return (
        once.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
