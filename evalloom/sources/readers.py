"""Reading manifests, results, attempts, episodes and training rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom import schemas
from evalloom.batches import Batches
from evalloom.operators.diagnostics import with_response


def _json(spark: SparkSession, path: str | list[str], schema: str, mode: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", mode).json(path)


def read_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON lines; blank lines are skipped and a malformed line fails the job."""
    return _json(spark, path, schemas.RESULTS, "FAILFAST")


def read_batches(spark: SparkSession, path: str, schema: str = schemas.RESULTS, file_format: str = "json") -> DataFrame:
    """The committed batches of a path that is appended to by batch ids; no rows before the first."""
    options = {"mode": "FAILFAST"} if file_format == "json" else {}
    rows = Batches(spark, path, file_format).read(schema=schema, **options)
    return spark.createDataFrame([], schema) if rows is None else rows


def read_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _json(spark, path, schemas.MANIFEST, "FAILFAST")


def read_completed(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ``sample_id`` of the readable lines; none when the path does not exist."""
    reader = spark.read.schema("sample_id string, _bad string").option("mode", "PERMISSIVE")
    try:
        lines = reader.option("columnNameOfCorruptRecord", "_bad").json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "sample_id string")
    kept = F.col("sample_id").isNotNull() & F.col("_bad").isNull()
    return lines.where(kept).select("sample_id").distinct()


def read_attempts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _json(spark, path, schemas.ATTEMPTS, "FAILFAST")


def read_episodes(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Episodes with ``response`` filled from worked steps and answer when absent.

    ``episode_id`` is a text that sorts by order of appearance: file, place of the split in
    it, and row; ``n`` takes the first episodes in that order, whatever order files
    are read in.
    """
    rows = with_response(_in_order(_json(spark, path, schemas.EPISODES, "FAILFAST"), "episode_id"))
    return rows if n is None else rows.orderBy("episode_id").limit(n)


def _in_order(rows: DataFrame, name: str) -> DataFrame:
    """Adds a text that sorts rows of files by path, split and row; within a split, row numbers of a task ascend."""
    start, row = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    place = F.concat_ws("#", "_metadata.file_path", F.lpad(start.cast("string"), 20, "0"), F.lpad(row.cast("string"), 20, "0"))
    return rows.withColumn(name, place)


def read_training_rows(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    rows = _json(spark, path, schemas.SFT, "FAILFAST")
    return rows if n is None else _in_order(rows, "_at").orderBy("_at").limit(n).drop("_at")


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Results of all runs below ``root/<model>/<strategy>/results.jsonl``.

    One scan over a glob; model and strategy are read off the path, and runs that do
    not exist are simply not there.
    """
    rows = spark.read.schema(schemas.RESULTS).option("mode", "FAILFAST").json(
        f"{root}/*/*/results.jsonl"
    )
    model, strategy = _run_of(F.col("_metadata.file_path"))
    return rows.withColumns({"run_model": model, "run_strategy": strategy})


def _run_of(path: Column) -> tuple[Column, Column]:
    """Model and strategy: the two folders before the first ``results.jsonl`` that has two.

    Every row has its path, and a pattern tried from each place in it costs many times what reading the row does.
    So the text before the first such name is cut out; the pattern is left for paths where two folders are not there.
    """
    before = F.substring_index(path, "/results.jsonl", 1)
    two = F.url_decode(F.substring_index(before, "/", -2))
    cut = F.substring_index(two, "/", 1), F.substring_index(two, "/", -1)
    there = (before != path) & F.contains(two, F.lit("/")) & (cut[0] != "") & (cut[1] != "")
    pattern = r"([^/]+)/([^/]+)/results\.jsonl"
    found = [F.regexp_extract(F.url_decode(path), pattern, group) for group in (1, 2)]
    return F.when(there, cut[0]).otherwise(found[0]), F.when(there, cut[1]).otherwise(found[1])


def model_slug(model):
    """Path-safe model name: last part, blanks and colons as underscores."""
    return F.regexp_replace(F.substring_index(model, "/", -1), "[ :]", "_")
