"""What several operators share: tables, words, hashes of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Has texts go to Python tasks by so many rows at a time, a few MB, instead of by the session's 10,000.

    The batches are held on both sides at once, so this bounds what a task needs beside the heap.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def words(text: Column) -> Column:
    """The words of a text in order; of null or blank text, an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or nulls where the table has none of that name."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(kind)
