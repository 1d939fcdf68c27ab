"""Tables that grow by named batches, each committed once.

A batch is written to its own directory, ``path/batch=<id>``, and counts from the moment its marker, a small
file in ``path/_committed``, is there. What a driver leaves behind that is lost while it writes has no
marker: it is never read, and the same batch written again replaces it. A batch that has its
marker is not written again.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"[A-Za-z0-9_.-]+")


class Batches:
    """The batches below ``path``, in any file format Spark writes. One driver at a time may write."""

    def __init__(self, spark: SparkSession, path: str, file_format: str = "parquet"):
        self.spark, self.path, self.file_format = spark, path.rstrip("/"), file_format

    def _at(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def place(self, batch: str) -> str:
        if not _NAME.fullmatch(batch):
            raise ValueError(f"a batch id is letters, digits, dots, hyphens and underscores, not {batch!r}")
        return f"{self.path}/batch={batch}"

    def notes(self, like: str = "*") -> dict[str, dict]:
        """What was noted with each committed batch whose name fits the pattern, by name in order."""
        fs, where = self._at(f"{self.path}/_committed/{like}")
        found = fs.globStatus(where) or []
        made = {}
        for status in found:
            stream = fs.open(status.getPath())
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            made[status.getPath().getName()] = json.loads(text)
        return dict(sorted(made.items()))

    def is_empty(self) -> bool:
        """Whether there is nothing at ``path``, committed or not."""
        fs, where = self._at(self.path)
        return not fs.exists(where) or not fs.listStatus(where)

    def commit(self, batch: str, note: dict | None = None) -> None:
        """Write the marker: to another name first, so that a marker is whole or not there."""
        fs, draft = self._at(f"{self.path}/_drafts/{batch}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(note or {}).encode()))
        stream.close()
        _, marker = self._at(f"{self.path}/_committed/{batch}")
        fs.mkdirs(marker.getParent())
        if not fs.rename(draft, marker):
            raise OSError(f"no marker for batch {batch} of {self.path}")

    def write(self, rows: DataFrame, batch: str, by: list[str] | None = None) -> None:
        """The rows of a batch, replacing what an unfinished attempt left; not committed yet."""
        writer = rows.write.mode("overwrite").format(self.file_format)
        (writer.partitionBy(*by) if by else writer).save(self.place(batch))

    def add(self, rows: DataFrame, batch: str, by: list[str] | None = None) -> bool:
        """Write and commit a batch unless it is committed; whether it was written now."""
        self.place(batch)
        if self.notes(batch):
            return False
        self.write(rows, batch, by)
        self.commit(batch)
        return True

    def read(self, batches: list[str] | None = None, schema=None, **options: str) -> DataFrame | None:
        """The rows of these batches, or of all committed ones; None where there are none."""
        names = list(self.notes()) if batches is None else batches
        if not names:
            return None
        reader = self.spark.read.format(self.file_format).option("basePath", self.path).options(**options)
        rows = (reader if schema is None else reader.schema(schema)).load([self.place(b) for b in names])
        return rows.drop("batch")
