"""Tables of an engine instance as versioned Parquet folders.

A version is written whole (`v7`, by `replace`) or as the rows it adds to the
version before it (`d8`, by `append`): appending never reads or rewrites what is
there.  A folder counts once its write has succeeded, so a reader of the last
version is not disturbed and a failed write leaves the table as it was.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

KEPT = 2  # versions of a table that stay readable
MOST_PARTS = 64  # appended folders after which an append writes the table whole, to bound the number of small files


class Warehouse:
    """Named tables below a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str]):
        self.spark, self.folder, self.schemas = spark, folder, schemas

    def _files(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, name))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _parts(self, name: str) -> list[tuple[int, bool]]:
        """(version, whether whole) of the complete folders, ascending."""
        path, files = self._files(name)
        if not files.exists(path):
            return []
        found = []
        for status in files.listStatus(path):
            m = re.fullmatch(r"([vd])(\d+)", status.getPath().getName())
            if m and files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found.append((int(m.group(2)), m.group(1) == "v"))
        return sorted(found)

    def versions(self, name: str) -> list[int]:
        """Readable versions of a table, ascending, the last `KEPT`."""
        return [n for n, _ in self._parts(name)][-KEPT:]

    def _place(self, name: str, number: int, whole: bool) -> str:
        return os.path.join(self.folder, name, f"{'v' if whole else 'd'}{number}")

    def read(self, name: str) -> DataFrame:
        """Last version of a table; empty, with its schema, before the first."""
        parts = self._parts(name)
        base = max((i for i, (_, whole) in enumerate(parts) if whole), default=0)
        if not parts:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*[self._place(name, *x) for x in parts[base:]])

    def _columns(self, name: str) -> list[str]:
        return [c.split()[0] for c in re.split(r", (?![^<]*>)", self.schemas[name])]

    def replace(self, name: str, rows: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Writes the next version of a table whole and returns it.  Folders that
        no kept version needs are removed."""
        parts = self._parts(name)
        writer = rows.select(*self._columns(name)).write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self._place(name, parts[-1][0] + 1 if parts else 1, True))
        # the version before stays readable: it begins at the last whole folder
        base = max((i for i, (_, whole) in enumerate(parts) if whole), default=0)
        _, files = self._files(name)
        for old in parts[:base]:
            files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._place(name, *old)), True)
        return self.read(name)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """The next version with rows added; only these are written."""
        parts = self._parts(name)
        if not parts or len(parts) > MOST_PARTS:
            return self.replace(name, self.read(name).unionByName(rows.select(*self._columns(name))))
        rows.select(*self._columns(name)).write.mode("overwrite").parquet(self._place(name, parts[-1][0] + 1, False))
        return self.read(name)
