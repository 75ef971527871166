"""Cutting lineage with tables in the shared checkpoint folder.

Operators that need an intermediate result more than once, or that loop, write
it as Parquet below the folder the session names in ``spark.checkpoint.dir`` and
read it back.  Every executor can reach that folder, so the result survives the
loss of executors.  Only where the setting is absent (tests, a laptop) a local
folder is made and set.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, as set in the session; set here if unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        path = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        folder = "file://" + path
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_own: dict[str, str] = {}


def _own_folder(spark: SparkSession) -> str:
    """Folder of this application below the shared folder.  Its file system
    removes it when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = os.path.join(shared_folder(spark), "corpusloom", app)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _own[app] = folder
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used."""
    return os.path.join(_own_folder(spark), f"{name}-{uuid.uuid4().hex}")


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """`df` written to the shared folder and read back: its lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_bytes(df: DataFrame) -> int:
    """Size in bytes of the files a staged table was read back from."""
    spark = df.sparkSession
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for name in df.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(configuration).getFileStatus(path).getLen()
    return total


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more: the
    states a loop has left behind."""
    spark = df.sparkSession
    own = _own_folder(spark).rstrip("/")
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(name) for name in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if os.path.basename(own) in folder:
            path.getFileSystem(configuration).delete(path, True)
