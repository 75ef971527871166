"""Getting this package to the executors' Python."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

from .plans.staging import fresh_path

_shipped: set[str] = set()


def ensure_on_executors(spark: SparkSession) -> None:
    """Hand the package to Spark once per application, so that functions which
    run in executors' Python can import it wherever the driver was started.

    The archive lies in the folder all executors share.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    place = fresh_path(spark, "package") + "/corpusloom.zip"
    path = context._jvm.org.apache.hadoop.fs.Path(place)
    stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    stream.write(data.getvalue())
    stream.close()
    context.addPyFile(place)
    _shipped.add(context.applicationId)
