"""Loading the tables the operators of this package work on."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def small_rows(df: DataFrame, most: int = 100_000) -> list:
    """All rows of a table that is small by its nature (word lists, label
    names).  A larger one is refused instead of being pulled to the driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in what should be a small table")
    return rows


def common_words(spark: SparkSession, sf_dir: str) -> frozenset[str]:
    """The common words of all languages, lower case."""
    df = table(spark, sf_dir, "common_words").select("word")
    return frozenset(r.word.lower() for r in small_rows(df) if r.word)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches of an Arrow stage in pieces, so that what Python makes of a
    batch stays small however large the session's batches are."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
