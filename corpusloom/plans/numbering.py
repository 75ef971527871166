"""Numbering and predecessors within groups that may be very large.

A window puts each group into one task.  Where a group is larger than
`LARGEST_GROUP` rows - counted first, with map-side combining - the same result
is made without one: rows are range-partitioned by group and order, numbered
within each partition, and the counts of earlier partitions are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

LARGEST_GROUP = 1_000_000  # rows of a group that one task may sort


def _spread(df: DataFrame, key: str, largest: int) -> bool:
    return not df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > largest).isEmpty()


def numbered(df: DataFrame, key: str, order: list[str], name: str = "number", largest: int = LARGEST_GROUP) -> DataFrame:
    """`df` with the rank from 1 of each row within its group, by ascending
    `order`; the order should be total, else ties are broken arbitrarily."""
    if not _spread(df, key, largest):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))
    placed = staged(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "placed")
    counts = placed.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))
    joined = placed.withColumn("_local", local).join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(name, F.col("_local") + F.col("_offset")).drop("_part", "_local", "_key", "_p", "_offset")


def with_previous(df: DataFrame, key: str, order: str, columns: dict[str, str], largest: int = LARGEST_GROUP) -> DataFrame:
    """`df` with values of the row before within the group: `columns` maps new
    names to columns; null for the first row of a group."""
    if not _spread(df, key, largest):
        window = Window.partitionBy(key).orderBy(order)
        return df.withColumns({new: F.lag(old).over(window) for new, old in columns.items()})
    ranked = staged(numbered(df, key, [order], "_number", largest), "ranked")
    before = ranked.select(F.col(key).alias("_key"), (F.col("_number") + 1).alias("_next"), *[F.col(old).alias(new) for new, old in columns.items()])
    joined = ranked.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_number") == F.col("_next")), "left")
    return joined.drop("_key", "_next", "_number")

