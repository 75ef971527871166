"""The crawl frontier as DataFrames: admission, order, retry, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import get_domain, normalize_url
from ..plans.numbering import numbered

# fixed values: priorities, smaller goes first
HIGHEST, HIGH, NORMAL, LOW = 0, 1, 2, 3


def admit(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates (url, priority, depth, parent_url) to add: addresses
    normalised, unusable ones dropped, each once - the most urgent, shallowest
    first - and none that is in `seen` (url).  The best candidate of an address is
    an aggregate: pages with millions of links to them are combined before the
    shuffle."""
    urls = candidates.withColumn("url", normalize_url("url")).where("url is not null")
    order = F.struct("priority", "depth", F.coalesce("parent_url", F.lit("")))
    first = urls.groupBy("url").agg(F.min_by(F.struct("priority", "depth", "parent_url"), order).alias("_first"))
    return first.select("url", "_first.*").join(seen.select("url"), "url", "left_anti")


def next_batch(frontier: DataFrame, n: int) -> DataFrame:
    """The next `n` items: by priority, depth and address."""
    return frontier.orderBy("priority", "depth", "url").limit(n)


def retry(failed: DataFrame, max_retries: int = 3) -> DataFrame:
    """Failed items put back with lower urgency, while retries are left."""
    again = failed.where(F.col("retry_count") < max_retries)
    return again.withColumns({"priority": F.least(F.col("priority") + 1, F.lit(LOW)), "retry_count": F.col("retry_count") + 1})


def counters(items: DataFrame) -> DataFrame:
    """Queue size, items in progress, seen, completed and failed, from the state
    of each item."""
    by = [F.count_if(F.col("state") == s).alias(a) for s, a in (("queued", "queue_size"), ("in_progress", "in_progress"), ("completed", "completed"), ("failed", "errors"))]
    return items.agg(*by, F.count("*").alias("seen"))


def fetch_slots(items: DataFrame, delay: Column, rate: float = 2.0) -> DataFrame:
    """Earliest start of each fetch in seconds: per host one after the other, at
    least the host's delay and 1 / rate apart."""
    placed = numbered(items.withColumn("domain", get_domain("url")).withColumn("_gap", F.greatest(delay, F.lit(1.0 / rate))), "domain", ["priority", "depth", "url"], "_place")
    return placed.withColumn("slot", (F.col("_place") - 1) * F.col("_gap")).drop("_place", "_gap")


def bloom_bits(items: Column, size: int = 1_000_000, hashes: int = 5) -> Column:
    """Bit positions of an item in a Bloom filter: MD5 of the item and the number
    of the hash, as a 128-bit number, modulo the size."""

    def bit(i: Column) -> Column:
        digest = F.md5(F.concat(items, i.cast("string")))
        halves = [F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)") % F.lit(size).cast("decimal(20,0)") for start in (1, 17)]
        high = (halves[0] * F.lit(2**64 % size).cast("decimal(10,0)")).cast("decimal(38,0)")
        return ((high + halves[1]) % F.lit(size).cast("decimal(20,0)")).cast("long")

    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), bit)


def bloom_filter(items: DataFrame, column: str, size: int = 1_000_000, hashes: int = 5) -> DataFrame:
    """(bit): the bits that are set after adding all items."""
    return items.select(F.explode(bloom_bits(F.col(column), size, hashes)).alias("bit")).distinct()


def bloom_contains(candidates: DataFrame, column: str, bits: DataFrame, size: int = 1_000_000, hashes: int = 5) -> DataFrame:
    """Distinct candidates with `maybe`: whether all their bits are set.  Never
    false for an item that was added; `admit` is the exact test."""
    wanted = candidates.select(column).distinct().select(column, F.explode(F.array_distinct(bloom_bits(F.col(column), size, hashes))).alias("bit"))
    found = wanted.join(bits.withColumn("set", F.lit(1)), "bit", "left")
    return found.groupBy(column).agg((F.count("*") == F.count("set")).alias("maybe"))
