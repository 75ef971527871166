"""A crawl over a closed set of pages, as bulk-synchronous supersteps.

Each superstep takes the whole frontier up to the page budget, drops what robots
rules forbid, "fetches" by a join with the available pages, and admits their
links as the next frontier.  State between steps is staged in the shared folder,
so the plan does not grow and lost executors cost one step at most.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normalize_url
from ..operators import frontier
from .staging import staged


@dataclass
class CrawlResult:
    """URL records of a crawl, what each superstep did, and what was admitted but
    not taken because the budget ran out (url, depth, parent_url)."""

    urls: DataFrame
    steps: list[dict]
    pending: DataFrame


def crawl(seeds: DataFrame, links: DataFrame, pages: DataFrame, allowed: DataFrame | None = None, max_pages: int = 100, max_depth: int = 10) -> CrawlResult:
    """Crawls from `seeds` (url, and depth and priority if they have them) along
    `links` (src, dst) over `pages` (url).

    Returns records (url, depth, parent_url, outcome): `completed`, `failed` (no
    such page) or `skipped` (robots; `allowed` is (url, allowed)).  The budget is
    exact and counts all three; in a step that exceeds it, items go by priority,
    depth and address.  Empty seeds give an empty crawl.

    Records are appended, one table a step; the links of a step are found by
    joining the edges with the addresses completed in it, which is a broadcast
    as long as these are few.
    """
    spark = seeds.sparkSession
    available = staged(pages.select(normalize_url("url").alias("url")).where("url is not null").distinct(), "crawl-pages")
    edges = staged(links.select(normalize_url("src").alias("src"), normalize_url("dst").alias("dst")).where("src is not null and dst is not null").distinct(), "crawl-links")
    rules = None if allowed is None else staged(allowed.select(normalize_url("url").alias("url"), F.col("allowed").alias("_allowed")).dropDuplicates(["url"]), "crawl-rules")
    seeds = seeds.where(F.trim("url") != "")
    first = {"priority": F.lit(frontier.HIGHEST), "depth": F.lit(0), "parent_url": F.lit(None).cast("string")}
    start = seeds.select("url", *[(F.col(c) if c in seeds.columns else value).alias(c) for c, value in first.items()])
    nothing = spark.createDataFrame([], "url string, depth int, parent_url string, outcome string")
    queue = staged(frontier.admit(start.where(F.col("depth") <= max_depth), nothing), "crawl-frontier")
    parts: list[DataFrame] = []
    steps: list[dict] = []
    budget = max_pages
    while True:
        size = queue.count()
        # only a frontier beyond the budget has to be ordered
        batch = queue if size <= budget else staged(frontier.next_batch(queue, budget), "crawl-batch")
        size = min(size, budget)
        if not size:
            break
        budget -= size
        found = batch.join(available.withColumn("_there", F.lit(True)), "url", "left")
        found = found.withColumn("_allowed", F.lit(True)) if rules is None else found.join(rules, "url", "left")
        outcome = F.when(~F.coalesce("_allowed", F.lit(True)), "skipped").when(F.col("_there"), "completed").otherwise("failed")
        records = staged(found.select("url", "depth", "parent_url", outcome.alias("outcome")), "crawl-records")
        parts.append(records)
        steps.append({"depth": len(steps), "fetched": size, "left": budget})
        new = edges.join(records.where((F.col("outcome") == "completed") & (F.col("depth") < max_depth)).select(F.col("url").alias("src"), (F.col("depth") + 1).alias("depth")), "src")
        candidates = new.select(F.col("dst").alias("url"), F.lit(frontier.NORMAL).alias("priority"), "depth", F.col("src").alias("parent_url"))
        left_over = None if batch is queue else queue.join(batch.select("url"), "url", "left_anti")
        seen = reduce(DataFrame.unionByName, [p.select("url") for p in parts])
        if left_over is not None:
            seen = seen.unionByName(left_over.select("url"))
        fresh = frontier.admit(candidates, seen).select("url", "priority", "depth", "parent_url")
        queue = staged(fresh if left_over is None else left_over.select("url", "priority", "depth", "parent_url").unionByName(fresh), "crawl-frontier")
    done = reduce(DataFrame.unionByName, parts) if parts else nothing
    return CrawlResult(done, steps, queue.select("url", "depth", "parent_url"))


def progress(urls: DataFrame, max_pages: int) -> DataFrame:
    """Counters of a crawl and the share of its budget in percent, at most 100."""
    counts = urls.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("completed", "failed", "skipped")], F.count("*").alias("total"))
    return counts.withColumn("percent", F.least(F.lit(100), F.round(F.col("total") * 100 / max_pages).cast("int")))
