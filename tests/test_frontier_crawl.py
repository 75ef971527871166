import hashlib

from pyspark.sql import functions as F

from corpusloom.operators import frontier
from corpusloom.plans.crawl import crawl, progress

from .conftest import rows

ITEM = "url string, priority int, depth int, parent_url string"


def test_admit(spark):
    candidates = spark.createDataFrame([("https://E.com/a", 2, 1, None), ("https://e.com/a#x", 1, 2, None), ("https://e.com/b", 2, 0, None), ("mailto:x", 0, 0, None), ("https://e.com/seen/", 2, 0, None)], ITEM)
    seen = spark.createDataFrame([("https://e.com/seen",)], "url string")
    assert rows(frontier.admit(candidates, seen), "url", "priority") == [("https://e.com/a", 1), ("https://e.com/b", 2)]
    assert frontier.admit(candidates.limit(0), seen).count() == 0


def test_order_retry_counters(spark):
    queue = spark.createDataFrame([("b", 3, 0, None), ("c", 1, 1, None), ("a", 1, 0, None), ("d", 0, 9, None)], ITEM)
    assert [r.url for r in frontier.next_batch(queue, 3).collect()] == ["d", "a", "c"]
    failed = spark.createDataFrame([("a", 2, 0), ("b", 3, 2), ("c", 1, 3)], "url string, priority int, retry_count int")
    assert rows(frontier.retry(failed)) == [("a", 3, 1), ("b", 3, 3)]
    counts = frontier.counters(spark.createDataFrame([("queued",), ("completed",), ("failed",), ("completed",)], "state string")).first()
    assert (counts.queue_size, counts.completed, counts.errors, counts.seen) == (1, 2, 1, 4)


def test_bloom_equals_definition(spark):
    items = [f"https://e.com/{i}" for i in range(30)]
    df = spark.createDataFrame([(x,) for x in items], "u string").select("u", frontier.bloom_bits(F.col("u")).alias("b"))
    for r in df.collect():
        assert r.b == [int(hashlib.md5(f"{r.u}{i}".encode()).hexdigest(), 16) % 1_000_000 for i in range(5)]
    bits = frontier.bloom_filter(df, "u")
    probe = spark.createDataFrame([(items[0],), ("https://e.com/absent",)], "u string")
    assert rows(frontier.bloom_contains(probe, "u", bits)) == [("https://e.com/0", True), ("https://e.com/absent", False)]


def test_crawl(spark):
    pages = spark.createDataFrame([(f"https://e.com/{p}",) for p in ("", "a", "b", "c", "d", "secret")], "url string")
    edges = [("", "a"), ("", "b"), ("a", "c"), ("b", "c"), ("c", ""), ("c", "d"), ("a", "missing"), ("a", "secret"), ("secret", "d")]
    links = spark.createDataFrame([(f"https://e.com/{s}", f"https://e.com/{t}") for s, t in edges], "src string, dst string")
    allowed = spark.createDataFrame([("https://e.com/secret", False)], "url string, allowed boolean")
    seeds = spark.createDataFrame([("https://E.com#x",)], "url string")
    result = crawl(seeds, links, pages, allowed, max_depth=2)
    got = {r.url.rpartition("/")[2]: (r.depth, r.outcome) for r in result.urls.collect()}
    assert got == {"": (0, "completed"), "a": (1, "completed"), "b": (1, "completed"), "c": (2, "completed"), "missing": (2, "failed"), "secret": (2, "skipped")}
    assert crawl(seeds, links, pages, max_pages=2).urls.count() == 2
    assert crawl(seeds.limit(0), links, pages).urls.count() == 0
    assert progress(result.urls, 4).first().percent == 100


def test_slots(spark):
    items = spark.createDataFrame([("https://e.com/b", 2, 0), ("https://e.com/a", 2, 0), ("https://f.com/a", 2, 0)], "url string, priority int, depth int")
    assert rows(frontier.fetch_slots(items, F.lit(3.0)), "url", "slot") == [("https://e.com/a", 0.0), ("https://e.com/b", 3.0), ("https://f.com/a", 0.0)]
