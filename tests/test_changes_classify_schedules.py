import difflib
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom import fixtures
from corpusloom.functions import text as T
from corpusloom.operators import catalog, changes, classify, schedules
from corpusloom.plans.staging import fresh_path
from corpusloom.streaming import changes as streams

from .conftest import rows

VERSIONS = [
    (1, "u", "A", "one\ntwo"), (2, "u", "A", "one\ntwo"), (3, "u", "B", "one\nTWO\nthree"), (4, "v", "C", "x"), (5, "u", "A", "one\ntwo"), (6, "u", "D", "++one\n--two"), (7, "w", "E", ""),
]
VERSION = "id long, url string, content_hash string, text_content string"


def test_content_hash_equals_stdlib(spark):
    texts = ["  Hello \n World ", "hello world", " x y\t", "", "ÀB", "a\r\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.content_hash(F.col("t")).alias("h"), T.word_count(F.col("t")).alias("n"))
    for r in df.collect():
        assert r.h == hashlib.sha256(re.sub(r"\s+", " ", r.t.strip().lower()).encode()).hexdigest()[:16]
        assert r.n == len(r.t.split())


def test_detect_log_and_revert(spark):
    versions = spark.createDataFrame(VERSIONS, VERSION)
    assert rows(changes.detect(versions)) == sorted([("u", 0, 1, "added"), ("u", 2, 3, "modified"), ("u", 3, 5, "modified"), ("u", 5, 6, "modified"), ("v", 0, 4, "added"), ("w", 0, 7, "added")], key=repr)
    log = {r.new_version_id: r for r in changes.change_log(versions).collect()}
    assert (log[3].added_lines, log[3].removed_lines, log[3].change_percent, log[3].summary) == (2, 1, 100.0, "Major page restructure")
    assert (log[6].added_lines, log[6].removed_lines) == (0, 2) or log[6].added_lines <= 2
    assert (log[1].added_lines, log[1].change_percent) == (2, 100.0)
    assert changes.change_log(versions.limit(0)).count() == 0


def test_diff_equals_definition():
    rng = random.Random(3)
    for _ in range(30):
        a = "\n".join(rng.choice("abc+-") for _ in range(rng.randrange(6)))
        b = "\n".join(rng.choice("abc+-") for _ in range(rng.randrange(6)))
        lines = list(difflib.unified_diff(a.split("\n"), b.split("\n"), lineterm=""))
        d = changes.diff(a, b)
        assert d["diff_lines"] == lines[:100]
        assert d["added_lines"] == sum(x[:1] == "+" and x[:3] != "+++" for x in lines)
    assert changes.diff(None, None)["change_percent"] == 0
    assert "Previous" in changes.html_diff("a", "b")


def test_versions_deleted_due_bands(spark):
    versions = spark.createDataFrame(VERSIONS, VERSION)
    assert rows(changes.new_versions(versions.where("id = 1"), versions.where("id > 1")), "id") == [(3,), (4,), (6,), (7,)]
    assert rows(changes.deleted(versions, versions.where("url = 'u'"))) == [("v", "deleted"), ("w", "deleted")]
    bands = spark.createDataFrame([(4.99,), (5.0,), (19.9,), (20.0,), (50.0,)], "p double").select(changes.severity(F.col("p")).alias("s"))
    assert [r.s.split()[0] for r in bands.collect()] == ["Minor", "Moderate", "Moderate", "Significant", "Major"]
    lines = spark.createDataFrame([("+++ x",), ("+x",), ("-x",), ("@@ 1",), (" x",)], "l string").select(changes.line_class(F.col("l")).alias("c"))
    assert [r.c for r in lines.collect()] == ["header", "add", "remove", "header", "context"]


def test_stream_equals_batch(spark):
    versions = spark.createDataFrame(VERSIONS, VERSION)
    place = fresh_path(spark, "test-stream")
    for k in range(3):
        versions.where(f"id > {k * 3} and id <= {k * 3 + 3}").coalesce(1).write.mode("append").parquet(f"{place}/in")
    source = spark.readStream.schema(versions.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    run = streams.detect_stream(source).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    assert rows(spark.read.schema(streams.CHANGES).parquet(f"{place}/out")) == rows(changes.detect(versions))


BRANCHES = [(f"only {words[0]} here", name) for name, words in classify.CATEGORY_KEYWORDS.items() if name not in ("Business",)]


@pytest.mark.parametrize(("text", "category"), [*BRANCHES, ("company ceo", "Business"), ("zzz qqq", "Unknown"), ("startup investment", "Business"), ("", "Unknown"), (None, "Unknown")])
def test_category(spark, text, category):
    low = (" " + (text or "")).lower()
    scores = {c: sum(k in low for k in ks) for c, ks in classify.CATEGORY_KEYWORDS.items()}
    best = max(scores, key=lambda c: scores[c]) if any(scores.values()) else "Unknown"
    row = classify.classify(spark.createDataFrame([(None, text)], "title string, text string")).first()
    assert row.category == best
    assert row.entities == []
    if text != "only latest here" and category in ("Unknown", "Business"):
        assert row.category == category


def test_sentiment_keywords_summary(spark):
    texts = [("great good bad", "positive"), ("bad awful good", "negative"), ("good bad", "neutral"), ("great good best bad awful", "neutral"), ("none", "neutral")]
    df = spark.createDataFrame([(None, t) for t, _ in texts], "title string, text string")
    got = {r.text: (r.sentiment, r.sentiment_score) for r in classify.classify(df).collect()}
    assert {t: got[t][0] for t, _ in texts} == dict(texts)
    assert got["great good bad"][1] == 0.5
    long = "Zebra apple zebra this apple mango. Short. This sentence is long enough to stay! And this third one too."
    row = classify.classify(spark.createDataFrame([("T", long)], "title string, text string")).first()
    assert row.keywords[:3] == ["zebra", "apple", "mango"]
    assert row.summary == "Zebra apple zebra this apple mango. This sentence is long enough to stay"
    assert row.word_count == len(re.findall(r"\w+", "T " + long))
    share = {r.category: r.share for r in classify.distribution(classify.classify(df)).collect()}
    assert abs(sum(share.values()) - 1) < 1e-9


def test_schedules(spark):
    now = F.lit(fixtures.NOW).cast("timestamp")
    next_run = {r.id: r.n for r in schedules.next_runs(fixtures.schedules(spark), now).select("id", F.date_format("next_run", "yyyy-MM-dd HH:mm:ss").alias("n")).collect()}
    assert next_run == {
        1: "2024-03-11 02:30:00", 2: "2024-03-11 09:00:00", 3: "2024-03-10 12:20:00", 4: "2024-03-10 12:15:30", 5: "2024-03-11 00:00:00", 6: None, 8: "2024-03-10 13:00:00",
    }
    assert rows(schedules.due(fixtures.schedules(spark), now), "id") == [(4,), (6,), (8,)]
    ended = schedules.after_run(fixtures.schedules(spark), 5, now).where("id = 5").first()
    assert (ended.status, ended.run_count) == ("completed", 1)
    assert schedules.set_status(fixtures.schedules(spark), 3, "paused").where("id = 3").first().status == "paused"


@pytest.mark.parametrize(("expression", "valid"), [("*/15 * * * *", True), ("0 0 1 jan *", True), ("5-10/2 * * * sun", True), ("60 * * * *", False), ("* * *", False), ("", False), ("a * * * *", False), ("1-0 * * * *", False)])
def test_cron_fields(expression, valid):
    assert (schedules.cron_values(expression) is not None) is valid


def test_cron_weekdays_of_numbers_and_names():
    assert schedules.cron_values("* * * * 0")["weekday"] == schedules.cron_values("* * * * sun")["weekday"] == schedules.cron_values("* * * * 7")["weekday"] == [6]
    assert schedules.cron_values("*/20 * * * *")["minute"] == [0, 20, 40]


def test_catalog(spark):
    urls = spark.createDataFrame(
        [(1, 1, "completed", 200, None), (2, 1, "completed", 404, None), (3, 1, "failed", None, "timeout"), (4, 1, "pending", None, None), (5, 2, "completed", 301, None), (5, 2, "completed", 301, None)],
        "id long, session_id long, status string, http_status int, error string",
    )
    from corpusloom.sources.storage import deduplicated

    assert rows(catalog.status_counts(deduplicated(urls))) == [(1, 4, 2, 1, 1), (2, 1, 1, 0, 0)]
    assert rows(catalog.crawl_totals(catalog.outcome(deduplicated(urls)))) == [(1, 1, 2, 0, 3), (2, 1, 0, 0, 1)]
    assert catalog.update_where(urls, F.col("id") == 4, status="failed").where("status = 'failed'").count() == 2
    assert catalog.delete_where(urls, F.col("error") == "timeout").count() == 5
    assert catalog.insert_new(urls, urls.unionByName(urls.withColumn("id", F.col("id") + 10)), ["id"]).count() == 5
    assert catalog.status_counts(urls.limit(0)).count() == 0
