import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.api import open_engine

from .conftest import rows



def clock(text):
    return F.lit(text).cast("timestamp")


@pytest.fixture(autouse=True)
def times(spark):
    global NOW, LATER
    NOW, LATER = clock("2024-05-01 10:00:00"), clock("2024-05-02 11:00:00")


def page(title, body, *links):
    return f"<html><head><title>{title}</title></head><body><p>{body}</p>" + "".join(f'<a href="{x}">x</a>' for x in links) + "</body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        [("https://e.com/", page("Home", "Welcome to the software", "/a", "/b", "https://other.org/")), ("https://e.com/a", page("A", "A recipe for food and a meal", "/c")),
         ("https://e.com/b", page("B", "The secret page", "/c")), ("https://e.com/c", page("C", "The last page about a hotel", "/"))], "url string, html string")


def test_life_of_an_instance(spark, pages, tmp_path):
    engine = open_engine(spark, str(tmp_path / "w"))
    robots = spark.createDataFrame([("e.com", "https://e.com/robots.txt", "User-agent: *\nDisallow: /b")], "domain string, base_url string, content string")
    first = engine.crawl("e.com", pages, robots, max_pages=2, save_html=True, now=NOW)
    assert engine.history().first().status == "interrupted"
    assert rows(engine.stats()) == [(first, 4, 2, 0, 2)] or engine.stats().first().pending >= 1
    while engine.resume(first, pages, robots, now=NOW):
        pass
    session = engine.history().first()
    assert (session.status, session.pages_crawled) == ("completed", 3)
    assert {r.url for r in engine.session_data(first).collect()} == {"https://e.com/", "https://e.com/a", "https://e.com/c"}
    assert engine.resume(first, pages) is False
    assert engine.index_session(first) == 3
    assert engine.index_all() == 3
    results, total = engine.search("hotel")
    assert [r.url for r in results.collect()] == ["https://e.com/c"]
    assert total.first().total == 1
    assert engine.search_stats()[0].first().total_pages == 3
    engine.export(str(tmp_path / "csv"), "csv")
    assert any(f.endswith(".csv") for f in os.listdir(tmp_path / "csv"))
    found, share = engine.classify_session(first)
    assert "Food" in {r.category for r in found.collect()}
    assert share.count() >= 2
    engine.delete_session(first)
    assert engine.search("hotel")[1].first().total == 0


def test_changes(spark, pages, tmp_path):
    engine = open_engine(spark, str(tmp_path / "w"))
    engine.monitor("https://e.com/a", "A", 24, now=NOW)
    assert rows(engine.due_checks(NOW), "url") == [("https://e.com/a",)]
    assert {r.change_type for r in engine.check(pages, now=NOW).collect()} == {"added"}
    assert engine.due_checks(NOW).count() == 0
    assert engine.due_checks(LATER).count() == 1
    assert engine.check(pages, now=NOW).count() == 0
    edited = pages.withColumn("html", F.regexp_replace("html", "secret", "public"))
    changed = engine.check(edited, now=LATER).collect()
    assert [(r.url, r.change_type) for r in changed] == [("https://e.com/b", "modified")]
    assert engine.recent_changes().first().url == "https://e.com/b"
    assert engine.url_history("https://e.com/b").count() == 2
    diff = engine.diff(changed[0].old_version_id, changed[0].new_version_id).first()
    assert (diff.added_lines, diff.removed_lines) == (1, 1)
    assert engine.version(changed[0].new_version_id).first().title == "B"
    assert engine.tracked().count() == 4
    engine.unmonitor("https://e.com/a")
    assert engine.due_checks(LATER).count() == 0


def test_schedules(spark, pages, tmp_path):
    engine = open_engine(spark, str(tmp_path / "w"))
    number = engine.create_schedule("hourly", "https://e.com/", "interval", hours=1, max_pages=3, now=NOW)
    once = engine.create_schedule("once", "https://e.com/", "once", run_at="2024-05-02T00:00:00", now=NOW)
    for bad in ({"kind": "cron", "cron": "x"}, {"kind": "interval"}, {"kind": "never"}, {"kind": "once", "run_at": "soon"}):
        with pytest.raises(ValueError):
            engine.create_schedule("bad", "https://e.com/", **bad)
    engine.run_schedule(number, pages, now=NOW)
    engine.run_schedule(once, pages, now=LATER)
    assert rows(engine.list_schedules(), "id", "status", "run_count") == [(number, "active", 1), (once, "completed", 1)]
    assert engine.schedule_runs(number).first().pages_crawled == 3
    assert rows(engine.next_runs(LATER), "id") == [(number,)]
    engine.set_schedule_status(number, "paused")
    assert engine.next_runs(LATER).count() == 0
    engine.delete_schedule(number)
    assert engine.list_schedules().count() == 1
    assert engine.schedule_runs(number).count() == 0


def test_resume_keeps_depth(spark, tmp_path):
    chain = spark.createDataFrame([(f"https://e.com/{i}", page(str(i), f"Text {i}", f"/{i + 1}")) for i in range(6)], "url string, html string")
    engine = open_engine(spark, str(tmp_path / "w"))
    session = engine.crawl("https://e.com/0", chain, max_pages=2, max_depth=3, now=NOW)
    while engine.resume(session, chain, max_pages=1, max_depth=3, now=NOW):
        pass
    found = {r.url: r.depth for r in engine.store.read("urls").collect()}
    assert found == {f"https://e.com/{i}": i for i in range(4)}  # as one crawl of this depth would


def test_crawl_with_sitemaps(spark, pages, tmp_path):
    lone = pages.unionByName(spark.createDataFrame([("https://e.com/lone", page("L", "Nothing links here"))], "url string, html string"))
    robots = spark.createDataFrame([("e.com", "https://e.com/robots.txt", "User-agent: *\nDisallow: /b\nSitemap: /maps/one.xml")], "domain string, base_url string, content string")
    maps = spark.createDataFrame([("https://e.com/maps/one.xml", "<urlset><url><loc>https://e.com/lone</loc></url><url><loc>https://other.org/x</loc></url></urlset>")], "sitemap_url string, content string")
    engine = open_engine(spark, str(tmp_path / "w"))
    session = engine.crawl("e.com", lone, robots, now=NOW, sitemaps=maps)
    depths = {r.url: r.depth for r in engine.store.read("urls").where(f"session_id = {session}").collect()}
    assert depths["https://e.com/lone"] == 1 and depths["https://e.com/"] == 0 and "https://other.org/x" not in depths
    engine.index_session(session)
    answer = engine.search_page("nothing")
    assert [r["url"] for r in answer["results"]] == ["https://e.com/lone"] and answer["total"] == 1 and answer["search_time_ms"] > 0
    assert engine.search_page('"')["total"] == 0
    engine.export(str(tmp_path / "array"), "array")
    text = "".join((tmp_path / "array" / f).read_text() for f in sorted(os.listdir(tmp_path / "array")) if f.startswith("part-"))
    assert len(json.loads(text)) == 4
    engine.export(str(tmp_path / "none"), "array", session_id=99)
    assert json.loads("".join((tmp_path / "none" / f).read_text() for f in os.listdir(tmp_path / "none") if f.startswith("part-"))) == []
