import gzip

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import robots, sitemap

from .conftest import rows


def allowed(spark, content, path, agent="TestBot"):
    files = spark.createDataFrame([("e.com", "https://e.com/robots.txt", content)], "domain string, base_url string, content string")
    return robots.can_fetch(spark.createDataFrame([(f"https://e.com{path}",)], "url string"), files, agent).first().allowed


@pytest.mark.parametrize(("content", "path", "expected"), [
    ("User-agent: *\nDisallow: /private/", "/private/x", False),
    ("User-agent: *\nDisallow: /private/", "/public", True),
    ("User-agent: *\nDisallow: /a/\nAllow: /a/b", "/a/b/c", True),
    ("User-agent: *\nDisallow: /a/\nAllow: /a/b", "/a/c", False),
    ("User-agent: *\nDisallow: /*.pdf", "/docs/x.pdf", False),
    ("User-agent: *\nDisallow: /*.pdf", "/docs/x.html", True),
    ("User-agent: *\nDisallow: /exact$", "/exact", False),
    ("User-agent: *\nDisallow: /exact$", "/exact/more", True),
    ("User-agent: *\nDisallow:", "/any", True),
    ("", "/any", True),
    ("User-agent: TestBot\nDisallow: /t\n\nUser-agent: Other\nDisallow: /", "/x", True),
    ("User-agent: TestBot\nDisallow: /t\n\nUser-agent: *\nDisallow: /", "/x", True),
    ("User-agent: Other\nDisallow: /\n\nUser-agent: *\nDisallow: /t", "/t", False),
    ("User-agent: Other\nUser-agent: testbot\nDisallow: /t", "/t", False),
    ("User-agent: *\nDisallow: /a+b(c)", "/a+b(c)d", False),
    ("User-agent: *\nAllow: /same\nDisallow: /same", "/same", True),
    ("User-agent: *\nDisallow: /p # why\nDisallow /q", "/q", True),
    ("User-agent: *\nDisallow: /s?x=1", "/s?x=1&y", False),
])
def test_allowed(spark, content, path, expected):
    assert allowed(spark, content, path) is expected


def test_delay_and_sitemaps(spark):
    files = spark.createDataFrame([("e.com", "https://e.com/robots.txt", "User-agent: *\nCrawl-delay: 5\nCrawl-delay: x\nSitemap: https://e.com/a.xml\nSitemap: /b.xml")], "domain string, base_url string, content string")
    assert robots.rule_sets(files).first().delay == 5.0
    assert rows(robots.sitemaps(files), "sitemap") == [("https://e.com/a.xml",), ("https://e.com/b.xml",)]
    assert spark.range(1).select(robots.effective_delay(F.lit(0.1))).first()[0] == 0.5


def test_parse_sitemap():
    full = '<urlset xmlns="http://x"><url><loc> https://e.com/a </loc><lastmod>2024-01-01</lastmod><changefreq>daily</changefreq><priority>0.5</priority></url><url><priority>1</priority></url></urlset>'
    assert sitemap.parse_sitemap(full) == [{"kind": "url", "loc": "https://e.com/a", "lastmod": "2024-01-01", "changefreq": "daily", "priority": 0.5}]
    assert sitemap.parse_sitemap(gzip.compress(full.encode())) == sitemap.parse_sitemap(full)
    assert [e["loc"] for e in sitemap.parse_sitemap("<urlset><LOC>https://e.com/b</LOC><loc>x</loc>")] == ["https://e.com/b"]
    broken = "<urlset><url><loc>https://e.com/1</loc></url><url><loc>https://e.com/2</loc><priority>high</priority></url><url><loc>https://e.com/3</loc></url></urlset>"
    assert [e["loc"] for e in sitemap.parse_sitemap(broken)] == ["https://e.com/1"]
    assert sitemap.parse_sitemap(None) == []
    assert sitemap.parse_sitemap("") == []


def test_expand_depth_and_cycles(spark):
    def index(*locs):
        return "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"

    def urls(*locs):
        return "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"

    files = [("s0", index("s1", "s0")), ("s1", index("s2")), ("s2", index("s3", "u2")), ("u2", urls("https://e/2")), ("s3", index("s4")), ("s4", urls("https://e/too-deep"))]
    found = sitemap.expand_sitemaps(spark.createDataFrame(files, "sitemap_url string, content string"), spark.createDataFrame([("s0",)], "sitemap_url string"))
    assert rows(found, "loc", "level") == [("https://e/2", 3)]
    assert sitemap.seeds(found).count() == 1
