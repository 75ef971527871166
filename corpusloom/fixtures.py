"""Small invented inputs for operators whose input the test tables lack: page
sources, robots files, sitemaps, schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HTML_PAGES = [
    ("https://site.example/a", '<html lang="en"><head><title> First page </title><meta name="description" content="About"><meta name="keywords" content="one, two"><meta property="og:title" content="OG one"><link rel="canonical" href="https://site.example/a"></head><body><nav><a href="/b">Next</a></nav><h1>Hello</h1><p>Some <b>bold</b> text<p>Second</body></html>'),
    ("https://site.example/b", '<html><head><title>Second</title><meta name="robots" content="noindex, NoFollow"><script type="application/ld+json">[{"@type":"Article","headline":"X"},{"@type":"Person"}]</script></head><body><script>var t="</p>";</script><h2>Sub</h2><a href="https://other.test/x" rel="nofollow me">Out</a><a href="mailto:a@b.c">Mail</a><iframe src="/frame"></iframe><img src="/i.png" alt="I"><img data-src="j.png"></body></html>'),
    ("https://site.example/c?q=1", "<body><a href='../d#top'>Up</a><a href='?q=2'>Query</a><!-- note --><footer>Foot</footer><ul><li>One<li>Two</ul></body>"),
    ("https://site.example/d", ""),
]
ROBOTS = [
    ("site.example", "https://site.example/robots.txt", "User-agent: *\nDisallow: /private/\nAllow: /private/open\nCrawl-delay: 5 # slow\nSitemap: /maps/site.xml\nDisallow: /*.pdf$\n"),
    ("other.test", "https://other.test/robots.txt", "User-agent: LoomBot\nUser-agent: Elsebot\nDisallow: /loom\n\nUser-agent: *\nDisallow: /\n"),
    ("empty.test", "https://empty.test/robots.txt", "User-agent: *\nDisallow:\n"),
]
ROBOTS_PATHS = [
    "https://site.example/", "https://site.example/private/x", "https://site.example/private/open/y", "https://site.example/doc.pdf", "https://site.example/doc.pdf?x=1",
    "https://other.test/loom/1", "https://other.test/other", "https://empty.test/any", "https://unknown.test/any",
]
SITEMAPS = [
    ("https://site.example/maps/index.xml", '<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://site.example/maps/one.xml</loc></sitemap><sitemap><loc>https://site.example/maps/index.xml</loc></sitemap><sitemap><loc>https://site.example/maps/two.xml</loc></sitemap></sitemapindex>'),
    ("https://site.example/maps/one.xml", '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://site.example/a </loc><lastmod>2024-01-02</lastmod><changefreq>daily</changefreq><priority>0.8</priority></url><url><loc>https://site.example/b</loc></url></urlset>'),
    ("https://site.example/maps/two.xml", "<urlset><url><loc>https://site.example/c</loc><url><LOC>https://site.example/d</LOC>"),
]
NOW = "2024-03-10 12:00:30"
SCHEDULES = [
    # id, name, url, type, cron, interval, run_at, status, last_run, run_count
    (1, "nightly", "https://site.example/", "cron", "30 2 * * *", None, None, "active", None, 0),
    (2, "weekday mornings", "https://site.example/", "cron", "0 9 * * mon-fri", None, None, "active", None, 3),
    (3, "hourly", "https://other.test/", "interval", None, 3600, None, "active", "2024-03-10 11:20:00", 7),
    (4, "never ran", "https://other.test/", "interval", None, 900, None, "active", None, 0),
    (5, "once ahead", "https://other.test/", "once", None, None, "2024-03-11 00:00:00", "active", None, 0),
    (6, "once past", "https://other.test/", "once", None, None, "2024-03-09 00:00:00", "active", None, 0),
    (7, "paused", "https://other.test/", "interval", None, 60, None, "paused", None, 0),
    (8, "missed", "https://other.test/", "interval", None, 3600, None, "active", "2024-03-10 02:00:00", 2),
]


def html_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HTML_PAGES, "url string, html string")


def robots_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROBOTS, "domain string, base_url string, content string")


def robots_paths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u,) for u in ROBOTS_PATHS], "url string")


def sitemap_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SITEMAPS, "sitemap_url string, content string")


def schedules(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(SCHEDULES, "id long, name string, url string, schedule_type string, cron_expression string, interval_seconds long, run_at string, status string, last_run string, run_count long")
    return rows.withColumns({c: rows[c].cast("timestamp") for c in ("run_at", "last_run")})


def values_sql(rows: list[tuple], columns: str) -> str:
    """Rows as a SQL table."""

    def literal(value) -> str:
        return "NULL" if value is None else str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"

    # line ends inside of literals are kept as they are
    body = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({columns}))"
