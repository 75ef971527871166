from pyspark.sql import functions as F

from corpusloom.sources import html

BASE = "https://example.com/page"
PAGE = """<html lang="en"><head><title>Test Page</title>
<meta name="description" content="First"><meta name="description" content="A description"><meta name="keywords" content="a, b ,c">
<meta property="og:title" content="OG Title"><meta property="og:image" content="https://example.com/i.jpg"><link rel="canonical" href="https://example.com/canonical">
<script type="application/ld+json">{"@type": "Article", "headline": "Test"}</script><script type="application/ld+json">not json</script></head>
<body><header>Head</header><nav><a href="/nav">Nav</a></nav><h1>Main</h1><h2> </h2><h2>Sub &amp; more</h2>
<p>Hello <b>big <i>world</b></p><p>Next<div>Block</div><script>alert("</p>")</script><!-- hidden -->
<a href="/internal">Internal</a><a href="https://other.com/x" rel="noopener nofollow">External</a><a href="javascript:void(0)">No</a><a href="#top">No</a><a>None</a>
<iframe src="/frame"></iframe><img src="a.png" alt="A"><img data-src="b.png"><img></body></html>"""


def test_metadata_and_structure():
    page = html.parse_html(PAGE, BASE)
    m = page["metadata"]
    assert m["title"] == "Test Page"
    assert m["description"] == "A description"
    assert m["keywords"] == ["a", "b", "c"]
    assert (m["og_title"], m["og_image"], m["og_type"]) == ("OG Title", "https://example.com/i.jpg", None)
    assert m["canonical_url"] == "https://example.com/canonical"
    assert m["language"] == "en"
    assert dict(page["headings"])["h1"] == ["Main"]
    assert dict(page["headings"])["h2"] == ["Sub & more"]
    assert page["structured_data"] == ['{"@type": "Article", "headline": "Test"}']
    assert page["images"] == [{"src": "https://example.com/a.png", "alt": "A", "title": ""}, {"src": "https://example.com/b.png", "alt": "", "title": ""}]


def test_text_leaves_out_frame_and_scripts():
    text = html.parse_html(PAGE, BASE)["text_content"]
    assert "Hello big world" in text
    assert "Next Block" in text
    assert not any(x in text for x in ("alert", "hidden", "Head", "Nav"))


def test_links():
    links = html.parse_html(PAGE, BASE)["links"]
    assert [(x["url"], x["is_internal"], x["nofollow"], x["link_type"]) for x in links] == [
        ("https://example.com/nav", True, False, "anchor"), ("https://example.com/internal", True, False, "anchor"),
        ("https://other.com/x", False, True, "anchor"), ("https://example.com/frame", True, False, "frame"),
    ]


def test_limits():
    page = html.parse_html("<img src=a>" * 60 + "<h1>" + "x" * 300 + "</h1><a href=/>" + "y" * 300 + "</a>", BASE)
    assert len(page["images"]) == 50
    assert len(dict(page["headings"])["h1"][0]) == 200
    assert len(page["links"][0]["text"]) == 200


def test_change_text_keeps_lines():
    text, title = html.change_text("<title>T</title><header>H</header><p>One</p><p>Two <b>x</b></p><aside>Kept</aside><script>s</script>")
    assert title == "T"
    assert text == "T\nOne\nTwo\nx\nKept"


def test_crawlable_links(spark):
    nofollow = PAGE.replace("<title>", '<meta name="robots" content="index,NOFOLLOW"><title>')
    pages = spark.createDataFrame([(BASE, PAGE), ("https://example.com/n", nofollow), ("https://example.com/e", None)], "url string, html string")
    parsed = html.parse_pages(pages)
    got = {r.url: r.u for r in parsed.select("url", html.crawlable_links(F.col("links"), F.col("metadata.robots")).alias("u")).collect()}
    assert got[BASE] == ["https://example.com/nav", "https://example.com/internal", "https://example.com/frame"]
    assert got["https://example.com/n"] == []
    assert got["https://example.com/e"] == []
    external = parsed.where(F.col("url") == BASE).select(html.crawlable_links(F.col("links"), respect_nofollow=False, internal_only=False).alias("u")).first().u
    assert "https://other.com/x" in external
    assert html.link_edges(parsed).where(F.col("src") == BASE).count() == 4


def test_variants(spark):
    pages = spark.createDataFrame([(BASE, '<script type="application/ld+json">[{"a": 1}, {"a": 2}]</script>')], "url string, html string")
    items = html.structured_variants(html.parse_pages(pages))
    assert [r.a for r in items.orderBy("pos").select(F.variant_get("item", "$.a", "int").alias("a")).collect()] == [1, 2]
