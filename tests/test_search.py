import sqlite3

import pytest

from corpusloom.functions.text import stem
from corpusloom.operators import search

from .conftest import rows

DOCS = [
    (1, "http://a.com/one", "Running shoes", "The runner was running in the park. Café culture!", "A run", "a.com", 1),
    (2, "http://b.com/two", "Coffee", "Cafe and coffee: the best coffee in town. Running water.", None, "b.com", 1),
    (3, "http://c.org/three", None, "Nothing to see here; only words and more words about parks", "parks", "c.org", 2),
    (4, "http://c.org/four", "Best of", "the the the the", "", "c.org", None),
    (5, "http://d.net/five", "Long", " ".join(f"filler{i}" for i in range(60)) + " needle in the haystack " + " ".join(f"tail{i}" for i in range(60)), "x", "d.net", 2),
    (6, "http://e.net/six", "", "", "", "e.net", 2),
]
SCHEMA = "id long, url string, title string, content string, description string, domain string, session_id long"
QUERIES = ["running", "run", "coffee", "cafe", "café", '"running in"', "running AND coffee", "running OR parks", "coffee NOT park", "the best", "need*", '"best coffee"', "words and more", "zzz", "BRAND", "park"]


@pytest.fixture(scope="module")
def store(spark):
    from pyspark.sql import functions as F

    return search.index_rows(spark.createDataFrame(DOCS, SCHEMA).withColumn("crawled_at", F.lit("2024-01-01").cast("timestamp"))).cache()


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(url, title, content, description, tokenize='porter unicode61')")
    con.executemany("insert into f(rowid, url, title, content, description) values (?, ?, ?, ?, ?)", [(d[0], d[1], d[2] or "", d[3], d[4] or "") for d in DOCS])
    return con


@pytest.mark.parametrize("text", QUERIES)
def test_equals_fts5(spark, store, fts, text):
    cleaned = search.clean_query(text)
    index, lengths = search.postings(store), search.doc_lengths(store)
    query = search.parse_query(cleaned)
    got = {r.doc_id: r.score for r in search.bm25(index, lengths, query).collect()}
    expected = {i: abs(s) for i, s in fts.execute("select rowid, bm25(f) from f where f match ?", (cleaned,))}
    assert got.keys() == expected.keys()
    assert all(abs(got[i] - expected[i]) < 1e-6 for i in got)


def test_invalid_queries_find_nothing(spark, store):
    index, lengths = search.postings(store), search.doc_lengths(store)
    for text in ("", "NOT apple", "*", "AND", '""', "a OR", None):
        page, total = search.search(store, index, lengths, text)
        assert page.count() == 0
        assert total.first().total == 0
        assert "snippet" in page.columns


def test_cleaning():
    assert search.clean_query("foo-bar, baz!") == "foo* bar* baz*"
    assert search.clean_query("BRAND new") == "BRAND* new*"
    assert search.clean_query("a AND b") == "a AND b"
    assert search.clean_query('"exact words"') == '"exact words"'


def test_paging_filters_snippets(spark, store):
    index, lengths = search.postings(store), search.doc_lengths(store)
    page, total = search.search(store, index, lengths, "the OR words OR needle", per_page=2)
    assert total.first().total == 5
    second, _ = search.search(store, index, lengths, "the OR words OR needle", page=2, per_page=2)
    assert len({r.doc_id for r in page.collect()} | {r.doc_id for r in second.collect()}) == 4
    assert {r.doc_id for r in search.search(store, index, lengths, "the OR words", domain="C.ORG")[0].collect()} == {3, 4}
    assert {r.doc_id for r in search.search(store, index, lengths, "the OR words OR needle", session_id=2)[0].collect()} == {3, 5}
    needle = search.search(store, index, lengths, "needle")[0].first()
    assert "<mark>needle</mark>" in needle.snippet
    assert needle.snippet.startswith("...")
    assert needle.snippet.endswith("...")
    assert search.search(store, index, lengths, "parks")[0].where("doc_id = 3").first().title == "Untitled"


def test_snippet_marks_phrases():
    query = search.parse_query('"best coffee"')
    assert search.snippet("The best coffee ever", query) == "The <mark>best coffee</mark> ever"
    assert search.snippet("", query) == ""


def test_stemmer_against_sqlite():
    words = "caresses ponies ties cats feed agreed plastered motoring conflated troubled sized hopping falling hissing failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption communism activate angulariti homologous effective bowdlerize probate rate cease controll roll generalizations oscillators".split()
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(x, tokenize='porter unicode61')")
    con.execute("create virtual table v using fts5vocab(f, 'instance')")
    con.executemany("insert into f(rowid, x) values (?, ?)", enumerate(words, 1))
    expected = dict(con.execute("select doc, term from v").fetchall())
    assert {w: stem(w) for w in words} == {w: expected[i] for i, w in enumerate(words, 1)}


def test_upsert_and_delete(spark, store):
    from pyspark.sql import functions as F

    new = spark.createDataFrame([(9, "http://a.com/one", "New", "fresh words here", None, "other", 7)], SCHEMA).withColumn("crawled_at", F.lit("2024-02-01").cast("timestamp"))
    merged = search.upsert(store, new)
    row = merged.where("url = 'http://a.com/one'").first()
    assert (row.title, row.word_count, row.domain, row.session_id) == ("New", 3, "a.com", 7)
    assert merged.count() == len(DOCS)
    assert {r.id for r in search.delete_session(store, 2).collect()} == {1, 2, 4}


def test_empty_store(spark, store):
    none = store.limit(0)
    page, total = search.search(none, search.postings(none), search.doc_lengths(none), "words")
    assert page.count() == 0
    assert total.first().total == 0
    assert rows(search.doc_lengths(none)) == []


def test_stored_index_equals_the_other(spark, tmp_path):
    """The stored index, read by partitions, ranks as the one made on the fly; a
    prefix of one letter reads all of it."""
    rows = [(i, f"https://h.example/{i}", f"Title {w}", f"Text about {w} and telescopes {i}", None) for i, w in enumerate("tea tent tiger moon Übung mill tea".split())]
    store = spark.createDataFrame(rows, "id long, url string, title string, content string, description string")
    index, lengths = search.stored_index(store, f"file://{tmp_path}/index")
    for text in ("t*", "te*", "telescope moon", '"about tea"', "ubung", "tea OR tiger", "tea NOT tent"):
        query = search.parse_query(text)
        a = {r.doc_id: round(r.score, 9) for r in search.bm25(index, lengths, query).collect()}
        b = {r.doc_id: round(r.score, 9) for r in search.bm25(search.postings(store), search.doc_lengths(store), query).collect()}
        assert a == b and a
    empty = search.stored_index(store.limit(0), f"file://{tmp_path}/none")
    assert search.bm25(*empty, search.parse_query("tea")).count() == 0
