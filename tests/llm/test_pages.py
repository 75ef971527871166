"""Operators on single pages: furniture, forms, quality, language, residue, subjects, spam."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import boilerplate, language, quality, residue, spam, subjects
from corpusloom.llm.furniture import furniture_flags
from corpusloom.llm.lineforms import line_form, page_form

DATA = "/root/testdata/sf0.001"
COMMON = frozenset("the a an of to in and is it that for on with as at by der die das und".split())
PROSE = "The old mill stands by the river and it is open to all. In the yard a wheel turns, and the water is cold."
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def flags(text, title=None):
    return [i for i, f in enumerate(furniture_flags(text.split("\n"), title)) if f]


def test_furniture_lines():
    text = "Home | About us | Contact\n\nThe title\n" + PROSE + "\nMost read\nThe early bird\nA late train and a ticket\n\nAll rights of the old lease were reserved for 3 years.\n© 2020 Some Press. All rights reserved.\nSome Press | Imprint | Privacy"
    assert flags(text, "The title") == [0, 4, 5, 6, 9, 10]


@pytest.mark.parametrize("line", ["* Kontakt", "News  Topics  Log in", "Gallery > Events", "12 comments", "Tags: one, two", "Anzeige", "Zum Inhalt springen", "Accept all", "We and 12 partners use cookies. OK", "Contact: office@site.example - phone 000 1 2"])
def test_furniture_wording(line):
    assert flags(line) == [0]


@pytest.mark.parametrize("line", ["A newsletter from Casna was read by 10 people that spring.", "The cookie banner of Brimar was redesigned in 2001.", "- hotel", "mens > chair > grill", "Privacy was a rare thing in town.", "The menu had only 3 entries.", "404 - the page you asked for could not be found."])
def test_no_furniture(line):
    assert flags(line) == []


def test_related_block_ends():
    assert flags("Related articles\nThe one\nThe two\nThe Title\nBody", "The Title") == [0] or flags("Related articles\nThe one\nThe two\nThe Title\nBody", "The Title") == [0, 1, 2]
    assert flags("Related articles\n" + PROSE) == [0]
    assert flags("") == []


@pytest.mark.parametrize(("line", "form"), [
    (PROSE, "P"), ("| a | b | c |", "C"), ("x;1;2;n/a", "C"), ("a\tb", "C"), ("tea ..... 3  4%", "C"), ("* item one", "E"), ("12. item", "E"), ("[x] done thing", "E"), ("https://e.com/x", "E"),
    ("A title - https://e.com/x", "E"), ("crib (12)", "E"), ("SKU 12345 lamp blue", "E"), ("#one #two #three", "L"), ("a > b > c", "L"), ("lamp-blue, sofa-red, desk-xl, tent-pro", "L"),
    ("12:00:01 WARN [w1] q=1 id=2", "J"), ("00000010  00 11 22 33 44 55 66 77", "J"), ("xxxxxxxxxxxxxxxxxxxxxxxx yyyy", "J"), ("@#$%^&*|~_=+<>/\\[]{}@#$%", "J"), ("The title", "H"), ("Access to host.example/a/1 is denied for this address.", "P"),
])
def test_line_form(line, form):
    assert line_form(line) == form


def test_page_form():
    assert page_form([PROSE, PROSE], COMMON)[0] == "prose"
    assert page_form(["Heading here", "* one", "* two", "* three"], COMMON)[0] == "list"
    assert page_form(["| a | b |", "| 1 | 2 | 3 |", "| 1 | 2 | 3 |"], COMMON)[0] == "table"
    assert page_form(["cheap lamp best lamp buy lamp lamp sale lamp new lamp offer lamp top lamp"] * 3, COMMON)[0] == "keywords"
    assert page_form([], COMMON)[0] == "empty"


PAGES = "id long, url string, title string, content string, word_count long"


def test_page_kinds(spark):
    rows = [(1, "u1", None, PROSE, len(PROSE.split())), (2, "u2", "T", "* a\n* b\n* c", 6), (3, "u3", None, None, 0), (4, "u4", None, None, None), (5, "u5", None, "", 0), (6, "u6", None, PROSE + "\n" + "* a", 3), (2, "u2", "T", "* a\n* b\n* c", 6), (7, "u7", None, "word " * 60000, 60000)]
    got = sorted(tuple(r) for r in quality.page_kinds(spark.createDataFrame(rows, PAGES), COMMON).collect())
    assert [g for g in got if g[0] != 7] == [(2, "list"), (2, "list"), (4, "miscounted"), (6, "miscounted")]
    assert quality.page_kinds(spark.createDataFrame([], PAGES), COMMON).count() == 0


def test_repetition_decides_stuffing():
    """Sentences of a few terms that come back are junk by repetition alone."""
    text = "\n".join(f"Looking for {a} lamp? Buy sofa, {b} sofa, lamp {a}, sofa lamp {b}. {a.upper()} LAMP!" for a, b in (("cheap", "new"), ("red", "used"), ("top", "best"), ("wide", "long")))
    assert quality.kind_of(text, None, COMMON) == "junk"
    assert quality.kind_of(text, None, COMMON, by_repetition=False) is None
    assert quality.kind_of("\n".join(["* a lamp of old"] * 9), None, COMMON) == "junk"
    assert quality.kind_of("\n".join(f"* a lamp of {x}" for x in "abcdefghi"), None, COMMON) == "list"


def test_statistics():
    s = dict(zip([c.split()[0] for c in quality.STATISTICS_SCHEMA.split(", ")][1:], quality.statistics("one two one two one two\none two one two one two\n\nend.", frozenset({"one"}))))
    assert s["n_words"] == 13
    assert s["duplicate_line_share"] == pytest.approx(1 / 3)
    assert s["top_2gram_coverage"] > 0.9
    assert s["duplicate_5gram_coverage"] > 0.5
    assert s["common_word_share"] == pytest.approx(6 / 13)
    assert all(x == 0 for x in quality.statistics(None, COMMON))
    assert quality.repetition(["a"]) == (0.0, 0.0, 0.0, 0.0)


def test_statistics_ignore_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", 5)], "id long, content string, text string, doc_id int")
    assert quality.text_statistics(df, "id", "content", COMMON).first().n_words == 2


def site_pages(hosts=1, per_host=60, menu="Zorgle  Frobnicator  Quux"):
    """Pages of made-up sites whose furniture no wording list knows."""
    rows = []
    for h in range(hosts):
        for i in range(per_host):
            body = [f"Body sentence number {'x' * (i * 7 % 90)} of page {chr(97 + i % 26) * 3} on site {h} tells of it at length.", *[f"More of text {'y' * (i + 1)} {chr(97 + j)}, quite unlike, on site {h}." for j in range(i % 9)]]
            related = ["Blorp these next", f"Das Haus {chr(65 + i % 26)}{chr(97 + i // 26)}{chr(97 + h)} am See", f"Ein Garten {chr(65 + i % 26)}{chr(97 + i // 26)}{chr(97 + h)} im Wind"] if i % 2 else []
            rows.append((f"https://h{h}.example/{i}", None, "\n".join([menu, *body, *related, "", f"Vreemd {2000 + i % 20} zonder woorden"])))
    return rows


def described(df):
    return df.select(F.lit("t").alias("tbl"), F.monotonically_increasing_id().alias("row_id"), "url", "title", "text")


def test_template_finds_unknown_furniture(spark):
    """Furniture that no wording list knows is found by its occurrence, the
    titles of a slot it opens included, with and without the lists."""
    pages = site_pages() + [(f"https://k.example/{i}", None, f"Only text {'z' * i}.") for i in range(10)]
    df = spark.createDataFrame(pages, "url string, title string, text string")
    templates = boilerplate.deduce_templates(df)
    assert {r.host for r in templates.collect()} == {"h0.example"}
    docs = described(df)
    for wording in (True, False):
        found = boilerplate.label_lines(docs, templates, wording)
        assert found.where("line_no = 1 and origin = 'template'").count() == 60
        assert found.where("origin = 'slot'").count() == 60
        assert found.where("origin = 'template'").count() == 60 + 30 + 60
        assert found.count() == 210
    bodies = [r.body for r in boilerplate.main_body(docs, templates).collect()]
    assert not any("Zorgle" in b or "Vreemd" in b or "am See" in b for b in bodies)
    assert all(b for b in bodies)


def test_shared_template_serves_small_hosts(spark):
    """A line of several hosts' templates is furniture on a host of one page."""
    df = spark.createDataFrame(site_pages(hosts=4, per_host=20) + [("https://one.example/", None, "Zorgle\nA sentence of its own stands on this page.")], "url string, title string, text string")
    found = boilerplate.label_lines(described(df).where("url = 'https://one.example/'"), boilerplate.deduce_templates(df), wording=False)
    assert [r.line_no for r in found.collect()] == [1]


def test_copies_of_a_page_are_no_template(spark):
    text = "A first sentence of the copied page stands here.\nA second one follows.\nThe third.\nTags: a, b"
    df = spark.createDataFrame([(f"https://h.example/{i}", None, text) for i in range(40)], "url string, title string, text string")
    docs = df.select(F.lit("t").alias("tbl"), F.lit(1).cast("long").alias("row_id"), "url", "title", "text")
    assert {r.line_no for r in boilerplate.label_lines(docs, boilerplate.deduce_templates(df)).collect()} == {4}


def test_large_templates_join(spark, monkeypatch):
    """Without a broadcast the same lines are found."""
    df = spark.createDataFrame(site_pages(hosts=4, per_host=20) + [("https://one.example/", None, "Zorgle\nA sentence of its own stands on this page.")], "url string, title string, text string")
    docs, templates = described(df), boilerplate.staged(boilerplate.deduce_templates(df), "t")
    want = sorted(tuple(r) for r in boilerplate.label_lines(docs, templates).collect())
    monkeypatch.setattr(boilerplate, "BROADCAST_BYTES", 0)
    assert sorted(tuple(r) for r in boilerplate.label_lines(docs, templates).collect()) == want
    assert len({x[1] for x in want}) == 81


def test_template_edge_cases(spark):
    df = spark.createDataFrame([(None, None, "A"), ("no address", "T", "A"), ("https://h.example/", "T", None), ("https://h.example/", "T", ""), ("https://h.example/", "T", "\n\n"), ("https://h.example/l", "T", "x" * 300_000)], "url string, title string, text string")
    templates = boilerplate.deduce_templates(df)
    assert templates.count() == 0
    assert boilerplate.label_lines(described(df), templates).count() == 0
    assert boilerplate.deduce_templates(df.limit(0)).count() == 0
    joined = boilerplate.label_lines(described(df), templates)
    assert joined.columns == ["tbl", "row_id", "line_no", "origin"]


def test_line_tokens():
    assert boilerplate.line_tokens("* Home | News 12") == boilerplate.line_tokens("home  news 7") and len(boilerplate.line_tokens("Home > News")) == 2
    assert boilerplate.line_tokens("Tea  12  -") == []
    assert boilerplate.line_tokens("") == []


@needs_data
def test_language_model_held_out(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{DATA}/subject_samples.parquet").orderBy("sample_id").collect()]
    model = language.train(rows[::2])
    best, sure = language.score(model, [t for _, t in rows[1::2]])
    assert np.mean([model.langs[b] == lang for b, (lang, _) in zip(best, rows[1::2])]) > 0.99
    one, _ = language.score(model, [rows[1][1]])
    assert one[0] == best[0]  # a text's score does not depend on its batch
    assert language.score(model, [""])[1][0] <= 1 / len(model.langs) + 1e-9 or len(language.score(model, [""])[0]) == 1
    assert (sure <= 1).all()


@pytest.mark.parametrize(("label", "code"), [("en-US", "en"), ("EN_gb", "en"), ("Deutsch", "de"), ("fra", "fr"), (" Español ", "es"), ("und", None), ("", None), (None, None), ("x-default", None), ("{{ lang }}", None), ("pt-BR", "pt")])
def test_label_language(spark, label, code):
    assert spark.createDataFrame([(label,)], "l string").select(language.label_language(F.col("l"))).first()[0] == code


@needs_data
def test_foreign_segments(spark):
    model = language.train_from_tables(spark, DATA)
    german = "Der alte Hafen liegt an der Küste, und die Fähre fährt jeden Morgen zu den Inseln. Es ist bekannt, dass die Reise lang ist."
    english = "The old harbour lies on the coast, and the ferry leaves for the islands every morning. It is said that the journey is long."
    rows = [(1, "a", None, english + "\n" + german + "\n" + english, 1), (2, "b", None, german, 1), (3, "c", None, "* a\n* b\n* c", 1), (4, "d", None, None, 1), (5, "e", None, "Zugriff verweigert für host.example.", 1)]
    labels = spark.createDataFrame([("a", "en"), ("b", "en"), ("c", None), ("e", "fr")], "url string, label string")
    got = sorted(tuple(r)[:3] for r in language.foreign_segments(spark.createDataFrame(rows, PAGES), labels, model, COMMON).collect())
    assert got == [(1, 2, "de"), (2, 0, "de")]


@pytest.mark.parametrize("text", ["Hello {{ name }}!", "{% title %}", "${user_name} x", "#{date}", "[[headline]]", "by [author]", "<%= company %>", "<?= $title ?>", "@@date@@", "__site.url__", "%TITLE%", "&lt;city&gt;", "{item.label}",
                                  "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Good text.\nContent coming soon. Check back later.", "404 - the page you asked for could not be found.", "Veuillez activer JavaScript pour afficher X.", "Fehler 404: Die Seite wurde nicht gefunden."])
def test_residue(text):
    assert residue.residue_text(text)


@pytest.mark.parametrize("text", ["A template writes `{{ name }}` where the value belongs.", "Designers often paste lorem ipsum into a draft, which is a habit.", "When a server answers with status 404, the team repairs it.", "An error 7 in 1990 taught us.", "[x] done", "[A link](http://e.com)", "100 % of it, 5% more", ""])
def test_no_residue(text):
    assert not residue.residue_text(text)


def test_residue_titles():
    assert all(map(residue.residue_title, ["%TITLE%", "undefined - Some Press", "null | X", "404 Not Found", "Untitled document", "Page introuvable", "Error 500", "{0} - X"]))
    assert not any(map(residue.residue_title, ["Null results from Minosk", "Error bars in the survey", "Maintenance of the bridge", "How we count errors", "The title"]))


def test_residue_by_host_evidence(spark):
    """A notice no detector knows is found by its return under many addresses."""
    docs = [("page_versions", i, f"https://h{i % 6}.example/topic{i}/item", "Some title about topic", f"The frobnicator has refused your wish number {i}.") for i in range(12)]
    docs += [("page_versions", 100, "https://h.example/cold-rivers", "Cold rivers", "Cold rivers are found in the north."), ("page_versions", 101, None, None, None), ("indexed_pages", 102, None, None, None), ("indexed_pages", 103, None, "404 Not Found", None)]
    df = spark.createDataFrame(docs, "tbl string, row_id long, url string, title string, text string")
    assert sorted(r.row_id for r in residue.residue(df).collect()) == [*range(12), 103]


def test_source_model():
    """Rates of slug, title and category come from pages; rows without any, and no
    pages at all, have a model, too."""
    pages = [(np.array([5.0, 0.0]), 10, [0], [0], ["a"]), (np.array([0.0, 5.0]), 10, [1], [], ["b"])] * 20 + [(np.zeros(2), 10, [], [], [])]
    source = subjects.fit_source(pages, 2)
    assert source.own[0] > 0.9 > source.own[1] > 0.4 and source.other[0] < 0.1
    says = subjects.category_says(source, ["a", "unheard"], 2)
    assert says[0] > 0 > says[1]
    assert (subjects.category_says(source, [], 2) == 0).all() and (subjects.category_says(None, ["a"], 2) == 0).all()
    assert subjects.fit_source([], 2).categories == []


@needs_data
def test_subject_chain_uses_cooccurrence_and_source():
    """Where terms are missing, the source moves what the chain decides."""
    import pandas as pd

    rows = [tuple(r) for r in pd.read_parquet(f"{DATA}/subject_samples.parquet")[["lang", "subject", "text"]].itertuples(index=False)]
    names = sorted({r[1] for r in rows})
    n = len(names)
    source = subjects.fit_source([(np.eye(n)[i] * 8, 10, [i], [i], [names[i]]) for i in range(n)] * 20, n)
    chain = subjects.train_chain(rows, names, COMMON, composed=1500, source=source)
    hits = np.zeros(n)
    hits[2] = 2  # a fifth of the sentences only
    bare = subjects.feature_row(hits, 10, 2, set(), set(), n)
    helped = subjects.feature_row(hits, 10, 2, {2}, {2}, n, subjects.category_says(source, [names[2]], n))
    _, chances = subjects.decode(chain, np.array([bare, helped]))
    assert chances[1, 2] > chances[0, 2]


EVIDENCE = "page_id long, url string, sentences int, paragraphs int, hits array<double>, slug array<int>, title array<int>, categories array<string>"


def test_source_counted_over_all_pages(spark):
    """The counts of Spark are those of `fit_source` on every row, and each set of
    categories gets what `category_says` says of it."""
    rng = np.random.default_rng(3)
    n, names = 3, ["a", "b", "c", "rare", "also rare"]
    rows = []
    for i in range(400):
        own = sorted(names[k] for k in rng.permutation(3)[: rng.integers(0, 3)])
        rows.append((i, f"u{i}", int(rng.integers(0, 9)), 1, [float(x) for x in rng.integers(0, 3, n)], sorted(int(x) for x in rng.permutation(n)[: rng.integers(0, 3)]), [int(x) for x in rng.permutation(n)[:1]], own))
    rows += [(400, "r", 4, 1, [0.0, 4.0, 4.0], [1], [2], ["a", "rare"]), (401, "s", 4, 1, [0.0, 4.0, 0.0], [], [], ["also rare"]), (0, "u0", *rows[0][2:])]
    local = subjects.fit_source([(np.array(r[4]), r[2], r[5], r[6], r[7]) for r in rows], n)
    source, odds = subjects.count_source(spark.createDataFrame(rows, EVIDENCE), n)
    np.testing.assert_allclose([*source.own, *source.other], [*local.own, *local.other])
    said = {tuple(r.categories): subjects.mean_odds(r.odds, n) for r in odds.collect()}
    assert set(said) == {tuple(r[7]) for r in rows if r[7]}
    for own, got in said.items():
        np.testing.assert_allclose(got, subjects.category_says(local, list(own), n))
    assert len(source.categories) == len(names) - 1  # the rare ones have equal counts
    np.testing.assert_allclose(source.given.sum(axis=1), 1)
    np.testing.assert_allclose(source.given[:, source.categories.index("also rare")], local.given[:, [local.categories.index("rare"), local.categories.index("also rare")]].sum(axis=1))
    np.testing.assert_allclose(source.given[:, -1], local.given[:, -1])
    source, odds = subjects.count_source(spark.createDataFrame([], EVIDENCE), n)
    assert source.categories == [] and odds.count() == 0


def test_subjects_learn_from_all_samples_and_pages(spark, tmp_path):
    """More samples and pages than were once looked at: the last samples, with
    terms that no other has, and the last page count, too."""
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))

    first, last = "The windmill turns and it is old.", "The weaver has a loom and it is good."
    pages = [(i, f"https://h.example/{'windmill' if i % 3 else 'x'}/{i}", "The house", first, 1) for i in range(6000)]
    pages += [(6000, "https://h.example/x/6000", "The weaver", last, 1), (6001, None, None, None, 1)]
    samples = [(i, *(("nl", "mills", "De molen staat aan zee.") if i % 2 else ("en", "mills", "The windmill turns and it is old."))) for i in range(20_100)]
    samples += [(20_100 + i, "en", "weaving", "The weaver has a loom and it is good.") for i in range(2)] + [(20_103, "en", None, "x"), (20_104, None, "mills", "x"), (20_105, "en", "mills", None), (20_106, "en", "other", "The loom")]
    write("indexed_pages", pages, PAGES)
    write("subject_samples", samples, "sample_id long, lang string, subject string, text string")
    write("subject_areas", [("mills",), ("weaving",)], "subject string")
    write("common_words", [("en", w, i) for i, w in enumerate(sorted(COMMON))], "lang string, word string, freq_rank int")
    write("classification_results", [(url, f"C{i % 2}") for i, (_, url, *_) in enumerate(pages)] + [(pages[6000][1], " Crafts ")], "url string, category string")
    found, chain = subjects.assigned_subjects(spark, str(tmp_path))
    assert chain.terms == {"en": {"windmill": 0, "turns": 0, "old": 0, "weaver": 1, "loom": 1, "has": 1, "good": 1}, "nl": {"molen": 0, "staat": 0, "aan": 0, "zee": 0}}
    np.testing.assert_allclose(chain.source.own, [4001 / 6005, 2 / 6005])
    assert sorted(chain.source.categories) == ["c0", "c1", "crafts"]
    assert {(r.page_id, r.subject) for r in found.collect()} == {(i, "mills") for i in range(6000)} | {(6000, "weaving")}
    model, local = language.train_from_tables(spark, str(tmp_path)), language.train([(r[1], r[3]) for r in samples], [("en", w) for w in COMMON])
    assert model.langs == local.langs == ["en", "nl"] and (model.table == local.table).all()


@needs_data
def test_subjects_do_not_depend_on_the_join(spark, monkeypatch):
    """What the categories say is the same where it is too large to be broadcast."""
    columns = "page_id", "subject", F.round("probability", 9), F.round("share", 9)
    found = sorted(tuple(r) for r in subjects.p5_subjects(spark, DATA).select(*columns).collect())
    monkeypatch.setattr(subjects, "BROADCAST_BYTES", -1)
    assert found and sorted(tuple(r) for r in subjects.p5_subjects(spark, DATA).select(*columns).collect()) == found


@needs_data
def test_subject_chain_held_out(spark):
    names = sorted(r.subject for r in spark.read.parquet(f"{DATA}/subject_areas.parquet").collect())
    rows = [(r.lang, r.subject, r.text) for r in spark.read.parquet(f"{DATA}/subject_samples.parquet").orderBy("sample_id").collect()]
    chain = subjects.train_chain(rows[::2], names, COMMON, composed=1500)
    features, truth = [], []
    for lang, subject, text in rows[1::2]:
        found = [subjects.sentence_subjects(w, chain.terms[lang]) for w in subjects.sentences(text)]
        hits = np.array([sum(i in f for f in found) for i in range(len(names))], dtype=float)
        features.append(subjects.feature_row(hits, len(found), 1, set(), set(), len(names)))
        truth.append(names.index(subject))
    labels, chances = subjects.decode(chain, np.array(features))
    assert np.mean([lab[t] == 1 for lab, t in zip(labels, truth)]) > 0.9
    assert labels.sum(axis=1).mean() < 1.2
    assert ((chances >= 0) & (chances <= 1)).all()
    blank, _ = subjects.decode(chain, np.array([subjects.feature_row(np.zeros(len(names)), 10, 2, set(), set(), len(names))]))
    assert blank.sum() == 0


def test_beam_search_finds_the_best_combination():
    rng = np.random.default_rng(1)
    n = 4
    weights = [rng.normal(size=4 * n + 3 + i) for i in range(n)]
    chain = subjects.Chain(list("abcd"), {}, {}, weights, np.tile([1.0, 0.0], (n, 1)))
    x = rng.normal(size=(5, 4 * n + 3))
    labels, _ = subjects.decode(chain, x, beam=16)
    for row, got in zip(x, labels):
        def value(combo, row=row):
            total = 0.0
            for i in range(n):
                p = 1 / (1 + np.exp(-(row @ weights[i][: len(row)] + np.dot(combo[:i], weights[i][len(row):]))))
                total += np.log(p if combo[i] else 1 - p)
            return total
        combos = [tuple((k >> i) & 1 for i in range(n)) for k in range(2**n)]
        assert tuple(int(v) for v in got) == max(combos, key=value)


def test_spam(spark):
    words = {"en": ["the", "a", "of", "and", "in", "is", "it", "to"]}
    rows, links = [], []
    for i in range(120):
        rows.append((i, f"u{i}", None, f"The mill of town {i} is old and it stands in the valley. A road leads to the mill and it is open." * (1 + i % 3), 1))
        links.append((f"u{i}", [("https://x.example/" + str(k), f"Link {k}") for k in range(i % 40)]))
    rows += [(500, "k", None, "lamp sale cheap lamp best lamp lamp offer sofa lamp buy sofa lamp lamp top sofa\n" * 4, 1), (501, "l", None, "\n".join(f"Entry number {k} - https://e.example/{k}" for k in range(20)), 1),
             (502, "m", None, "\n".join(f"{w} ({i})" for i, w in enumerate("lamp sofa desk tent kite drum harp mug".split())), 1), (503, "n", None, "\n".join(f"* small item {k}, town" for k in range(20)), 1), (504, "o", None, None, 1)]
    links.append(("l", [(f"http://e.example/{k}/", "other") for k in range(20)]))
    df = spark.createDataFrame(rows, PAGES)
    table = spark.createDataFrame(links, "url string, links array<struct<url string, text string>>")
    assert sorted((r.page_id, r.kind) for r in spam.spam_pages(df, table, words).collect()) == [(500, "keywords"), (501, "links"), (502, "tags")]
    assert spam.spam_pages(df.limit(0), table, words).count() == 0


def test_entry_keys_equal_sql(spark):
    text, url = "A title", "https://E.example/x/"
    keys = spam.entry_keys(f"- {text} - {url}")[0][0]
    row = spark.createDataFrame([(text, url)], "t string, u string").select(F.xxhash64("t").alias("t"), F.xxhash64(F.lit("e.example/x")).alias("u")).first()
    assert set(keys) == {row.t, row.u}


def test_host_evidence_finds_unknown_residue(spark):
    """Titles and short responses that no list knows, on several hosts; pages that
    have a text of their own besides are none."""
    rows = []
    for i in range(12):
        url = f"https://h{i % 4}.example/a/{i}"
        rows.append(("indexed_pages", i, url, "Blorpmodus", f"The mill of town {i} is old and it stands by the river."))
        rows.append(("indexed_pages", 100 + i, url + "/m", "The windmill", f"A windmill of town {i} is old and it stands by the river."))
        rows.append(("page_versions", i, url, f"The mill {'x' * i}", f"Snarfle gebloop krunk {i} zork binnen {i} minuten."))
        rows.append(("page_versions", 100 + i, url, f"The mill {'x' * i}", f"Snarfle gebloop krunk {i} zork binnen {i} minuten.\nThe mill of town is old and it stands by the river."))
    rows += [("indexed_pages", 500, None, None, None), ("page_versions", 500, None, None, None), ("page_versions", 501, None, None, ""), ("page_versions", 502, "u", "T", "Text with {{ title }} in it.")]
    df = spark.createDataFrame(rows, "tbl string, row_id long, url string, title string, text string")
    want = {("indexed_pages", i) for i in range(12)} | {("page_versions", i) for i in range(12)} | {("page_versions", 502)}
    for lists in (True, False):
        assert {(r.tbl, r.row_id) for r in residue.residue(df, COMMON, lists).collect()} == want
    assert residue.residue(df.limit(0), COMMON).count() == 0


def test_long_notice():
    assert residue.notice("Error 503: the service is down. " + "It will be back after some work on it. " * 8)
    assert not residue.notice("The error of 503 was a mistake in the year. " + "It was told at length. " * 20)


@needs_data
def test_every_document_has_a_language(spark):
    model = language.train_from_tables(spark, DATA)
    german = "Der alte Hafen liegt an der Küste, und die Fähre fährt jeden Morgen zu den Inseln."
    english = "The old harbour lies on the coast, and the ferry leaves for the islands every morning."
    rows = [("t", 1, None, german), ("t", 2, None, None), ("t", 3, None, ""), ("t", 4, None, "12 34\n- -"), ("t", 5, None, "* the harbour\n* the island"), ("t", 6, None, f"{german} {german}\n{english}"), ("t", 7, None, "Home | About us"), ("t", 1, None, german)]
    got = [(r.row_id, r.lang, r.confidence, r.share) for r in language.document_languages(spark.createDataFrame(rows, "tbl string, row_id long, title string, text string"), model).collect()]
    assert sorted((i, lang) for i, lang, _, _ in got) == [(1, "de"), (1, "de"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (6, "de"), (7, "en")]
    by_id = {i: (c, s) for i, _, c, s in got}
    assert by_id[1][0] > 0.95 and by_id[2] == (0.0, 0.0) and 0.5 < by_id[6][1] < 0.8 and by_id[6][0] < by_id[1][0]
