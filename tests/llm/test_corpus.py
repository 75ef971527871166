"""Operators on the corpus: near-duplicates, packing, mixing, encodings."""

from __future__ import annotations

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import encoding, mixing, neardup, packing, tokens

VOCABULARY = os.path.join(tokens.FOLDER, tokens.VOCABULARY)
needs_tokenizer = pytest.mark.skipif(not os.path.isfile(VOCABULARY), reason="needs the public tokenizer files")

# --- near-duplicates
DOCS = "tbl string, row_id long, text string"
WORDS = [f"w{i}" for i in range(400)]


def brute(texts, words, similarity, least):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        s = frozenset(zip(*(w[k:] for k in range(words))))
        if len(s) >= least:
            sets[i] = s
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity}


def edited(rng, words, share):
    return [rng.choice(WORDS) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def family():
    rng = random.Random(7)
    texts = []
    for _ in range(25):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(90, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            texts.append(" ".join(edited(rng, base, rng.choice([0.0, 0.02, 0.05, 0.1, 0.3]))))
    texts += ["short text only", "", None, "Ünïcödé ÄÖÜ " * 3, "a " * 50_000]
    return list(enumerate(texts, 1))


def test_shingles_equal_definition(family):
    texts = [t or "" for _, t in family] + ["A-b_c d1 2e\nf", "İstanbul ſtraße x y", "x y\x00z w v"]
    sets, keys = neardup.shingles(texts, 3)
    for t, s in zip(texts, sets):
        w = re.findall(r"[^\W_]+", t.lower())
        assert len(s) == len(set(zip(w, w[1:], w[2:])))
    again, key = neardup.shingles(["Other text", texts[0].upper()], 3)
    assert key[1] == keys[0]  # neither neighbours nor case matter
    assert np.array_equal(again[1], sets[0])
    assert len(set(neardup.shingles(["a b c d", "a b d c"], 3)[1])) == 2


@pytest.mark.parametrize("share", [0.3, 0.5, 0.8])
def test_superminhash_is_unbiased_and_tighter(share):
    rng = np.random.default_rng(3)
    n = 150
    common = round(2 * n * share / (1 + share))
    estimates = []
    for _ in range(120):
        pool = rng.integers(0, 2**63, size=2 * n, dtype=np.int64).astype(np.uint64)
        sig = neardup.superminhash([pool[:n], np.concatenate([pool[:common], pool[n : 2 * n - common]])])
        estimates.append((sig[0] == sig[1]).mean())
    true = common / (2 * n - common)
    assert abs(np.mean(estimates) - true) < 0.01
    assert np.std(estimates) < (true * (1 - true) / neardup.SLOTS) ** 0.5


def test_signature_does_not_depend_on_neighbours():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, size=k, dtype=np.int64).astype(np.uint64)) for k in (1, 5, 60, 900)]
    together = neardup.superminhash(sets)
    assert all(np.array_equal(neardup.superminhash([s])[0], t) for s, t in zip(sets, together))
    assert (neardup.superminhash([np.zeros(0, dtype=np.uint64)]) == np.iinfo(np.uint64).max).all()


@pytest.mark.parametrize(("words", "similarity", "least"), [(3, 0.5, 60), (5, 0.8, 1)])
def test_pairs_equal_brute_force(spark, family, words, similarity, least):
    df = spark.createDataFrame([("t", i, t) for i, t in family] + [("other", i, t) for i, t in family[:5]], DOCS)
    members, pairs = neardup.similar_texts(df, words, similarity, least)
    got = {(r.id_a, r.id_b) for r in neardup.all_pairs(members, pairs).where("tbl = 't'").collect()}
    expected = brute(family, words, similarity, least)
    assert got <= expected
    assert len(got) >= 0.98 * len(expected)


def test_classes(spark, family):
    df = spark.createDataFrame([("t", i, t) for i, t in family] * 2, DOCS)  # every row delivered twice
    members, pairs = neardup.similar_texts(df, 3, 0.5, 60)
    got = neardup.group_classes(members, pairs)
    assert got.count() == got.select("row_id").distinct().count()
    classes = {r.row_id: r.class_id for r in got.collect()}
    parent = {i: i for i in classes}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in neardup.all_pairs(members, pairs).collect():
        parent[max(root(r.id_a), root(r.id_b))] = min(root(r.id_a), root(r.id_b))
    assert classes == {i: root(i) for i in classes}


def test_linking_pairs_give_the_same_classes(spark, family):
    """The few pairs that are checked for classes lead to the classes of all pairs."""
    df = spark.createDataFrame([("t", i, t) for i, t in family] + [("other", i, t) for i, t in family[:5]], DOCS)
    every = {(r.tbl, r.row_id): r.class_id for r in neardup.group_classes(*neardup.similar_texts(df, 3, 0.5, 60)).collect()}
    few = {(r.tbl, r.row_id): r.class_id for r in neardup.group_classes(*neardup.linking_pairs(df, 3, 0.5, 60)).collect()}
    assert few == every


def test_many_near_copies_stay_linear(spark):
    """A group of near copies, all different: the pairs checked for its class
    grow with its rows."""
    n = 3000
    base = " ".join(f"w{i}" for i in range(300))
    df = spark.range(n).select(F.lit("t").alias("tbl"), F.col("id").alias("row_id"), F.concat(F.lit(base + " tail"), F.col("id").cast("string")).alias("text"))
    members, pairs = neardup.linking_pairs(df, 5, 0.8)
    assert pairs.count() < 4 * n
    assert neardup.group_classes(members, pairs).where("class_id = 0").count() == n


def test_salted_bucket_gives_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SALTED", 7)
    rows = spark.range(40).select(F.lit(1).cast("long").alias("bucket"), F.lit("t").alias("tbl"), F.col("id").alias("row_id"), F.lit(40).cast("long").alias("held"))
    assert neardup.bucket_pairs(rows).count() == 40 * 39 // 2


def test_long_chain_of_links(spark):
    members = spark.createDataFrame([("t", i, i) for i in range(1, 41)], "tbl string, row_id long, first long")
    pairs = spark.createDataFrame([("t", i, i + 1, 0.9) for i in range(1, 30)], "tbl string, id_a long, id_b long, similarity double")
    got = {r.row_id: (r.class_id, r.links) for r in neardup.group_classes(members, pairs).collect()}
    assert all(got[i][0] == 1 for i in range(1, 31))
    assert got[5][1] == 2
    assert got[40] == (40, 0)


def test_a_hot_group_of_equal_texts(spark):
    text = " ".join(WORDS[:100])
    df = spark.createDataFrame([("t", i, text) for i in range(300)] + [("t", 1000 + i, " ".join(reversed(WORDS[i : i + 90]))) for i in range(3)], DOCS)
    members, pairs = neardup.similar_texts(df, 5, 0.8)
    got = neardup.group_classes(members, pairs)
    assert got.where("class_id = 0").count() == 300
    assert got.where("row_id = 7").first().links == 299


def test_no_texts(spark):
    df = spark.createDataFrame([("t", 1, None), ("t", 2, "")], DOCS)
    members, pairs = neardup.similar_texts(df)
    assert members.count() == 0
    assert pairs.count() == 0
    assert neardup.group_classes(members, pairs).count() == 0


def test_short_texts_have_classes(spark, tmp_path):
    long = " ".join(WORDS[:80])
    texts = [(5, "n/a"), (3, "n/a"), (9, "n/a"), (1, "..."), (2, "two words"), (4, None), (6, ""), (7, long), (8, long + " more")]
    spark.createDataFrame(texts + texts[:7], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))  # short ones delivered twice
    got = {r.row_id: (r.class_id, r.links) for r in neardup.p7_document_classes(spark, str(tmp_path)).collect()}
    assert got == {5: (3, 2), 3: (3, 2), 9: (3, 2), 1: (1, 0), 2: (2, 0), 4: (4, 1), 6: (4, 1), 7: (7, 1), 8: (7, 1)}


# --- packing
SIZES = "doc_id long, n_tokens long"


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100, 512])
    sizes = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, max(1, capacity // 3)) for _ in range(rng.randrange(1, 400))]
    plan = packing.plan_packing(dict(Counter(sizes)), capacity)
    fill = Counter()
    large = Counter()
    for size, runs in plan.runs.items():
        n = Counter(sizes)[size]
        begins = [r[0] for r in runs] + [n]
        assert begins[0] == 0
        assert begins == sorted(begins)
        for (begin, first, each), end in zip(runs, begins[1:]):
            for rank in range(begin, end):
                fill[first + (rank - begin) // each] += size
                large[first + (rank - begin) // each] += 3 * size > capacity
    assert sum(fill.values()) == sum(sizes)
    assert max(fill.values()) <= capacity
    assert max(large.values()) <= 2
    assert set(fill) == set(range(plan.containers))
    # never worse than first fit decreasing by more than one in ten, never below the volume
    bins: list[int] = []
    for s in sorted(sizes, reverse=True):
        for i, b in enumerate(bins):
            if b + s <= capacity:
                bins[i] += s
                break
        else:
            bins.append(s)
    assert -(-sum(sizes) // capacity) <= plan.containers <= len(bins) * 1.1 + 1


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(0, 60)) for i in range(500)] + [(900, 250), (901, 100), (902, 0), (903, 101)] + [(None, 5)] + [(1000 + i, 31) for i in range(400)]
    packed = packing.pack(spark.createDataFrame(rows, SIZES), [100, 64])
    got = packed.collect()
    for capacity in (100, 64):
        own = [r for r in got if r.capacity == capacity]
        total = Counter()
        for r in own:
            total[r.container] += r["size"]
        assert max(total.values()) <= capacity
        by_doc = Counter()
        for r in own:
            by_doc[r.doc_id] += r["size"]
        assert by_doc == Counter({i: n for i, n in rows if i is not None})
        parts = Counter(r.doc_id for r in own)
        assert {i for i, n in parts.items() if n > 1} == {i for i, n in rows if i is not None and n > capacity}
        assert len(total) <= sum(n for i, n in rows if i is not None) / capacity * 1.05 + 2
    assert sorted((r.start_token, r["size"]) for r in got if r.doc_id == 900 and r.capacity == 100) == [(0, 100), (100, 100), (200, 50)]
    assert packing.pack(spark.createDataFrame([], SIZES), [10]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], SIZES), [0])


# --- mixing
def test_budgets():
    leaves = {("d", "en", "a"): (0.5, 10.0), ("d", "en", "b"): (0.25, 1000.0), ("e", "fr", "c"): (0.25, 1000.0)}
    given = mixing.budgets(leaves, 100.0)
    assert given[("d", "en", "a")] == 10
    assert given[("d", "en", "b")] == pytest.approx(65)  # the sibling takes the shortage before others
    assert given[("e", "fr", "c")] == pytest.approx(25)
    full = mixing.budgets({("d", "en", "a"): (0.5, 10.0), ("d", "en", "b"): (0.25, 30.0), ("e", "fr", "c"): (0.25, 1000.0)}, 100.0)
    assert full[("e", "fr", "c")] == pytest.approx(60)
    assert sum(mixing.budgets(leaves, 1e9).values()) == pytest.approx(2010)
    assert mixing.budgets({}, 5.0) == {}


@needs_tokenizer
def test_mixture(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a.x", "b.x", "c.y"]) if i % 10 else None, rng.choice(["en", "de", None]), " ".join(["word"] * rng.randrange(1, 60))) for i in range(1, 900)]
    rows += [(2000, "a.x", "en", None), (2001, "a.x", "en", ""), (2002, "z.z", "en", "not listed")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    weights = spark.createDataFrame([("a.x", 0.6, 1), ("b.x", 0.1, 3), ("c.y", 0.2, 2), ("none.y", 0.1, 5)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(docs, weights).cache()
    assert mixed.count() == mixed.select("doc_id").distinct().count()
    share = {r.source: r for r in mixing.shares(mixed, weights).collect()}
    assert share["none.y"].documents == 0
    assert abs(share["a.x"].actual_share - 0.6) < 0.02
    assert abs(share["b.x"].actual_share - 0.1) < 0.02
    assert abs(share["c.y"].actual_share - 0.3) < 0.02  # takes its absent sibling's share
    assert all(r.most_repeats <= r.max_repeats for r in share.values())
    again = mixing.mixture(docs.repartition(7), weights)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))
    big = mixing.shares(mixing.mixture(docs, weights, total_tokens=10**9), weights)
    assert all(r.most_repeats == r.max_repeats for r in big.where("documents > 0").collect())
    assert mixing.mixture(docs.limit(0), weights).count() == 0


@needs_tokenizer
def test_token_sizes(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_sizes(docs).collect()}
    assert got[1] == 2
    assert got[2] == got[3] == 0
    assert got[4] > 1
    encoder = tokens.encoding(VOCABULARY)
    text = "Grüße, мир! 12 cafés"
    assert encoder.decode(encoder.encode_ordinary(text)) == text


# --- encodings
CLEAN = {
    "de": "Die Prüfung für das große Gespräch über die schöne Straße beginnt spät im Frühling.",
    "fr": "La façade du théâtre où l'élève répète dès l'été est très élégante et brève.",
    "en": "The café’s price was less than € 20 at about 30 °C. “A naïve claim.” – Anna.",
    "ru": "Каждый новый опыт дополняет наш старый список перед долгой зимой.",
}
CHAIN_NAMES = ["cp1252", "latin-1", "cp437", "cp850", "mac_roman"]


def test_garble_round_trip():
    for lang, text in CLEAN.items():
        for chain in encoding.CHAINS:
            bad = encoding.garble(text, chain)
            if bad is not None and bad != text and encoding.LOST not in bad:
                assert encoding.ungarble(bad, chain) == text, (lang, chain)


def test_repair(spark):
    docs, truth = [], {}
    i = 0
    for _ in range(12):
        for lang, text in CLEAN.items():
            i += 1
            docs.append((i, lang, text))
    for chain in [c for c in encoding.CHAINS if c[0][0] == "utf-8" and c[-1][1] in CHAIN_NAMES] + [(("cp1251", "cp1252"),), (("cp1252", "cp437"),), (("cp1252", "mac_roman"),)]:
        for lang, text in CLEAN.items():
            bad = encoding.garble(text, chain)
            if bad is None or bad == text or (lang == "ru") != ("cp1251" in chain[0] or len(chain) == 1 and chain[0][0] == "utf-8" and lang == "ru"):
                continue
            i += 1
            docs.append((i, lang, "A plain line.\n" + bad))
            truth[i] = "A plain line.\n" + text
    lossy = {i + 1: "Die Pr�fung beginnt."}
    docs += [(i + 1, "de", lossy[i + 1]), (i + 2, "de", None), (i + 3, "de", ""), (i + 4, "en", "Only ASCII here."), (i + 5, None, "Ein großer Übungsplatz, naïve façade, ÀÉÈ ± 0.5 µm")]
    got = {r.doc_id: (r.status, r.text) for r in encoding.repair(spark.createDataFrame(docs, "doc_id long, lang string, text string")).collect()}
    assert set(got) == set(truth) | set(lossy)
    assert all(got[k][0] == "lossy" for k in lossy)
    assert all(got[k][0] == "restorable" for k in truth)
    assert sum(got[k][1] == truth[k] for k in truth) >= 0.95 * len(truth)
    assert encoding.repair(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0


@pytest.mark.parametrize(("lang", "chain"), [("de", (("utf-8", "cp1252"),)), ("ru", (("cp1251", "koi8_r"),)), ("ru", (("cp1251", "cp1252"),))])
def test_copies_of_a_damaged_text_do_not_outvote_its_originals(spark, lang, chain):
    clean = [(i, lang if i % 3 else None, f"{CLEAN[lang]} {i}") for i in range(1, 9)]
    bad = encoding.garble(CLEAN[lang], chain)
    copies = [(100 + i, lang if i % 2 else None, bad) for i in range(120)]
    got = {r.doc_id: (r.status, r.text) for r in encoding.repair(spark.createDataFrame(clean + copies, "doc_id long, lang string, text string")).collect()}
    labelled = {i for i, label, _ in copies if label}
    assert labelled <= set(got) <= {i for i, _, _ in copies}  # and no clean text is damaged by them
    assert all(got[i] == ("restorable", CLEAN[lang]) for i in labelled)


def test_units():
    assert encoding.units("Anna’s") == ["\x01’s"]
    assert encoding.units("“Another") == ["“\x02"]
    assert encoding.units("é") == []
    assert encoding.words_of("plain ascii") == []
