"""Problem 5: the subject areas of documents, by a classifier chain.

Features of a page are of three kinds: terms (for each subject the share of the
sentences of its body paragraphs that hold a term of the subject, by a term
model per language), source (subjects whose terms stand in the address slug and
in the title, and what the noisy category of an older classifier says for each
subject) and structure (sentences, paragraphs).  The chain has one logistic
classifier a subject; each sees the features and the labels decided before it,
and so models which subjects occur together.  Its probabilities are calibrated
on held-out documents, and the best label combination is found by beam search.

Training: the clean samples have one subject each, so training documents are
composed from their sentences - none, one or several subjects in varying shares,
sentences without subject between - and labelled by the definition (a subject is
assigned from a quarter of the sentences on).  Their source features are drawn
as they are on real pages: over all pages it is counted how often slug, title
and category agree with what the sentences are about.  The model is small,
trained on the driver, and broadcast.

All samples and all pages count, where they are read: terms by their samples,
sentences by the set of subjects whose terms they hold, pages by their main
subject and set of categories.  The driver sees terms and counts; categories with
equal counts are one to it, and what a category says is joined with the pages.

Pages are read once, in Arrow batches; what is joined with the categories and
decoded are a few numbers a page.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import staged, staged_bytes
from . import language
from .furniture import furniture_flags
from .lineforms import PROSE, page_form
from .residue import filler, notice, only_notice
from .tables import common_words, slices, small_rows, table

COMPOSED = 6_000  # training documents composed from the samples
HELD_OUT = 0.25  # share of those kept for calibration
SURE = 0.9  # probability from which, and below whose complement, the chain alone decides; in between the definition is checked
QUARTER = 0.25  # share of sentences from which a subject is assigned
BEAM = 6
SHORTEST_SENTENCE = 3  # words
TERM_SAMPLES, TERM_PURITY = 2, 0.85  # samples a term must stand in, share of them of one subject
SEED = 5
BROADCAST_BYTES = 4 << 20  # written size of what the sets of categories say up to which it is broadcast; beyond, it is joined by shuffle

_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»’]?\s+")


@dataclass
class Chain:
    """Term model per language, chain weights and calibration."""

    subjects: list[str]
    terms: dict[str, dict[str, int]]
    slug_terms: dict[str, int]
    weights: list[np.ndarray]
    calibration: np.ndarray
    source: "Source | None" = None


def sample_words(samples: Iterable[tuple[str, str, str]], subjects: list[str], common: frozenset[str]) -> Counter:
    """In how many (language, subject, text) samples of each language and subject
    (its index) each word stands; common words and those of one or two letters do
    not count, nor do samples with a null or of a subject that is not listed."""
    index = {s: i for i, s in enumerate(subjects)}
    return Counter((lang, word, index[subject]) for lang, subject, text in samples if lang and text and subject in index
                   for word in set(_WORD.findall(text.lower())) if word not in common and len(word) > 2)


def train_terms(samples: list[tuple[str, str, str]], subjects: list[str], common: frozenset[str]) -> dict[str, dict[str, int]]:
    """Terms of each language that tell a subject: in at least `TERM_SAMPLES`
    samples, nearly all of one subject."""
    seen: dict[tuple[str, str], Counter] = defaultdict(Counter)
    for (lang, word, subject), n in sample_words(samples, subjects, common).items():
        seen[lang, word][subject] += n
    out: dict[str, dict[str, int]] = defaultdict(dict)
    for (lang, word), counts in seen.items():
        (best, n), total = counts.most_common(1)[0], sum(counts.values())
        if n >= TERM_SAMPLES and n >= TERM_PURITY * total:
            out[lang][word] = best
    return dict(out)


def counted_terms(samples: DataFrame, subjects: list[str], common: frozenset[str]) -> dict[str, dict[str, int]]:
    """`train_terms` of all rows of `samples` (lang, subject, text), counted where
    they are read; only the terms come to the driver."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("subject", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = sample_words(zip(*(c.to_pylist() for c in batch.columns)), subjects, common)
            columns = [*zip(*counts)] or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, counts.values()], schema.types)], schema=schema)

    counted = samples.select("lang", "subject", "text").mapInArrow(count, "lang string, word string, subject int, n long")
    each = counted.groupBy("lang", "word", "subject").agg(F.sum("n").alias("n"))
    best = each.groupBy("lang", "word").agg(F.max(F.struct("n", "subject")).alias("best"), F.sum("n").alias("total"))
    kept = best.where((F.col("best.n") >= TERM_SAMPLES) & (F.col("best.n") >= F.lit(TERM_PURITY) * F.col("total"))).select("lang", "word", "best.subject").toArrow()
    out: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, word, subject in zip(*(c.to_pylist() for c in kept.columns)):
        out[lang][word] = subject
    return dict(out)


def sentences(paragraph: str) -> list[list[str]]:
    """Words of each sentence of a paragraph; shorter ones than
    `SHORTEST_SENTENCE` words do not count."""
    return [words for s in _SENTENCE.split(paragraph.lower()) if len(words := _WORD.findall(s)) >= SHORTEST_SENTENCE]


def sentence_subjects(words: list[str], terms: dict[str, int]) -> set[int]:
    return {terms[w] for w in words if w in terms}


def sample_sentences(samples: Iterable[tuple[str, str, str]], subjects: list[str], terms: dict[str, dict[str, int]]) -> Counter:
    """How many sentences of the (language, subject, text) samples of each
    language and subject (its index) hold terms of each set of subjects."""
    index = {s: i for i, s in enumerate(subjects)}
    return Counter((lang, index[subject], tuple(sorted(sentence_subjects(words, terms.get(lang, {}))))) for lang, subject, text in samples if lang and text and subject in index
                   for words in sentences(text))


def counted_sentences(samples: DataFrame, subjects: list[str], terms: dict[str, dict[str, int]]) -> Counter:
    """`sample_sentences` of all rows of `samples` (lang, subject, text), counted
    where they are read."""
    schema = pa.schema([("lang", pa.string()), ("subject", pa.int32()), ("found", pa.list_(pa.int32())), ("n", pa.int64())])
    shared = samples.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = sample_sentences(zip(*(c.to_pylist() for c in batch.columns)), subjects, shared.value)
            columns = [*zip(*counts)] or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, counts.values()], schema.types)], schema=schema)

    counted = samples.select("lang", "subject", "text").mapInArrow(count, "lang string, subject int, found array<int>, n long")
    sums = counted.groupBy("lang", "subject", "found").agg(F.sum("n").alias("n")).toArrow()
    return Counter({(lang, subject, tuple(found)): n for lang, subject, found, n in zip(*(c.to_pylist() for c in sums.columns))})


@dataclass
class Source:
    """What the source of a page tells of its subjects: the chance of a term of
    the main subject, and of any other subject, in slug and title; chance of each
    category given the main subject (rows; the last row for none; the last column
    for no category), and by how much a category speaks for each subject (log
    odds).  Categories with equal counts may share a column, under the name of one
    of them, with the chance of all; `totals` are the counts the chances are of."""

    own: tuple[float, float]
    other: tuple[float, float]
    categories: list[str]
    given: np.ndarray
    odds: np.ndarray
    totals: np.ndarray | None = None


def category_odds(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Log odds for each subject of categories that stand on so many pages of each
    main subject (rows: main subjects, the last for none), of `totals` pages."""
    chance = counts / totals[:, None]
    return np.log(chance[:-1] / chance.mean(axis=0)) if len(chance) > 1 else np.zeros((0, counts.shape[1]))


UNSEEN = 0.5  # what is added to each count of a category


def source_of(names: list[str], counts: np.ndarray, times: np.ndarray, rates: tuple[np.ndarray, np.ndarray, int, int]) -> Source:
    """Source model of counts: of categories by main subject (the last column for
    none), each column standing for `times` categories; `rates` are how often slug
    and title name the main subject, how often others, pages with and without one."""
    (own, other, mains, none), n = rates, len(counts) - 1
    counts = counts + UNSEEN
    totals = (counts * times).sum(axis=1)
    chances = tuple((own + 1) / (mains + 4.0)), tuple((other + 0.5) / (mains * (n - 1) + none * n + 2.0 * n + 2))
    return Source(*chances, names, counts * times / totals[:, None], category_odds(counts, totals), totals)


def fit_source(pages: list[tuple[np.ndarray, int, list[int], list[int], list[str]]], n: int) -> Source:
    """Source model of real pages: (hits by subject, sentences, slug subjects,
    title subjects, categories).  The main subject of a page is the one of most
    of its sentences, from a quarter on."""
    names = sorted({c for *_, categories in pages for c in categories})
    index = {c: i for i, c in enumerate(names)}
    counts = np.zeros((n + 1, len(names) + 1))
    own, other, mains = np.zeros(2), np.zeros(2), 0
    for hits, total, slug, title, categories in pages:
        main = int(np.argmax(hits)) if n and total and hits.max() >= QUARTER * total else n
        for c in categories or [None]:
            counts[main, len(names) if c is None else index[c]] += 1
        for k, found in enumerate((slug, title)):
            own[k] += main in found
            other[k] += len([x for x in found if x != main])
        mains += main < n
    return source_of(names, counts, np.ones(len(names) + 1), (own, other, mains, len(pages) - mains))


def count_source(evidence: DataFrame, n: int) -> tuple[Source, DataFrame]:
    """`fit_source` of all rows of `evidence` (staged, as of `with_categories`),
    and (categories, odds): what each category says of each set of categories
    that pages have; the empty set has no row.

    Counted are pages of equal main subject and equal set of categories; of the
    categories themselves only the different counts come to the driver."""
    main = F.when((F.col("sentences") > 0) & (F.array_max("hits") >= QUARTER * F.col("sentences")), F.array_position("hits", F.array_max("hits")).cast("int") - 1).otherwise(n)
    found = [F.sum(F.array_contains(c, F.col("main")).cast("long")).alias(f"own_{c}") for c in ("slug", "title")]
    found += [F.sum(F.size(F.array_remove(c, F.col("main"))).cast("long")).alias(f"other_{c}") for c in ("slug", "title")]
    sets = staged(evidence.withColumn("main", main).groupBy("categories", "main").agg(F.count("*").alias("pages"), *found), "category-sets")
    sums = sets.agg(*[F.sum(f"{k}_{c}").alias(f"{k}_{c}") for k in ("own", "other") for c in ("slug", "title")], F.sum(F.when(F.col("main") < n, F.col("pages"))).alias("mains"), F.sum("pages").alias("pages")).first()
    mains, pages = sums.mains or 0, sums.pages or 0
    rates = tuple(np.array([sums[f"{k}_slug"] or 0, sums[f"{k}_title"] or 0], dtype=float) for k in ("own", "other"))
    each = sets.select(F.explode("categories").alias("category"), "main", "pages").groupBy("category", "main").agg(F.sum("pages").alias("pages"))
    by_main = F.array_sort(F.collect_list(F.struct("main", "pages")))  # at most one element a subject, and one for none
    spoken = staged(each.groupBy("category").agg(by_main.alias("counts")), "categories")
    alike = sorted((r.counts, r.name, r.times) for r in spoken.groupBy("counts").agg(F.min("category").alias("name"), F.count("*").alias("times")).collect())
    counts = np.zeros((n + 1, len(alike) + 1))
    for k, (own, _, _) in enumerate(alike):
        for at, pages_of in own:
            counts[at, k] = pages_of
    for r in sets.where(F.size("categories") == 0).select("main", "pages").collect():
        counts[r.main, -1] = r.pages
    source = source_of([name for _, name, _ in alike], counts, np.array([times for *_, times in alike] + [1.0]), (*rates, mains, pages - mains))
    totals, schema = source.totals, pa.schema([("category", pa.string()), ("odds", pa.list_(pa.float64()))])

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = np.full((n + 1, batch.num_rows), UNSEEN)
            for k, own in enumerate(batch.column(1).to_pylist()):
                for x in own:
                    counts[x["main"], k] += x["pages"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(category_odds(counts, totals).T.tolist(), schema.types[1])], schema=schema)

    odds = spoken.mapInArrow(say, "category string, odds array<double>")
    members = sets.select("categories").distinct().select("categories", F.explode("categories").alias("category"))
    return source, members.join(odds, "category").groupBy("categories").agg(F.array_sort(F.collect_list("odds")).alias("odds"))  # one element a category of the set


NO_SOURCE = Source((0.5, 0.5), (0.01, 0.01), [], np.ones((0, 1)), np.zeros((0, 1)))


def feature_row(hits: np.ndarray, n_sentences: int, n_paragraphs: int, slug: set[int], title: set[int], n_subjects: int, said: np.ndarray | None = None) -> np.ndarray:
    """Features of a document: sentence shares, their excess over a quarter,
    slug and title subjects, what its categories say, structure, constant."""
    share = hits / max(1, n_sentences)
    source = np.zeros(3 * n_subjects)
    for i in slug:
        source[i] = 1
    for i in title:
        source[n_subjects + i] = 1
    if said is not None:
        source[2 * n_subjects :] = said
    return np.concatenate([share, np.maximum(0, share - QUARTER), source, [1 / np.sqrt(max(1, n_sentences)), min(n_paragraphs, 20) / 20, 1.0]])


def category_says(source: Source | None, categories: list[str], n: int) -> np.ndarray:
    """Log odds for each subject from the categories of a page, their mean; zeros
    without any."""
    if source is None:
        return np.zeros(n)
    index = {c: i for i, c in enumerate(source.categories)}
    return mean_odds([source.odds[:, index[c]] for c in categories if c in index], n)


def mean_odds(odds: list | None, n: int) -> np.ndarray:
    """Mean of the log odds of several categories; zeros without any."""
    return np.mean(odds, axis=0) if odds and len(odds[0]) == n else np.zeros(n)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    eye = np.eye(x.shape[1]) * ridge
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + eye
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train_chain(samples: list[tuple[str, str, str]], subjects: list[str], common: frozenset[str], composed: int = COMPOSED, seed: int = SEED, source: Source = NO_SOURCE, terms: dict | None = None) -> Chain:
    """Chain of (language, subject, text) samples; those with a null, or of a
    subject that is not listed, are skipped.  `terms` are those of `train_terms`
    if not given."""
    terms = train_terms(samples, subjects, common) if terms is None else terms
    return fit_chain(sample_sentences(samples, subjects, terms), subjects, terms, composed, seed, source)


def fit_chain(counted: Counter, subjects: list[str], terms: dict[str, dict[str, int]], composed: int = COMPOSED, seed: int = SEED, source: Source = NO_SOURCE) -> Chain:
    """Chain of counted sentences, as of `sample_sentences`.  A sentence of a
    training document is drawn from all of its language and subject."""
    slug_terms = terms.get("en", {})
    n = len(subjects)
    pools: dict[str, dict[int, tuple[list[tuple[int, ...]], np.ndarray]]] = defaultdict(dict)
    for (lang, subject), group in groupby(sorted(counted.items()), key=lambda x: x[0][:2]):
        found, counts = zip(*((key[2], count) for key, count in group))
        pools[lang][subject] = found, np.cumsum(counts)
    rng = np.random.default_rng(seed)
    langs = sorted(pools)
    x, y = [], []
    for _ in range(composed if langs else 0):
        lang = langs[rng.integers(len(langs))]
        own = sorted(pools[lang])
        chosen = [own[i] for i in rng.permutation(len(own))[: rng.integers(0, 4)]]
        total = int(rng.integers(3, 40))
        rest = 1.0
        made: list[tuple[int | None, tuple[int, ...]]] = []
        for s in chosen:
            part = rest * rng.uniform(0.05, 1.0)
            rest -= part
            found, ends = pools[lang][s]
            made += [(s, found[np.searchsorted(ends, rng.integers(ends[-1]), side="right")]) for _ in range(round(part * total))]
        while len(made) < total:
            made.append((None, ()))
        hits = np.zeros(n)
        for _, found in made:
            for i in found:
                hits[i] += 1
        origin = Counter(s for s, _ in made if s is not None)
        main = origin.most_common(1)[0][0] if origin else None
        found_in = [{i for i in range(n) if rng.random() < (source.own[k] if i == main else source.other[k])} for k in (0, 1)]
        said = None
        if len(source.given):
            drawn = rng.choice(source.given.shape[1], p=source.given[n if main is None else main])
            said = source.odds[:, drawn] if drawn < len(source.categories) else None
        x.append(feature_row(hits, total, int(rng.integers(1, 12)), *found_in, n, said))
        y.append([origin[i] >= QUARTER * total for i in range(n)])
    features, labels = np.array(x), np.array(y, dtype=float)
    weights, calibration = [], np.tile([1.0, 0.0], (n, 1))
    cut = int(len(features) * (1 - HELD_OUT))
    for i in range(n):
        chained = np.hstack([features, labels[:, :i]]) if len(features) else np.zeros((0, 0))
        if not len(features) or not 0 < labels[:cut, i].sum() < cut:
            weights.append(np.zeros(5 * n + 3 + i))
            calibration[i] = [1.0, -30.0]
            continue
        w = _logistic(chained[:cut], labels[:cut, i])
        weights.append(w)
        held = np.column_stack([chained[cut:] @ w, np.ones(len(features) - cut)])
        if 0 < labels[cut:, i].sum() < len(held):
            calibration[i] = _logistic(held, labels[cut:, i], ridge=0.1)
    return Chain(subjects, terms, slug_terms, weights, calibration, source)


def decode(chain: Chain, features: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Best label combination of each row of features, by beam search over the
    chain, and the calibrated probability of each of its labels."""
    rows, n = len(features), len(chain.subjects)
    labels = np.zeros((rows, 1, n))
    chances = np.zeros((rows, 1, n))
    total = np.zeros((rows, 1))
    for i in range(n):
        w = chain.weights[i]
        base = features @ w[: features.shape[1]]
        logit = base[:, None] + labels[:, :, :i] @ w[features.shape[1] :]
        logit = np.clip(chain.calibration[i][0] * logit + chain.calibration[i][1], -30, 30)
        yes = 1 / (1 + np.exp(-logit))
        grown = np.concatenate([total + np.log(yes), total + np.log1p(-yes)], axis=1)
        labels = np.concatenate([labels, labels], axis=1)
        chances = np.concatenate([chances, chances], axis=1)
        half = labels.shape[1] // 2
        labels[:, :half, i] = 1
        chances[:, :half, i] = yes
        chances[:, half:, i] = yes
        keep = np.argsort(-grown, axis=1, kind="stable")[:, :beam]
        total = np.take_along_axis(grown, keep, axis=1)
        labels = np.take_along_axis(labels, keep[:, :, None], axis=1)
        chances = np.take_along_axis(chances, keep[:, :, None], axis=1)
    return labels[:, 0], chances[:, 0]


EVIDENCE = "page_id long, url string, sentences int, paragraphs int, hits array<double>, slug array<int>, title array<int>"
_EVIDENCE = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("sentences", pa.int32()), ("paragraphs", pa.int32()),
    ("hits", pa.list_(pa.float64())), ("slug", pa.list_(pa.int32())), ("title", pa.list_(pa.int32())),
])


def page_evidence(pages: DataFrame, terms: dict[str, dict[str, int]], n: int, speech: language.Model, common: frozenset[str]) -> DataFrame:
    """Evidence of the prose pages of `pages` (id, url, title, content): sentences
    that hold a term of each subject, subjects of slug and title, structure.

    Lists, tables and junk, pages whose body is only an error notice, and null or
    empty contents have none.  Repeated rows give repeated results.
    """
    shared = pages.sparkSession.sparkContext.broadcast((terms, speech))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, speech = shared.value
        slug_terms = terms.get("en", {})
        for batch in slices(batches):
            kept: list[tuple] = []
            texts: list[str] = []
            for page_id, url, title, content in zip(*(c.to_pylist() for c in batch.columns)):
                if not content or not speech.langs or not n:
                    continue
                lines = content.split("\n")
                body = [s for line, f in zip(lines, furniture_flags(lines, title)) if not f and (s := line.strip())]
                form, _, forms = page_form(body, common)
                if form != "prose" or only_notice(body):
                    continue
                paragraphs = [s for s, f in zip(body, forms) if f == PROSE and not notice(s) and not filler(s)]
                if paragraphs:
                    kept.append((page_id, url, title or "", len(texts), len(paragraphs)))
                    texts += paragraphs
            spoken = language.score(speech, texts)[0] if kept else []
            rows: list[tuple] = []
            for page_id, url, title, at, count in kept:
                hits, total = [0.0] * n, 0
                votes: Counter[str] = Counter()
                for k in range(at, at + count):
                    lang = speech.langs[spoken[k]]
                    own = terms.get(lang, {})
                    votes[lang] += 1
                    for words in sentences(texts[k]):
                        total += 1
                        for i in sentence_subjects(words, own):
                            hits[i] += 1
                slug = sentence_subjects(_WORD.findall((url or "").partition("://")[2].partition("/")[2].lower()), slug_terms)
                named = sentence_subjects(_WORD.findall(title.lower()), terms.get(votes.most_common(1)[0][0], {}))
                rows.append((page_id, url, total, count, hits, sorted(slug), sorted(named)))
            columns = list(zip(*rows)) if rows else [()] * len(_EVIDENCE)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _EVIDENCE.types)], schema=_EVIDENCE)

    return pages.select(F.col("id").cast("long"), "url", "title", "content").mapInArrow(measure, EVIDENCE)


def with_categories(evidence: DataFrame, results: DataFrame) -> DataFrame:
    """Adds the categories that `results` (url, category) has for each page, lower
    case and trimmed; pages without any get an empty list, and of equal ones one
    counts."""
    clean = results.select("url", F.lower(F.trim("category")).alias("category")).where("url is not null and category is not null")
    sets = clean.groupBy("url").agg(F.array_sort(F.collect_set("category")).alias("categories"))  # a few spellings at most
    return evidence.join(sets, "url", "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


def settled(labels: np.ndarray, chances: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The labels of the chain; where it is not sure, the definition decides on
    the sentences whose terms are known."""
    return np.where((chances > 1 - SURE) & (chances < SURE), shares >= QUARTER, labels)


ASSIGNED = "page_id long, subject string, probability double, share double"


def page_subjects(evidence: DataFrame, chain: Chain) -> DataFrame:
    """(page_id, subject, probability, share): the best label combination of each
    row of `evidence` (as of `page_evidence`, with the `odds` of its categories as
    of `count_source`, null without any), by beam search over the chain, `settled`
    where the chain is not sure."""
    shared = evidence.sparkSession.sparkContext.broadcast(chain)
    schema = pa.schema([("page_id", pa.int64()), ("subject", pa.string()), ("probability", pa.float64()), ("share", pa.float64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        n = len(chain.subjects)
        for batch in slices(batches, 5000):
            rows: list[tuple] = []
            if batch.num_rows and n:
                ids, totals, counts, hits, slugs, titles, odds = (c.to_pylist() for c in batch.columns)
                hits = np.array(hits).reshape(len(ids), n)
                features = np.array([feature_row(h, t, c, a, b, n, mean_odds(k, n)) for h, t, c, a, b, k in zip(hits, totals, counts, slugs, titles, odds)])
                labels, chances = decode(chain, features)
                shares = hits / np.maximum(1, np.array(totals))[:, None]
                labels = settled(labels, chances, shares)
                rows = [(ids[r], chain.subjects[i], float(chances[r, i]), float(shares[r, i])) for r, i in zip(*np.nonzero(labels))]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return evidence.select("page_id", "sentences", "paragraphs", "hits", "slug", "title", "odds").mapInArrow(assign, ASSIGNED)


def assigned_subjects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Chain]:
    """Trains on all samples and all pages, and labels all pages."""
    common = common_words(spark, sf_dir)
    subjects = sorted({r.subject for r in small_rows(table(spark, sf_dir, "subject_areas").select("subject")) if r.subject})
    samples = table(spark, sf_dir, "subject_samples")
    terms = counted_terms(samples, subjects, common)
    evidence = page_evidence(table(spark, sf_dir, "indexed_pages"), terms, len(subjects), language.train_from_tables(spark, sf_dir), common)
    evidence = staged(with_categories(evidence, table(spark, sf_dir, "classification_results").select("url", "category")), "subject-evidence")
    source, odds = count_source(evidence, len(subjects))
    chain = fit_chain(counted_sentences(samples, subjects, terms), subjects, terms, source=source)
    odds = staged(odds, "category-odds")
    said = evidence.join(F.broadcast(odds) if staged_bytes(odds) <= BROADCAST_BYTES else odds, "categories", "left")
    return page_subjects(said, chain), chain


def p5_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned_subjects(spark, sf_dir)[0]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_subjects(spark, sf_dir).select("page_id", "subject")


def p5_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each subject, and how many have the subject besides another."""
    assigned = p5_subjects(spark, sf_dir)
    several = assigned.groupBy("page_id").agg(F.collect_list("subject").alias("subjects"))  # at most one element a subject
    each = several.select(F.size("subjects").alias("n"), F.explode("subjects").alias("subject"))
    return each.groupBy("subject").agg(F.count("*").alias("pages"), F.sum((F.col("n") > 1).cast("long")).alias("with_others"))


QUERIES = {"p5_found": p5_found, "p5_subjects": p5_subjects, "p5_composition": p5_composition}
SQL: dict[str, str] = {}
