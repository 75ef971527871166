"""Problem 3: the language of documents and of their mixed-language segments.

Multinomial naive Bayes over hashed character n-grams.  The n-grams of all
labelled texts are counted where they are read (`ngrams`) and give a
log-probability matrix of fixed size, which is broadcast.  Scoring is sparse:
the texts of a batch become one array of code points, n-gram hashes are formed
by shifting that array, and the matrix rows they select are summed per segment
with `numpy.add.reduceat`; a batch takes a fixed number of numpy calls.

`document_languages` gives each document, whatever it is, its language with a
confidence.  `page_languages` scores every body line of prose of every page,
whole, gives the page the language of most of its body, and reports foreign
paragraphs.  All languages are equally likely beforehand: how many samples a
language has says nothing about the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import staged
from .furniture import furniture_flags
from .lineforms import HEADING, PROSE, page_form
from .residue import filler, notice, only_notice
from .tables import common_words, slices, small_rows, table

BUCKETS = 1 << 15
ORDERS = (2, 3)
SMOOTHING = 0.5
CHUNK_CHARS = 400_000  # characters scored at once
PARAGRAPH_WORDS = 6  # words of a line from which it counts as a paragraph of sentences
SURE = 0.99  # confidence from which a line is reported as foreign

# --- fixed values: names of the languages in their own and other languages ---
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés ingles inglese inglês engels английский eng",
    "de": "german deutsch allemand alemán aleman tedesco alemão alemao duits немецкий deu ger",
    "fr": "french französisch franzoesisch français francais francés frances francese francês frans французский fra fre",
    "es": "spanish spanisch espagnol español espanol castellano spagnolo espanhol spaans испанский spa",
    "it": "italian italienisch italien italiano italiaans итальянский ita",
    "pt": "portuguese portugiesisch portugais portugués portugues portoghese português portugees португальский por",
    "nl": "dutch niederländisch niederlaendisch néerlandais neerlandais neerlandés olandese neerlandês holandês nederlands vlaams flemish нидерландский nld dut",
    "ru": "russian russisch russe ruso russo русский rus",
}
# --- end of fixed values ----------------------------------------------------


@dataclass
class Model:
    """Log-probabilities: `table[l]` has a value per hash bucket and a zero at
    the end for n-grams that cross a border."""

    langs: list[str]
    table: np.ndarray
    prior: np.ndarray


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-case texts, each between line ends, and the
    start of each text."""
    joined = "\n" + "\n".join(" " + t.lower().replace("\n", " ") + " " for t in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    digits = (codes >= 48) & (codes <= 57)
    codes = np.where(digits, np.uint32(48), codes)
    starts = np.flatnonzero(codes == 10)[:-1]
    return codes, starts


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that begins at each position, per order; the last
    bucket where it would cross a border."""
    border = codes == 10
    out = []
    for n in ORDERS:
        h = np.zeros(len(codes), dtype=np.uint32)
        cut = np.zeros(len(codes), dtype=bool)
        for k in range(n):
            h[: len(codes) - k] = (h[: len(codes) - k] ^ codes[k:]) * np.uint32(0x9E3779B1)
            cut[: len(codes) - k] |= border[k:]
            if k:
                cut[len(codes) - k :] = True
        h = (h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS)
        h[cut] = BUCKETS
        out.append(h.astype(np.int64))
    return out


def _count(texts: list[str]) -> np.ndarray:
    """How often each bucket occurs in the texts; n-grams across a border are in
    the last one."""
    return sum(np.bincount(h, minlength=BUCKETS + 1) for h in _hashes(_codes(texts)[0]))


def train(samples: list[tuple[str, str]], words: list[tuple[str, str]] = ()) -> Model:
    """Model of (language, text) samples and (language, word) pairs; rows
    without language or text are skipped."""
    texts: dict[str, list[str]] = {}
    for lang, text in samples:
        if lang and text:
            texts.setdefault(lang, []).append(text)
    return counted_model({lang: _count(own) for lang, own in texts.items()}, words)


def counted_model(grams: dict[str, np.ndarray], words: list[tuple[str, str]] = ()) -> Model:
    """Model of the n-gram counts of each language and (language, word) pairs;
    words of other languages are skipped."""
    langs = sorted(grams)
    counts = np.full((len(langs), BUCKETS + 1), 0.0)
    for i, lang in enumerate(langs):
        counts[i] += grams[lang] + _count([word for own, word in words if own == lang and word])
    counts[:, BUCKETS] = 0
    smoothed = counts[:, :BUCKETS] + SMOOTHING
    logs = np.log(smoothed / smoothed.sum(axis=1, keepdims=True))
    logs -= logs.mean(axis=0)  # the same for all languages: keeps sums small
    matrix = np.zeros((len(langs), BUCKETS + 1), dtype=np.float32)
    matrix[:, :BUCKETS] = logs
    return Model(langs, matrix, np.zeros(len(langs)))


def score(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language of each text, and its confidence between 0 and 1.
    The empty text gets the first language with confidence 1 / languages."""
    best = np.zeros(len(texts), dtype=np.int64)
    if not model.langs:
        return best, np.zeros(len(texts))
    sure = np.full(len(texts), 1.0 / len(model.langs))
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= CHUNK_CHARS):
            size += len(texts[end])
            end += 1
        codes, starts = _codes(texts[start:end])
        sums = np.zeros((len(model.langs), end - start))
        for h in _hashes(codes):
            for i in range(len(model.langs)):
                sums[i] += np.add.reduceat(model.table[i][h], starts)
        lengths = np.maximum(1, np.diff(np.append(starts, len(codes) - 1)) - 3)
        # n-grams overlap: temper the sums, or every confidence would be 1
        tempered = (sums + model.prior[:, None]) / np.sqrt(lengths)
        tempered -= tempered.max(axis=0)
        odds = np.exp(tempered)
        best[start:end] = tempered.argmax(axis=0)
        sure[start:end] = odds.max(axis=0) / odds.sum(axis=0)
        start = end
    return best, sure


NGRAMS = "lang string, bucket int, occurrences long"


def ngrams(samples: DataFrame) -> DataFrame:
    """(lang, bucket, occurrences): the n-grams of all rows of `samples` (lang,
    text); rows without language or text are skipped, and a language whose texts
    have no n-gram still has its border bucket."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("occurrences", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts: dict[str, list[str]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                if lang and text:
                    texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                counts = _count(own)
                buckets = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(buckets), pa.string()), pa.array(buckets.astype(np.int32)), pa.array(counts[buckets].astype(np.int64))], schema=schema)

    return samples.select("lang", "text").mapInArrow(count, NGRAMS).groupBy("lang", "bucket").agg(F.sum("occurrences").alias("occurrences"))


def train_from_tables(spark: SparkSession, sf_dir: str) -> Model:
    """Model of all clean labelled samples and the common words.  What comes to
    the driver has the size of the model, however many samples there are."""
    counted = ngrams(table(spark, sf_dir, "subject_samples")).toArrow()
    grams: dict[str, np.ndarray] = {}
    if counted.num_rows:
        langs, buckets, occurrences = counted["lang"].combine_chunks().dictionary_encode(), counted["bucket"].to_numpy(), counted["occurrences"].to_numpy()
        codes = langs.indices.to_numpy()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            grams[lang] = np.bincount(buckets[codes == i], weights=occurrences[codes == i], minlength=BUCKETS + 1)
    words = small_rows(table(spark, sf_dir, "common_words").select("lang", "word"))
    return counted_model(grams, [(r.lang, r.word) for r in words])


def label_language(label: F.Column) -> F.Column:
    """Language code a declared label names, null if it names none: codes,
    regional codes and names in any spelling of case and separator."""
    known = {name: code for code, names in LANGUAGE_NAMES.items() for name in (code, *names.split())}
    pairs = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    clean = F.lower(F.regexp_replace(F.trim(label), "_", "-"))
    return F.coalesce(F.try_element_at(pairs, clean), F.try_element_at(pairs, F.split_part(clean, F.lit("-"), F.lit(1))), F.try_element_at(pairs, F.split_part(clean, F.lit(" "), F.lit(1))))


UNKNOWN = "und"  # code of a text without letters
DOCUMENTS = "tbl string, row_id long, lang string, confidence double, share double"


def document_languages(documents: DataFrame, model: Model) -> DataFrame:
    """(tbl, row_id, lang, confidence, share): the language of each row of
    `documents` (tbl, row_id, title, text), none left out.

    Every line with letters outside of site furniture is scored; a text that is
    all furniture is scored as a whole.  The language is that of most characters,
    ties by code; `share` is its part of them, and `confidence` the mean of its
    lines' confidence by characters, times that part.  Null and empty texts and
    texts without letters are `und` with confidence 0.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("tbl", pa.string()), ("row_id", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("share", pa.float64())])

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            texts: list[str] = []
            kept: list[tuple] = []
            for tbl, row_id, title, text in zip(*(c.to_pylist() for c in batch.columns)):
                lines = (text or "").split("\n")
                filled = [(s, f) for line, f in zip(lines, furniture_flags(lines, title)) if (s := line.strip()) and any(map(str.isalpha, s))]
                chosen = [s for s, f in filled if not f] or [s for s, _ in filled]
                kept.append((tbl, row_id, len(texts), len(chosen) if model.langs else 0))
                texts += chosen
            best, sure = score(model, texts)
            sizes = np.array([len(t) for t in texts], dtype=float)
            rows = []
            for tbl, row_id, at, count in kept:
                if not count:
                    rows.append((tbl, row_id, UNKNOWN, 0.0, 0.0))
                    continue
                own, size = best[at : at + count], sizes[at : at + count]
                chars = np.bincount(own, weights=size, minlength=len(model.langs))
                main = int(chars.argmax())
                share = chars[main] / chars.sum()
                mean = (sure[at : at + count] * size)[own == main].sum() / chars[main]
                rows.append((tbl, row_id, model.langs[main], float(mean * share), float(share)))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return documents.select("tbl", F.col("row_id").cast("long"), "title", "text").mapInArrow(detect, DOCUMENTS)


SEGMENTS = "page_id long, url string, line_no int, lang string, confidence double, chars long"


def page_languages(pages: DataFrame, model: Model, common: frozenset[str], foreign_only: bool = False) -> DataFrame:
    """Language of each prose page (line_no 0) and of each of its body lines of
    prose (line_no from 1): page_id, url, line_no, lang, confidence, chars.

    `pages` has (id, url, title, content).  The page's language is the one with
    most characters among its lines, ties by code; its confidence is the mean of
    those lines'.  Pages that are lists, tables or junk, pages whose body is only
    an error notice, and pages with null or empty content give no row.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("line_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("chars", pa.int64())])

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            whole: list[list] = [[] for _ in schema]
            kept: list[tuple] = []
            texts: list[str] = []
            for page_id, url, title, content in zip(*(c.to_pylist() for c in batch.columns)):
                if not content or not model.langs:
                    continue
                lines = content.split("\n")
                body = [(i + 1, s) for i, (line, f) in enumerate(zip(lines, furniture_flags(lines, title))) if not f and (s := line.strip())]
                only = [s for _, s in body]
                form, _, forms = page_form(only, common)
                if form != "prose" or only_notice(only):
                    continue
                chosen = [x for x, form in zip(body, forms) if form == PROSE and not notice(x[1]) and not filler(x[1])]
                chosen = chosen or [x for x, form in zip(body, forms) if form == HEADING] or body
                kept.append((page_id, url, len(texts), chosen))
                texts += [s for _, s in chosen]
            best, sure = score(model, texts)
            for page_id, url, at, chosen in kept:
                chars: dict[int, int] = {}
                for k, (_, s) in enumerate(chosen):
                    chars[best[at + k]] = chars.get(best[at + k], 0) + len(s)
                main = min(chars, key=lambda i: (-chars[i], i))
                of_main = [sure[at + k] for k in range(len(chosen)) if best[at + k] == main]
                rows = [(page_id, url, 0, model.langs[main], float(np.mean(of_main)), chars[main])]
                rows += [(page_id, url, n, model.langs[best[at + k]], float(sure[at + k]), len(s)) for k, (n, s) in enumerate(chosen)
                         if s.count(" ") + 1 >= PARAGRAPH_WORDS and sum(map(str.isalpha, s)) > 0.6 * len(s) and not (foreign_only and (best[at + k] == main or sure[at + k] < SURE))]
                for row in rows:
                    for column, value in zip(whole, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(whole, schema.types)], schema=schema)

    return pages.select(F.col("id").cast("long"), "url", "title", "content").mapInArrow(detect, SEGMENTS)


def foreign_segments(pages: DataFrame, labels: DataFrame, model: Model, common: frozenset[str]) -> DataFrame:
    """(page_id, line_no, lang, confidence): with line_no 0 the pages whose
    declared label is missing, names no language or another one than most of the
    body; above 0 the paragraphs in another language than most of the body.

    `labels` has (url, label); a page without a row there has no label, and of
    several rows with the same url one counts."""
    found = staged(page_languages(pages, model, common, foreign_only=True), "languages")
    declared = labels.groupBy("url").agg(F.min(label_language(F.col("label"))).alias("declared"))
    whole = found.where("line_no = 0").join(declared, "url", "left")
    wrong = whole.where("declared is null or declared != lang")
    columns = ["page_id", "line_no", "lang", "confidence"]
    return wrong.select(columns).unionByName(found.where("line_no > 0").select(columns))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "indexed_pages")
    labels = table(spark, sf_dir, "parsed_pages").select("url", F.col("metadata.language").alias("label"))
    return pages, labels


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = _inputs(spark, sf_dir)
    return foreign_segments(pages, labels, train_from_tables(spark, sf_dir), common_words(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_segments(spark, sf_dir).select("page_id", "line_no", "lang")


def p3_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each declared label occurs and which language it names."""
    _, labels = _inputs(spark, sf_dir)
    return labels.groupBy("label").agg(F.count("*").alias("pages"), F.first(label_language(F.col("label"))).alias("lang"))


def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page and every document, one row each."""
    pages = table(spark, sf_dir, "indexed_pages").select(F.lit("indexed_pages").alias("tbl"), F.col("id").alias("row_id"), "title", F.col("content").alias("text"))
    documents = table(spark, sf_dir, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_id"), "title", "text")
    return document_languages(pages.unionByName(documents), train_from_tables(spark, sf_dir))


QUERIES = {"p3_found": p3_found, "p3_languages": p3_languages, "p3_segments": p3_segments, "p3_declared": p3_declared}
_NAMES = {name: code for code, names in LANGUAGE_NAMES.items() for name in (code, *names.split())}
SQL = {
    "p3_declared": f"""
        WITH m(name, code) AS (VALUES {", ".join(f"('{n}', '{c}')" for n, c in _NAMES.items())}),
             l AS (SELECT metadata.language AS label, lower(replace(trim(metadata.language), '_', '-')) AS c FROM parsed_pages)
        SELECT l.label, count(*) AS pages, any_value(coalesce(a.code, b.code, d.code)) AS lang
        FROM l LEFT JOIN m a ON a.name = c LEFT JOIN m b ON b.name = split_part(c, '-', 1) LEFT JOIN m d ON d.name = split_part(c, ' ', 1)
        GROUP BY l.label
    """,
}
