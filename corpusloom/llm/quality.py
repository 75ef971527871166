"""Problem 1: text statistics of documents, and telling prose from the rest.

`text_statistics` gives one row of statistics per document: counts, word length,
symbol share, lines that end like sentences, common words, and the repetition
statistics (duplicate lines and paragraphs, character coverage of the dominant
n-grams).  `page_kinds` combines them with the forms of the body lines
(`lineforms.py`) into the kinds list, table and junk, and checks stored word
counts.

Everything is computed row by row within Arrow batches: no shuffle, nothing
broadcast but a word list of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .furniture import furniture_flags
from .lineforms import page_form
from .tables import common_words, slices, table

STATISTICS_SCHEMA = (
    "doc_id long, n_words long, n_chars long, n_lines long, mean_word_length double, symbol_ratio double, "
    "punctuated_line_share double, bullet_line_share double, common_word_share double, "
    "duplicate_line_share double, duplicate_line_char_share double, duplicate_paragraph_share double, "
    "top_2gram_coverage double, top_3gram_coverage double, top_4gram_coverage double, duplicate_5gram_coverage double"
)

_SENTENCE_END = tuple(".!?…\"”“»")
_BULLETS = tuple("*•·-–‣▪")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"’“”„«»()€$£%°-]")


def repetition(words: list[str]) -> tuple[float, float, float, float]:
    """Character coverage of the dominant 2-, 3- and 4-gram and of all repeated
    5-grams, as shares of the characters of all words."""
    total = sum(map(len, words))
    if not total:
        return 0.0, 0.0, 0.0, 0.0
    out = []
    for n in (2, 3, 4):
        grams = Counter(zip(*(words[i:] for i in range(n))))
        if grams:
            gram, count = max(grams.items(), key=lambda x: (x[1], sum(map(len, x[0]))))
            out.append(min(1.0, count * sum(map(len, gram)) / total) if count > 1 else 0.0)
        else:
            out.append(0.0)
    fives = list(zip(*(words[i:] for i in range(5))))
    covered = 0
    if len(fives) > len(set(fives)):
        seen: set[tuple] = set()
        reach = 0
        for i, gram in enumerate(fives):
            if gram in seen:
                for j in range(max(i, reach), i + 5):
                    covered += len(words[j])
                reach = i + 5
            seen.add(gram)
    return (*out, covered / total)


def statistics(text: str | None, common: frozenset[str]) -> tuple:
    """Statistics of one text, in the order of `STATISTICS_SCHEMA` without the
    id.  Null counts as the empty text; shares of nothing are 0."""
    text = text or ""
    words = text.split()
    lines = [x for x in (line.strip() for line in text.split("\n")) if x]
    n, nl = len(words), len(lines)
    chars = sum(map(len, words))
    low = [w.strip(".,;:!?\"'()“”„«»").lower() for w in words]
    paragraphs = [p for p in (p.strip() for p in re.split(r"\n\s*\n", text)) if p]
    distinct = Counter(lines)
    line_chars = sum(map(len, lines))
    return (
        n, len(text), nl,
        chars / n if n else 0.0,
        len(_SYMBOL.findall(text)) / chars if chars else 0.0,
        sum(line.endswith(_SENTENCE_END) for line in lines) / nl if nl else 0.0,
        sum(line.startswith(_BULLETS) for line in lines) / nl if nl else 0.0,
        sum(w in common for w in low) / n if n else 0.0,
        1 - len(distinct) / nl if nl else 0.0,
        sum((c - 1) * len(x) for x, c in distinct.items()) / line_chars if line_chars else 0.0,
        1 - len(set(paragraphs)) / len(paragraphs) if paragraphs else 0.0,
        *repetition(low),
    )


def _rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, per_row) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        columns = [c.to_pylist() for c in batch.columns]
        out = [x for row in zip(*columns) for x in per_row(*row)]
        arrays = [pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def arrow_rows(df: DataFrame, per_row, names: list[str], types: list[pa.DataType], ddl: str) -> DataFrame:
    """Apply `per_row(*columns) -> rows` to every row of `df`, in Arrow batches."""
    schema = pa.schema(list(zip(names, types)))
    return df.mapInArrow(lambda batches: _rows(batches, schema, per_row), ddl)


def text_statistics(df: DataFrame, id_col: str, text_col: str, common: frozenset[str]) -> DataFrame:
    """One row of text statistics for each row of `df`.

    Only the two named columns are read, so other columns, whatever their
    names, have no influence.  A null or empty text gives zeros; repeated rows
    give repeated results; an empty table gives an empty one.
    """
    names = [c.split()[0] for c in STATISTICS_SCHEMA.split(", ")]
    types = [pa.int64()] * 4 + [pa.float64()] * (len(names) - 4)
    return arrow_rows(
        df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
        lambda i, text: [(i, *statistics(text, common))], names, types, STATISTICS_SCHEMA,
    )


#: Combined rules for bodies whose lines look like sentences but hold hardly any common words: repeated
#: word pairs (as share of the characters), lines or paragraphs from which they are junk.
SCARCE, REPEATED_PAIRS, REPEATED_LINES = 0.1, 0.2, 0.5
#: The same for lists and tables: entries of which most are copies of another are no list but junk.
COPIED_LINES = 0.5


def kind_of(text: str, title: str | None, common: frozenset[str], by_repetition: bool = True) -> str | None:
    """`list`, `table` or `junk` for a page whose body is for the most part not
    prose, else None.

    Combined rules: repetition of dominant terms tells stuffing (`page_form`),
    then the forms of the lines count, then duplicate lines and paragraphs and
    the dominant word pairs turn what is repeated into junk.  With
    `by_repetition` false the forms alone decide."""
    lines = text.split("\n")
    flags = furniture_flags(lines, title)
    body = [s for line, furniture in zip(lines, flags) if not furniture and (s := line.strip())]
    form, shares, _ = page_form(body, common, by_repetition)
    if form == "empty":
        return None
    if form == "keywords":
        return "junk"
    if by_repetition and len(body) > 2:
        copied = 1 - len(set(body)) / len(body)
        if form == "prose" and shares["common"] < SCARCE:
            paragraphs = [p for p in ("\n".join(x for x, f in zip(lines, flags) if not f)).split("\n\n") if p.strip()]
            pairs = repetition(" ".join(body).lower().split())[0]
            if pairs > REPEATED_PAIRS or max(copied, 1 - len(set(paragraphs)) / max(1, len(paragraphs))) > REPEATED_LINES:
                return "junk"
        elif form != "prose" and copied > COPIED_LINES:
            return "junk"
    return None if form == "prose" else form


def page_kinds(pages: DataFrame, common: frozenset[str], by_repetition: bool = True) -> DataFrame:
    """(page_id, kind) of `pages` (id, title, content, word_count): the kind of
    each page that is not prose, and `miscounted` where the stored word count is
    null or not the number of whitespace-separated words of the content.

    A null content has no words and no kind.  Ties between forms go to the
    kind that is later in the alphabet.
    """

    def per_row(page_id, title, content, stored):
        content = content or ""
        kind = kind_of(content, title, common, by_repetition) if content else None
        if kind:
            yield page_id, kind
        if stored is None or stored != len(content.split()):
            yield page_id, "miscounted"

    columns = pages.select(F.col("id").cast("long"), "title", "content", F.col("word_count").cast("long"))
    return arrow_rows(columns, per_row, ["page_id", "kind"], [pa.int64(), pa.string()], "page_id long, kind string")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_kinds(table(spark, sf_dir, "indexed_pages"), common_words(spark, sf_dir))


def p1_text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_statistics(table(spark, sf_dir, "indexed_pages"), "id", "content", common_words(spark, sf_dir))


def p1_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored against counted words, in SQL expressions only."""
    pages = table(spark, sf_dir, "indexed_pages")
    words = F.filter(F.split("content", r"\s+"), lambda w: w != "")
    return pages.select(F.col("id").alias("page_id"), F.col("word_count").alias("stored"), F.size(words).cast("long").alias("counted"))


QUERIES = {"p1_found": p1_found, "p1_text_statistics": p1_text_statistics, "p1_word_counts": p1_word_counts}
SQL = {
    "p1_word_counts": """
        SELECT id AS page_id, word_count AS stored,
               CAST(len([w for w in regexp_split_to_array(content, '\\s+') if w <> '']) AS BIGINT) AS counted
        FROM indexed_pages
    """,
}
