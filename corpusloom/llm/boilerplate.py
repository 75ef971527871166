"""Problem 2: keeping the main body of pages that carry site furniture.

Template deduction by equivalence classes.  The tokens are the fields of lines
(a menu in one line has several), with digits masked; the occurrence vector of
a token is the set of pages of a host that hold it.

1. `page_tokens` turns every page into its distinct tokens; one shuffle counts
   them for each host: support, a fingerprint of the occurrence vector (xor and
   sum of page hashes, so equal vectors are told exactly but for hash
   collisions), and what stands around the token.
2. `deduce_templates` puts the tokens of a host with equal vectors into classes
   and keeps the valid ones: frequent enough, and no copies of one page, whose
   classes cover most of their pages and whose pages are all of one length.
   Classes are nested by exact inclusion of their vectors: the pages that each
   two classes have in common are counted.  A class that stands on too few
   pages to be valid by itself is kept if it is nested in a valid one and keeps
   to the page's edges.
3. Valid tokens of several hosts make the shared template, which serves hosts
   with too few pages.
4. `label_lines` takes out the lines whose fields are all of the template.  The
   slots between them are the page's text, but for slots that the template
   itself opens: where a token is followed by a run of titles on nearly all its
   pages, the titles after it are its nested slot (related pages).  Only what is
   left is typed by wording (`furniture.py`): furniture too rare for a template.

No host is gathered in one task: classes, nesting and counts are aggregates that
combine before their shuffles.  A host's frequent tokens are bounded, with a
support of at least the share `s` of its pages, by `fields per page / s`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import staged, staged_bytes
from .furniture import furniture_flags, title_like
from .tables import slices, table

MIN_SUPPORT = 3  # pages a template token stands on at least
MIN_SHARE = 0.02  # share of its host's pages a template token stands on at least
NESTED_SHARE = 0.008  # the same for a token of a class nested in a valid one
EDGE_SHARE, EDGE_LINES = 0.8, 8  # how often, and within how many lines, a nested token stands near an edge
LENGTH_SPREAD = 0.2  # least variation of the pages' lengths: copies of one page share lines, too
MOST_COVERED = 0.5  # share of its pages' characters a class covers at most: copies share most of their text
SHARED_HOSTS = 3  # hosts whose templates hold a token of the shared template
SHARED_PART = 0.5  # part that they are, at least, of the hosts on which the token recurs at all
OPENS = 0.6  # share of a token's pages on which a run of titles follows it, from which it opens a slot
RUN = 2  # titles of a run at least
BROADCAST_BYTES = 8 << 20  # written size of the templates up to which they are broadcast; beyond, they join the pages' tokens

_DIGITS = re.compile(r"\d+", re.ASCII)
_FIELDS = re.compile(r"\s{2,}|\t|\s?\|\s?|\s[>›»·•/–-]\s")
_BULLET = re.compile(r"[*\-•·–]\s+")
_LETTER = re.compile(r"[^\W\d_]")


def host_of(url: F.Column) -> F.Column:
    """Lower-cased host of an address; the empty string where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _signed(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=42)
    return h - (1 << 64) if h >> 63 else h


def line_tokens(line: str) -> list[int]:
    """Hashes of the tokens of a stripped line: its fields, lower case, digits
    masked, without a list mark before them.  A line with a field without
    letters is a row of values and has no tokens."""
    mark = _BULLET.match(line)
    core = _DIGITS.sub("0", line[mark.end():] if mark else line).lower()
    fields = [f for f in map(str.strip, _FIELDS.split(core)) if f]
    return [_signed(f) for f in fields] if all(map(_LETTER.search, fields)) else []


TOKENS = "host string, page long, chars double, token long, edge boolean, opens boolean, size int"
_TOKENS = pa.schema([
    ("host", pa.string()), ("page", pa.int64()), ("chars", pa.float64()), ("token", pa.int64()), ("edge", pa.bool_()), ("opens", pa.bool_()), ("size", pa.int32()),
])


def runs_of_titles(lines: list[str], title: str | None) -> list[int]:
    """For each stripped line the number of title-like lines right after it; the
    page's own title ends a run."""
    after = [0] * (len(lines) + 1)
    for i in range(len(lines) - 1, -1, -1):
        after[i] = after[i + 1] + 1 if lines[i] and lines[i] != title and title_like(lines[i]) else 0
    return after[1:]


def page_tokens(pages: DataFrame) -> DataFrame:
    """One row for each page and distinct token: host, page, the page's
    characters, whether the token's line is near an edge, whether a run of titles
    follows it, and its length.  `pages` has (url, title, text), one row a page;
    pages without host or text have no tokens."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in _TOKENS]
            for host, page, title, text in zip(*(c.to_pylist() for c in batch.columns)):
                lines = [line.strip() for line in text.split("\n")]
                after = runs_of_titles(lines, title)
                filled = [i for i, line in enumerate(lines) if line]
                seen: dict[int, tuple] = {}
                for k, i in enumerate(filled):
                    edge = min(k, len(filled) - 1 - k) < EDGE_LINES
                    for token in line_tokens(lines[i]):
                        seen.setdefault(token, (edge, after[i] >= RUN, len(lines[i])))
                n = len(seen)
                out[0] += [host] * n
                out[1] += [page] * n
                out[2] += [float(len(text))] * n
                out[3] += seen
                for column, values in zip(out[4:], zip(*seen.values())):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TOKENS.types)], schema=_TOKENS)

    columns = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("url").alias("page"), "title", "text").where("host != '' and text is not null")
    return columns.mapInArrow(compute, TOKENS)



def deduce_templates(pages: DataFrame) -> DataFrame:
    """Template tokens of each host: (host, token, level, support, opens).

    `level` counts the classes a token's class is nested in, `opens` tells that a
    slot of titles follows it.  The shared template has the empty host and the
    number of hosts as support.  `pages` has (url, title, text), one row per
    page; a null text has no tokens, and a host with fewer than `MIN_SUPPORT`
    pages only the shared template."""
    tokens = staged(page_tokens(pages), "page-tokens")
    sizes = pages.groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))
    counted = tokens.groupBy("host", "token").agg(
        F.count("*").alias("support"), F.bit_xor("page").alias("v1"), F.bit_xor(F.xxhash64("page")).alias("v2"), F.avg(F.col("edge").cast("double")).alias("edge"),
        F.avg(F.col("opens").cast("double")).alias("opens"), F.avg("chars").alias("chars"), F.avg(F.col("chars") * F.col("chars")).alias("chars2"), F.max("size").alias("size"),
    ).where(F.col("support") >= MIN_SUPPORT)
    counted = staged(counted, "recurring-tokens")
    frequent = staged(
        counted.join(sizes, "host").where(F.col("support") >= NESTED_SHARE * F.col("pages")).withColumn("class", F.xxhash64("host", "support", "v1", "v2")), "frequent"
    )
    spread = F.sqrt(F.greatest(F.lit(0.0), F.first("chars2") - F.first("chars") * F.first("chars"))) / F.greatest(F.lit(1.0), F.first("chars"))
    classes = staged(
        frequent.groupBy("host", "class").agg(F.first("support").alias("support"), F.first("pages").alias("pages"), F.avg("edge").alias("edge"), (F.sum("size") / F.first("chars")).alias("covered"), spread.alias("spread"))
        .where((F.col("covered") <= MOST_COVERED) & (F.col("spread") >= LENGTH_SPREAD))
        .withColumn("valid", F.col("support") >= MIN_SHARE * F.col("pages")), "classes"
    )
    # pages that two classes have in common, counted from one token of each class
    one = frequent.join(classes.select("host", "class", "valid"), ["host", "class"]).groupBy("host", "class", "valid").agg(F.min("token").alias("token"))
    held = tokens.select("host", "page", "token").join(one, ["host", "token"]).groupBy("host", "page").agg(F.collect_list(F.struct("class", "valid")).alias("held"))  # a page's classes
    inner = held.select("host", "held", F.explode("held").alias("x"))
    pairs = inner.select("host", F.col("x.class").alias("class"), F.explode(F.filter("held", lambda y: y["valid"] & (y["class"] != F.col("x.class")))).alias("outer"))
    common = pairs.groupBy("host", "class", F.col("outer.class").alias("outer")).agg(F.count("*").alias("both"))
    nested = common.join(classes.select("host", "class", "support"), ["host", "class"]).where("both = support").groupBy("host", "class").agg(F.count("*").cast("int").alias("level"))
    kept = classes.join(nested, ["host", "class"], "left").where(F.col("valid") | (F.col("level").isNotNull() & (F.col("edge") >= EDGE_SHARE)))
    own = staged(
        frequent.drop("edge").join(kept.select("host", "class", F.coalesce("level", F.lit(0)).alias("level")), ["host", "class"])
        .select("host", "token", "level", "support", (F.col("opens") >= OPENS).alias("opens")), "own-templates"
    )
    recurring = counted.groupBy("token").agg(F.count("*").alias("hosts"))
    shared = (
        own.groupBy("token").agg(F.count("*").alias("support"), F.avg(F.col("opens").cast("double")).alias("opens")).where(F.col("support") >= SHARED_HOSTS)
        .join(recurring, "token").where(F.col("support") >= SHARED_PART * F.col("hosts"))
    )
    return own.unionByName(shared.select(F.lit("").alias("host"), "token", F.lit(0).alias("level"), "support", (F.col("opens") >= 0.5).alias("opens")))


def _with_own_tokens(texts: DataFrame, known: DataFrame) -> DataFrame:
    """`texts` with those of each row's tokens that its host's or the shared
    template holds, found by joins, for templates that are too large for a
    broadcast.  A row has no more of them than fields."""
    schema = pa.schema([("tbl", pa.string()), ("row_id", pa.int64()), ("host", pa.string()), ("token", pa.int64())])

    def fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [
                (tbl, row_id, host, token) for tbl, row_id, host, text in zip(*(c.to_pylist() for c in batch.columns))
                for token in {t for line in (text or "").split("\n") for t in line_tokens(line.strip())}
            ]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    held = staged(texts.select("tbl", "row_id", "host", "text").mapInArrow(fields, "tbl string, row_id long, host string, token long"), "fields")
    own = held.join(known.where("host != ''"), ["host", "token"]).select("tbl", "row_id", "token", "opens", F.lit(1).alias("rank"))
    shared = held.join(known.where("host = ''").select("token", "opens"), "token").select("tbl", "row_id", "token", "opens", F.lit(0).alias("rank"))
    best = own.unionByName(shared).groupBy("tbl", "row_id", "token").agg(F.max_by("opens", "rank").alias("opens"))
    sets = best.groupBy("tbl", "row_id").agg(F.collect_list(F.struct("token", "opens")).alias("tokens"))
    return texts.join(sets, ["tbl", "row_id"], "left").select("tbl", "row_id", "title", "text", "host", F.coalesce("tokens", F.array().cast("array<struct<token:bigint,opens:boolean>>")).alias("tokens"))


LABELS = "tbl string, row_id long, line_no int, origin string"


def template_flags(lines: list[str], title: str | None, template: dict[int, bool]) -> list[str | None]:
    """Origin of each stripped line by the template alone: `template`, `slot` for
    titles of a slot the template opens, None for the rest.  `template` maps
    tokens to whether they open a slot.  The page's own title is never of it."""
    out: list[str | None] = [None] * len(lines)
    run = False
    after = runs_of_titles(lines, title)
    for i, line in enumerate(lines):
        if not line or line == title:
            run = False
            continue
        own = line_tokens(line)
        if own and all(t in template for t in own):
            out[i] = "template"
            run = after[i] >= RUN and any(template[t] for t in own)
        elif run and title_like(line):
            out[i] = "slot"
        else:
            run = False
    return out


def label_lines(documents: DataFrame, templates: DataFrame, wording: bool = True) -> DataFrame:
    """(tbl, row_id, line_no, origin) of each line of site furniture; `origin` is
    `template` for lines of the host's or the shared template, `slot` for titles
    in a slot that the template opens, and `wording` for lines that only the
    lists of wordings tell.  With `wording` false those lists are not used.

    `documents` has (tbl, row_id, url, title, text); `templates` comes from
    `deduce_templates`.  Null and empty texts have no lines.  A page's own title
    is never a template line.
    """
    known = staged(templates.select("host", "token", "opens"), "templates")
    texts = documents.select("tbl", F.col("row_id").cast("long"), "title", "text", host_of(F.col("url")).alias("host"))
    by_host: dict[str, dict[int, bool]] = {"": {}}
    if staged_bytes(known) <= BROADCAST_BYTES:
        for r in known.collect():
            by_host.setdefault(r.host, {})[r.token] = r.opens
        columns = texts.select("tbl", "row_id", "title", "text", "host", F.lit(None).cast("array<struct<token:bigint,opens:boolean>>").alias("tokens"))
    else:
        columns = _with_own_tokens(texts, known)
    shared = documents.sparkSession.sparkContext.broadcast(by_host)
    schema = pa.schema([("tbl", pa.string()), ("row_id", pa.int64()), ("line_no", pa.int32()), ("origin", pa.string())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[str, dict[int, bool]] = {}
        for batch in slices(batches):
            tbls, ids, numbers, origins = [], [], [], []
            for tbl, row_id, title, text, host, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if not text:
                    continue
                if tokens is not None:
                    template = {x["token"]: x["opens"] for x in tokens}
                elif host in merged:
                    template = merged[host]
                else:
                    template = merged[host] = {**shared.value[""], **shared.value.get(host, {})}
                lines = [line.strip() for line in text.split("\n")]
                found = template_flags(lines, title, template)
                if wording:
                    flags = furniture_flags(lines, title, template=[x is not None for x in found])
                    found = [(x or "wording") if flag else None for x, flag in zip(found, flags)]
                for i, origin in enumerate(found):
                    if origin:
                        tbls.append(tbl)
                        ids.append(row_id)
                        numbers.append(i + 1)
                        origins.append(origin)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((tbls, ids, numbers, origins), schema.types)], schema=schema)

    return columns.mapInArrow(label, LABELS)


def main_body(documents: DataFrame, templates: DataFrame) -> DataFrame:
    """(tbl, row_id, body): the texts without their lines of site furniture.
    A text that is null gives null; one that is all furniture the empty text."""
    flags = label_lines(documents, templates).groupBy("tbl", "row_id").agg(F.collect_set("line_no").alias("furniture"))
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.coalesce("furniture", F.array().cast("array<int>")), i + 1))
    return documents.select("tbl", "row_id", "text").join(flags, ["tbl", "row_id"], "left").select("tbl", "row_id", F.trim(F.array_join(kept, "\n")).alias("body"))


def stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_id, url, title, text) of both tables of page texts."""
    pages = table(spark, sf_dir, "indexed_pages").select(F.lit("indexed_pages").alias("tbl"), F.col("id").alias("row_id"), "url", "title", F.col("content").alias("text"))
    versions = table(spark, sf_dir, "page_versions").select(F.lit("page_versions").alias("tbl"), F.col("id").alias("row_id"), "url", "title", F.col("text_content").alias("text"))
    return pages.unionByName(versions)


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduce_templates(table(spark, sf_dir, "indexed_pages").select("url", "title", F.col("content").alias("text")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_lines(spark, sf_dir).select("tbl", "row_id", "line_no")


def p2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`p2_found` with the origin of each line."""
    return label_lines(stored_texts(spark, sf_dir), _templates(spark, sf_dir))


def p2_main_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_body(stored_texts(spark, sf_dir), _templates(spark, sf_dir))


def p2_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each host's template, by level of nesting."""
    return _templates(spark, sf_dir).groupBy("host", "level").agg(F.count("*").alias("tokens"), F.max("support").alias("support"))


QUERIES = {"p2_found": p2_found, "p2_lines": p2_lines, "p2_main_body": p2_main_body, "p2_templates": p2_templates}
SQL: dict[str, str] = {}
