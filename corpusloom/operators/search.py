"""Full-text search on DataFrames: postings, boolean and phrase matching, BM25,
snippets, paging.

The index is a postings table (doc_id, col, pos, term).  A query is parsed on
the driver into leaves (term, prefix, phrase) and a boolean expression.  All
leaves are matched in one pass over the postings of the terms they name; the
boolean expression is a Column over the leaves' frequencies per document.
Document lengths and the two corpus scalars come from `doc_lengths`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import analyse, analyse_terms, tokens, word_count
from ..plans.staging import staged
from .catalog import upsert_latest

COLUMNS = ("url", "title", "content", "description")
# --- fixed values
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
MOST_CONTENT, MOST_DESCRIPTION, SNIPPET_TOKENS, MOST_PER_PAGE = 50_000, 1_000, 40, 100
# --- end of fixed values


# --- the document store
def index_rows(pages: DataFrame) -> DataFrame:
    """Rows to index of `pages` (url, title, content, description, domain,
    session_id, crawled_at): words counted before the content is cut, null
    texts as empty ones."""
    return pages.withColumns({
        "word_count": word_count(F.col("content")), "title": F.coalesce("title", F.lit("")),
        "content": F.substring(F.coalesce("content", F.lit("")), 1, MOST_CONTENT),
        "description": F.substring(F.coalesce("description", F.lit("")), 1, MOST_DESCRIPTION),
    })


def upsert(store: DataFrame, pages: DataFrame) -> DataFrame:
    """The store with pages put in by address; host and crawl time stay as first
    written."""
    return upsert_latest(store, index_rows(pages), "url", "crawled_at", keep_first=("domain", "crawled_at"))


def delete_session(store: DataFrame, session_id: int) -> DataFrame:
    """The store without one session's pages; pages without session stay."""
    return store.where(F.coalesce(F.col("session_id") != session_id, F.lit(True)))


# --- the index
def postings(store: DataFrame, columns: tuple[str, ...] = COLUMNS, stem: bool = True, doc_id: str = "id") -> DataFrame:
    """(doc_id, col, pos, term): every token with its place.  With `stem`, terms
    are folded and stemmed; each distinct token is analysed once."""
    parts = F.array(*[F.struct(F.lit(i).alias("col"), tokens(F.col(c)).alias("tokens")) for i, c in enumerate(columns)])
    exploded = store.select(F.col(doc_id).alias("doc_id"), F.explode(parts).alias("p")).select("doc_id", "p.col", F.posexplode("p.tokens").alias("pos", "token"))
    if not stem:
        return exploded.withColumnRenamed("token", "term")
    vocabulary = exploded.select("token").distinct().withColumn("term", analyse_terms("token"))
    return exploded.join(vocabulary, "token").select("doc_id", "col", "pos", "term")


def doc_lengths(store: DataFrame, columns: tuple[str, ...] = COLUMNS, doc_id: str = "id") -> DataFrame:
    """(doc_id, len): tokens of all columns together."""
    length = sum((F.size(tokens(F.col(c))) for c in columns), F.lit(0))
    return store.select(F.col(doc_id).alias("doc_id"), length.cast("long").alias("len"))


INDEX = "doc_id long, col int, pos int, term string, lead int"
LENGTHS = "doc_id long, len long"
LEADS = 64  # partitions of a stored index


def lead_of(term: Column) -> Column:
    """Partition of a term: by its first two letters, so that a term, and every
    prefix of two letters and more, is in one partition."""
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(LEADS)).cast("int")


def stored_index(store: DataFrame, path: str, columns: tuple[str, ...] = COLUMNS, stem: bool = True, doc_id: str = "id") -> tuple[DataFrame, DataFrame]:
    """Writes the index of a store below a path, partitioned by `lead_of`, and
    returns (postings, lengths) that read it: queries then scan the partitions of
    their terms only, and texts are never tokenised again."""
    spark = store.sparkSession
    index = postings(store, columns, stem, doc_id)
    # brought together by partition, large ones in several files
    index.withColumn("lead", lead_of(F.col("term"))).hint("rebalance", "lead").write.partitionBy("lead").parquet(path + "/postings")
    doc_lengths(store, columns, doc_id).write.parquet(path + "/lengths")
    return spark.read.schema(INDEX).parquet(path + "/postings"), spark.read.schema(LENGTHS).parquet(path + "/lengths")


# --- queries
@dataclass(frozen=True)
class Leaf:
    """A term, a prefix, or a phrase whose last word may be a prefix."""

    terms: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Query:
    """Leaves, and a boolean expression over them: an index, or (operator, left,
    right) with and, or, not - the latter as in `a NOT b`."""

    leaves: tuple[Leaf, ...]
    tree: object


class QuerySyntaxError(ValueError):
    pass


_TOKENS = re.compile(r'"([^"]*)"(\*?)|(\S+)')
_SPLIT = re.compile(r"[^\W_]+")


def clean_query(query: str) -> str:
    """Other signs than words, quotes, stars become blanks; a query without
    quotes, stars and whole-word operators gets prefix matching on each term."""
    text = " ".join(re.sub(r'[^\w\s"*]', " ", query or "").split())
    if text and not any(c in text for c in '"*') and not any(w in ("AND", "OR", "NOT") for w in text.split()):
        text = " ".join(f"{w}*" for w in text.split())
    return text


def parse_query(query: str, stem: bool = True) -> Query | None:
    """Query of a cleaned text; None if it is empty or no valid query.  Terms
    side by side are joined by AND, which binds like the word AND; NOT binds
    strongest, OR weakest."""
    normal = analyse if stem else (lambda w: w)
    items: list[object] = []
    leaves: list[Leaf] = []
    for phrase, star, word in _TOKENS.findall(query or ""):
        if word in ("AND", "OR", "NOT"):
            items.append(word)
            continue
        raw, prefix = (phrase, star == "*") if not word else (word.rstrip("*"), word.endswith("*"))
        parts = tuple(normal(w.lower()) for w in _SPLIT.findall(raw))
        if parts:
            items.append(len(leaves))
            leaves.append(Leaf(parts, prefix))
        elif word and set(word) <= {"*"}:
            return None
    try:
        tree, rest = _or(items)
        return Query(tuple(leaves), tree) if not rest else None
    except QuerySyntaxError:
        return None


def _or(items):
    left, rest = _and(items)
    while rest and rest[0] == "OR":
        right, rest = _and(rest[1:])
        left = ("or", left, right)
    return left, rest


def _and(items):
    left, rest = _not(items)
    while rest and (rest[0] == "AND" or isinstance(rest[0], int)):
        right, rest = _not(rest[1:] if rest[0] == "AND" else rest)
        left = ("and", left, right)
    return left, rest


def _not(items):
    if not items or not isinstance(items[0], int):
        raise QuerySyntaxError
    left, rest = items[0], items[1:]
    while rest and rest[0] == "NOT":
        if len(rest) < 2 or not isinstance(rest[1], int):
            raise QuerySyntaxError
        left, rest = ("not", left, rest[1]), rest[2:]
    return left, rest


def _condition(tree, found: list[Column]) -> Column:
    if isinstance(tree, int):
        return found[tree] > 0
    op, a, b = tree[0], _condition(tree[1], found), _condition(tree[2], found)
    return a & b if op == "and" else a | b if op == "or" else a & ~b


# --- matching and ranking
def leaf_frequencies(index: DataFrame, query: Query) -> DataFrame:
    """(doc_id, leaf, tf): how often each leaf occurs in each document.  Phrases
    are adjacent positions within one column."""

    def matches(leaf: Leaf, i: int) -> Column:
        prefix = leaf.prefix and i == len(leaf.terms) - 1
        return F.col("term").startswith(leaf.terms[i]) if prefix else F.col("term") == leaf.terms[i]

    wanted = F.lit(False)
    for leaf in query.leaves:
        for i in range(len(leaf.terms)):
            wanted |= matches(leaf, i)
    near = index.where(wanted)
    if "lead" in index.columns and all(len(t) > 1 for leaf in query.leaves for t in leaf.terms):
        # a term of one letter as prefix is in many partitions, all others in one each
        leads = index.sparkSession.range(1).select(*[lead_of(F.lit(t)).alias(f"l{i}") for i, t in enumerate(sorted({t for leaf in query.leaves for t in leaf.terms}))]).first()
        near = near.where(F.col("lead").isin(sorted(set(leads))))
    phrases = [k for k, leaf in enumerate(query.leaves) if len(leaf.terms) > 1]
    if phrases:
        near = staged(near, "near")  # read once for each word of a phrase, and no more than the places of the query's terms
    singles = [F.when(matches(leaf, 0), k) for k, leaf in enumerate(query.leaves) if len(leaf.terms) == 1]
    out = None
    if singles:
        # all single terms in one pass; a place can count for several of them
        found = near.select("doc_id", F.explode(F.array_compact(F.array(*singles))).alias("leaf"))
        out = found.groupBy("doc_id", "leaf").agg(F.count("*").alias("tf"))
    for k in phrases:
        leaf, found = query.leaves[k], None
        for i in range(len(leaf.terms)):
            places = near.where(matches(leaf, i)).select("doc_id", "col", (F.col("pos") - i).alias("pos"))
            found = places if found is None else found.join(places, ["doc_id", "col", "pos"])
        counts = found.groupBy("doc_id").agg(F.count("*").alias("tf")).select("doc_id", F.lit(k).alias("leaf"), "tf")
        out = counts if out is None else out.unionByName(counts)
    return out


def bm25(index: DataFrame, lengths: DataFrame, query: Query, stats: tuple[int, float] | None = None) -> DataFrame:
    """(doc_id, score) of the documents that match.

    The score sums, over the query's leaves, idf * tf (k1 + 1) / (tf + k1 (1 - b
    + b len / avglen)), lengths and frequencies over all columns, idf =
    ln((N - n + 0.5) / (n + 0.5)) but at least a small constant.  `stats` is
    (documents, mean length), computed from `lengths` if not given.
    """
    frequencies = leaf_frequencies(index, query)
    # read twice, for document frequencies and for scores, and small beside the index: one pass over the postings
    per_doc = staged(frequencies.groupBy("doc_id").agg(*[F.coalesce(F.max(F.when(F.col("leaf") == k, F.col("tf"))), F.lit(0)).alias(f"tf_{k}") for k in range(len(query.leaves))]), "hits")
    if stats is None:
        corpus = lengths.agg(F.struct(F.count("*").alias("docs"), F.avg("len").alias("mean_len")).alias("s")).scalar()
    else:
        corpus = F.struct(F.lit(stats[0]).alias("docs"), F.lit(float(stats[1])).alias("mean_len"))
    holding = per_doc.agg(F.array(*[F.count_if(F.col(f"tf_{k}") > 0) for k in range(len(query.leaves))]).alias("n")).scalar()
    matching = per_doc.where(_condition(query.tree, [F.col(f"tf_{k}") for k in range(len(query.leaves))]))
    scored = matching.join(lengths, "doc_id").withColumns({"_corpus": corpus, "_holding": holding})
    docs, mean_len = F.col("_corpus.docs"), F.col("_corpus.mean_len")
    total = F.lit(0.0)
    for k in range(len(query.leaves)):
        n, tf = F.col("_holding")[k], F.col(f"tf_{k}").cast("double")
        idf = F.greatest(F.log((docs - n + F.lit(0.5)) / (n + F.lit(0.5))), F.lit(LEAST_IDF))
        idf = F.when(idf <= LEAST_IDF, F.lit(LEAST_IDF)).otherwise(idf)
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / mean_len))
    return scored.select("doc_id", total.alias("score"))


def facet_filter(store: DataFrame, session_id: int | None = None, domain: str | None = None) -> DataFrame:
    """The store's rows of a session and of hosts that contain a text, in any
    case; `%` and `_` in it are wildcards."""
    if session_id is not None:
        store = store.where(F.col("session_id") == session_id)
    if domain:
        store = store.where(F.col("domain").ilike(f"%{domain}%"))
    return store


def search(store: DataFrame, index: DataFrame, lengths: DataFrame, text: str, page: int = 1, per_page: int = 20, session_id: int | None = None,
           domain: str | None = None, stem: bool = True, doc_id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(page of results, total): results by falling score and rising id, with
    snippet and title; an invalid or empty query finds nothing."""
    spark = store.sparkSession
    query = parse_query(clean_query(text), stem)
    chosen = facet_filter(store, session_id, domain)
    if query is None:
        hits = spark.createDataFrame([], "doc_id long, score double")
    else:
        hits = bm25(index, lengths, query).join(chosen.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi")
    per_page = max(1, min(per_page, MOST_PER_PAGE))
    top = hits.orderBy(F.desc(F.round("score", 6)), "doc_id").offset((max(page, 1) - 1) * per_page).limit(per_page)
    rows = F.broadcast(top).join(chosen.withColumnRenamed(doc_id, "doc_id"), "doc_id")  # at most MOST_PER_PAGE rows
    results = rows.select(
        "doc_id", "url", F.when(F.coalesce(F.col("title"), F.lit("")) == "", "Untitled").otherwise(F.col("title")).alias("title"), F.round("score", 6).alias("score"), "session_id", "crawled_at", "word_count",
        F.coalesce("content", F.lit("")).alias("content"),
    )
    if query is not None:
        results = snippets(results, query, stem)
    else:
        results = results.withColumn("snippet", F.lit("")).drop("content")
    return results.orderBy(F.desc("score"), "doc_id"), hits.agg(F.count("*").alias("total"))


# --- snippets
_WORDS = re.compile(r"[^\W_]+")


def snippet(content: str, query: Query, stem: bool = True, size: int = SNIPPET_TOKENS) -> str:
    """The window of at most `size` tokens with most different leaves and hits,
    the earliest of equals; hits are marked, adjacent words of a phrase as one;
    dots stand where the text goes on."""
    places = [(m.start(), m.end(), analyse(m.group().lower()) if stem else m.group().lower()) for m in _WORDS.finditer(content or "")]
    if not places:
        return ""
    spans: list[tuple[int, int, int]] = []  # first token, last token, leaf
    for k, leaf in enumerate(query.leaves):
        n = len(leaf.terms)
        for i in range(len(places) - n + 1):
            if all((places[i + j][2].startswith(t) if leaf.prefix and j == n - 1 else places[i + j][2] == t) for j, t in enumerate(leaf.terms)):
                spans.append((i, i + n - 1, k))
    starts = sorted({max(0, min(a, len(places) - size)) for a, _, _ in spans} | {0})

    def worth(start: int) -> tuple[int, int]:
        inside = [k for a, b, k in spans if a >= start and b < start + size]
        return len(set(inside)), len(inside)

    start = max(starts, key=lambda s: (*worth(s), -s))
    end = min(len(places), start + size)
    marked: list[list[int]] = []
    for a, b, _ in sorted(s for s in spans if s[0] >= start and s[1] < end):
        if marked and a <= marked[-1][1]:
            marked[-1][1] = max(marked[-1][1], b)
        else:
            marked.append([a, b])
    out, at = [], 0 if start == 0 else places[start][0]
    for a, b in marked:
        out += [content[at : places[a][0]], "<mark>", content[places[a][0] : places[b][1]], "</mark>"]
        at = places[b][1]
    out.append(content[at:] if end == len(places) else content[at : places[end - 1][1]])
    return ("..." if start else "") + "".join(out) + ("..." if end < len(places) else "")


def snippets(rows: DataFrame, query: Query, stem: bool = True) -> DataFrame:
    """`rows` with `snippet` in place of `content`.  For pages of results."""
    schema = rows.drop("content").withColumn("snippet", F.lit("")).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("content")
            texts = pa.array([snippet(c, query, stem) for c in batch.column(at).to_pylist()], pa.string())
            names = [n for n in batch.schema.names if n != "content"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], texts], names=[*names, "snippet"])

    return rows.mapInArrow(add, schema)


