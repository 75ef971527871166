"""Problem 6: pages of repeated keywords, link lists and product labels.

Every page gets a few features of its body: density of links and labels, term
entropy, repetition, function words, marked sentences, signs and list marks.  Per language
the location and scatter of these features are estimated robustly over all pages
(medians first, then concentration steps over the pages near the centre), and
each page gets its Mahalanobis distance.  A page is spam when it is an outlier
and its deviation lies in a direction of spam: more repetition and fewer
function words (`keywords`), entries that are the page's own links (`links`),
labels of products (`tags`).  Directions are where a page of nothing but this
kind would be; features being shares, a page half of which is spam lies half way
there.  Tables, other lists and machine text are outliers, too, but in other
directions.  No other rule and no form of lines decides.

The features are computed once, in Arrow batches, and staged as a narrow table.
Links enter by hash: only the hashes of a page's entries meet those of its
links, in a join by address; texts are not shuffled.  Location and scatter are
ordinary aggregates of a few sums per language.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import staged
from .furniture import furniture_flags
from .tables import slices, small_rows, table

FEATURES = ["link_density", "label_density", "entropy", "repetition", "function_words", "marked", "signs", "listed"]
#: Scatter every feature has at least: most pages share the value 0 of some of them.
FLOOR = np.array([0.05, 0.05, 0.04, 0.04, 0.05, 0.1, 0.03, 0.1]) ** 2
NEAR = 3.0  # distance, in scatters, up to which a page takes part in a concentration step
STEPS = 2  # concentration steps
CUTOFF = 13.36  # squared distance of an outlier: chi square, 8 degrees of freedom, p = 0.9
TOP_TERMS = 3  # terms whose repetition is measured
FEW_TERMS = 12  # words by which the repetition of a page is damped: on a page of two lines a term comes back by chance
#: What the features of a page are where its whole body is of a kind; features that are not named are
#: those of the language.  The deviation of such a page from the centre is the kind's direction; keywords
#: come as sentences and as bare terms.
SPAM = {
    "links": {"link_density": 1.0, "marked": 0.0},
    "tags": {"label_density": 1.0, "function_words": 0.0, "marked": 0.0},
    "keywords": {"repetition": 0.5, "function_words": 0.0, "entropy": 0.6},
    "bare keywords": {"repetition": 0.5, "function_words": 0.0, "entropy": 0.6, "marked": 0.0},
}
#: Directions of outliers that are no spam: lists of other entries, machine text, tables.
OTHERS = {
    "list": {"listed": 1.0, "function_words": 0.0, "marked": 0.0, "repetition": 0.3},
    "bare list": {"function_words": 0.0, "marked": 0.0, "repetition": 0.2},
    "machine": {"function_words": 0.05, "marked": 0.0, "signs": 0.4, "entropy": 0.6, "repetition": 0.4},
    "table": {"marked": 0.0, "signs": 0.5, "function_words": 0.15},
}
ALIGNED = 0.65  # cosine between deviation and direction from which a page is of the kind
SPOKEN = 0.05  # share of function words up to which a page has no language
MOST = 0.5  # part of a direction's length a deviation must reach: a page of which half is spam deviates by half

_TERM = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_URL = re.compile(r"(?:https?://)?(?:[\w-]+\.)+[a-z]{2,}(?::\d+)?(?:/[^\s<>()\[\]]*)?", re.I)
_LEAD = re.compile(r"^(?:[*•·▪–—-]|\d{1,4}[.)]|[a-zA-Z][.)]|\[[ xX]?\])\s+")
_PIECES = re.compile(r" \| |; | · | / | > ")
_MARKDOWN = re.compile(r"\[([^\]]+)\]\(([^)]+)\)")
_TRIM = " \t-–—:|<>()[]\"'*•"
_TAG = re.compile(r"[#@][\w-]+")
_SKU = re.compile(r"(?:SKU|Art\.?|Item|Ref\.?|No\.?)[ :#-]*\d{2,}", re.I)
_COUNTED = re.compile(r"[\w-]+ \(\d+\)\Z")
_VARIANT = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+\Z")
_PATH = re.compile(r"[\w-]+(?: [>›»/] [\w-]+){1,4}\Z")
_SENTENCE_END = re.compile(r"[.!?…][\"”“»’)\]]*\Z")


def signed_hash(text: str) -> int:
    """Hash of a text, equal to `xxhash64` in SQL."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=42)
    return h - (1 << 64) if h >> 63 else h


def address_key(address: str) -> str:
    """An address without scheme and trailing slash, lower case."""
    return re.sub(r"^[a-z]+://", "", address.strip().lower()).rstrip("/.,;")


def entry_keys(line: str) -> list[tuple[list[int], int]]:
    """The entries of a line, each as the hashes of its texts and addresses and
    its length in characters."""
    core = _LEAD.sub("", line)
    pieces = _PIECES.split(core) if len(core) > 30 else [core]
    out = []
    for piece in pieces:
        keys = []
        marked = _MARKDOWN.search(piece)
        if marked:
            keys += [marked.group(1).strip(), address_key(marked.group(2))]
        else:
            for m in _URL.finditer(piece):
                keys.append(address_key(m.group()))
            text = _URL.sub("", piece).strip(_TRIM) if keys else piece.strip(_TRIM)
            if text:
                keys.append(text)
        if keys:
            out.append(([signed_hash(k) for k in keys], len(piece)))
    return out


def is_label(line: str) -> bool:
    """Whether a line consists of labels of products: article numbers, hash
    tags, counted single names, variants, paths of single names."""
    if _SKU.match(line) or _COUNTED.match(line):
        return True
    words = line.split()
    if len(words) >= 2 and sum(1 for w in words if _TAG.match(w)) >= 0.8 * len(words):
        return True
    if _PATH.match(line):
        return True
    cells = [c.strip() for c in re.split(r"[,;|]", line) if c.strip()]
    return len(cells) >= 3 and sum(1 for c in cells if _VARIANT.match(c)) >= 0.7 * len(cells)


FEATURE_SCHEMA = (
    "page_id long, url string, lang string, label_density double, entropy double, repetition double, "
    "function_words double, marked double, signs double, listed double, entry_keys array<array<long>>, entry_chars array<int>, body_chars int"
)
_ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("lang", pa.string()), ("label_density", pa.float64()), ("entropy", pa.float64()),
    ("repetition", pa.float64()), ("function_words", pa.float64()), ("marked", pa.float64()), ("signs", pa.float64()), ("listed", pa.float64()),
    ("entry_keys", pa.list_(pa.list_(pa.int64()))), ("entry_chars", pa.list_(pa.int32())), ("body_chars", pa.int32()),
])


def page_features(pages: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """Features of each page's body, its entries as hashes, and the language most
    of its function words belong to (`none` where there are hardly any).

    `pages` has (id, url, title, content); `words` the common words by language.
    A null or empty content gives zeros and no entries.
    """
    languages = {w: tuple(lang for lang, own in words.items() if w in own) for w in {w for own in words.values() for w in own}}

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in _ARROW]
            for page_id, url, title, content in zip(*(c.to_pylist() for c in batch.columns)):
                lines = (content or "").split("\n")
                body = [s for line, f in zip(lines, furniture_flags(lines, title)) if not f and (s := line.strip())]
                total = sum(map(len, body))
                joined = " ".join(body).lower()
                tokens = _TERM.findall(joined)
                counts = Counter(tokens)
                n = len(tokens)
                entropy = -sum(c / n * math.log(c / n) for c in counts.values()) / math.log(n) if n > 1 else 0.0
                votes: Counter[str] = Counter()
                function = 0
                for token in counts.keys() & languages.keys():
                    function += counts[token]
                    for lang in languages[token]:
                        votes[lang] += counts[token]
                lang = max(votes, key=lambda x: (votes[x], x)) if function > SPOKEN * n else "none"
                top = sorted((c for t, c in counts.items() if len(t) > 2 and t not in languages), reverse=True)[:TOP_TERMS]
                # terms come back throughout a page: what each has beyond a single use counts
                repeated = sum(c - 1 for c in top)
                others = n - function
                letters = sum(map(len, tokens))
                filled = len(joined) - joined.count(" ")
                keys, chars, label, marked, listed = [], [], 0, 0, 0
                for line in body:
                    if _SENTENCE_END.search(line) and line.count(" ") > 7:
                        marked += len(line)
                        if "http" not in line:
                            # a sentence is one entry at most
                            keys.append([signed_hash(line.strip(_TRIM))])
                            chars.append(len(line))
                            continue
                    label += len(line) if is_label(line) else 0
                    listed += len(line) if _LEAD.match(line) else 0
                    for own_keys, length in entry_keys(line):
                        keys.append(own_keys)
                        chars.append(length)
                row = (
                    page_id, url, lang, label / total if total else 0.0, entropy, repeated / (others + FEW_TERMS), function / n if n else 0.0,
                    marked / total if total else 0.0, 1 - letters / filled if filled else 0.0, listed / total if total else 0.0, keys, chars, total,
                )
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _ARROW.types)], schema=_ARROW)

    return pages.select(F.col("id").cast("long"), "url", "title", "content").mapInArrow(compute, FEATURE_SCHEMA)


def with_links(features: DataFrame, links: DataFrame) -> DataFrame:
    """Adds `link_density`: the share of the body's characters in entries that
    are links of the page, by text or address.  `links` has (url, links) with
    structs of url and text; pages without a row there have no links."""
    hashed = links.where(F.size("links") > 0).select(
        "url",
        F.concat(
            F.transform("links", lambda x: F.xxhash64(F.trim(x["text"]))),
            F.transform("links", lambda x: F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x["url"])), "^[a-z]+://", ""), "[/.,;]+$", ""))),
        ).alias("link_keys"),
    )
    bare = features.where(F.size("entry_keys") == 0)
    entries = features.where(F.size("entry_keys") > 0)
    matched = F.aggregate(
        F.arrays_zip("entry_keys", "entry_chars"), F.lit(0),
        lambda acc, e: acc + F.when(F.arrays_overlap(e["entry_keys"], F.col("link_keys")), e["entry_chars"]).otherwise(0),
    )
    joined = entries.join(hashed, "url", "left").withColumn(
        "link_density", F.when(F.col("link_keys").isNull() | (F.col("body_chars") == 0), 0.0).otherwise(F.least(F.lit(1.0), matched / F.col("body_chars")))
    )
    return joined.drop("link_keys").unionByName(bare.withColumn("link_density", F.lit(0.0)))


def robust_scatter(features: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Location and inverse scatter of the features of each language, from all
    its pages: medians and absolute deviations first, then concentration steps.
    Pages without language are measured against all languages pooled.  What
    reaches the driver is a few sums for each language."""
    n = len(FEATURES)
    spoken = features.select("lang", *FEATURES).where(F.col("lang") != "none")
    medians = small_rows(spoken.groupBy("lang").agg(F.count("*").alias("n"), *[F.percentile_approx(f, 0.5, 1000).alias(f) for f in FEATURES]))
    centre = {r.lang: np.array([float(r[f]) for f in FEATURES]) for r in medians}
    everything = sum(r.n for r in medians)
    centre["none"] = sum((r.n / everything * centre[r.lang] for r in medians), np.zeros(n))
    inverse = {lang: np.diag(1 / (FLOOR * 4)) for lang in centre}
    sums = [F.count("*").alias("n")] + [F.sum(f).alias(f"s_{f}") for f in FEATURES]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if j >= i]
    for _ in range(STEPS):
        near = with_distance(spoken, {k: (centre[k], inverse[k]) for k in centre}).where(F.col("distance") <= NEAR**2 * n)
        pooled = [0, np.zeros(n), np.zeros((n, n))]
        for r in small_rows(near.groupBy("lang").agg(*sums)):
            total, products = np.array([r[f"s_{f}"] for f in FEATURES]), np.zeros((n, n))
            for i in range(n):
                for j in range(i, n):
                    products[i, j] = products[j, i] = r[f"p_{i}_{j}"]
            pooled = [pooled[0] + r.n, pooled[1] + total, pooled[2] + products]
            if r.n >= 2 * n:
                centre[r.lang], inverse[r.lang] = _location(r.n, total, products)
        if pooled[0] >= 2 * n:
            centre["none"], inverse["none"] = _location(*pooled)
    return {lang: (centre[lang], inverse[lang]) for lang in centre}


def _location(count: int, total: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and inverse covariance, with `FLOOR` added, from sums."""
    mean = total / count
    return mean, np.linalg.inv(products / count - np.outer(mean, mean) + np.diag(FLOOR))


def with_distance(features: DataFrame, robust: dict[str, tuple[np.ndarray, np.ndarray]], directions: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Adds the squared Mahalanobis distance from the centre of the page's
    language and, for each of `directions`, `along_...`, the part of the
    direction's length that the deviation reaches, and `cos_...`, the cosine
    between both, in the metric of the language's scatter.  Computed for a whole
    Arrow batch at once; a language without centre has no distance."""
    directions = directions or {}
    added = ["distance", *[f"{what}_{name}" for name in directions for what in ("along", "cos")]]
    kept = features.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            out = np.full((len(added), len(langs)), np.nan)
            for lang, (centre, inverse) in robust.items():
                own = np.flatnonzero(langs == lang)
                deviation = values[own] - centre
                distance = np.einsum("ij,jk,ik->i", deviation, inverse, deviation)
                out[0, own] = distance
                for k, wanted in enumerate(directions.values()):
                    aim = np.array([wanted.get(f, c) for f, c in zip(FEATURES, centre)]) - centre
                    length = max(1e-9, float(aim @ inverse @ aim))
                    dot = deviation @ inverse @ aim
                    out[1 + 2 * k, own] = dot / length
                    out[2 + 2 * k, own] = dot / np.sqrt(length * np.maximum(1e-9, distance))
            arrays = [*batch.columns, *[pa.array(x, pa.float64(), from_pandas=True) for x in out]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema.fields) + "".join(f", `{x}` double" for x in added)
    return features.mapInArrow(score, schema)


def spam_pages(pages: DataFrame, links: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """(page_id, kind, distance) of the spam pages; `kind` is `keywords`, `links`
    or `tags`.

    A page is spam if it is an outlier of its language, its deviation is aligned
    with the direction of a kind more than with that of any other outliers, and
    reaches half of that direction's length, as where half the body is of the
    kind.  The best aligned kind counts, of equal ones the first of `SPAM`.
    Pages without body are none.
    """
    measured = staged(page_features(pages, words), "spam-measured")
    features = staged(with_links(measured, links).where("body_chars > 0").select("page_id", "lang", *FEATURES), "spam-features")
    scored = with_distance(features, robust_scatter(features), {**SPAM, **OTHERS}).where(F.col("distance") > CUTOFF)
    best = F.greatest(*[F.col(f"`cos_{k}`") for k in (*SPAM, *OTHERS)])
    kind = F.coalesce(*[F.when((F.col(f"`cos_{k}`") >= F.greatest(best, F.lit(ALIGNED))) & (F.col(f"`along_{k}`") >= MOST), k.split()[-1]) for k in SPAM])
    return scored.select("page_id", kind.alias("kind"), "distance").where("kind is not null")


def _inputs(spark: SparkSession, sf_dir: str):
    words: dict[str, list[str]] = {}
    for r in small_rows(table(spark, sf_dir, "common_words").select("lang", "word")):
        if r.lang and r.word:
            words.setdefault(r.lang, []).append(r.word.lower())
    return table(spark, sf_dir, "indexed_pages"), table(spark, sf_dir, "parsed_pages").select("url", "links"), words


def p6_spam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(*_inputs(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_spam(spark, sf_dir).select("page_id", "kind")


QUERIES = {"p6_found": p6_found, "p6_spam": p6_spam}
SQL: dict[str, str] = {}
