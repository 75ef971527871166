"""Problem 7: near-duplicate texts by SuperMinHash, banding and union-find.

1. `signatures` reads every text whole, forms its distinct word shingles and
   their SuperMinHash signature.  In SuperMinHash each element walks through its
   own random permutation of the signature's slots and offers slot p(j) the
   value r_j + j, so the ranks of one element are correlated, the variance is
   lower than MinHash's, and the walk stops as soon as every slot holds a value
   below the current step.  Here all elements of many texts take each step
   together in numpy; texts whose slots are full drop out.
2. Texts with equal word sequences form a group; only its first one goes on.
3. `shared_buckets` hashes bands of the signature, counts buckets with map-side
   combining and keeps those of two and more.
4. Candidates: for all pairs, `bucket_pairs` joins each bucket with itself, a hot
   one in salted parts.  For classes that would be quadratic in the copies of a
   text: `class_pairs` first takes only pairs with the smallest id of a bucket,
   and after their classes are known only the pairs of a bucket that lie in
   different classes.  Pairs within a class need no check, so no link between
   classes is lost.
5. `verified_pairs` drops pairs whose sketches (one byte of each of 64 slots)
   agree six deviations less than the similarity asks for, then computes the
   exact similarity from the texts of the documents still in question.
6. `group_classes` joins verified pairs to classes by distributed union-find:
   min-label hooking with pointer jumping, each round staged.

No step gathers a bucket, a group or a component in one task: buckets are
counted by aggregates and joined row by row, groups of equal texts are
represented by their smallest id, and classes are label columns.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import staged, staged_bytes, unstage
from .tables import slices, table

ROWS, BANDS = 4, 50  # signature slots a band, bands: finds a pair of similarity 0.5 with 0.96, 0.6 with 0.999
SLOTS = ROWS * BANDS
SKETCH = 64  # slots of which one byte is kept
DEVIATIONS = 6  # binomial deviations by which the agreeing share of sketch bytes may be below the similarity asked for: loses 1e-9 of the pairs
BROADCAST_BYTES = 8 << 20  # written size up to which the ids of the documents to verify are broadcast
SALTED = 2000  # rows of a bucket's part in a join with itself
CHUNK_CHARS = 1_000_000  # characters hashed at once

_ALNUM: np.ndarray | None = None
_U = np.uint64


def _alnum() -> np.ndarray:
    """Whether each code point is a letter or a digit."""
    global _ALNUM
    if _ALNUM is None:
        _ALNUM = np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)
    return _ALNUM


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads the bits of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def shingles(texts: list[str], words: int) -> tuple[list[np.ndarray], list[int]]:
    """The distinct word shingles of each text as sorted 64-bit hashes, and a
    hash of its word sequence.  Words are the longest runs of letters and digits
    of the text in lower case; a text of fewer words has no shingle."""
    joined = "\n" + "\n".join(t.lower().replace("\n", " ") for t in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = _alnum()[codes]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8)))
    begin, end = edges[::2] + 1, edges[1::2] + 1  # the text begins and ends with a line end
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(np.where(inside, codes.astype(np.uint64) + _U(1), _U(0)) * _powers(_BASE, len(codes)), out=sums[1:])
    word = _mix((sums[end] - sums[begin]) * _powers(_INVERSE, len(codes))[begin] + (end - begin).astype(np.uint64))
    borders = np.flatnonzero(codes == 10)
    first = np.searchsorted(begin, borders)
    bounds = list(zip(first[:-1], first[1:]))
    if len(word) >= words:
        grams = np.zeros(len(word) - words + 1, dtype=np.uint64)
        for k in range(words):
            grams = _mix(grams + word[k : len(word) - words + 1 + k] + _U(k + 1))
    else:
        grams = np.zeros(0, dtype=np.uint64)
    sets = [np.unique(grams[a : max(a, b - words + 1)]) for a, b in bounds]
    # hash of the sequence: each word is mixed with its position in its own text
    place = np.arange(max((b - a for a, b in bounds), default=0), dtype=np.uint64) * _U(_BASE)
    keys = [int(_mix(word[a:b] + place[: b - a]).sum(dtype=np.uint64)) for a, b in bounds]
    return sets, keys


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of sets of 64-bit hashes, one row of `slots`
    64-bit values each: the step in the top byte and the random rank below it.
    Equal values in a slot estimate the similarity of two sets without bias."""
    empty = np.iinfo(np.uint64).max
    out = np.full(len(sets) * slots, empty, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return out.reshape(len(sets), slots)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    swaps: list[np.ndarray] = []
    for j in range(slots):
        random = _mix(element + _U((j + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        rank = random >> _U(12)
        # Fisher-Yates step j of each element's permutation, traced lazily
        chosen = (j + ((random & _U(0xFFFFFFFF)) * _U(slots - j) >> _U(32)).astype(np.int64)).astype(np.int16)
        swaps.append(chosen)
        place = chosen
        for t in range(j - 1, -1, -1):
            place = np.where(place == swaps[t], np.int16(t), place)
        at = owner * slots + place
        fresh = np.flatnonzero(out[at] > _U(j) << _U(56))  # earlier steps win over this one
        at = at[fresh]
        np.minimum.at(out, at, (_U(j) << _U(56)) | rank[fresh])
        # early stop: a text whose slots are all taken cannot change any more
        open_ = (out.reshape(len(sets), slots) == empty).any(axis=1)
        if not open_.any():
            break
        alive = open_[owner]
        if not alive.all():
            element, owner = element[alive], owner[alive]
            swaps = [s[alive] for s in swaps]
            if not len(element):
                break
    return out.reshape(len(sets), slots)


SIGNATURE_SCHEMA = "tbl string, row_id long, text_key long, n int, bands array<int>, sketch binary"
_SIGNATURE = pa.schema([("tbl", pa.string()), ("row_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int32()), ("bands", pa.list_(pa.int32())), ("sketch", pa.binary())])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    for batch in slices(batches, 2000):
        tbls, ids, texts = (c.to_pylist() for c in batch.columns)
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= CHUNK_CHARS or i == len(texts) - 1:
                yield tbls[start : i + 1], ids[start : i + 1], [t or "" for t in texts[start : i + 1]]
                start, size = i + 1, 0


def signatures(documents: DataFrame, words: int, least: int) -> DataFrame:
    """Signature bands and sketch of each text of `documents` (tbl, row_id,
    text) with at least `least` distinct shingles of `words` words.  Null and
    short texts give no row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tbls, ids, texts in _chunks(batches):
            sets, keys = shingles(texts, words)
            keep = [i for i, s in enumerate(sets) if len(s) >= least]
            if not keep:
                continue
            signature = superminhash([sets[i] for i in keep])
            bands = np.zeros((len(keep), BANDS), dtype=np.uint64)
            for r in range(ROWS):
                bands = _mix(bands + signature[:, r::ROWS] + _U(r))
            sketch = (_mix(signature[:, :SKETCH]) & _U(0xFF)).astype(np.uint8)
            flat = pa.array((bands >> _U(32)).astype(np.uint32).view(np.int32).ravel(), pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array([tbls[i] for i in keep], pa.string()), pa.array([ids[i] for i in keep], pa.int64()),
                pa.array(np.array([keys[i] for i in keep], dtype=np.uint64).view(np.int64), pa.int64()), pa.array([len(sets[i]) for i in keep], pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat), pa.array([row.tobytes() for row in sketch], pa.binary()),
            ], schema=_SIGNATURE)

    return documents.select("tbl", F.col("row_id").cast("long"), "text").mapInArrow(compute, SIGNATURE_SCHEMA)


def shared_buckets(firsts: DataFrame) -> DataFrame:
    """(bucket, tbl, row_id, held, lead) of `firsts` (tbl, row_id, bands): the
    buckets of two and more rows, with their number of rows and smallest id."""
    bucket = F.xxhash64("tbl", "band", "value")
    exploded = firsts.select("tbl", "row_id", F.posexplode("bands").alias("band", "value")).select(bucket.alias("bucket"), "tbl", "row_id")
    counted = exploded.groupBy("bucket").agg(F.count("*").alias("held"), F.min("row_id").alias("lead")).where("held > 1")
    return staged(exploded.join(counted, "bucket"), "buckets")


def bucket_pairs(shared: DataFrame) -> DataFrame:
    """Distinct pairs (tbl, id_a, id_b) of rows that share a bucket.  A bucket of
    more than `SALTED` rows is joined in parts: each row of one side is in one
    part, the other side in all."""
    parts = F.ceil(F.col("held") / SALTED).cast("int")
    a = shared.select("bucket", "tbl", F.col("row_id").alias("id_a"), F.pmod(F.xxhash64("row_id"), parts).cast("int").alias("part"))
    b = shared.select("bucket", "tbl", F.col("row_id").alias("id_b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return a.join(b, ["bucket", "tbl", "part"]).where("id_a < id_b").select("tbl", "id_a", "id_b").distinct()


def _agreeing(least: float):
    floor = least - DEVIATIONS * (least * (1 - least) / SKETCH) ** 0.5

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
            b = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
            yield batch.select([0, 1, 2]).filter(pa.array((a == b).mean(axis=1) >= floor))

    return keep


def _text_sets(documents: DataFrame, words: int) -> DataFrame:
    """(tbl, row_id, shingles): the distinct shingles as 32-bit hashes in bytes."""
    schema = pa.schema([("tbl", pa.string()), ("row_id", pa.int64()), ("shingles", pa.binary())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tbls, ids, texts in _chunks(batches):
            sets, _ = shingles(texts, words)
            data = [np.unique((s >> _U(32)).astype(np.uint32)).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(tbls, pa.string()), pa.array(ids, pa.int64()), pa.array(data, pa.binary())], schema=schema)

    return documents.select("tbl", F.col("row_id").cast("long"), "text").mapInArrow(compute, "tbl string, row_id long, shingles binary")


def _exact(least: float):
    schema = pa.schema([("tbl", pa.string()), ("id_a", pa.int64()), ("id_b", pa.int64()), ("similarity", pa.float64())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep, found = [], []
            for i, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                a, b = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
                both = len(np.intersect1d(a, b, assume_unique=True))
                similarity = both / (len(a) + len(b) - both)
                if similarity >= least:
                    keep.append(i)
                    found.append(similarity)
            kept = batch.select([0, 1, 2]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.float64())], schema=schema)

    return compute


def verified_pairs(candidates: DataFrame, sketches: DataFrame, documents: DataFrame, words: int, least: float) -> DataFrame:
    """(tbl, id_a, id_b, similarity) of the candidate pairs whose exact
    similarity is at least `least`."""
    a = sketches.select("tbl", F.col("row_id").alias("id_a"), F.col("sketch").alias("sketch_a"))
    b = sketches.select("tbl", F.col("row_id").alias("id_b"), F.col("sketch").alias("sketch_b"))
    likely = staged(
        candidates.join(a, ["tbl", "id_a"]).join(b, ["tbl", "id_b"]).select("tbl", "id_a", "id_b", "sketch_a", "sketch_b")
        .mapInArrow(_agreeing(least), "tbl string, id_a long, id_b long"), "likely-pairs"
    )
    ids = staged(likely.select("tbl", F.col("id_a").alias("row_id")).union(likely.select("tbl", F.col("id_b").alias("row_id"))).distinct(), "ids")
    if staged_bytes(ids) <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    sets = staged(_text_sets(documents.select("tbl", "row_id", "text").join(ids, ["tbl", "row_id"], "left_semi"), words), "shingles")
    return (
        likely.join(sets.select("tbl", F.col("row_id").alias("id_a"), F.col("shingles").alias("set_a")), ["tbl", "id_a"])
        .join(sets.select("tbl", F.col("row_id").alias("id_b"), F.col("shingles").alias("set_b")), ["tbl", "id_b"])
        .select("tbl", "id_a", "id_b", "set_a", "set_b")
        .mapInArrow(_exact(least), "tbl string, id_a long, id_b long, similarity double")
    )


def equal_texts(documents: DataFrame, words: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Members (tbl, row_id, first) - each text with at least `least` shingles
    and the smallest id among the texts with the same words - and the signatures
    of these first texts."""
    signed = staged(signatures(documents, words, least), "signatures")
    firsts_of = signed.groupBy("tbl", "text_key").agg(F.min("row_id").alias("first"))
    members = staged(signed.select("tbl", "text_key", "row_id").distinct().join(firsts_of, ["tbl", "text_key"]).select("tbl", "row_id", "first"), "members")
    firsts = members.where("row_id = first").select("tbl", "row_id")
    return members, signed.dropDuplicates(["tbl", "row_id"]).join(firsts, ["tbl", "row_id"], "left_semi")


def similar_texts(documents: DataFrame, words: int = 5, similarity: float = 0.8, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate structure of `documents` (tbl, row_id, text), within each
    table: members as of `equal_texts`, and all verified pairs (tbl, id_a, id_b,
    similarity) between such first texts.

    Repeated rows with the same id count once.  Texts without enough shingles
    and nulls are in neither."""
    members, chosen = equal_texts(documents, words, least)
    candidates = bucket_pairs(shared_buckets(chosen.select("tbl", "row_id", "bands")))
    return members, verified_pairs(candidates, chosen.select("tbl", "row_id", "sketch"), documents, words, similarity)


def linking_pairs(documents: DataFrame, words: int = 5, similarity: float = 0.8, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """As `similar_texts`, but with as many verified pairs as the classes need:
    their number grows with the rows, not with the square of a group of copies."""
    members, chosen = equal_texts(documents, words, least)
    chosen = staged(chosen.select("tbl", "row_id", "bands", "sketch"), "chosen")
    sketches = chosen.select("tbl", "row_id", "sketch")
    shared = shared_buckets(chosen.select("tbl", "row_id", "bands"))
    star = shared.where("row_id != lead").select("tbl", F.col("lead").alias("id_a"), F.col("row_id").alias("id_b")).distinct()
    verified = staged(verified_pairs(star, sketches, documents, words, similarity), "star-pairs")
    labels = class_labels(verified.select("tbl", "id_a", "id_b"))
    placed = staged(
        shared.select("bucket", "tbl", "row_id").join(labels, ["tbl", "row_id"], "left").select("bucket", "tbl", "row_id", F.coalesce("label", "row_id").alias("label")), "placed"
    )
    rest = verified_pairs(_across(placed), sketches, documents, words, similarity)
    return members, staged(verified.unionByName(rest), "linking-pairs")


def _across(placed: DataFrame) -> DataFrame:
    """Distinct pairs of rows that share a bucket and lie in different classes, of
    `placed` (bucket, tbl, row_id, label).  Classes of a bucket are paired first,
    so that rows of one class never meet."""
    several = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("bucket")
    open_ = staged(placed.join(several, "bucket", "left_semi"), "open-buckets")
    classes = open_.select("bucket", "label").distinct()
    a = classes.select("bucket", F.col("label").alias("label_a"))
    b = classes.select("bucket", F.col("label").alias("label_b"))
    pairs = a.join(b, "bucket").where("label_a < label_b")
    rows_a = open_.select("bucket", "tbl", F.col("row_id").alias("a"), F.col("label").alias("label_a"))
    rows_b = open_.select("bucket", F.col("row_id").alias("b"), F.col("label").alias("label_b"))
    met = pairs.join(rows_a, ["bucket", "label_a"]).join(rows_b, ["bucket", "label_b"])
    return met.select("tbl", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def all_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tbl, id_a, id_b), id_a < id_b: verified pairs and equal texts spread over
    the members of their groups."""
    a = members.select("tbl", F.col("first").alias("id_a"), F.col("row_id").alias("a"))
    b = members.select("tbl", F.col("first").alias("id_b"), F.col("row_id").alias("b"))
    between = pairs.select("tbl", "id_a", "id_b").join(a, ["tbl", "id_a"]).join(b, ["tbl", "id_b"]).select("tbl", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
    groups = members.where("row_id != first").select("tbl", "first").distinct()
    several = members.join(groups, ["tbl", "first"], "left_semi")
    equal = several.select("tbl", "first", F.col("row_id").alias("id_a")).join(several.select("tbl", "first", F.col("row_id").alias("id_b")), ["tbl", "first"]).where("id_a < id_b").select("tbl", "id_a", "id_b")
    return between.unionByName(equal)


def class_labels(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(tbl, row_id, label): the smallest id that `pairs` (tbl, id_a, id_b) lead
    to, for each id in them.

    Union-find over label columns: in each round every node takes the smallest
    label among itself and its neighbours, and the label's own label (pointer
    jumping), until nothing changes; lineage is cut by staging each round.
    """
    edges = pairs.select("tbl", F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    edges = staged(edges.unionByName(edges.select("tbl", F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    labels = staged(edges.select("tbl", "u").distinct().withColumn("label", F.col("u")), "labels")
    for _ in range(most_rounds):
        near = edges.join(labels.select("tbl", F.col("u").alias("v"), "label"), ["tbl", "v"]).groupBy("tbl", "u").agg(F.min("label").alias("near"))
        hooked = labels.join(near, ["tbl", "u"]).select("tbl", "u", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        target = labels.select("tbl", F.col("u").alias("label"), F.col("label").alias("jump"))
        before = labels
        moved = staged(hooked.join(target, ["tbl", "label"], "left").select("tbl", "u", "old", F.coalesce(F.least("label", "jump"), "label").alias("label")), "labels")
        labels = moved.select("tbl", "u", "label")
        unstage(before)
        if moved.where("old != label").isEmpty():
            return labels.withColumnRenamed("u", "row_id")
    raise RuntimeError(f"classes did not settle in {most_rounds} rounds")


def group_classes(members: DataFrame, pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(tbl, row_id, class_id, links): the class of each member - the smallest id
    that verified pairs lead to - and the number of the given pairs and of equal
    texts of its group's first text."""
    pairs = staged(pairs.select("tbl", "id_a", "id_b"), "pairs")
    labels = class_labels(pairs, most_rounds)
    ends = pairs.select("tbl", F.col("id_a").alias("row_id")).unionByName(pairs.select("tbl", F.col("id_b").alias("row_id")))
    degree = ends.groupBy("tbl", "row_id").agg(F.count("*").alias("links"))
    copies = members.groupBy("tbl", "first").agg((F.count("*") - 1).alias("copies"))
    known = labels.join(degree, ["tbl", "row_id"]).select("tbl", F.col("row_id").alias("first"), "label", "links")
    return (
        members.join(copies, ["tbl", "first"]).join(known, ["tbl", "first"], "left")
        .select("tbl", "row_id", F.coalesce("label", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies")).alias("links"))
    )


def all_classes(documents: DataFrame, words: int = 5, similarity: float = 0.8, least: int = 1) -> DataFrame:
    """(tbl, row_id, class_id, links) as of `group_classes`, by the pairs of
    `linking_pairs`, with one row for each id of `documents` (tbl, row_id, text).  Texts with fewer than `least`
    shingles are in a class with the texts equal to them, character by
    character; null texts are equal to the empty one.  Rows without id give
    none."""
    members, pairs = linking_pairs(documents, words, similarity, least)
    texts = documents.where("row_id is not null").select("tbl", F.col("row_id").cast("long"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    short = staged(texts.join(members.select("tbl", "row_id"), ["tbl", "row_id"], "left_anti").distinct(), "short-texts")
    equal = short.groupBy("tbl", "key").agg(F.min("row_id").alias("class_id"), (F.count("*") - 1).alias("links"))
    return group_classes(members, pairs).unionByName(short.join(equal, ["tbl", "key"]).select("tbl", "row_id", "class_id", "links"))


#: Parameters that TESTDATA.md fixes for this problem.
WORDS, SIMILARITY, LEAST = 3, 0.5, 60


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "indexed_pages").select(F.lit("indexed_pages").alias("tbl"), F.col("id").alias("row_id"), F.col("content").alias("text"))
    versions = table(spark, sf_dir, "page_versions").select(F.lit("page_versions").alias("tbl"), F.col("id").alias("row_id"), F.col("text_content").alias("text"))
    return pages.unionByName(versions)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, pairs = similar_texts(_texts(spark, sf_dir), WORDS, SIMILARITY, LEAST)
    return all_pairs(members, pairs)


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_classes(_texts(spark, sf_dir), WORDS, SIMILARITY, LEAST)


def p7_document_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of the corpus documents, with five words and a similarity of 0.8."""
    documents = table(spark, sf_dir, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_id"), "text")
    return all_classes(documents)


QUERIES = {"p7_found": p7_found, "p7_classes": p7_classes, "p7_document_classes": p7_document_classes}
SQL: dict[str, str] = {}
