"""Problem 10: text that was decoded with the wrong character encoding.

1. `vocabulary` counts, per language, every word of the corpus that holds a
   character beyond ASCII: in how many documents, and in how many different
   texts, so that copies of a damaged text do not outvote its originals.  Names with a sign attached ("Anna’s") are rarely
   seen twice, so the sign with its surroundings counts as a word of its own
   (`units`).
2. `garbled_table` generates the garbled forms of all these words under every
   chain of encodings and hash-joins them with the vocabulary: what is left are
   the garbled forms that occur, each with the original it is verified by - a
   word seen much more often in the same language.
3. `repair` hash-joins the documents' words with that table.  Documents with a
   hit are restored line by line: the chain most hits of a line agree on is
   undone for the whole line if that is possible without loss, else the words
   are substituted by their verified originals.

A document is `restorable` if its wrong reading kept every character, `lossy` if
replacement signs show that some are gone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.staging import staged, staged_bytes
from .tables import slices, table

# --- fixed values: chains of (encoding written, encoding read), undone from the last to the first
READINGS = ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "iso8859_15", "iso8859_2", "cp852", "cp1251", "cp866", "koi8_r", "cp1254", "cp1257"]
CHAINS: list[tuple[tuple[str, str], ...]] = (
    [(("utf-8", reading),) for reading in READINGS]
    + [(("utf-8", a), ("utf-8", b)) for a in ("cp1252", "latin-1") for b in ("cp1252", "latin-1")]
    + [(("cp1252", reading),) for reading in ("cp437", "cp850", "mac_roman", "cp1250", "iso8859_2", "cp852", "cp1251", "latin-1")]
    + [(("mac_roman", "cp1252"),), (("cp437", "cp1252"),), (("cp850", "cp1252"),), (("mac_roman", "latin-1"),)]
    + [(("cp1251", "cp1252"),), (("cp1251", "latin-1"),), (("cp1251", "koi8_r"),), (("koi8_r", "cp1251"),), (("cp866", "cp1251"),), (("cp1251", "cp866"),)]
    + [(("koi8_r", "cp1252"),), (("koi8_r", "latin-1"),), (("cp866", "cp1252"),), (("iso8859_5", "cp1252"),), (("cp1251", "mac_roman"),)]
)
# --- end of fixed values

LOST = "�"
POOLED = "*"  # all languages together: the vocabulary for texts without a language
RATIO = 3  # times an original must be as frequent as its garbled form, if the form is no valid UTF-8
SHORT_RATIO = 10  # the same for single characters and units, and for pooled languages
BROADCAST_BYTES = 4 << 20  # written size of a table up to which it is broadcast; beyond, it is joined by shuffle
FLUSH = 100_000  # words counted before a task hands its counts on

_WORD = re.compile(r"[^\x00-/:-@\[-`{-\x7f]*[^\x00-\x7f][^\x00-/:-@\[-`{-\x7f]*")
_RUN = re.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=64)
def _tables(encoding: str) -> tuple[dict[str, int], list[str]]:
    """Characters to bytes and bytes to characters of a single-byte encoding;
    undefined bytes stand for themselves."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return {c: b for b, c in reversed(list(enumerate(chars)))}, chars


def _encode(text: str, encoding: str) -> bytes | None:
    if encoding == "utf-8":
        try:
            return text.encode()
        except UnicodeEncodeError:
            return None
    codes = _tables(encoding)[0]
    try:
        return bytes([codes[c] for c in text])
    except KeyError:
        return None


def _decode(data: bytes, encoding: str) -> str | None:
    if encoding == "utf-8":
        try:
            return data.decode()
        except UnicodeDecodeError:
            return None
    chars = _tables(encoding)[1]
    return "".join([chars[b] for b in data])


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text as a chain of wrong readings shows it; None if a step cannot
    write it."""
    for written, read in chain:
        data = _encode(text, written)
        text = None if data is None else _decode(data, read)
        if text is None:
            return None
    return text


def ungarble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The original of a garbled text; None if the chain cannot be undone."""
    for written, read in reversed(chain):
        data = _encode(text, read)
        text = None if data is None else _decode(data, written)
        if text is None:
            return None
    return text


def units(word: str) -> list[str]:
    """Runs of non-ASCII characters of a word with their surroundings: letters
    before are one mark, letters after are kept up to two, else one mark."""
    out = []
    for m in _RUN.finditer(word):
        if m.start() == 0 and m.end() == len(word):
            continue  # the word itself
        tail = word[m.end():]
        out.append(("\x01" if m.start() else "") + m.group() + (tail if len(tail) <= 2 and tail.isascii() else "\x02"))
    return out


def words_of(text: str) -> list[str]:
    """Words of a text that hold a character beyond ASCII, and their units."""
    words = _WORD.findall(text)
    return words + [u for w in words for u in units(w)]


VOCABULARY = "lang string, word string, n double, rows long"
_VOCABULARY = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.float64()), ("rows", pa.int64())])


def _repeated(documents: DataFrame) -> DataFrame:
    """(key, lang, own, everywhere): the hashes of the non-ASCII texts that occur
    more than once, how often with this language, and how often at all."""
    texts = documents.where(F.octet_length("text") > F.length("text")).select(F.xxhash64("text").alias("key"), F.coalesce("lang", F.lit("")).alias("lang"))
    own = texts.groupBy("key", "lang").agg(F.count("*").alias("own"))
    return own.withColumn("everywhere", F.sum("own").over(Window.partitionBy("key"))).where("everywhere > 1")


def vocabulary(documents: DataFrame) -> DataFrame:
    """(lang, word, n, rows) of `documents` (doc_id, lang, text): in how many
    different texts and in how many documents each non-ASCII word occurs, per
    language and pooled.  Words with replacement signs and texts that are null
    or empty do not count."""
    repeated = staged(_repeated(documents), "repeated")
    few = staged_bytes(repeated) <= BROADCAST_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[tuple[str, str], float] = {}
        rows: Counter[tuple[str, str]] = Counter()

        def flush() -> pa.RecordBatch:
            langs, words = zip(*texts) if texts else ((), ())
            out = pa.RecordBatch.from_arrays([
                pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(texts.values()), pa.float64()), pa.array([rows[k] for k in texts], pa.int64()),
            ], schema=_VOCABULARY)
            texts.clear()
            rows.clear()
            return out

        for batch in slices(batches):
            for lang, text, own, everywhere in zip(*(c.to_pylist() for c in batch.columns)):
                if not text or text.isascii():
                    continue
                words = {w for w in words_of(text) if LOST not in w}
                # all copies of a text together weigh one
                for name, weight in ((POOLED, 1 / (everywhere or 1)), (lang, 1 / (own or 1))):
                    if name:
                        keys = [(name, w) for w in words]
                        rows.update(keys)
                        for k in keys:
                            texts[k] = texts.get(k, 0.0) + weight
            if len(texts) > FLUSH:
                yield flush()
        yield flush()

    keyed = documents.select("lang", "text", F.xxhash64("text").alias("key"), F.coalesce("lang", F.lit("")).alias("label"))
    copies = repeated.withColumnRenamed("lang", "label")
    weighed = keyed.join(F.broadcast(copies) if few else copies, ["key", "label"], "left").select("lang", "text", "own", "everywhere")
    partial = weighed.mapInArrow(count, VOCABULARY)
    return partial.groupBy("lang", "word").agg(F.round(F.sum("n")).cast("long").alias("n"), F.sum("rows").alias("rows"))


def _signs_only(word: str) -> bool:
    return not any(c.isalpha() for c in word if ord(c) > 127)


GARBLED = "lang string, word string, original string, chain int, seen long, seen_rows long"
_GARBLED = pa.schema([("lang", pa.string()), ("word", pa.string()), ("original", pa.string()), ("chain", pa.int32()), ("seen", pa.int64()), ("seen_rows", pa.int64())])


def garbled_table(counted: DataFrame) -> DataFrame:
    """(lang, word, original, chain): the garbled forms that occur in the
    vocabulary `counted`, each with its most frequent original that is
    not such a form itself.

    Different texts decide.  Where the original is in as many of them as the
    form, or the form shows by itself that it is garbled UTF-8, its documents
    may decide as well."""

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            out: list[list] = [[] for _ in _GARBLED]
            for lang, word, n, rows in zip(*(c.to_pylist() for c in batch.select(["lang", "word", "n", "rows"]).columns)):
                if ("\x01" in word or "\x02" in word) and not _signs_only(word):
                    continue  # of units, only signs are originals
                done = {word}
                for k, chain in enumerate(CHAINS):
                    form = garble(word, chain)
                    if form and form not in done:
                        done.add(form)
                        for column, value in zip(out, (lang, form, word, k, n, rows)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _GARBLED.types)], schema=_GARBLED)

    forms = counted.mapInArrow(generate, GARBLED)
    occurring = forms.join(counted, ["lang", "word"])
    utf8 = F.col("chain").isin([k for k, chain in enumerate(CHAINS) if chain[0][0] == "utf-8"])
    short = (F.length("word") <= 1) | F.col("word").contains("\x01") | F.col("word").contains("\x02") | (F.col("lang") == POOLED)
    ratio = F.when(short, SHORT_RATIO).otherwise(RATIO)
    in_utf8 = (F.col("seen") * 2 >= F.col("n")) | (F.col("seen_rows") * 2 >= F.col("rows"))
    in_others = (F.col("seen") >= F.col("n") * ratio) | ((F.col("seen") >= F.col("n")) & (F.col("seen_rows") >= F.col("rows") * ratio))
    verified = staged(occurring.where(F.when(utf8, in_utf8).otherwise(in_others)).select("lang", "word", "original", "chain", "seen", "seen_rows"), "verified")
    # an original that is a garbled form itself comes after all others
    again = verified.select("lang", F.col("word").alias("original"), F.lit(True).alias("again")).distinct()
    best = F.max_by(F.struct("original", "chain"), F.struct(F.col("again").isNull(), "seen", "seen_rows", -F.col("chain"), "original"))
    return verified.join(again, ["lang", "original"], "left").groupBy("lang", "word").agg(best.alias("best")).select("lang", "word", "best.original", "best.chain")


def _repair_line(line: str, found: dict[str, tuple[str, int]]) -> str:
    """The line with its verified garbled words restored."""
    words = _WORD.findall(line)
    votes = Counter(found[x][1] for w in words for x in (w, *units(w)) if x in found)
    for chain, _ in votes.most_common():
        whole = ungarble(line, CHAINS[chain])
        if whole is not None and LOST not in whole:
            return whole
        # line with correct signs besides: undo the chain word by word
        if whole is None:
            def undo(m: re.Match) -> str:
                word = m.group()
                if word in found:
                    return found[word][0]
                if any(u in found for u in units(word)):
                    return ungarble(word, CHAINS[chain]) or word
                return word

            return _WORD.sub(undo, line)
    return line


REPAIRED = "doc_id long, status string, text string"


def repair(documents: DataFrame) -> DataFrame:
    """(doc_id, status, text) of the damaged rows of `documents` (doc_id, lang,
    text), with the text restored where that is possible.

    Texts that are null, empty or pure ASCII are never damaged.  Repeated rows
    are repaired each."""
    counted = staged(vocabulary(documents), "vocabulary")
    hits = staged(garbled_table(counted), "garbled")
    few = staged_bytes(hits) <= BROADCAST_BYTES

    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("word", pa.string())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], []]
            for doc_id, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text and not text.isascii():
                    words = set(words_of(text))
                    out[0] += [doc_id] * len(words)
                    out[1] += [lang or POOLED] * len(words)
                    out[2] += words
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    columns = documents.select(F.col("doc_id").cast("long"), "lang", "text")
    words = columns.mapInArrow(spread, "doc_id long, lang string, word string")
    found = words.join(F.broadcast(hits) if few else hits, ["lang", "word"]).select("doc_id", "word", "original", "chain").distinct()
    per_document = staged(found.groupBy("doc_id").agg(F.collect_list(F.struct("word", "original", "chain")).alias("found")), "found")  # bounded by a document's words
    broken = columns.join(per_document, "doc_id", "left").where(F.col("found").isNotNull() | F.col("text").contains(LOST)).select("doc_id", "text", "found")
    out_schema = pa.schema([("doc_id", pa.int64()), ("status", pa.string()), ("text", pa.string())])

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            statuses, texts = [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                known = {f["word"]: (f["original"], f["chain"]) for f in found or ()}
                texts.append("\n".join(line if line.isascii() else _repair_line(line, known) for line in text.split("\n")) if known else text)
                statuses.append("lossy" if LOST in text else "restorable")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(statuses, pa.string()), pa.array(texts, pa.string())], schema=out_schema)

    return broken.mapInArrow(restore, REPAIRED)


def p10_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_repaired(spark, sf_dir).select("doc_id", "status")


QUERIES = {"p10_found": p10_found, "p10_repaired": p10_repaired}
SQL: dict[str, str] = {}
