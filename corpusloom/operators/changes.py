"""Page versions and change detection, in batch.

Each capture is compared with the one before it of the same address, in order of
arrival.  Equal hashes end the comparison before any diff; the line diff of the
rest is the only Python, in Arrow batches.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..plans.numbering import with_previous

MOST_DIFF_LINES = 100  # fixed value: lines of a diff that are kept


def new_versions(existing: DataFrame, captures: DataFrame) -> DataFrame:
    """Captures whose (url, content_hash) is new, each once, the first by id."""
    first = F.row_number().over(Window.partitionBy("url", "content_hash").orderBy("id"))
    fresh = captures.withColumn("_row", first).where("_row = 1").drop("_row")
    return fresh.join(existing.select("url", "content_hash").distinct(), ["url", "content_hash"], "left_anti")


def line_counts(old: Column, new: Column) -> tuple[Column, Column]:
    """Lines of the two texts; an empty text has one."""
    return F.size(F.split(old, "\n", -1)), F.size(F.split(new, "\n", -1))


def diff(old: str | None, new: str | None) -> dict:
    """Unified line diff: lines added and removed, percent of the longer text's
    lines (up to 200), first lines of the diff.  Nulls count as empty."""
    a, b = (old or "").split("\n"), (new or "").split("\n")
    lines = list(difflib.unified_diff(a, b, lineterm=""))
    added = sum(x.startswith("+") and not x.startswith("+++") for x in lines)
    removed = sum(x.startswith("-") and not x.startswith("---") for x in lines)
    return {"added_lines": added, "removed_lines": removed, "change_percent": round((added + removed) / max(len(a), len(b), 1) * 100, 2), "diff_lines": lines[:MOST_DIFF_LINES]}


def html_diff(old: str | None, new: str | None) -> str:
    """Side-by-side table of the first lines of two texts."""
    a, b = (old or "").split("\n"), (new or "").split("\n")
    return difflib.HtmlDiff().make_table(a[:MOST_DIFF_LINES], b[:MOST_DIFF_LINES], fromdesc="Previous", todesc="Current")


DIFF = "added_lines int, removed_lines int, change_percent double, diff_lines array<string>"


def with_diff(pairs: DataFrame, old: str = "old_text", new: str = "new_text") -> DataFrame:
    """`pairs` with the diff of two text columns in place of them."""
    kept = pairs.drop(old, new)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [DIFF])
    types = pa.schema([("added_lines", pa.int32()), ("removed_lines", pa.int32()), ("change_percent", pa.float64()), ("diff_lines", pa.list_(pa.string()))])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n not in (old, new)]
            found = [diff(a, b) for a, b in zip(batch.column(batch.schema.get_field_index(old)).to_pylist(), batch.column(batch.schema.get_field_index(new)).to_pylist())]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            columns += [pa.array([f[t.name] for f in found], t.type) for t in types]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *types.names])

    return pairs.mapInArrow(compute, schema)


def severity(percent: Column) -> Column:
    """Band of a change: under 5 percent minor, 20 moderate, 50 significant."""
    return F.when(percent < 5, "Minor text changes").when(percent < 20, "Moderate content update").when(percent < 50, "Significant content changes").otherwise("Major page restructure")


def compared(versions: DataFrame) -> DataFrame:
    """Captures (id, url, content_hash, text_content) with the one before of the
    same address: `old_id` and `old_hash`, null for the first."""
    return with_previous(versions, "url", "id", {"old_id": "id", "old_hash": "content_hash"})


def detect(versions: DataFrame) -> DataFrame:
    """(url, old_version_id, new_version_id, change_type): first sight of an
    address is `added` with old version 0, another hash than the one before
    `modified`; captures without change give no row."""
    rows = compared(versions.select("id", "url", "content_hash"))
    changed = rows.where("old_id is null or old_hash != content_hash")
    return changed.select("url", F.coalesce("old_id", F.lit(0)).alias("old_version_id"), F.col("id").alias("new_version_id"), F.when(F.col("old_id").isNull(), "added").otherwise("modified").alias("change_type"))


def change_log(versions: DataFrame) -> DataFrame:
    """`detect` with lines added and removed, percent, severity and diff.  The
    first version counts its lines as added and 100 percent.  Texts are joined
    only to changed pairs."""
    changes = detect(versions)
    texts = versions.select(F.col("id"), F.col("text_content"))
    added = changes.where("change_type = 'added'").join(texts.withColumnRenamed("id", "new_version_id"), "new_version_id").select(
        "url", "old_version_id", "new_version_id", "change_type", F.size(F.split("text_content", "\n", -1)).alias("added_lines"), F.lit(0).alias("removed_lines"),
        F.lit(100.0).alias("change_percent"), F.array().cast("array<string>").alias("diff_lines"),
    )
    pairs = (
        changes.where("change_type = 'modified'")
        .join(texts.select(F.col("id").alias("old_version_id"), F.col("text_content").alias("old_text")), "old_version_id")
        .join(texts.select(F.col("id").alias("new_version_id"), F.col("text_content").alias("new_text")), "new_version_id")
        .select("url", "old_version_id", "new_version_id", "change_type", "old_text", "new_text")
    )
    return added.unionByName(with_diff(pairs).select(*added.columns)).withColumn("summary", F.when(F.col("change_type") == "added", "New page tracked").otherwise(severity(F.col("change_percent"))))


def version_pair(versions: DataFrame, old_id: int, new_id: int, lines: int = 50) -> DataFrame:
    """Diff of two versions by their ids, with the first lines of it; no row if
    one of them is missing."""
    old = versions.where(F.col("id") == old_id).select(F.col("id").alias("old_version_id"), F.col("text_content").alias("old_text"), F.lit(0).alias("_k"))
    new = versions.where(F.col("id") == new_id).select(F.col("id").alias("new_version_id"), F.col("text_content").alias("new_text"), F.lit(0).alias("_k"))
    found = with_diff(old.join(new, "_k").drop("_k"))
    return found.withColumns({"summary": severity(F.col("change_percent")), "diff_lines": F.slice("diff_lines", 1, lines)})


def version_view(versions: DataFrame, version_id: int, chars: int = 5000) -> DataFrame:
    """One version with the beginning of its text."""
    return versions.where(F.col("id") == version_id).withColumn("text_content", F.substring("text_content", 1, chars))


def monitor(monitored: DataFrame, url: str, name: str, hours: int, now: Column) -> DataFrame:
    """Monitored addresses with one added or replaced: it gets a new id, is active
    and has never been checked."""
    spark = monitored.sparkSession
    last = monitored.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    row = spark.range(1).select(
        (last + 1).cast("long").alias("id"), F.lit(url).alias("url"), F.lit(name).alias("name"), F.lit(hours).alias("check_interval_hours"), F.lit(None).cast("timestamp").alias("last_checked"),
        F.lit(True).alias("is_active"), now.cast("timestamp").alias("created_at"),
    )
    return monitored.where(F.col("url") != url).unionByName(row)


def recent(changes: DataFrame, versions: DataFrame, limit: int = 50) -> DataFrame:
    """Latest changes with the titles of both versions; the old one may be
    missing, a change without its new version is left out."""
    old = versions.select(F.col("id").alias("old_version_id"), F.col("title").alias("old_title"))
    new = versions.select(F.col("id").alias("new_version_id"), F.col("title").alias("new_title"), F.col("word_count").alias("new_word_count"))
    latest = F.broadcast(changes.join(new.select("new_version_id"), "new_version_id", "left_semi").orderBy(F.desc("id")).limit(limit))  # at most limit rows
    with_new = latest.join(new, "new_version_id")
    return with_new.join(old.join(F.broadcast(with_new.select("old_version_id")), "old_version_id", "left_semi"), "old_version_id", "left").orderBy(F.desc("id"))


def deleted(before: DataFrame, after: DataFrame) -> DataFrame:
    """(url, change_type): addresses of an earlier snapshot missing in a later."""
    return before.select("url").distinct().join(after.select("url"), "url", "left_anti").withColumn("change_type", F.lit("deleted"))


def due(monitored: DataFrame, now: Column) -> DataFrame:
    """Active monitored addresses never checked, or last checked an interval ago."""
    next_check = F.col("last_checked") + F.make_interval(hours=F.col("check_interval_hours"))
    return monitored.where(F.col("is_active") & (F.col("last_checked").isNull() | (next_check <= now)))


def line_class(line: Column) -> Column:
    """Class of a diff line for display."""
    return (
        F.when(line.startswith("+++") | line.startswith("---") | line.startswith("@@"), "header").when(line.startswith("+"), "add").when(line.startswith("-"), "remove").otherwise("context")
    )


__all__ = ["compared", "content_hash", "change_log", "deleted", "detect", "diff", "due", "html_diff", "line_class", "line_counts", "new_versions", "recent", "severity", "with_diff"]
