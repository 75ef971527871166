"""Content files, exports and table access."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CONTENT

TEXT_CHARS, HTML_CHARS = 10_000, 100_000  # fixed values: what a content record keeps of text and source
EXPORT_FIELDS = ["url", "title", "description", "crawled_at"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def deduplicated(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows delivered more than once, once: equal rows share the key."""
    return df.dropDuplicates([key])


def content_records(parsed: DataFrame, html: DataFrame | None = None) -> DataFrame:
    """Content records of parsed pages, with the page sources (url, html) if given;
    text and source are cut to the lengths a record keeps."""
    records = parsed.select(
        "url", F.col("metadata.title").alias("title"), F.col("metadata.description").alias("description"), F.substring("text_content", 1, TEXT_CHARS).alias("text"), F.size("links").alias("links_count")
    )
    if html is None:
        return records
    return records.join(html.select("url", F.substring("html", 1, HTML_CHARS).alias("html")).dropDuplicates(["url"]), "url", "left")


def write_content(pages: DataFrame, folder: str, session: str = "session_id") -> None:
    """Appends page records as JSON lines, one folder a session."""
    pages.write.mode("append").partitionBy(session).json(folder)


def read_content(spark: SparkSession, path: str) -> DataFrame:
    """Page records of JSON lines files.  Blank lines are no records; lines that
    are no JSON are left out; missing fields are null."""
    return _records(spark.read.text(path)).drop("_file")


def _records(lines: DataFrame) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", CONTENT, options).alias("r"), F.input_file_name().alias("_file"))
    return parsed.where("r is not null and r._corrupt_record is null").select("r.*", "_file").drop("_corrupt_record")


def read_all_content(spark: SparkSession, folder: str, pattern: str = "content_*.jsonl") -> DataFrame:
    """Records of all sessions' files, with the session the file name gives."""
    rows = _records(spark.read.text(os.path.join(folder, pattern)))
    return rows.withColumn("session_id", F.expr("try_cast(regexp_extract(_file, 'content_([0-9]+)\\\\.jsonl', 1) as bigint)")).drop("_file")


def latest_session(content: DataFrame) -> DataFrame:
    """Records of the session with the largest number."""
    return content.where(F.col("session_id") == content.agg(F.max("session_id")).scalar())


def projection(content: DataFrame, fields: list[str] = EXPORT_FIELDS) -> DataFrame:
    """The exported fields, in order; fields the records lack are null."""
    return content.select(*[F.col(f) if f in content.columns else F.lit(None).cast("string").alias(f) for f in fields])


def export_csv(content: DataFrame, path: str, fields: list[str] = EXPORT_FIELDS) -> None:
    """CSV with header; nulls are empty."""
    projection(content, fields).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def export_json(content: DataFrame, path: str) -> None:
    """JSON lines, text unescaped; nulls are kept as fields."""
    content.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_json_array(content: DataFrame, path: str) -> None:
    """One JSON array in one text file `part-*`: the records, one a line, commas
    between them.  The records are written by one task, in the order of the
    partitions; for exports that other tools load whole.  `export_json` writes in
    parallel."""
    lines = content.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1)
    if lines.isEmpty():
        lines.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return

    def enclose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(values: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"])

        yield rows(["["])
        last = None  # a record is written when it is known whether another follows
        for batch in batches:
            out = []
            for line in batch.column(0).to_pylist():
                if last is not None:
                    out.append(last + ",")
                last = line
            yield rows(out)
        yield rows([*([] if last is None else [last]), "]"])

    lines.mapInArrow(enclose, "value string").write.mode("overwrite").text(path)


def preview(content: DataFrame, lines: int = 50) -> DataFrame:
    """First records, by time of crawl and address, with the length of their html
    in its place."""
    order = [c for c in ("crawled_at", "url") if c in content.columns]
    return content.withColumn("html_length", F.coalesce(F.length("html"), F.lit(0))).drop("html").orderBy(*order).limit(lines)
