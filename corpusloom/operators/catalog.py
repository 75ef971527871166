"""Sessions, URL records, versions of upserted tables, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_counts(urls: DataFrame) -> DataFrame:
    """Per session: records, and those completed, failed and pending."""
    by = [F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "pending")]
    return urls.groupBy("session_id").agg(F.count("*").alias("total"), *by)


def fetch_succeeded(http_status: Column, error: Column) -> Column:
    """Whether a response counts as success: status 200 to 399 and no error."""
    return F.coalesce(http_status.between(200, 399), F.lit(False)) & error.isNull()


def is_html(content_type: Column) -> Column:
    """Whether a content type, in any spelling, is HTML."""
    low = F.lower(content_type)
    return F.coalesce(low.contains("text/html") | low.contains("xhtml"), F.lit(False))


def outcome(urls: DataFrame) -> DataFrame:
    """`urls` with `outcome`: pending stays, else completed exactly if the fetch
    succeeded - 4xx and 5xx are failures even without error text."""
    good = fetch_succeeded(F.col("http_status"), F.col("error"))
    return urls.withColumn("outcome", F.when(F.col("status") == "pending", "pending").when(good, "completed").otherwise("failed"))


def crawl_totals(outcomes: DataFrame) -> DataFrame:
    """Crawled, failed and skipped pages and their sum, per session."""
    counts = [F.count_if(F.col("outcome") == o).alias(a) for o, a in (("completed", "crawled"), ("failed", "failed"), ("skipped", "skipped"))]
    return outcomes.groupBy("session_id").agg(*counts).withColumn("total", F.col("crawled") + F.col("failed") + F.col("skipped"))


def domain_stats(urls: DataFrame, domain: Column) -> DataFrame:
    """Per session and host: requests, failures, last request."""
    return urls.withColumn("domain", domain).groupBy("session_id", "domain").agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") == "failed").alias("failures"), F.max("crawled_at").alias("last_request")
    )


def pending(urls: DataFrame, session_id: int, limit: int = 100) -> DataFrame:
    """Next records to fetch of a session: pending, by depth and id."""
    return urls.where((F.col("session_id") == session_id) & (F.col("status") == "pending")).orderBy("depth", "id").limit(limit)


def history(sessions: DataFrame, limit: int = 20) -> DataFrame:
    """Latest sessions first."""
    return sessions.orderBy(F.desc("id")).limit(limit)


def _whole_row(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def latest_per(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in the given order; rows whose order is null come
    last.  An aggregate, combined before the shuffle: a hot key is one row there."""
    best = F.max_by(_whole_row(df), F.struct(F.col(order).isNotNull(), F.col(order)))
    return df.groupBy(F.col(key).alias("_key")).agg(best.alias("_best")).select("_best.*")


def last_rows(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last `n` rows of each key, latest first, numbered in `position`."""
    row = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("position", row).where(F.col("position") <= n)


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` whose keys are neither in `existing` nor repeated among them."""
    return rows.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def upsert_latest(existing: DataFrame, rows: DataFrame, key: str, order: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """`existing` with `rows` put in by key: the latest row wins, but the columns
    `keep_first` stay as first written."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    place = F.struct("_new", F.col(order).isNotNull(), F.col(order))
    row = F.struct(*[F.col(f"`{c}`") for c in existing.columns])
    best = both.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, place).alias("_best"), F.min_by(row, place).alias("_first"))
    return best.select(*[F.col(f"{'_first' if c in keep_first else '_best'}.`{c}`").alias(c) for c in existing.columns])


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that a deletion leaves; a null condition deletes nothing."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def update_where(df: DataFrame, condition: Column, **values) -> DataFrame:
    """`df` with the given columns set where the condition holds."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({name: F.when(hit, F.lit(value) if not isinstance(value, Column) else value).otherwise(F.col(name)) for name, value in values.items()})


def start_session(sessions: DataFrame, session_id: int, seed_url: str, now: Column) -> DataFrame:
    """`sessions` with a new running session."""
    spark = sessions.sparkSession
    row = spark.range(1).select(
        F.lit(session_id).cast("long").alias("id"), F.lit(seed_url).alias("seed_url"), now.cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("completed_at"), F.lit("running").alias("status"), F.lit(0).cast("long").alias("pages_crawled"), F.lit(0).cast("long").alias("pages_failed"),
    )
    return sessions.unionByName(row)


def close_session(sessions: DataFrame, session_id: int, status: str, now: Column) -> DataFrame:
    """`sessions` with one ended; its status tells how it ended."""
    return update_where(sessions, F.col("id") == session_id, status=status, completed_at=now.cast("timestamp"))


def resumable(sessions: DataFrame) -> DataFrame:
    """The latest session that is still running."""
    return sessions.where("status = 'running'").orderBy(F.desc("id")).limit(1)


def top_domains(pages: DataFrame, limit: int = 10) -> DataFrame:
    """Hosts with most pages, with their words; ties by name."""
    return (
        pages.where("domain is not null and domain != ''").groupBy("domain").agg(F.count("*").alias("pages"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))
        .orderBy(F.desc("pages"), "domain").limit(limit)
    )


def latest_sessions(pages: DataFrame, limit: int = 10) -> DataFrame:
    """Pages of the sessions with the highest numbers."""
    return pages.where("session_id is not null").groupBy("session_id").agg(F.count("*").alias("pages")).orderBy(F.desc("session_id")).limit(limit)


def corpus_totals(pages: DataFrame) -> DataFrame:
    """Number of pages and words."""
    return pages.agg(F.count("*").alias("total_pages"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("total_words"))


def indexed_totals(pages: DataFrame) -> DataFrame:
    """Pages per session and, with a null session, in all."""
    return pages.where("session_id is not null").rollup("session_id").agg(F.count("*").alias("pages"))
