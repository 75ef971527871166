"""The engine as one object: crawl, resume, search, changes, schedules, export.

Everything is kept in a `Warehouse`; methods that report return DataFrames.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions.text import content_hash, word_count
from .functions.urls import default_scheme, get_domain, normalize_url
from .operators import catalog, changes, classify, frontier, schedules, search
from .plans import crawl as crawling
from .plans.numbering import numbered
from .plans.staging import staged
from .sources import html, robots, sitemap, storage
from .sources.warehouse import Warehouse

TABLES = {
    "sessions": schemas.SESSION,
    "urls": schemas.URL_RECORD,
    "content": "session_id long, url string, crawled_at timestamp, title string, description string, text string, links_count int, depth int, html string",
    "postings": search.INDEX,
    "lengths": search.LENGTHS,
    "pages": "id long, url string, title string, content string, description string, domain string, session_id long, word_count long, crawled_at timestamp",
    "versions": "id long, url string, content_hash string, text_content string, title string, word_count long, captured_at timestamp",
    "changes": "id long, url string, old_version_id long, new_version_id long, change_type string, change_percent double, added_lines int, removed_lines int, diff_summary string, detected_at timestamp",
    "monitored": schemas.MONITORED,
    "schedules": schemas.SCHEDULE,
    "runs": schemas.SCHEDULE_RUN,
}


class Engine:
    """One instance over a folder.  `now` is a timestamp Column, by default the
    clock; tests pass a literal."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.store = Warehouse(spark, folder, TABLES)

    # --- helpers
    def _next_id(self, table: str) -> int:
        return (self.store.read(table).agg(F.max("id").alias("m")).first().m or 0) + 1

    def _numbered(self, table: str, rows: DataFrame, order: list[str]) -> DataFrame:
        """`rows` with ids after the table's last, in the given order."""
        ranked = numbered(rows.withColumn("_all", F.lit(0)), "_all", order, "_rank")
        return ranked.withColumn("id", F.col("_rank") + F.lit(self._next_id(table) - 1).cast("long")).drop("_all", "_rank")

    # --- crawling
    def crawl(self, seed: str, pages: DataFrame, robots_files: DataFrame | None = None, max_pages: int = 100, max_depth: int = 10, save_html: bool = False, agent: str = "*", now=None,
              sitemaps: DataFrame | None = None) -> int:
        """Crawls from a seed over the closed set `pages` (url, html) and returns
        the session's number.  The session is `completed` when nothing is left to
        fetch, else `interrupted`, with the rest pending.

        `sitemaps` (sitemap_url, content) are the sitemaps that can be fetched.
        Those of the seed's host - declared in its robots file, or in a well-known
        place - are expanded, and their first addresses are crawled from besides
        the seed, at depth 1 and before links."""
        now = F.current_timestamp() if now is None else now
        start = self.spark.createDataFrame([(seed,)], "url string").select(default_scheme("url").alias("url"))
        session = self._next_id("sessions")
        self.store.replace("sessions", catalog.start_session(self.store.read("sessions"), session, start.first().url, now))
        if sitemaps is not None:
            start = self._with_sitemaps(start, robots_files, sitemaps)
        self._run(session, start, pages, robots_files, max_pages, max_depth, save_html, agent, now)
        return session

    def _with_sitemaps(self, start: DataFrame, robots_files: DataFrame | None, files: DataFrame) -> DataFrame:
        """Seeds of a crawl with those of the host's sitemaps."""
        hosts = start.select(get_domain("url").alias("domain"))
        if robots_files is None:
            declared = self.spark.createDataFrame([], "domain string, sitemap string")
        else:
            declared = robots.sitemaps(robots_files).select("domain", "sitemap")
        named = sitemap.discover(hosts, declared, files)
        found = sitemap.seeds(sitemap.expand_sitemaps(files, named.select("sitemap_url")))
        own = start.select("url", F.lit(frontier.HIGHEST).alias("priority"), F.lit(0).alias("depth"))
        more = found.join(hosts, get_domain("url") == F.col("domain"), "left_semi").select("url", F.lit(frontier.HIGH).alias("priority"), "depth")
        return staged(own.unionByName(more), "seeds")

    def resume(self, session_id: int, pages: DataFrame, robots_files: DataFrame | None = None, max_pages: int = 100, max_depth: int = 10, save_html: bool = False, agent: str = "*", now=None) -> bool:
        """Goes on with a session that has pending records, each at the depth it
        was found at; False if it has none."""
        now = F.current_timestamp() if now is None else now
        pending = staged(self.store.read("urls").where((F.col("session_id") == session_id) & (F.col("status") == "pending")).select("url", "depth", "parent_url"), "resume")
        if pending.isEmpty():
            return False
        self.store.replace("urls", catalog.delete_where(self.store.read("urls"), (F.col("session_id") == session_id) & (F.col("status") == "pending")))
        self._run(session_id, pending, pages, robots_files, max_pages, max_depth, save_html, agent, now)
        return True

    def _run(self, session, seeds, pages, robots_files, max_pages, max_depth, save_html, agent, now) -> None:
        known = self.store.read("urls").where(F.col("session_id") == session).select("url")
        parsed = staged(html.parse_pages(pages), "parsed")
        follow = parsed.select(F.col("url").alias("src"), F.explode(html.crawlable_links(F.col("links"), F.col("metadata.robots"))).alias("dst"))
        follow = follow.withColumn("dst", normalize_url("dst")).join(known.select(F.col("url").alias("dst")), "dst", "left_anti")
        allowed = None
        if robots_files is not None:
            everything = follow.select(F.col("dst").alias("url")).unionByName(seeds.select("url")).distinct()
            allowed = robots.can_fetch(everything, robots_files, agent).select("url", "allowed")
        result = crawling.crawl(seeds, follow, parsed.select("url"), allowed, max_pages, max_depth)
        found = result.urls.unionByName(result.pending.withColumn("outcome", F.lit("pending")))
        records = found.select(
            F.lit(session).cast("long").alias("session_id"), "url", F.when(F.col("outcome") == "skipped", "failed").otherwise(F.col("outcome")).alias("status"),
            F.when(F.col("outcome") == "completed", 200).when(F.col("outcome") == "failed", 404).cast("int").alias("http_status"), F.lit(None).cast("string").alias("content_type"), "depth", "parent_url",
            F.when(F.col("outcome") != "pending", now.cast("timestamp")).alias("crawled_at"), F.when(F.col("outcome") == "skipped", "robots").alias("error"),
        )
        self.store.append("urls", self._numbered("urls", records, ["depth", "url"]))
        done = result.urls.where("outcome = 'completed'").select("url", "depth")
        texts = storage.content_records(parsed, pages if save_html else None).withColumn("url", normalize_url("url")).dropDuplicates(["url"])
        content = texts.join(done, "url").withColumns({"session_id": F.lit(session).cast("long"), "crawled_at": now.cast("timestamp")})
        self.store.append("content", content if save_html else content.withColumn("html", F.lit(None).cast("string")))
        status = "completed" if result.pending.isEmpty() else "interrupted"
        counts = catalog.crawl_totals(catalog.outcome(self.store.read("urls").where(F.col("session_id") == session))).first()
        ended = catalog.close_session(self.store.read("sessions"), session, status, now)
        self.store.replace("sessions", catalog.update_where(ended, F.col("id") == session, pages_crawled=counts.crawled if counts else 0, pages_failed=counts.failed if counts else 0))

    def stats(self) -> DataFrame:
        """Status counts of each session."""
        return catalog.status_counts(self.store.read("urls"))

    def history(self, limit: int = 20) -> DataFrame:
        return catalog.history(self.store.read("sessions"), limit)

    def session_data(self, session_id: int, limit: int = 50) -> DataFrame:
        return storage.preview(self.store.read("content").where(F.col("session_id") == session_id), limit)

    def export(self, path: str, kind: str = "json", session_id: int | None = None) -> None:
        """Content of a session, by default the latest: `json` as JSON lines,
        written in parallel, `array` as one JSON array, `csv` as CSV."""
        content = self.store.read("content")
        content = storage.latest_session(content) if session_id is None else content.where(F.col("session_id") == session_id)
        {"csv": storage.export_csv, "array": storage.export_json_array}.get(kind, storage.export_json)(content.drop("session_id"), path)

    # --- search
    def index_session(self, session_id: int) -> int:
        """Puts a session's content into the search store; returns the pages."""
        return self._index(self.store.read("content").where(F.col("session_id") == session_id))

    def index_all(self) -> int:
        return self._index(self.store.read("content"))

    def _index(self, content: DataFrame) -> int:
        latest = catalog.latest_per(content, "url", "crawled_at")
        rows = staged(latest.select("url", "title", F.col("text").alias("content"), "description", get_domain("url").alias("domain"), "session_id", "crawled_at"), "to-index")
        old = self.store.read("pages")
        merged = search.upsert(old.drop("id"), rows)
        ids = merged.join(old.select("url", "id"), "url", "left")
        fresh = self._numbered("pages", ids.where("id is null").drop("id"), ["url"])
        self.store.replace("pages", ids.where("id is not null").unionByName(fresh))
        self._rebuild()
        return rows.count()

    def _rebuild(self) -> None:
        """Writes the index of the search store anew; searches read only it and the
        rows they show."""
        pages = self.store.read("pages")
        self.store.replace("postings", search.postings(pages).withColumn("lead", search.lead_of(F.col("term"))), partition_by="lead")
        self.store.replace("lengths", search.doc_lengths(pages))

    def delete_session(self, session_id: int) -> None:
        self.store.replace("pages", search.delete_session(self.store.read("pages"), session_id))
        self._rebuild()

    def search(self, text: str, page: int = 1, per_page: int = 20, session_id: int | None = None, domain: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(page of results, total)."""
        pages = self.store.read("pages")
        return search.search(pages, self.store.read("postings"), self.store.read("lengths"), text, page, per_page, session_id, domain)

    def search_page(self, text: str, page: int = 1, per_page: int = 20, session_id: int | None = None, domain: str | None = None) -> dict:
        """One page of results as a response: rows, total, page, pages and the
        milliseconds it took.  At most `MOST_PER_PAGE` rows reach the driver."""
        began = time.perf_counter()
        found, total = self.search(text, page, per_page, session_id, domain)
        rows, count = [r.asDict() for r in found.collect()], total.first().total
        per_page = max(1, min(per_page, search.MOST_PER_PAGE))
        return {"query": text, "results": rows, "total": count, "page": max(page, 1), "pages": -(-count // per_page), "search_time_ms": (time.perf_counter() - began) * 1000}

    def search_stats(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(totals, top hosts, latest sessions)."""
        pages = self.store.read("pages")
        return catalog.corpus_totals(pages), catalog.top_domains(pages), catalog.latest_sessions(pages)

    # --- changes
    def check(self, pages: DataFrame, now=None) -> DataFrame:
        """Compares pages (url, html) with the last observation of each address,
        keeps the new versions, and returns the changes."""
        now = F.current_timestamp() if now is None else now
        texts = html.page_texts(pages)
        seen = texts.select("url", content_hash(F.col("text")).alias("content_hash"), F.col("text").alias("text_content"), "title", word_count(F.col("text")).alias("word_count"), now.cast("timestamp").alias("captured_at"))
        numbered = staged(self._numbered("versions", seen, ["url"]), "captures")
        before = self.store.read("versions")
        last = catalog.latest_per(before, "url", "id").join(numbered.select("url"), "url", "left_semi")
        log = changes.change_log(last.unionByName(numbered)).join(numbered.select(F.col("id").alias("new_version_id")), "new_version_id", "left_semi")
        known = last.select(F.col("url"), F.col("content_hash")).withColumn("_same", F.lit(True))
        fresh = numbered.join(known, ["url", "content_hash"], "left").where("_same is null").drop("_same")
        rows = log.select("url", "old_version_id", "new_version_id", "change_type", "change_percent", "added_lines", "removed_lines", F.col("summary").alias("diff_summary"), now.cast("timestamp").alias("detected_at"))
        rows = staged(self._numbered("changes", rows, ["new_version_id"]), "changes")
        self.store.append("versions", fresh)
        self.store.append("changes", rows)
        touched = self.store.read("monitored").join(numbered.select("url").withColumn("_now", now.cast("timestamp")), "url", "left")
        self.store.replace("monitored", touched.withColumn("last_checked", F.coalesce("_now", "last_checked")))
        return rows

    def recent_changes(self, limit: int = 50) -> DataFrame:
        return changes.recent(self.store.read("changes"), self.store.read("versions"), limit)

    def url_history(self, url: str, limit: int = 20) -> DataFrame:
        return self.store.read("changes").where(F.col("url") == url).orderBy(F.desc("id")).limit(limit)

    def version(self, version_id: int) -> DataFrame:
        return changes.version_view(self.store.read("versions"), version_id)

    def diff(self, old_id: int, new_id: int) -> DataFrame:
        return changes.version_pair(self.store.read("versions"), old_id, new_id)

    def tracked(self) -> DataFrame:
        return self.store.read("versions").select("url").distinct().orderBy("url")

    def monitor(self, url: str, name: str = "", hours: int = 24, now=None) -> None:
        self.store.replace("monitored", changes.monitor(self.store.read("monitored"), url, name, hours, F.current_timestamp() if now is None else now))

    def unmonitor(self, url: str) -> None:
        self.store.replace("monitored", catalog.delete_where(self.store.read("monitored"), F.col("url") == url))

    def due_checks(self, now=None) -> DataFrame:
        return changes.due(self.store.read("monitored"), F.current_timestamp() if now is None else now)

    # --- classification
    def classify(self, text: str, title: str | None = None) -> DataFrame:
        return classify.classify(self.spark.createDataFrame([(title, text)], "title string, text string"))

    def classify_session(self, session_id: int, limit: int = 20) -> tuple[DataFrame, DataFrame]:
        """(classes of a session's first pages, distribution)."""
        found = classify.classify_session(self.store.read("content").where(F.col("session_id") == session_id), limit)
        return found, classify.distribution(found)

    # --- schedules
    def create_schedule(self, name: str, url: str, kind: str, cron: str | None = None, hours: float | None = None, run_at: str | None = None, max_pages: int = 100, max_depth: int = 10, now=None) -> int:
        """Adds a schedule of kind cron, interval or once; invalid ones raise."""
        if kind not in ("cron", "interval", "once"):
            raise ValueError(f"unknown kind of schedule: {kind}")
        if kind == "cron" and schedules.cron_values(cron or "") is None:
            raise ValueError(f"no crontab expression: {cron}")
        if kind == "interval" and not (hours and hours > 0):
            raise ValueError("an interval needs hours")
        number = self._next_id("schedules")
        now = F.current_timestamp() if now is None else now
        row = self.spark.range(1).select(
            F.lit(number).cast("long").alias("id"), F.lit(name).alias("name"), F.lit(url).alias("url"), F.lit(kind).alias("schedule_type"), F.lit(cron).cast("string").alias("cron_expression"),
            (schedules.interval_seconds(F.lit(hours)) if hours else F.lit(None).cast("long")).alias("interval_seconds"), schedules.parse_run_at(F.lit(run_at).cast("string")).alias("run_at"),
            F.lit(max_pages).alias("max_pages"), F.lit(max_depth).alias("max_depth"), F.lit("active").alias("status"), now.cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("last_run"), F.lit(0).cast("long").alias("run_count"),
        )
        if kind == "once" and row.where("run_at is null").count():
            raise ValueError(f"no ISO time: {run_at}")
        self.store.append("schedules", row)
        return number

    def list_schedules(self) -> DataFrame:
        return self.store.read("schedules").orderBy(F.desc("id"))

    def set_schedule_status(self, schedule_id: int, status: str) -> None:
        """Pauses (`paused`) or resumes (`active`) a schedule."""
        self.store.replace("schedules", schedules.set_status(self.store.read("schedules"), schedule_id, status))

    def delete_schedule(self, schedule_id: int) -> None:
        self.store.replace("schedules", catalog.delete_where(self.store.read("schedules"), F.col("id") == schedule_id))
        self.store.replace("runs", catalog.delete_where(self.store.read("runs"), F.col("schedule_id") == schedule_id))

    def next_runs(self, now=None) -> DataFrame:
        return schedules.next_runs(self.store.read("schedules"), F.current_timestamp() if now is None else now)

    def schedule_runs(self, schedule_id: int, limit: int = 10) -> DataFrame:
        return self.store.read("runs").where(F.col("schedule_id") == schedule_id).orderBy(F.desc("id")).limit(limit)

    def run_schedule(self, schedule_id: int, pages: DataFrame, now=None) -> int:
        """Runs a schedule's crawl and records the run; returns the session."""
        now = F.current_timestamp() if now is None else now
        plan = self.store.read("schedules").where(F.col("id") == schedule_id).first()
        if plan is None:
            raise ValueError(f"no schedule {schedule_id}")
        session = self.crawl(plan.url, pages, max_pages=plan.max_pages, max_depth=plan.max_depth, now=now)
        ended = self.store.read("sessions").where(F.col("id") == session).first()
        run = self.spark.range(1).select(
            F.lit(self._next_id("runs")).cast("long").alias("id"), F.lit(schedule_id).cast("long").alias("schedule_id"), now.cast("timestamp").alias("started_at"), now.cast("timestamp").alias("completed_at"),
            F.lit("completed").alias("status"), F.lit(ended.pages_crawled).cast("long").alias("pages_crawled"), F.lit(ended.pages_failed).cast("long").alias("pages_failed"), F.lit(None).cast("string").alias("error"),
        )
        self.store.append("runs", run)
        self.store.replace("schedules", schedules.after_run(self.store.read("schedules"), schedule_id, now.cast("timestamp")))
        return session


def open_engine(spark: SparkSession, folder: str) -> Engine:
    """Engine over a folder; relative local paths are made absolute."""
    return Engine(spark, folder if "://" in folder else "file://" + os.path.abspath(folder))
