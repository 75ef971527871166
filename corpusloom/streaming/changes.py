"""Change detection and crawl monitoring as structured streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "url string, old_version_id long, new_version_id long, change_type string"
STATE = "version_id long, content_hash string"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Emits the changes of one address and keeps its last observation."""
    last = tuple(state.get) if state.exists else None
    rows = pd.concat(list(batches)).sort_values("id")
    out = []
    for version, digest in zip(rows["id"], rows["content_hash"]):
        if last is None:
            out.append((key[0], 0, int(version), "added"))
        elif last[1] != digest:
            out.append((key[0], int(last[0]), int(version), "modified"))
        last = (int(version), digest)
    if last is not None:
        state.update(last)
    yield pd.DataFrame(out, columns=["url", "old_version_id", "new_version_id", "change_type"])


def detect_stream(captures: DataFrame) -> DataFrame:
    """Stream of changes of a stream of captures (id, url, content_hash), in order
    of arrival: state is one last observation for each address."""
    keyed = captures.select("id", "url", "content_hash").groupBy("url")
    return keyed.applyInPandasWithState(_advance, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)


def crawl_rate(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events and their mean value per type and window of event time; rows later
    than the watermark are dropped.  Works on streams and on tables."""
    spans = F.window("ts", window, slide) if slide else F.window("ts", window)
    counted = events.withWatermark("ts", late).groupBy(spans.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "events", "value")


def visits(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users: events without a longer pause than `gap`."""
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return counted.select("user_id", F.col("w.start").alias("visit_start"), F.col("w.end").alias("visit_end"), "events")


def first_deliveries(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Stream without repeated deliveries within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
