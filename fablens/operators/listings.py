"""Sorted listings. A limit here is part of the report and runs as a distributed top-k."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablens.operators.rollups import between, severity_is, since

DETAIL_COLUMNS = [
    "ts", "source", "severity", "event_type", "message",
    "ai_category", "ai_root_cause", "ai_recommended_action", "confidence_score",
]


def events_detail(
    events: DataFrame, as_of, hours: int = 24, severities: list[str] | None = None, limit: int = 100
) -> DataFrame:
    """Newest events of the trailing hours, optionally of some severities."""
    recent = since(events, as_of, hours, inclusive=False)
    if severities:
        recent = recent.filter(severity_is(severities))
    return recent.orderBy(F.desc("ts"), "event_id").limit(limit).select(*DETAIL_COLUMNS)


def machine_events(events: DataFrame, source: str, start, end) -> DataFrame:
    kept = between(events, start, end).filter(F.col("source") == source)
    return kept.orderBy(F.desc("ts"), "event_id")


def latest_alerts(alerts: DataFrame, limit: int = 50) -> DataFrame:
    return alerts.orderBy(F.desc("created_at"), "machine").limit(limit)


def category_detail(events: DataFrame, category: str, severities: list[str], as_of, hours: int = 24) -> DataFrame:
    recent = since(events, as_of, hours, inclusive=False)
    kept = recent.filter((F.col("ai_category") == category) & severity_is(severities))
    return kept.orderBy(F.desc("ts"), "event_id")


def queue_page(items: DataFrame, limit: int, offset: int) -> DataFrame:
    return items.orderBy(F.desc("ts"), "event_id").offset(offset).limit(limit)


def queue_page_after(items: DataFrame, limit: int, after: tuple | None = None) -> DataFrame:
    """The page that follows an item, given by its (ts, event_id); the first page without one.

    The bound on the bare time reaches the scan, so a page costs the same wherever it is: the top `limit` of what is left.
    """
    if after is None:
        return queue_page(items, limit, 0)
    ts, event_id = after
    bound = F.lit(str(ts)).cast(items.schema["ts"].dataType)
    rest = items.filter(F.col("ts") <= bound).filter((F.col("ts") < bound) | (F.col("event_id") > event_id))
    return queue_page(rest, limit, 0)


def items_per_day(items: DataFrame) -> DataFrame:
    """(day, n): the table by which a page is found; keep it stored and add to it as items come and go."""
    return items.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def queue_page_at(items: DataFrame, per_day: DataFrame, limit: int, offset: int) -> DataFrame:
    """The same rows as queue_page, read from the days that hold them only; `per_day` has one row per day."""
    skipped, low, high, left = 0, None, None, offset + limit
    for day, n in per_day.filter(F.col("day").isNotNull()).orderBy(F.desc("day")).select("day", "n").collect():
        if high is None and offset < skipped + n:
            high, offset, left = day, offset - skipped, offset - skipped + limit
        if high is not None:
            low, left = day, left - n
            if left <= 0:
                break
        skipped += n
    if high is None:
        return items.limit(0)
    kind = items.schema["ts"].dataType
    after_high = F.lit(str(high + dt.timedelta(days=1))).cast(kind)
    days = items.filter((F.col("ts") >= F.lit(str(low)).cast(kind)) & (F.col("ts") < after_high))
    return queue_page(days, limit, offset)


def retained(df: DataFrame, as_of, days: int, ts: str = "ts") -> DataFrame:
    """Rows inside the retention period; on a date-partitioned table the filter prunes whole folders."""
    return since(df, as_of, days * 24, ts)
