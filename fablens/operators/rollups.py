"""Counts, rollups and time series over the event table.

All of them are groupBy aggregates on native expressions: partial aggregation on the map side keeps a hot key to
one row per task, so no salting is needed. Time filters reach the Parquet scan because they compare the bare
timestamp column with a literal.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fablens.operators.skew import floor_div

SEVERITIES = ["CRITICAL", "ERROR", "WARNING", "INFO"]


def between(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Rows in the closed time range."""
    return df.filter(F.col(ts).between(_literal(df, ts, start), _literal(df, ts, end)))


def since(df: DataFrame, as_of, hours: float, ts: str = "ts", inclusive: bool = True) -> DataFrame:
    """Rows of the trailing `hours` before `as_of`. The bound is computed here, so the scan can prune on it."""
    bound = _literal(df, ts, _as_datetime(as_of) - dt.timedelta(hours=hours))
    return df.filter(F.col(ts) >= bound if inclusive else F.col(ts) > bound)


def _as_datetime(value) -> dt.datetime:
    return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value))


def _literal(df: DataFrame, ts: str, value) -> Column:
    return F.lit(_as_datetime(value).isoformat(sep=" ")).cast(df.schema[ts].dataType)


def hour_of(df: DataFrame, ts: str = "ts") -> Column:
    return F.date_trunc("hour", ts).cast(df.schema[ts].dataType)


def day_of(df: DataFrame, ts: str = "ts") -> Column:
    return F.date_trunc("day", ts).cast(df.schema[ts].dataType)


def minutes_bucket(df: DataFrame, minutes: int, ts: str = "ts") -> Column:
    """Start of the tumbling bucket of `minutes` counted from the epoch."""
    width = minutes * 60_000_000
    start = floor_div(F.unix_micros(F.col(ts).cast("timestamp")), width) * width
    return F.timestamp_micros(start).cast(df.schema[ts].dataType)


def severity_is(levels: list[str], severity: str = "severity") -> Column:
    """Severity match that ignores case."""
    return F.upper(severity).isin([level.upper() for level in levels])


def _count(name: str = "event_count") -> Column:
    return F.count(F.lit(1)).alias(name)


def _count_of(condition: Column, name: str) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long").alias(name)


def _mean(column: str, name: str) -> Column:
    return F.round(F.avg(column), 8).alias(name)


def counts_by_category_severity(events: DataFrame, start, end) -> DataFrame:
    counts = between(events, start, end).groupBy("ai_category", "severity").agg(_count("count"))
    return counts.orderBy(F.desc("count"), "ai_category", "severity")


def severity_breakdown(events: DataFrame) -> DataFrame:
    return events.groupBy(F.upper("severity").alias("severity")).agg(_count("count"))


def hourly_severity(events: DataFrame, as_of, hours: int) -> DataFrame:
    """Events per hour and severity in the trailing hours, oldest first."""
    recent = since(events, as_of, hours)
    series = recent.groupBy(hour_of(events).alias("hour"), F.upper("severity").alias("severity")).agg(_count("count"))
    return series.orderBy("hour", "severity")


def _whole_buckets(events: DataFrame, unit: str, start, end, ts: str = "ts") -> DataFrame:
    """Rows of all buckets of a unit (hour or day) that begin in [start, end], by bounds on the bare time column."""
    if start is None:
        return events
    floor = {"hour": dict(minute=0, second=0, microsecond=0), "day": dict(hour=0, minute=0, second=0, microsecond=0)}[unit]
    low, high = _as_datetime(start).replace(**floor), _as_datetime(end).replace(**floor) + dt.timedelta(**{f"{unit}s": 1})
    return events.filter((F.col(ts) >= _literal(events, ts, low)) & (F.col(ts) < _literal(events, ts, high)))


def hourly_category_rollup(events: DataFrame, start=None, end=None) -> DataFrame:
    """All buckets, or those that a read of [start, end] needs; the bounds reach the scan."""
    events = _whole_buckets(events, "hour", start, end)
    return events.groupBy(hour_of(events).alias("bucket"), "ai_category", F.upper("severity").alias("severity")).agg(_count())


def daily_machine_rollup(events: DataFrame, start=None, end=None) -> DataFrame:
    """All buckets, or those that a read of [start, end] needs; the bounds reach the scan."""
    events = _whole_buckets(events, "day", start, end)
    return events.groupBy(
        day_of(events).alias("bucket"), "source", "ai_category", F.upper("severity").alias("severity")
    ).agg(_count(), _mean("confidence_score", "avg_confidence"))


def five_minute_rollup(readings: DataFrame, minutes: int = 5) -> DataFrame:
    return readings.groupBy(
        minutes_bucket(readings, minutes, "event_time").alias("bucket"), "tool_id", "severity"
    ).agg(
        _count(),
        _mean("normalize_confidence", "avg_norm_conf"),
        _mean("temperature_k", "avg_temp_k"),
        _mean("pressure_pa", "avg_pressure_pa"),
        _mean("rf_power_w", "avg_rf_power_w"),
    )


def hourly_tool_rollup(readings: DataFrame) -> DataFrame:
    return readings.groupBy(hour_of(readings, "event_time").alias("bucket"), "tool_id", "severity").agg(
        _count(),
        _count_of(F.col("severity") == "CRITICAL", "critical_count"),
        _count_of(F.col("severity") == "ERROR", "error_count"),
        _mean("temperature_k", "avg_temp_k"),
        _mean("pressure_pa", "avg_pressure_pa"),
    )


def read_hourly(rollup: DataFrame, start, end) -> DataFrame:
    """Buckets of a rollup in a closed range, newest first."""
    return between(rollup, start, end, "bucket").orderBy(F.desc("bucket"), "ai_category", "severity")


def machine_health(rollup: DataFrame, source: str, start, end) -> DataFrame:
    kept = between(rollup, start, end, "bucket").filter(F.col("source") == source)
    return kept.orderBy(F.desc("bucket"), "ai_category", "severity")


def errors_by_machine(events: DataFrame, as_of, hours: int = 24) -> DataFrame:
    recent = since(events, as_of, hours, inclusive=False).filter(severity_is(["ERROR"]))
    return recent.groupBy("source").agg(_count("count"), _mean("confidence_score", "avg_confidence"))


def confidence_by_category(events: DataFrame, as_of, hours: int = 168) -> DataFrame:
    recent = since(events, as_of, hours, inclusive=False)
    return recent.groupBy("ai_category", F.upper("severity").alias("severity")).agg(
        _mean("confidence_score", "avg_confidence")
    )


def events_by_hour(events: DataFrame, as_of, hours: int = 24, severities: list[str] | None = None) -> DataFrame:
    """Hourly counts for charting, optionally of some severities, newest first."""
    recent = since(events, as_of, hours, inclusive=False)
    if severities:
        recent = recent.filter(severity_is(severities))
    series = recent.groupBy(hour_of(events).alias("hour"), F.upper("severity").alias("severity")).agg(_count())
    return series.orderBy(F.desc("hour"), "severity")


def chart_pivot(series: DataFrame) -> DataFrame:
    """One row per hour of a severity series: critical, errors and everything else."""
    n = F.col("count")
    level = F.col("severity")
    total = lambda condition, name: F.sum(F.when(condition, n).otherwise(0)).cast("long").alias(name)
    return series.groupBy("hour").agg(
        total(level == "CRITICAL", "critical"),
        total(level == "ERROR", "errors"),
        total(~level.isin("CRITICAL", "ERROR"), "non_urgent"),
    )


def result_series(result: DataFrame) -> DataFrame:
    """Any result as an hour x severity series; one that is aggregated already passes through."""
    names = set(result.columns)
    hour = next((c for c in ("hour", "time") if c in names), None)
    count = next((c for c in ("event_count", "count") if c in names), None)
    level = F.coalesce(F.nullif(F.col("severity"), F.lit("")), F.lit("unknown"))
    if hour and count:
        return result.select(
            F.col(hour).cast("string").alias("hour"), level.alias("severity"), F.col(count).cast("long").alias("count")
        )
    ts = next(c for c in ("timestamp", "ts") if c in names)
    text = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH"), F.lit(":00"))
    return result.groupBy(text.alias("hour"), level.alias("severity")).agg(_count("count"))


def distinct_filters(items: DataFrame) -> DataFrame:
    """Distinct severities and sources of a result, sorted, for filter boxes."""
    pairs = items.select(F.explode(F.array(
        F.struct(F.lit("severity").alias("field"), F.col("severity").alias("value")),
        F.struct(F.lit("source").alias("field"), F.col("source").alias("value")),
    )).alias("p"))
    return pairs.select("p.field", "p.value").distinct().orderBy("field", "value")


def dashboard_stats(events: DataFrame, statuses: DataFrame, raw_logs: DataFrame, as_of) -> DataFrame:
    """One row: events, events still in review, failed jobs, jobs of the day, and counts per severity.

    Each figure is an aggregate of its own; the parts are unioned and summed, which needs no cross join.
    """
    from fablens.operators.joins import failed_jobs, pending_reviews

    today = F.to_date(F.lit(str(as_of)).cast("timestamp_ntz"))
    parts = [
        pending_reviews(events, statuses, sort=False).agg(_count("n")).withColumn("figure", F.lit("events_in_review")),
        failed_jobs(raw_logs, events).agg(_count("n")).withColumn("figure", F.lit("errors")),
        raw_logs.filter(F.to_date("created_at") >= today).agg(_count("n")).withColumn("figure", F.lit("jobs_today")),
        severity_breakdown(events).select(F.col("count").alias("n"), F.col("severity").alias("figure")),
    ]
    figures = parts[0]
    for part in parts[1:]:
        figures = figures.unionByName(part)
    names = ["events_in_review", "errors", "jobs_today"]
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    value = lambda name: total(F.col("figure") == name)
    # The severity rows add up to all events, so these need no scan of their own.
    processed = total(F.col("figure").isNull() | ~F.col("figure").isin(names)).alias("events_processed")
    levels = [value(level).alias(f"n_{level.lower()}") for level in SEVERITIES]
    breakdown = F.map_from_entries(F.array_sort(F.collect_list(F.when(
        ~F.col("figure").isin(names), F.struct("figure", "n")
    )))).alias("severity_breakdown")
    return figures.agg(processed, *[value(n).alias(n) for n in names], *levels, breakdown)


def summary_panel(stats: DataFrame) -> DataFrame:
    """Bar values of the summary panel and the maximum that scales them."""
    rows = stats.select(
        "events_processed", "events_in_review",
        F.col("n_critical").alias("critical"),
        F.col("n_error").alias("errors_shown"),
        (F.col("n_warning") + F.col("n_info")).alias("non_urgent"),
        F.col("errors").alias("failures"),
    )
    return rows.withColumn(
        "max_count", F.greatest("critical", "errors_shown", "non_urgent", "failures", F.lit(1).cast("long"))
    )


def topic_counts_per_job(routed: DataFrame) -> DataFrame:
    """Events per job and topic, and those in review."""
    topic = F.col("topic")
    return routed.groupBy("job_id").agg(
        _count("events"),
        _count_of(topic == "logs.p0", "p0"),
        _count_of(topic == "logs.p1", "p1"),
        _count_of(topic == "logs.p2", "p2"),
        _count_of(topic == "logs.deadletter", "deadletter"),
        _count_of(topic.isNull(), "review"),
    )


def routing_table(routed: DataFrame) -> DataFrame:
    """One row per job and topic with the number of events sent there."""
    return routed.filter(F.col("topic").isNotNull()).groupBy("job_id", F.col("topic").alias("kafka_topic")).agg(_count())


def job_counters(routed: DataFrame, parse_errors: DataFrame) -> DataFrame:
    """Counters of a job row: total, parsed, hot, cold, review, dead letter and status."""
    from fablens.functions.routing import job_status

    topic = F.col("topic")
    good = routed.select("job_id", "topic", F.lit(False).alias("bad"))
    bad = parse_errors.select("job_id", F.lit(None).cast("string").alias("topic"), F.lit(True).alias("bad"))
    parsed = ~F.col("bad")
    counters = good.unionByName(bad).groupBy("job_id").agg(
        _count("total_events"),
        _count_of(parsed, "parsed_events"),
        _count_of(parsed & topic.isin("logs.p0", "logs.p1"), "hot_events"),
        _count_of(parsed & (topic == "logs.p2"), "cold_events"),
        _count_of(parsed & topic.isNull(), "review_events"),
        _count_of(parsed & (topic == "logs.deadletter"), "deadletter_events"),
        _count_of(F.col("bad"), "n_errors"),
    )
    return counters.withColumn("status", job_status(F.col("n_errors"), F.col("parsed_events") == 0))


def sources_with_several(events: DataFrame, at_least: int = 2) -> DataFrame:
    """Sources with at least two events and their number."""
    return events.groupBy("source").agg(_count()).filter(F.col("event_count") >= at_least)
