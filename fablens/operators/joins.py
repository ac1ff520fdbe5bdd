"""Joins of events with jobs, review status, rules and approved examples.

The table side always has one row per key, so a join never multiplies rows. `lookup_join` broadcasts it when its
size is checked to be small and salts hot keys otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fablens import constants as C
from fablens.functions.classify import equipment_class, keyword_category
from fablens.operators.skew import MAX_BROADCAST_ROWS, hot_keys, is_small, lookup_join
from fablens.session import stored

_EVENT_ID = ["job_id", "event_id"]


def with_status(events: DataFrame, statuses: DataFrame) -> DataFrame:
    """Events with the review status of their job; unreviewed ones are pending."""
    columns = statuses.select("job_id", F.col("status").alias("review_status"), "reviewer_notes", "reviewed_at")
    joined = lookup_join(events, columns, ["job_id"], "left", spread_by=["event_id"])
    return joined.withColumn("review_status", F.coalesce("review_status", F.lit("pending")))


def pending_reviews(events: DataFrame, statuses: DataFrame, sort: bool = True) -> DataFrame:
    """Events that need review and are neither approved nor rejected, newest first."""
    due = with_status(events.filter("requires_review"), statuses).filter(F.col("review_status") == "pending")
    return due.orderBy(F.desc("ts"), "event_id") if sort else due


def event_detail(events: DataFrame, routing: DataFrame, statuses: DataFrame, raw_logs: DataFrame) -> DataFrame:
    """Events with topic, review status and file name of their job."""
    topics = routing.select("job_id", "kafka_topic")
    reviews = statuses.select("job_id", F.col("status").alias("review_status"))
    files = raw_logs.select("job_id", "file_name")
    detail = events
    for table in (topics, reviews, files):
        detail = lookup_join(detail, table, ["job_id"], "left", spread_by=["event_id"])
    return detail


def failed_jobs(raw_logs: DataFrame, events: DataFrame) -> DataFrame:
    """Registered jobs without any event."""
    return raw_logs.join(events.select("job_id").distinct(), "job_id", "left_anti")


def events_with_pending_status(events: DataFrame, statuses: DataFrame) -> DataFrame:
    pending = statuses.filter(F.col("status") == "pending").select("job_id", "status")
    joined = lookup_join(events, pending, ["job_id"], "inner", spread_by=["event_id"])
    return joined.orderBy(F.desc("ts"), "event_id")


def without_resolved(items: DataFrame, resolved_jobs: DataFrame) -> DataFrame:
    """Queue items whose job is not resolved."""
    jobs = resolved_jobs.select("job_id").distinct()
    return lookup_join(items, jobs, ["job_id"], "left_anti", spread_by=["event_id"])


def filter_queue(items: DataFrame, severity: str = "all", source: str = "all") -> DataFrame:
    """Queue items of one severity and/or source; 'all' leaves a filter out."""
    if severity != "all":
        items = items.filter(F.col("severity") == severity)
    if source != "all":
        items = items.filter(F.col("source") == source)
    return items


def best_rules(rules: DataFrame) -> DataFrame:
    """Per source the rule with most approvals (the first by field name among equals) and the summed boost."""
    best = F.min_by(
        F.struct("category", "recommended_action", "min_confidence"),
        F.struct(-F.coalesce("approval_count", F.lit(0)), F.col("category")),
    )
    return rules.groupBy("source").agg(
        best.alias("_best"), F.round(F.sum(F.coalesce("confidence_boost", F.lit(0.0))), 4).alias("rule_boost")
    ).select(
        "source",
        F.col("_best.category").alias("rule_category"),
        F.col("_best.recommended_action").alias("rule_action"),
        F.coalesce(F.col("_best.min_confidence"), F.lit(0.0)).alias("rule_min_confidence"),
        "rule_boost",
    )


def with_rule(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events with the best rule of their source; `has_rule` tells whether there is one."""
    best = stored(best_rules(rules), "best-rules").withColumn("has_rule", F.lit(True))
    joined = lookup_join(events, best, ["source"], "left", spread_by=_EVENT_ID)
    return joined.withColumn("has_rule", F.coalesce("has_rule", F.lit(False)))


def with_rule_fields(records: DataFrame, rules: DataFrame, raw: str = "raw_fields") -> DataFrame:
    """Records with `rule_fields`: the values that aliases of a configuration table (field, alias) find, by field.

    Keys of the raw map are joined with the aliases, ignoring case. Of several aliases of a field that occur the first in
    order wins, among keys that differ only in case the first in record order; null values do not count.
    """
    kept = rules.filter(F.col("field").isin(list(C.FIELD_ALIASES)) & F.col("alias").isNotNull())
    per_key = kept.groupBy(F.lower("alias").alias("_key"), "field").agg(F.min("alias").alias("alias"))
    # One row per key, with at most one entry per canonical field.
    by_key = stored(per_key.groupBy("_key").agg(F.collect_list(F.struct("field", "alias")).alias("_named")), "aliases")
    own = stored(records.withColumn("_record", F.monotonically_increasing_id()), "records")
    entries = own.select("_record", F.posexplode(F.map_entries(raw)).alias("_at", "_entry")).filter(F.col("_entry.value").isNotNull())
    entries = entries.select("_record", "_at", F.lower("_entry.key").alias("_key"), F.col("_entry.value").alias("_value"))
    found = lookup_join(entries, by_key, ["_key"], "inner", spread_by=["_record"])
    found = found.select("_record", "_at", "_value", F.explode("_named").alias("_named"))
    first = found.groupBy("_record", "_named.field").agg(F.min_by("_value", F.struct("_named.alias", "_at")).alias("_value"))
    fields = first.groupBy("_record").agg(F.map_from_entries(F.collect_list(F.struct("field", "_value"))).alias("rule_fields"))
    return own.join(fields, "_record", "left").drop("_record")


def catalog_match(events: DataFrame, catalog: DataFrame, spread_by: Sequence[str] = ("event_id",)) -> DataFrame:
    """Events with category and priority of the catalog rule for (vendor, field name, field value)."""
    keys = ["vendor_id", "field_name", "field_value"]
    return lookup_join(events, catalog, keys, "inner", spread_by=spread_by)


# Rows of readings per segment of their group, and the number of segments of a group at most.
SEGMENT_ROWS = 1_000_000
MAX_SEGMENTS = 1024
_GROUP = ["vendor_id", "field_name"]


def with_segments(readings: DataFrame, segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Readings with `_segment`, and the cuts (vendor_id, field_name, _cuts) between segments of about equal depth.

    The cuts are quantiles of each group's own values, from sketches that tasks fill and Spark merges; a group has as many
    segments as its rows ask for. So readings that crowd in a narrow range are spread like any others. A value that is
    itself frequent stays in one segment; such segments are salted by the join.
    """
    steps = F.array(*[F.lit(k / MAX_SEGMENTS) for k in range(1, MAX_SEGMENTS)])
    groups = readings.groupBy(*_GROUP).agg(
        F.count("value").alias("_n"), F.percentile_approx(F.col("value").cast("double"), steps, 10 * MAX_SEGMENTS).alias("_quantiles")
    )
    stride = F.greatest(F.lit(1), F.floor(F.lit(MAX_SEGMENTS * segment_rows) / F.greatest(F.col("_n"), F.lit(1))))
    cuts = F.array_sort(F.array_distinct(F.filter("_quantiles", lambda q, i: (i + 1) % stride == 0)))
    cuts = stored(groups.select(*_GROUP, F.coalesce(cuts, F.array().cast("array<double>")).alias("_cuts")), "cuts")
    placed = lookup_join(readings, cuts, _GROUP, "inner", spread_by=["value"])
    return placed.withColumn("_segment", _segment("value")).drop("_cuts"), cuts


def _segment(value: str) -> Column:
    """Number of cuts that are not above the value."""
    return F.size(F.filter("_cuts", lambda cut: cut <= F.col(value)))


def catalog_range_match(
    readings: DataFrame, catalog: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS, segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Numeric form of the match: (vendor, field name) equal and the value inside [low, high).

    A large catalog is joined by segments of the values: each range goes to the segments it touches, so that a vendor with
    very many readings is spread, wherever they lie, and no reading meets all ranges of its vendor.
    """
    inside = (F.col("value") >= F.col("low")) & (F.col("value") < F.col("high"))
    if is_small(catalog, max_broadcast_rows):
        return readings.join(F.broadcast(catalog), _GROUP).filter(inside)
    placed, cuts = with_segments(stored(readings, "readings"), segment_rows)
    ranges = lookup_join(catalog.filter(F.col("low") < F.col("high")), cuts, _GROUP, "inner", spread_by=["low", "high"])
    ranges = ranges.withColumn("_segment", F.explode(F.sequence(_segment("low"), _segment("high")))).drop("_cuts")
    keys = [*_GROUP, "_segment"]
    hot = stored(hot_keys(placed, keys, 2 * segment_rows), "hot-segments")
    rest = [c for c in readings.columns if c not in _GROUP]
    salted = placed.join(hot, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*rest), F.col("_salts")), F.lit(0)).cast("int"))
    every = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    spread = ranges.join(hot, keys, "left").withColumn("_salt", F.explode(every)).drop("_salts")
    return salted.drop("_salts").join(spread, [*keys, "_salt"]).filter(inside).drop("_segment", "_salt")


def approved_pool(events: DataFrame, statuses: DataFrame, limit: int = C.POOL_LIMIT) -> DataFrame:
    """The first approved events, at most `limit` (the operator's own bound), with their position in the pool."""
    approved = statuses.filter(F.col("status") == "approved").select("job_id")
    kept = lookup_join(events, approved, ["job_id"], "left_semi", spread_by=["event_id"])
    first = kept.orderBy("job_id", "event_id").limit(limit).select(
        F.coalesce("ai_category", F.lit("unknown")).alias("category"), "job_id", "event_id", "message", "source",
        F.col("confidence_score").alias("confidence"),
    )
    return stored(first, "pool")


def tentative_category(rule_category: Column) -> Column:
    """Category used to look examples up: the rule's, or else the keyword category."""
    by_keyword = keyword_category(F.col("message"), F.col("event_type"), F.col("source"))
    return F.coalesce(F.nullif(rule_category, F.lit("")), by_keyword)


def with_examples(
    events: DataFrame, pool: DataFrame, category: str, limit: int = C.EXAMPLES_PER_EVENT,
) -> DataFrame:
    """Add `examples`: up to three approved examples of the category, those of the same machine first, then of
    the same equipment class, then others, each in pool order.

    The pool, bounded by `approved_pool`, is grouped into one array per category and broadcast if it is small, so that
    no event is multiplied and nothing is shuffled.
    """
    example = F.struct("job_id", "event_id", "source", "message", "confidence")
    grouped = pool.groupBy(F.col("category").alias(category)).agg(F.array_sort(F.collect_list(example)).alias("_pool"))
    grouped = F.broadcast(grouped) if is_small(pool) else grouped
    machine = F.col("source")
    kind = equipment_class(machine)
    joined = events.join(grouped, category, "left")
    tiers = F.concat(
        F.filter("_pool", lambda e: e["source"] == machine),
        F.filter("_pool", lambda e: (e["source"] != machine) & F.contains(F.upper(e["source"]), kind)),
        F.filter("_pool", lambda e: (e["source"] != machine) & ~F.contains(F.upper(e["source"]), kind)),
    )
    empty = F.filter("_pool", lambda e: F.lit(False))
    return joined.withColumn("examples", F.coalesce(F.slice(tiers, 1, limit), empty)).drop("_pool")
