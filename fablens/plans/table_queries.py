"""Joins (C), rollups (E), listings (G), category registry (H), retention and table updates (I7, I9, J)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fablens.operators import categories, joins, listings, review, rollups
from fablens.plans import bindings as B
from fablens.plans.registry import query
from fablens.plans.scoring_queries import SCORED_VIEWS, keyword_case
from fablens.session import scratch_path, stored
from fablens.streaming import retention as partitions
from fablens.streaming.jobs import scored_events

ROLLUP_START, ROLLUP_END = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
_AS_OF_SQL = f"TIMESTAMP '{B.AS_OF}'"
_RANGE_SQL = f"ts BETWEEN TIMESTAMP '{ROLLUP_START}' AND TIMESTAMP '{ROLLUP_END}'"
ROLLUP_MACHINE = "tool_ETCH-01"


# ---- joins -------------------------------------------------------------------------------------------------

@query("c1_pending_reviews", B.sql(B.EVENTS_SQL, B.JOBS_SQL, select="""
SELECT event_id, ev.job_id, ts, source, severity, ai_category, confidence_score,
  coalesce(status, 'pending') AS review_status, reviewer_notes, reviewed_at
FROM ev LEFT JOIN jobs USING (job_id) WHERE requires_review AND (status IS NULL OR status = 'pending')
ORDER BY ts DESC"""))
def pending_reviews(spark, sf_dir):
    queue = joins.pending_reviews(B.events(spark, sf_dir), B.jobs(spark, sf_dir))
    return queue.select(
        "event_id", "job_id", "ts", "source", "severity", "ai_category", "confidence_score", "review_status",
        "reviewer_notes", "reviewed_at",
    )


@query("c2_event_detail", B.sql(B.EVENTS_SQL, B.JOBS_SQL, select="""
SELECT event_id, job_id, ts, source, severity, ai_category, kafka_topic, status AS review_status, file_name
FROM ev LEFT JOIN jobs USING (job_id)"""))
def event_detail(spark, sf_dir):
    jobs = B.jobs(spark, sf_dir)
    detail = joins.event_detail(B.events(spark, sf_dir), jobs, jobs, jobs)
    return detail.select(
        "event_id", "job_id", "ts", "source", "severity", "ai_category", "kafka_topic", "review_status", "file_name"
    )


@query("c3_failed_jobs", B.sql(B.EVENTS_SQL, B.JOBS_SQL, select="""
SELECT job_id, file_name, created_at FROM jobs WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.job_id = jobs.job_id)"""))
def failed_jobs(spark, sf_dir):
    jobs = B.jobs(spark, sf_dir).select("job_id", "file_name", "created_at")
    return joins.failed_jobs(jobs, B.events(spark, sf_dir))


@query("c4_events_with_pending_status", B.sql(B.EVENTS_SQL, B.JOBS_SQL, select="""
SELECT event_id, job_id, ts, source, status FROM ev JOIN jobs USING (job_id) WHERE status = 'pending' ORDER BY ts DESC"""))
def events_with_pending_status(spark, sf_dir):
    joined = joins.events_with_pending_status(B.events(spark, sf_dir), B.jobs(spark, sf_dir))
    return joined.select("event_id", "job_id", "ts", "source", "status")


@query("c5_rule_lookup", B.sql(*SCORED_VIEWS, select="""
SELECT event_id, source, has_rule, rule_category, rule_action, rule_boost FROM scored"""))
def rule_lookup(spark, sf_dir):
    ruled = joins.with_rule(B.events(spark, sf_dir), B.rules(spark, sf_dir))
    return ruled.select("event_id", "source", "has_rule", "rule_category", "rule_action", "rule_boost")


_POOL_SQL = """pool AS (
  SELECT ai_category AS category, job_id, event_id, source, message, row_number() OVER (ORDER BY job_id, event_id) AS pos
  FROM ev JOIN jobs USING (job_id) WHERE status = 'approved' ORDER BY job_id, event_id LIMIT 50)"""


@query("c7_examples", B.sql(B.EVENTS_SQL, B.JOBS_SQL, _POOL_SQL, f"""asked AS (
  SELECT event_id, source, {keyword_case("lower(message || ' ' || event_type || ' ' || source)")} AS category,
    split_part(replace(upper(source), 'TOOL_', ''), '-', 1) AS kind FROM ev)""", select="""
SELECT event_id, "rank", example_id, category FROM (
  SELECT a.event_id, a.category, p.event_id AS example_id, row_number() OVER (PARTITION BY a.event_id ORDER BY
    CASE WHEN p.source = a.source THEN 1 WHEN contains(upper(p.source), a.kind) THEN 2 ELSE 3 END, p.pos) AS "rank"
  FROM asked a JOIN pool p ON p.category = a.category)
WHERE "rank" <= 3"""))
def examples(spark, sf_dir):
    """Few-shot examples by category, ranked by machine closeness (C7, F2)."""
    events = B.events(spark, sf_dir)
    pool = joins.approved_pool(events, B.jobs(spark, sf_dir))
    asked = events.withColumn("category", joins.tentative_category(F.lit(None).cast("string")))
    found = joins.with_examples(asked, pool, "category")
    ranked = found.select("event_id", "category", F.posexplode("examples").alias("_at", "e"))
    return ranked.select("event_id", (F.col("_at") + 1).cast("long").alias("rank"), F.col("e.event_id").alias("example_id"), "category")


@query("f2_ranked_examples", B.sql(*SCORED_VIEWS, B.JOBS_SQL, _POOL_SQL, f"""asked AS (
  SELECT event_id, source, coalesce(rule_category, {keyword_case("lower(message || ' ' || event_type || ' ' || source)")})
    AS category, split_part(replace(upper(source), 'TOOL_', ''), '-', 1) AS kind FROM scored)""", select="""
SELECT source, category, string_agg(CAST(example_id AS VARCHAR), ',' ORDER BY n) AS examples FROM (
  SELECT a.source, a.category, p.event_id AS example_id, row_number() OVER (PARTITION BY a.source, a.category ORDER BY
    CASE WHEN p.source = a.source THEN 1 WHEN contains(upper(p.source), a.kind) THEN 2 ELSE 3 END, p.pos) AS n
  FROM (SELECT DISTINCT source, category, kind FROM asked) a JOIN pool p ON p.category = a.category)
WHERE n <= 3 GROUP BY source, category"""))
def ranked_examples(spark, sf_dir):
    """Tiered top three per machine and category; the category is the rule's, or else the keyword one."""
    events = B.events(spark, sf_dir)
    pool = joins.approved_pool(events, B.jobs(spark, sf_dir))
    ruled = joins.with_rule(events, B.rules(spark, sf_dir))
    asked = ruled.withColumn("category", joins.tentative_category(F.col("rule_category")))
    pairs = asked.groupBy("source", "category").agg(F.min("event_id").alias("event_id"))
    found = joins.with_examples(pairs, pool, "category").filter(F.size("examples") > 0)
    ids = F.transform("examples", lambda e: e["event_id"].cast("string"))
    return found.select("source", "category", F.concat_ws(",", ids).alias("examples"))


_CATALOG_SQL = """catalog AS (
  SELECT p_brand AS vendor_id, 'type' AS field_name, p_type AS field_value, min(p_name) AS category,
    CASE WHEN max(p_size) > 45 THEN 'P0' ELSE 'P1' END AS priority FROM part GROUP BY p_brand, p_type)"""


def _catalog(spark, sf_dir):
    return B.table(spark, sf_dir, "part").groupBy(
        F.col("p_brand").alias("vendor_id"), F.lit("type").alias("field_name"), F.col("p_type").alias("field_value")
    ).agg(
        F.min("p_name").alias("category"), F.when(F.max("p_size") > 45, "P0").otherwise("P1").alias("priority")
    )


@query("c10_catalog_match", f"""
WITH {_CATALOG_SQL}
SELECT p_partkey, vendor_id, field_value, category, priority FROM part
JOIN catalog ON vendor_id = p_brand AND field_value = p_type""")
def catalog_match(spark, sf_dir):
    part = B.table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("vendor_id"), F.lit("type").alias("field_name"), F.col("p_type").alias("field_value")
    )
    return joins.catalog_match(part, _catalog(spark, sf_dir), spread_by=["p_partkey"]).drop("field_name")


_BANDS_SQL = """
WITH bands AS (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 20.0 ELSE 30.0 END AS cut FROM supplier)
SELECT l_orderkey, l_linenumber, l_suppkey AS vendor_id, l_quantity AS value,
  CASE WHEN l_quantity < cut THEN 'P1' ELSE 'P0' END AS priority
FROM lineitem JOIN bands ON s_suppkey = l_suppkey WHERE l_quantity >= 10.0"""


def _range_match(spark, sf_dir, **settings):
    cut = F.when(F.col("s_acctbal") < 0, 20.0).otherwise(30.0)
    bands = B.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("vendor_id"), F.lit("quantity").alias("field_name"),
        F.explode(F.array(
            F.struct(F.lit(10.0).alias("low"), cut.alias("high"), F.lit("P1").alias("priority")),
            F.struct(cut.alias("low"), F.lit(float("inf")).alias("high"), F.lit("P0").alias("priority")),
        )).alias("band"),
    ).select("vendor_id", "field_name", "band.*")
    rows = B.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("vendor_id"), F.lit("quantity").alias("field_name"),
        F.col("l_quantity").alias("value"),
    )
    matched = joins.catalog_range_match(rows, bands, **settings)
    return matched.select("l_orderkey", "l_linenumber", "vendor_id", "value", "priority")


@query("c10_catalog_range_match", _BANDS_SQL)
def catalog_range_match(spark, sf_dir):
    return _range_match(spark, sf_dir)


@query("c10_range_segments", _BANDS_SQL)
def range_segments(spark, sf_dir):
    """The form for a catalog that is too large to broadcast."""
    return _range_match(spark, sf_dir, max_broadcast_rows=0, segment_rows=100)


@query("c11_without_resolved", B.sql(B.EVENTS_SQL, B.JOBS_SQL, select="""
SELECT event_id, job_id, source FROM ev WHERE requires_review
  AND job_id NOT IN (SELECT job_id FROM jobs WHERE status <> 'pending')"""))
def without_resolved(spark, sf_dir):
    resolved = B.jobs(spark, sf_dir).filter(F.col("status") != "pending")
    items = B.events(spark, sf_dir).filter("requires_review")
    return joins.without_resolved(items, resolved).select("event_id", "job_id", "source")


# ---- rollups -----------------------------------------------------------------------------------------------

@query("e1_category_severity", B.sql(B.EVENTS_SQL, select=f"""
SELECT ai_category, severity, count(*) AS "count" FROM ev WHERE {_RANGE_SQL} GROUP BY ALL ORDER BY "count" DESC"""))
def counts_by_category_severity(spark, sf_dir):
    return rollups.counts_by_category_severity(B.events(spark, sf_dir), ROLLUP_START, ROLLUP_END)


@query("e2_severity_breakdown", B.sql(B.EVENTS_SQL, select="""
SELECT upper(severity) AS severity, count(*) AS "count" FROM ev GROUP BY 1"""))
def severity_breakdown(spark, sf_dir):
    return rollups.severity_breakdown(B.events(spark, sf_dir))


_HOURLY = """SELECT date_trunc('hour', ts) AS hour, upper(severity) AS severity, count(*) AS "count"
FROM ev WHERE ts >= {as_of} - INTERVAL {hours} HOUR GROUP BY 1, 2"""


@query("e3_hourly_severity", B.sql(B.EVENTS_SQL, select=_HOURLY.format(as_of=_AS_OF_SQL, hours=168)))
def hourly_severity(spark, sf_dir):
    return rollups.hourly_severity(B.events(spark, sf_dir), B.AS_OF, 168)


_BY_HOUR = """SELECT date_trunc('hour', ts) AS bucket, ai_category, upper(severity) AS severity, count(*) AS event_count
FROM ev GROUP BY 1, 2, 3"""
_BY_DAY = """SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, source, ai_category, upper(severity) AS severity,
  count(*) AS event_count, round(avg(confidence_score), 8) AS avg_confidence FROM ev GROUP BY 1, 2, 3, 4"""


@query("e4_hourly_category_rollup", B.sql(B.EVENTS_SQL, select=_BY_HOUR))
def hourly_category_rollup(spark, sf_dir):
    return rollups.hourly_category_rollup(B.events(spark, sf_dir))


@query("e5_daily_machine_rollup", B.sql(B.EVENTS_SQL, select=_BY_DAY))
def daily_machine_rollup(spark, sf_dir):
    return rollups.daily_machine_rollup(B.events(spark, sf_dir))


@query("e6_five_minute_rollup", B.sql(B.READINGS_SQL, select="""
SELECT time_bucket(INTERVAL 5 MINUTE, event_time) AS bucket, tool_id, severity, count(*) AS event_count,
  round(avg(normalize_confidence), 8) AS avg_norm_conf, round(avg(temperature_k), 8) AS avg_temp_k,
  round(avg(pressure_pa), 8) AS avg_pressure_pa, round(avg(rf_power_w), 8) AS avg_rf_power_w
FROM readings GROUP BY 1, 2, 3"""))
def five_minute_rollup(spark, sf_dir):
    return rollups.five_minute_rollup(B.readings(spark, sf_dir))


@query("e7_hourly_tool_rollup", B.sql(B.READINGS_SQL, select="""
SELECT date_trunc('hour', event_time) AS bucket, tool_id, severity, count(*) AS event_count,
  count(*) FILTER (severity = 'CRITICAL') AS critical_count, count(*) FILTER (severity = 'ERROR') AS error_count,
  round(avg(temperature_k), 8) AS avg_temp_k, round(avg(pressure_pa), 8) AS avg_pressure_pa
FROM readings GROUP BY 1, 2, 3"""))
def hourly_tool_rollup(spark, sf_dir):
    return rollups.hourly_tool_rollup(B.readings(spark, sf_dir))


@query("e8_hourly_analytics", B.sql(B.EVENTS_SQL, select=f"""
SELECT * FROM ({_BY_HOUR}) WHERE bucket BETWEEN TIMESTAMP '{ROLLUP_START}' AND TIMESTAMP '{ROLLUP_END}' ORDER BY bucket DESC"""))
def hourly_analytics(spark, sf_dir):
    return rollups.read_hourly(rollups.hourly_category_rollup(B.events(spark, sf_dir), ROLLUP_START, ROLLUP_END), ROLLUP_START, ROLLUP_END)


@query("e9_machine_health", B.sql(B.EVENTS_SQL, select=f"""
SELECT * FROM ({_BY_DAY}) WHERE source = '{ROLLUP_MACHINE}' AND bucket BETWEEN TIMESTAMP '{ROLLUP_START}' AND TIMESTAMP '{ROLLUP_END}'
ORDER BY bucket DESC"""))
def machine_health(spark, sf_dir):
    return rollups.machine_health(rollups.daily_machine_rollup(B.events(spark, sf_dir), ROLLUP_START, ROLLUP_END), ROLLUP_MACHINE, ROLLUP_START, ROLLUP_END)


_STATS_SQL = """stats AS (
  SELECT (SELECT count(*) FROM ev) AS events_processed,
    (SELECT count(*) FROM ev LEFT JOIN jobs USING (job_id) WHERE requires_review AND (status IS NULL OR status = 'pending'))
      AS events_in_review,
    (SELECT count(*) FROM jobs WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.job_id = jobs.job_id)) AS errors,
    (SELECT count(*) FROM jobs WHERE created_at >= TIMESTAMP '1998-01-01 00:00:00') AS jobs_today,
    (SELECT count(*) FROM ev WHERE upper(severity) = 'CRITICAL') AS n_critical,
    (SELECT count(*) FROM ev WHERE upper(severity) = 'ERROR') AS n_error,
    (SELECT count(*) FROM ev WHERE upper(severity) = 'WARNING') AS n_warning,
    (SELECT count(*) FROM ev WHERE upper(severity) = 'INFO') AS n_info)"""


def _stats(spark, sf_dir):
    jobs = B.jobs(spark, sf_dir)
    return rollups.dashboard_stats(B.events(spark, sf_dir), jobs, jobs, "1998-01-01 00:00:00")


@query("e10_dashboard_stats", B.sql(B.EVENTS_SQL, B.JOBS_SQL, _STATS_SQL, select="SELECT * FROM stats"))
def dashboard_stats(spark, sf_dir):
    return _stats(spark, sf_dir).drop("severity_breakdown")


@query("e11_errors_by_machine", B.sql(B.EVENTS_SQL, select=f"""
SELECT source, count(*) AS "count", round(avg(confidence_score), 8) AS avg_confidence FROM ev
WHERE severity = 'ERROR' AND ts > {_AS_OF_SQL} - INTERVAL 240 HOUR GROUP BY source"""))
def errors_by_machine(spark, sf_dir):
    return rollups.errors_by_machine(B.events(spark, sf_dir), B.AS_OF, 240)


@query("e12_best_rules", B.sql(B.EVENTS_SQL, B.DECISIONS_SQL, B.RULES_SQL, B.BEST_RULES_SQL, select="""
SELECT source, rule_category, rule_action, 0.5::DOUBLE AS rule_min_confidence, rule_boost FROM best"""))
def best_rules(spark, sf_dir):
    return joins.best_rules(B.rules(spark, sf_dir))


@query("e13_confidence_by_category", B.sql(B.EVENTS_SQL, select=f"""
SELECT ai_category, upper(severity) AS severity, round(avg(confidence_score), 8) AS avg_confidence FROM ev
WHERE ts > {_AS_OF_SQL} - INTERVAL 168 HOUR GROUP BY 1, 2"""))
def confidence_by_category(spark, sf_dir):
    return rollups.confidence_by_category(B.events(spark, sf_dir), B.AS_OF)


@query("e14_events_by_hour", B.sql(B.EVENTS_SQL, select=f"""
SELECT date_trunc('hour', ts) AS hour, upper(severity) AS severity, count(*) AS event_count FROM ev
WHERE ts > {_AS_OF_SQL} - INTERVAL 720 HOUR AND upper(severity) IN ('CRITICAL', 'ERROR') GROUP BY 1, 2"""))
def events_by_hour(spark, sf_dir):
    return rollups.events_by_hour(B.events(spark, sf_dir), B.AS_OF, 720, ["critical", "error"])


@query("e15_topic_counts", B.sql(*SCORED_VIEWS, select="""
SELECT job_id, count(*) AS events, count(*) FILTER (topic = 'logs.p0') AS p0, count(*) FILTER (topic = 'logs.p1') AS p1,
  count(*) FILTER (topic = 'logs.p2') AS p2, count(*) FILTER (topic = 'logs.deadletter') AS deadletter,
  count(*) FILTER (topic IS NULL) AS review FROM routed GROUP BY job_id"""))
def topic_counts(spark, sf_dir):
    return rollups.topic_counts_per_job(scored_events(B.events(spark, sf_dir), B.rules(spark, sf_dir)))


@query("e15_routing_table", B.sql(*SCORED_VIEWS, select="""
SELECT job_id, topic AS kafka_topic, count(*) AS event_count FROM routed WHERE topic IS NOT NULL GROUP BY 1, 2"""))
def routing_table(spark, sf_dir):
    return rollups.routing_table(scored_events(B.events(spark, sf_dir), B.rules(spark, sf_dir)))


@query("e16_feedback_counters", B.sql(B.EVENTS_SQL, B.DECISIONS_SQL, select="""
SELECT source, category, a AS approval_count, r AS rejection_count,
  round((a - r) / greatest(a + r, 1) * 0.20, 4) AS confidence_boost
FROM (SELECT source, category, count(*) FILTER (decision = 'approved') AS a, count(*) FILTER (decision = 'rejected') AS r
      FROM decisions WHERE decision IN ('approved', 'rejected') GROUP BY 1, 2)"""))
def feedback_counters(spark, sf_dir):
    return review.feedback_counters(B.decisions(spark, sf_dir))


@query("e17_rules_by_vendor", f"""
WITH {_CATALOG_SQL}
SELECT vendor_id, row_number() OVER (PARTITION BY vendor_id ORDER BY field_name, field_value) AS place,
  count(*) OVER (PARTITION BY vendor_id) AS rule_count, field_value, category, priority FROM catalog""")
def rules_by_vendor(spark, sf_dir):
    return review.rules_by_vendor(_catalog(spark, sf_dir)).drop("field_name")


@query("e18_category_set", """
SELECT DISTINCT name FROM (SELECT lower(p_type) AS name FROM part UNION ALL SELECT unnest(['thermal','mechanical',
  'electrical','gas_leak','contamination','process_drift','safety','software','maintenance','unknown'])) ORDER BY name""")
def category_set(spark, sf_dir):
    """Default categories and the stored ones (E18, H1)."""
    return categories.category_set(B.table(spark, sf_dir, "part").select(F.lower("p_type").alias("category")))


@query("e19_distinct_filters", B.sql(B.EVENTS_SQL, select="""
SELECT DISTINCT 'severity' AS field, severity AS value FROM ev WHERE requires_review
UNION ALL SELECT DISTINCT 'source', source FROM ev WHERE requires_review"""))
def distinct_filters(spark, sf_dir):
    return rollups.distinct_filters(B.events(spark, sf_dir).filter("requires_review"))


@query("e20_chart_pivot", B.sql(B.EVENTS_SQL, f"series AS ({_HOURLY.format(as_of=_AS_OF_SQL, hours=168)})", select="""
SELECT hour, CAST(sum(CASE WHEN severity = 'CRITICAL' THEN "count" ELSE 0 END) AS BIGINT) AS critical,
  CAST(sum(CASE WHEN severity = 'ERROR' THEN "count" ELSE 0 END) AS BIGINT) AS errors,
  CAST(sum(CASE WHEN severity NOT IN ('CRITICAL', 'ERROR') THEN "count" ELSE 0 END) AS BIGINT) AS non_urgent
FROM series GROUP BY hour"""))
def chart_pivot(spark, sf_dir):
    series = rollups.hourly_severity(B.events(spark, sf_dir), B.AS_OF, 168)
    return rollups.chart_pivot(series).orderBy("hour")


@query("e21_result_series", B.sql(B.EVENTS_SQL, select="""
SELECT strftime(ts, '%Y-%m-%dT%H') || ':00' AS hour, severity, count(*) AS "count" FROM ev GROUP BY 1, 2"""))
def result_series(spark, sf_dir):
    return rollups.result_series(B.events(spark, sf_dir).select("ts", "severity", "message"))


@query("e21_series_passed_through", B.sql(B.EVENTS_SQL, select=f"""
SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, upper(severity) AS severity, count(*) AS "count" FROM ev
WHERE ts > {_AS_OF_SQL} - INTERVAL 720 HOUR GROUP BY 1, 2"""))
def series_passed_through(spark, sf_dir):
    """A result that is aggregated already keeps its rows."""
    return rollups.result_series(rollups.events_by_hour(B.events(spark, sf_dir), B.AS_OF, 720))


@query("e22_summary_panel", B.sql(B.EVENTS_SQL, B.JOBS_SQL, _STATS_SQL, select="""
SELECT events_processed, events_in_review, n_critical AS critical, n_error AS errors_shown,
  n_warning + n_info AS non_urgent, errors AS failures, greatest(n_critical, n_error, n_warning + n_info, errors, 1) AS max_count
FROM stats"""))
def summary_panel(spark, sf_dir):
    return rollups.summary_panel(_stats(spark, sf_dir))


@query("e24_sources_with_several", B.sql(B.EVENTS_SQL, select="""
SELECT source, count(*) AS event_count FROM ev GROUP BY source HAVING count(*) >= 2"""))
def sources_with_several(spark, sf_dir):
    return rollups.sources_with_several(B.events(spark, sf_dir))


@query("e25_job_counters", B.sql(*SCORED_VIEWS, select="""
SELECT job_id, count(*) AS total_events, count(*) FILTER (good) AS parsed_events,
  count(*) FILTER (good AND topic IN ('logs.p0', 'logs.p1')) AS hot_events, count(*) FILTER (good AND topic = 'logs.p2')
    AS cold_events,
  count(*) FILTER (good AND topic IS NULL) AS review_events, count(*) FILTER (good AND topic = 'logs.deadletter')
    AS deadletter_events,
  count(*) FILTER (NOT good) AS n_errors,
  CASE WHEN count(*) FILTER (good) = 0 THEN 'failed' WHEN count(*) FILTER (NOT good) > 0 THEN 'partial_success'
       ELSE 'success' END AS status
FROM (SELECT *, event_type <> 'signup' AS good FROM routed) GROUP BY job_id"""))
def job_counters(spark, sf_dir):
    """Counters with the events of broken payloads as parse errors."""
    routed = scored_events(B.events(spark, sf_dir), B.rules(spark, sf_dir))
    broken = F.col("event_type") == "signup"
    return rollups.job_counters(routed.filter(~broken), B.events(spark, sf_dir).filter(broken))


# ---- listings ----------------------------------------------------------------------------------------------

_DETAIL = "ts, source, severity, event_type, message, ai_category, ai_root_cause, ai_recommended_action, confidence_score"


@query("g1_events_detail", B.sql(B.EVENTS_SQL, select=f"""
SELECT {_DETAIL} FROM ev WHERE ts > {_AS_OF_SQL} - INTERVAL 168 HOUR AND upper(severity) IN ('CRITICAL', 'WARNING')
ORDER BY ts DESC, event_id LIMIT 100"""))
def events_detail(spark, sf_dir):
    return listings.events_detail(B.events(spark, sf_dir), B.AS_OF, 168, ["critical", "warning"], 100)


@query("g2_machine_events", B.sql(B.EVENTS_SQL, select=f"""
SELECT * FROM ev WHERE source = '{ROLLUP_MACHINE}' AND {_RANGE_SQL} ORDER BY ts DESC"""))
def machine_events(spark, sf_dir):
    return listings.machine_events(B.events(spark, sf_dir), ROLLUP_MACHINE, ROLLUP_START, ROLLUP_END)


@query("g4_category_detail", B.sql(B.EVENTS_SQL, select=f"""
SELECT event_id, {_DETAIL} FROM ev WHERE ai_category = 'thermal' AND severity IN ('CRITICAL', 'ERROR')
  AND ts > {_AS_OF_SQL} - INTERVAL 240 HOUR ORDER BY ts DESC"""))
def category_detail(spark, sf_dir):
    found = listings.category_detail(B.events(spark, sf_dir), "thermal", ["CRITICAL", "ERROR"], B.AS_OF, 240)
    return found.select("event_id", *listings.DETAIL_COLUMNS)


@query("g5_queue_page", B.sql(B.EVENTS_SQL, B.JOBS_SQL, select="""
SELECT event_id, job_id, ts FROM ev LEFT JOIN jobs USING (job_id)
WHERE requires_review AND coalesce(status, 'pending') = 'pending' ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50"""))
def queue_page(spark, sf_dir):
    queue = joins.pending_reviews(B.events(spark, sf_dir), B.jobs(spark, sf_dir), sort=False)
    return listings.queue_page(queue, 25, 50).select("event_id", "job_id", "ts")


@query("g5_keyset_page", B.sql(B.EVENTS_SQL, B.JOBS_SQL, select="""
SELECT w AS way, event_id, job_id, ts FROM (SELECT event_id, job_id, ts, row_number() OVER (ORDER BY ts DESC, event_id) AS n
  FROM ev LEFT JOIN jobs USING (job_id) WHERE requires_review AND coalesce(status, 'pending') = 'pending'),
  (VALUES ('next', 51, 75), ('jump', 301, 325)) t(w, low, high) WHERE n BETWEEN low AND high"""))
def keyset_page(spark, sf_dir):
    """The third page, by the last item of the second one; and a later page, by the counts per day."""
    queue = joins.pending_reviews(B.events(spark, sf_dir), B.jobs(spark, sf_dir), sort=False)
    after = None
    for _ in range(2):
        last = listings.queue_page_after(queue, 25, after).orderBy("ts", F.desc("event_id")).first()
        after = (last["ts"], last["event_id"])
    per_day = stored(listings.items_per_day(queue), "items-per-day")
    pages = {"next": listings.queue_page_after(queue, 25, after), "jump": listings.queue_page_at(queue, per_day, 25, 300)}
    found = [page.select(F.lit(way).alias("way"), "event_id", "job_id", "ts") for way, page in pages.items()]
    return found[0].unionByName(found[1])


# ---- categories, retention and updates -----------------------------------------------------------------------

@query("h2_add_categories", """
SELECT name, clean, clean IS NOT NULL AS valid,
  clean IS NOT NULL AND clean NOT IN ('thermal','mechanical','electrical','gas_leak','contamination','process_drift',
    'safety','software','maintenance','unknown') AS created
FROM (SELECT name, CASE WHEN regexp_matches(lower(trim(name)), '^[a-z][a-z0-9_]{0,31}$') THEN lower(trim(name)) END AS clean
  FROM (SELECT DISTINCT CASE WHEN p_size < 20 THEN p_type WHEN p_size < 30 THEN p_name ELSE ' Thermal ' END AS name FROM part))""")
def add_categories(spark, sf_dir):
    size = F.col("p_size")
    names = B.table(spark, sf_dir, "part").select(
        F.when(size < 20, F.col("p_type")).when(size < 30, F.col("p_name")).otherwise(" Thermal ").alias("name")
    )
    return categories.add_categories(categories.default_categories(spark), names)


@query("h1_category_union", """
WITH asked AS (SELECT DISTINCT lower(trim(CASE WHEN p_size < 20 THEN p_type WHEN p_size < 30 THEN p_name ELSE ' Thermal ' END))
  AS name FROM part)
SELECT unnest(['thermal','mechanical','electrical','gas_leak','contamination','process_drift','safety','software',
  'maintenance','unknown']) AS name
UNION SELECT name FROM asked WHERE regexp_matches(name, '^[a-z][a-z0-9_]{0,31}$')""")
def category_union(spark, sf_dir):
    """Registry after the valid new names were added."""
    size = F.col("p_size")
    names = B.table(spark, sf_dir, "part").select(
        F.when(size < 20, F.col("p_type")).when(size < 30, F.col("p_name")).otherwise(" Thermal ").alias("name")
    )
    return categories.registry_after(categories.default_categories(spark), names)


@query("i7_retention", B.sql(B.EVENTS_SQL, select=f"""
SELECT event_id, ts FROM ev WHERE ts >= {_AS_OF_SQL} - INTERVAL 7 DAY"""))
def retention(spark, sf_dir):
    return listings.retained(B.events(spark, sf_dir), B.AS_OF, 7).select("event_id", "ts")


@query("i7_partition_drop", B.sql(B.EVENTS_SQL, select=f"""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN CAST(ts AS DATE) < CAST({_AS_OF_SQL} AS DATE) - 14 THEN 'deleted'
    WHEN CAST(ts AS DATE) < CAST({_AS_OF_SQL} AS DATE) - 7 THEN 'hidden' ELSE 'kept' END AS state,
  CASE WHEN CAST(ts AS DATE) < CAST({_AS_OF_SQL} AS DATE) - 7 THEN 0 ELSE count(*) END AS n_rows
FROM ev GROUP BY CAST(ts AS DATE)"""))
def partition_drop(spark, sf_dir):
    """Retention of seven days, run a week ago and now: which days are gone, which are hidden, and the rows that stay."""
    path, as_of = scratch_path(spark, "retained"), dt.date.fromisoformat(B.AS_OF[:10])
    events = B.events(spark, sf_dir).withColumn("event_date", F.to_date("ts"))
    events.select("event_id", "event_date").write.partitionBy("event_date").parquet(path)
    partitions.drop_expired(spark, path, as_of - dt.timedelta(days=7), 7)
    done = partitions.drop_expired(spark, path, as_of, 7)
    state = F.when(F.col("day").isin(done["deleted"]), "deleted").when(F.col("day").isin(done["hidden"]), "hidden").otherwise("kept")
    left = partitions.read_retained(spark, path).groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))
    days = events.select(F.col("event_date").alias("day")).distinct()
    joined = days.join(left, F.col("day") == F.col("event_date"), "left")
    return joined.select(F.col("day").cast("string").alias("day"), state.alias("state"), F.coalesce("n", F.lit(0)).alias("n_rows"))


_LAST_DECISION = """last_decision AS (
  SELECT job_id, max_by(decision, (decided_at, decision_id)) AS decision, max_by(category, (decided_at, decision_id)) AS
    new_category, max_by(coalesce(severity, ''), (decided_at, decision_id)) AS new_severity,
    max_by(notes, (decided_at, decision_id)) AS notes, max(decided_at) AS decided_at
  FROM decisions WHERE decision IN ('approved', 'rejected') GROUP BY job_id)"""


@query("i9_forward_approved", B.sql(B.EVENTS_SQL, B.DECISIONS_SQL, _LAST_DECISION, select="""
SELECT event_id, source, upper(coalesce(nullif(new_severity, ''), ev.severity)) AS severity, new_category AS ai_category,
  CASE WHEN upper(coalesce(nullif(new_severity, ''), ev.severity)) = 'CRITICAL' THEN 'logs.p0' ELSE 'logs.p1' END AS topic
FROM ev JOIN last_decision USING (job_id) WHERE decision = 'approved'"""))
def forward_approved(spark, sf_dir):
    valid = B.decisions(spark, sf_dir).filter(F.col("decision").isin(review.DECISIONS))
    latest = valid.groupBy("job_id").agg(F.max(F.struct(
        "decided_at", "decision_id", "decision", "category", "severity"
    )).alias("d")).select("job_id", "d.decision", "d.category", "d.severity")
    forwarded = review.forward_approved(B.events(spark, sf_dir), latest)
    return forwarded.select("event_id", "source", "severity", "ai_category", "topic")


@query("j1_insert_if_absent", B.sql(B.EVENTS_SQL, B.JOBS_SQL, select="""
SELECT job_id, file_name FROM jobs
UNION ALL SELECT new_id, min_by(source || '#' || CAST(event_id AS VARCHAR), event_id)
  FROM (SELECT *, job_id + CASE WHEN event_type = 'error' THEN 100000000 ELSE 0 END AS new_id FROM ev)
  WHERE new_id NOT IN (SELECT job_id FROM jobs) GROUP BY new_id"""))
def insert_if_absent(spark, sf_dir):
    target = B.jobs(spark, sf_dir).select("job_id", "file_name")
    new_id = F.col("job_id") + F.when(F.col("event_type") == "error", 100_000_000).otherwise(0)
    new = B.events(spark, sf_dir).select(
        new_id.alias("job_id"), F.concat("source", F.lit("#"), F.col("event_id").cast("string")).alias("file_name"), "event_id"
    )
    return review.insert_if_absent(target, new, ["job_id"], ["event_id"])


@query("j2_review_decisions", B.sql(B.EVENTS_SQL, B.JOBS_SQL, B.DECISIONS_SQL, _LAST_DECISION, select="""
SELECT job_id, coalesce(decision, status) AS status, CASE WHEN decision IS NULL THEN reviewer_notes ELSE notes END AS
  reviewer_notes, CASE WHEN decision IS NULL THEN reviewed_at ELSE decided_at END AS reviewed_at
FROM jobs LEFT JOIN last_decision USING (job_id)"""))
def review_decisions(spark, sf_dir):
    return review.apply_decisions(B.jobs(spark, sf_dir), B.decisions(spark, sf_dir))


@query("j3_enqueue_reviews", B.sql(B.EVENTS_SQL, B.JOBS_SQL, select="""
SELECT DISTINCT job_id, 'pending' AS status FROM ev WHERE requires_review
  AND job_id NOT IN (SELECT job_id FROM jobs WHERE status = 'approved')"""))
def enqueue_reviews(spark, sf_dir):
    reviewed = B.jobs(spark, sf_dir).filter(F.col("status") == "approved")
    return review.enqueue_reviews(B.events(spark, sf_dir), reviewed)


@query("j4_approved_pool", B.sql(B.EVENTS_SQL, B.JOBS_SQL, select="""
SELECT ai_category AS category, job_id, event_id, message, source, confidence_score AS confidence
FROM ev JOIN jobs USING (job_id) WHERE status = 'approved' ORDER BY job_id, event_id LIMIT 50"""))
def approved_pool(spark, sf_dir):
    return joins.approved_pool(B.events(spark, sf_dir), B.jobs(spark, sf_dir))


@query("c12_merge_feedback", B.sql(B.EVENTS_SQL, B.DECISIONS_SQL, B.RULES_SQL, """more AS (
  SELECT source, category, count(*) FILTER (decision = 'approved') AS a, count(*) FILTER (decision = 'rejected') AS r
  FROM decisions WHERE event_type IN ('view', 'error') AND decision IN ('approved', 'rejected') GROUP BY 1, 2)""", select="""
SELECT source, category, ac AS approval_count, rc AS rejection_count,
  CASE WHEN a IS NULL THEN confidence_boost ELSE round((ac - rc) / greatest(ac + rc, 1) * 0.20, 4) END AS confidence_boost,
  recommended_action, min_confidence
FROM (SELECT *, CAST(coalesce(approval_count, 0) + coalesce(a, 0) AS BIGINT) AS ac,
        CAST(coalesce(rejection_count, 0) + coalesce(r, 0) AS BIGINT) AS rc
      FROM rules FULL JOIN more USING (source, category))"""))
def merge_feedback(spark, sf_dir):
    later = B.decisions(spark, sf_dir).filter(F.col("event_type").isin("view", "error"))
    return review.merge_feedback(B.rules(spark, sf_dir), later)
