"""Binding of the log model to the given tables: each view as a DataFrame and, for the checks, as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fablens.operators.skew import spread_scan

AS_OF = "2024-01-31 00:00:00"
LIMIT = 150.0

# Fixed values of the binding.
TOOLS = ["PECVD", "ETCH", "LITHO", "CMP", "IMPLANT", "PUMP"]
CATEGORIES = [
    "thermal", "mechanical", "electrical", "gas_leak", "contamination",
    "process_drift", "safety", "software", "maintenance", "unknown",
]
PHRASES = {
    "view": "scheduled calibration check", "signup": "recipe load", "error": "toxic gas alarm",
    "click": "mfc flow reading", "purchase": "heater temperature reading",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same for work that is heavy per row: on enough tasks even if the table is one unsplittable file."""
    return spread_scan(table(spark, sf_dir, name))


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream; the glob lets the path be a file or a folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def as_events(raw: DataFrame) -> DataFrame:
    """Event table from the raw events, batch or stream."""
    source = F.concat(
        F.lit("tool_"), pick(TOOLS, F.col("user_id") % 6 + 1), F.lit("-"),
        F.lpad((F.col("user_id") % 20).cast("string"), 2, "0"),
    )
    is_error = F.col("event_type") == "error"
    severity = (
        F.when(is_error & (F.col("value") >= 100), "CRITICAL").when(is_error, "ERROR")
        .when(F.col("event_type") == "purchase", "WARNING").otherwise("INFO")
    )
    phrase = None
    for kind, text in PHRASES.items():
        hit = F.col("event_type") == kind
        phrase = F.when(hit, text) if phrase is None else phrase.when(hit, text)
    k = F.get_json_object("props", "$.k").cast("double")
    return raw.select(
        "event_id",
        F.floor(F.col("event_id") / 8).alias("job_id"),
        "ts",
        source.alias("source"),
        "event_type",
        severity.alias("severity"),
        F.concat(phrase, F.lit(" on "), source, F.lit(" value "), F.format_string("%.2f", "value")).alias("message"),
        pick(CATEGORIES, F.col("event_id") % 10 + 1).alias("ai_category"),
        F.concat(F.lit("cause of "), F.col("event_type")).alias("ai_root_cause"),
        F.concat(F.lit("inspect "), source).alias("ai_recommended_action"),
        (k / 100).alias("confidence_score"),
        (k / 100 < 0.85).alias("requires_review"),
        "value",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(table(spark, sf_dir, "events"))


EVENTS_SQL = """ev AS (
  SELECT event_id, event_id // 8 AS job_id, ts,
    'tool_' || ['PECVD','ETCH','LITHO','CMP','IMPLANT','PUMP'][CAST(user_id % 6 + 1 AS INT)] || '-'
      || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS source,
    event_type,
    CASE WHEN event_type = 'error' AND value >= 100 THEN 'CRITICAL' WHEN event_type = 'error' THEN 'ERROR'
         WHEN event_type = 'purchase' THEN 'WARNING' ELSE 'INFO' END AS severity,
    CASE event_type WHEN 'view' THEN 'scheduled calibration check' WHEN 'signup' THEN 'recipe load'
         WHEN 'error' THEN 'toxic gas alarm' WHEN 'click' THEN 'mfc flow reading'
         WHEN 'purchase' THEN 'heater temperature reading' END
      || ' on ' || source || ' value ' || printf('%.2f', value) AS message,
    ['thermal','mechanical','electrical','gas_leak','contamination','process_drift','safety','software',
     'maintenance','unknown'][CAST(event_id % 10 + 1 AS INT)] AS ai_category,
    'cause of ' || event_type AS ai_root_cause,
    'inspect ' || source AS ai_recommended_action,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS confidence_score,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 < 0.85 AS requires_review,
    value
  FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs, their review status and their topic, from orders."""
    status = F.col("o_orderstatus")
    urgency = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.when(status == "F", "approved").when(status == "O", "pending").otherwise("rejected").alias("status"),
        F.col("o_orderpriority").alias("reviewer_notes"),
        F.col("o_orderdate").alias("reviewed_at"),
        F.concat(F.lit("job_"), F.col("o_orderkey").cast("string"), F.lit(".json")).alias("file_name"),
        F.col("o_orderdate").alias("created_at"),
        F.when(urgency == "1", "logs.p0").when(urgency == "2", "logs.p1").when(urgency == "5", "logs.deadletter")
        .otherwise("logs.p2").alias("kafka_topic"),
    )


JOBS_SQL = """jobs AS (
  SELECT o_orderkey AS job_id,
    CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status,
    o_orderpriority AS reviewer_notes, o_orderdate AS reviewed_at,
    'job_' || CAST(o_orderkey AS VARCHAR) || '.json' AS file_name, o_orderdate AS created_at,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'logs.p0' WHEN '2' THEN 'logs.p1'
         WHEN '5' THEN 'logs.deadletter' ELSE 'logs.p2' END AS kafka_topic
  FROM orders)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review decisions, one per event: approved from a confidence of 0.5 on; a few are of no valid kind."""
    score = F.col("confidence_score")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("decision_id"), "job_id", "source",
        F.col("ai_category").alias("category"), "event_type",
        F.when(score >= 0.5, "approved").when(score >= 0.03, "rejected").otherwise("deferred").alias("decision"),
        F.col("event_type").alias("notes"),
        F.col("ts").alias("decided_at"),
        F.when(F.col("event_type") == "click", "critical").when(F.col("event_type") == "view", "error").alias("severity"),
    )


DECISIONS_SQL = """decisions AS (
  SELECT event_id AS decision_id, job_id, source, ai_category AS category, event_type,
    CASE WHEN confidence_score >= 0.5 THEN 'approved' WHEN confidence_score >= 0.03 THEN 'rejected'
         ELSE 'deferred' END AS decision,
    event_type AS notes, ts AS decided_at,
    CASE event_type WHEN 'click' THEN 'critical' WHEN 'view' THEN 'error' END AS severity
  FROM ev)"""


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules learned from the decisions on errors and purchases."""
    from fablens.operators.review import feedback_counters

    kept = decisions(spark, sf_dir).filter(F.col("event_type").isin("error", "purchase"))
    return feedback_counters(kept).withColumns({
        "recommended_action": F.concat(F.lit("check "), F.col("category")),
        "min_confidence": F.lit(0.5),
    })


RULES_SQL = """rules AS (
  SELECT *, round((approval_count - rejection_count) / greatest(approval_count + rejection_count, 1) * 0.20, 4)
      AS confidence_boost, 'check ' || category AS recommended_action, 0.5 AS min_confidence
  FROM (SELECT source, category,
          CAST(count(*) FILTER (decision = 'approved') AS DOUBLE) AS approval_count,
          CAST(count(*) FILTER (decision <> 'approved') AS DOUBLE) AS rejection_count
        FROM decisions WHERE event_type IN ('error', 'purchase') AND decision IN ('approved', 'rejected')
        GROUP BY source, category))"""

BEST_RULES_SQL = """best AS (
  SELECT source, any_value(rule_category) AS rule_category, any_value(rule_action) AS rule_action,
         round(sum(confidence_boost), 4) AS rule_boost
  FROM (SELECT source, confidence_boost,
          first_value(category) OVER w AS rule_category, first_value(recommended_action) OVER w AS rule_action
        FROM rules WINDOW w AS (PARTITION BY source ORDER BY approval_count DESC, category))
  GROUP BY source)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploaded files, one each ten minutes."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("job_id"),
        (start + F.make_dt_interval(mins=F.col("doc_id").cast("int") * 10)).alias("ts"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
        "text", "lang", "source",
    )


FILES_SQL = """files AS (
  SELECT doc_id AS job_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 10) AS ts,
    'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS file_name, text, lang, source
  FROM documents)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor readings from lineitem."""
    flag = F.col("l_returnflag")
    minute = F.pmod(F.col("l_orderkey") * 7 + F.col("l_partkey"), F.lit(1440)).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(mins=minute)).alias("event_time"),
        F.concat(F.lit("tool_"), F.col("l_suppkey").cast("string")).alias("tool_id"),
        F.when(flag == "R", "CRITICAL").when(flag == "A", "ERROR").otherwise("INFO").alias("severity"),
        (F.lit(1.0) - F.col("l_tax")).alias("normalize_confidence"),
        F.col("l_quantity").alias("temperature_k"),
        F.col("l_extendedprice").alias("pressure_pa"),
        F.col("l_discount").alias("rf_power_w"),
    )


READINGS_SQL = """readings AS (
  SELECT CAST(l_shipdate AS TIMESTAMP) + to_minutes((l_orderkey * 7 + l_partkey) % 1440) AS event_time,
    'tool_' || CAST(l_suppkey AS VARCHAR) AS tool_id,
    CASE l_returnflag WHEN 'R' THEN 'CRITICAL' WHEN 'A' THEN 'ERROR' ELSE 'INFO' END AS severity,
    1.0 - l_tax AS normalize_confidence, l_quantity AS temperature_k, l_extendedprice AS pressure_pa,
    l_discount AS rf_power_w
  FROM lineitem)"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per event, its shape by event type: object, array, object with a list, mixed array, broken."""
    ev = as_events(wide_table(spark, sf_dir, "events"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    second = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    shifted = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
    plain = F.to_json(F.struct(
        iso.alias("ts"), F.col("source").alias("machine"), F.col("severity").alias("level"),
        F.col("message").alias("msg"), F.col("event_type").alias("type"),
    ))
    full = F.to_json(F.struct(
        second.alias("timestamp"), "source", F.lower("severity").alias("severity"), "message", "event_type",
    ))
    other = F.to_json(F.struct(
        F.lit("").alias("Time"), F.col("source").alias("HOST"), F.lit("debug").alias("Priority"),
        F.col("ai_category").alias("category"),
    ))
    nested = F.to_json(F.struct(
        F.lit("invalid-date").alias("time"), F.struct(F.col("source").alias("id")).alias("machine"),
        F.struct(F.col("event_type").alias("type"), F.struct(F.lit("007").alias("code")).alias("fault")).alias("event"),
        F.lit("UNKNOWN_SEV").alias("severity"),
    ))
    late = F.to_json(F.struct(shifted.alias("created_at"), F.col("source").alias("device"), F.lit("WARN").alias("log_level")))
    shape = F.col("event_type")
    document = (
        F.when(shape == "view", plain)
        .when(shape == "click", F.concat(F.lit("["), full, F.lit(","), other, F.lit("]")))
        .when(shape == "purchase", F.concat(F.lit('{"site":"[F1]","records":['), nested, F.lit("]}")))
        .when(shape == "error", F.concat(F.lit("["), late, F.lit(",5]")))
        .otherwise(F.concat(F.lit('{"source": '), F.col("source")))
    )
    return ev.select("event_id", document.alias("document"))


def xml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = as_events(wide_table(spark, sf_dir, "events"))
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    body = F.concat(
        tag("source", F.col("source")), tag("severity", F.col("severity")), tag("message", F.col("message")),
        F.lit('<reading unit="mV">'), F.format_string("%.2f", "value"), F.lit("</reading>"),
        F.lit("<fault>"), tag("code", F.lit("007")), F.lit("</fault>"),
    )
    broken = F.concat(F.lit("<EventLog><Event>"), F.col("source"))
    whole = F.concat(
        F.lit('<?xml version="1.0"?><l:EventLog xmlns:l="urn:log"><l:Event zone="Z1">'), body,
        F.lit('</l:Event><CORRUPT vendor="V"/></l:EventLog>'),
    )
    return ev.select("event_id", F.when(F.col("event_type") == "signup", broken).otherwise(whole).alias("document"))


def csv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = as_events(wide_table(spark, sf_dir, "events"))
    value = F.format_string("%.2f", "value")
    plain = F.concat(
        F.lit("timestamp,source,severity,value\n"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(","),
        F.col("source"), F.lit(","), F.col("severity"), F.lit(","), value, F.lit("\n"),
        F.lit("2024-01-01,"), F.col("source"), F.lit("\n"),
        F.lit("2024-01-02,a,INFO,1.0,surplus,cells\n"),
    )
    quoted = F.concat(
        F.lit("source,message\n"), F.col("source"), F.lit(',"'), F.col("message"), F.lit(', two\nlines ""x"""\n'),
    )
    return ev.select("event_id", F.when(F.col("event_type") == "error", quoted).otherwise(plain).alias("document"))


def sql(*views: str, select: str) -> str:
    """SQL text with the named views in front."""
    return "WITH " + ",\n".join(views) + "\n" + select.strip()
