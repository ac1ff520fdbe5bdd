"""Classification, scoring, routing (B10-B28) and predicates (B31-B33)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fablens import constants as C
from fablens.functions import classify, routing, scoring
from fablens.operators import iforest, joins, rollups
from fablens.plans import bindings as B
from fablens.plans.registry import query
from fablens.streaming.jobs import alert_rows, event_rows, normalize_logs, scored_events


def keyword_case(text: str) -> str:
    """The keyword table as a SQL CASE over lower-cased text."""
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + f" THEN '{category}'"
        for category, words in C.CATEGORY_KEYWORDS
    )
    return f"CASE {arms} ELSE 'unknown' END"


def _code_case(column: str, codes: dict[str, int], default: int) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in codes.items())
    return f"CAST(CASE lower({column}) {arms} ELSE {default} END AS DOUBLE)"


@query("b10_keyword_category", "WITH t AS (SELECT doc_id, lower(text || ' ' || lang || ' ' || source) AS t FROM documents) "
       f"SELECT doc_id, {keyword_case('t')} AS category FROM t")
def keyword_category(spark, sf_dir):
    docs = B.wide_table(spark, sf_dir, "documents")
    return docs.select("doc_id", classify.keyword_category(F.col("text"), F.col("lang"), F.col("source")).alias("category"))


@query("b10_event_category", B.sql(B.EVENTS_SQL, select=f"""
SELECT event_id, {keyword_case("lower(message || ' ' || event_type || ' ' || source)")} AS category FROM ev"""))
def event_category(spark, sf_dir):
    text = [F.col(c) for c in ("message", "event_type", "source")]
    return B.events(spark, sf_dir).select("event_id", classify.keyword_category(*text).alias("category"))


@query("b11_allowed_category", """
SELECT p_partkey, CASE WHEN p_size <= 25 THEN 'thermal' ELSE 'unknown' END AS category FROM part""")
def allowed_category(spark, sf_dir):
    given = F.when(F.col("p_size") <= 25, "thermal").otherwise(F.lower("p_type"))
    return B.table(spark, sf_dir, "part").select("p_partkey", classify.allowed_category(given).alias("category"))


@query("b12_validated_result", B.sql(B.EVENTS_SQL, select="""
SELECT event_id,
  CASE WHEN event_type IN ('error', 'click') THEN 'unknown' ELSE ai_category END AS category,
  CASE WHEN event_type = 'error' THEN 'unknown' ELSE ai_root_cause END AS root_cause,
  CASE WHEN event_type = 'error' THEN 'manual review' ELSE ai_recommended_action END AS recommended_action,
  CASE WHEN event_type = 'error' THEN 0.0 WHEN event_type = 'view' THEN 0.5
       ELSE greatest(0.0, least(1.0, confidence_score * 2 - 0.5)) END AS confidence
FROM ev"""))
def validated_result(spark, sf_dir):
    kind = F.col("event_type")
    result = F.to_json(F.struct(
        F.when(kind == "click", "explosion").otherwise(F.col("ai_category")).alias("category"),
        F.col("ai_root_cause").alias("root_cause"), F.col("ai_recommended_action").alias("recommended_action"),
        F.when(kind != "view", F.col("confidence_score") * 2 - 0.5).alias("confidence"),
    ))
    given = F.when(kind == "error", F.concat(F.lit("Sorry: "), result)).otherwise(result)
    return B.events(spark, sf_dir).select("event_id", classify.validated_result(given).alias("r")).select("event_id", "r.*")


@query("b13_equipment_class", B.sql(B.EVENTS_SQL, select="""
SELECT event_id, split_part(replace(replace(replace(upper(source), 'TOOL_', ''), 'MACHINE_', ''), 'DEVICE_', ''),
  '-', 1) AS equipment_class FROM ev"""))
def equipment_class(spark, sf_dir):
    return B.events(spark, sf_dir).select("event_id", classify.equipment_class(F.col("source")).alias("equipment_class"))


def _family_sql() -> str:
    rows = ", ".join(
        f"('{family}', {n}, '{token}')" for n, (family, tokens, _) in enumerate(C.EQUIPMENT_FAMILIES) for token in tokens
    )
    cats = ", ".join(f"('{family}', '{c}')" for family, _, cats in C.EQUIPMENT_FAMILIES for c in cats)
    return B.sql(B.EVENTS_SQL, f"alias(family, n, token) AS (VALUES {rows})", f"cat(family, category) AS (VALUES {cats})",
                 "hits AS (SELECT DISTINCT s.source, family, n FROM (SELECT DISTINCT source FROM ev) s "
                 "JOIN alias ON contains(upper(s.source), token))", select="""
SELECT ev.event_id, f.families, c.categories FROM ev
JOIN (SELECT source, string_agg(family, ',' ORDER BY n) AS families FROM hits GROUP BY source) f USING (source)
JOIN (SELECT source, string_agg(category, ',' ORDER BY category) AS categories
      FROM (SELECT DISTINCT source, category FROM hits JOIN cat USING (family)) GROUP BY source) c USING (source)""")


@query("b14_equipment_families", _family_sql())
def equipment_families(spark, sf_dir):
    source = F.col("source")
    return B.events(spark, sf_dir).select(
        "event_id",
        F.concat_ws(",", classify.equipment_family(source)).alias("families"),
        F.concat_ws(",", classify.candidate_categories(source)).alias("categories"),
    )


def _messages(spark, sf_dir):
    """Events as decoded messages, with fields missing here and there."""
    kind = F.col("event_type")
    return B.events(spark, sf_dir).select(
        F.when(kind != "signup", F.col("job_id").cast("string")).alias("job_id"),
        F.col("event_id").alias("event_index"),
        F.when(kind == "purchase", "no-time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("timestamp"),
        F.when(kind != "view", F.col("source")).alias("source"),
        F.when(kind != "view", kind).alias("event_type"),
        F.when(kind != "click", F.col("severity")).alias("severity"),
        "message",
        F.when(kind != "error", F.struct(
            F.col("ai_category").alias("category"), F.col("ai_root_cause").alias("root_cause"),
            F.col("ai_recommended_action").alias("recommended_action"), F.col("confidence_score").alias("confidence"),
        )).alias("ai_normalized"),
    )


_DEAD_REASON = """CASE WHEN c < 0.3 THEN 'AI confidence too low (' || printf('%.0f', c * 100) || '%) — model could not reliably classify this event'
  WHEN k = 'unknown' AND s = 'error' THEN 'Unclassifiable error: AI returned category=''unknown'' with severity=''' || s || ''' — likely an unseen log format'
  ELSE 'Dead-lettered: category=''' || k || ''', confidence=' || printf('%.0f', c * 100) || '%, severity=''' || s || '''' END"""


@query("b15_event_rows", B.sql(B.EVENTS_SQL, """m AS (
  SELECT CAST(job_id AS VARCHAR) AS job_id, event_id AS event_index,
    CASE WHEN event_type = 'purchase' THEN TIMESTAMP '2024-01-31 00:00:00' ELSE ts END AS "timestamp",
    CASE WHEN event_type = 'view' THEN 'unknown' ELSE source END AS source,
    CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END AS event_type,
    CASE WHEN event_type <> 'click' THEN severity END AS severity, message,
    CASE WHEN event_type = 'error' THEN 'unknown' ELSE ai_category END AS ai_category,
    CASE WHEN event_type <> 'error' THEN ai_root_cause END AS ai_root_cause,
    CASE WHEN event_type = 'error' THEN '' ELSE ai_recommended_action END AS ai_recommended_action,
    CASE WHEN event_type = 'error' THEN 0.0 ELSE confidence_score END AS confidence_score
  FROM ev WHERE event_type <> 'signup')""", f"d AS (SELECT *, confidence_score AS c, ai_category AS k, lower(coalesce(severity, '')) AS s FROM m)",
    select=f"""
SELECT 'hot' AS consumer, job_id, event_index, "timestamp", source, event_type, coalesce(severity, 'ERROR') AS severity,
  message, ai_category, coalesce(ai_root_cause, 'unknown') AS ai_root_cause, ai_recommended_action, confidence_score,
  false AS requires_review, '' AS review_reason FROM d
UNION ALL SELECT 'cold', job_id, event_index, "timestamp", source, event_type, coalesce(severity, 'INFO'), message,
  ai_category, coalesce(ai_root_cause, ''), ai_recommended_action, confidence_score, false, NULL FROM d
UNION ALL SELECT 'deadletter', job_id, event_index, "timestamp", source, event_type, coalesce(severity, 'UNKNOWN'), message,
  ai_category, coalesce(ai_root_cause, ''), ai_recommended_action, confidence_score, true, {_DEAD_REASON} FROM d"""))
def consumer_rows(spark, sf_dir):
    as_of = F.lit(B.AS_OF).cast("timestamp")
    messages = _messages(spark, sf_dir)
    result = None
    for consumer in ("hot", "cold", "deadletter"):
        rows = event_rows(messages, consumer, as_of).withColumn("consumer", F.lit(consumer))
        result = rows if result is None else result.unionByName(rows)
    return result.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("b16_alerts", B.sql(B.EVENTS_SQL, select="""
SELECT TIMESTAMP '2024-01-31 00:00:00' AS "timestamp", job_id, source, severity, message, ai_category AS category,
  confidence_score AS confidence, CASE severity WHEN 'CRITICAL' THEN 'logs.p0' ELSE 'logs.p1' END AS topic,
  ai_recommended_action AS action
FROM ev WHERE NOT requires_review AND severity IN ('CRITICAL', 'ERROR')
  AND NOT (ai_category = 'unknown' AND severity = 'ERROR')"""))
def alerts(spark, sf_dir):
    events = B.events(spark, sf_dir).withColumn("topic", routing.route_topic(
        F.col("requires_review"), F.col("confidence_score"), F.col("ai_category"), F.col("severity")
    ))
    urgent = events.filter(F.col("topic").isin(C.TOPIC_P0, C.TOPIC_P1))
    return alert_rows(urgent, F.col("topic"), F.lit(B.AS_OF).cast("timestamp_ntz"))


@query("b17_flatten_result", B.sql(B.EVENTS_SQL, select="""
SELECT event_id, source, ai_category, ai_root_cause, ai_recommended_action, confidence_score FROM ev"""))
def flatten_result(spark, sf_dir):
    nested = B.events(spark, sf_dir).select("event_id", "source", F.struct(
        F.col("ai_category").alias("category"), F.col("ai_root_cause").alias("root_cause"),
        F.col("ai_recommended_action").alias("recommended_action"), F.col("confidence_score").alias("confidence"),
    ).alias("ai_normalized"))
    return classify.flatten_result(nested)


# Events with their rule applied, as SQL.
SCORED_SQL = """scored AS (
  SELECT *, (has_rule AND rule_category IS DISTINCT FROM ai_category) AS conflict,
    greatest(0.0, least(1.0, confidence_score
      + CASE WHEN NOT has_rule THEN 0.0 WHEN rule_category IS DISTINCT FROM ai_category THEN -0.1 ELSE 0.15 END
      + CASE WHEN has_rule THEN coalesce(rule_boost, 0.0) ELSE 0.0 END)) AS exact_confidence
  FROM (SELECT ev.*, best.source IS NOT NULL AS has_rule, rule_category, rule_action, rule_boost
        FROM ev LEFT JOIN best USING (source))),
decided AS (
  SELECT *, exact_confidence < 0.85 OR conflict AS review,
    coalesce(rule_category, ai_category) AS final_category, coalesce(rule_action, ai_recommended_action) AS final_action,
    round(exact_confidence, 3) AS final_confidence
  FROM scored),
routed AS (
  SELECT *, CASE WHEN review THEN NULL
      WHEN final_confidence < 0.3 OR (final_category = 'unknown' AND severity = 'ERROR') THEN 'logs.deadletter'
      WHEN severity = 'CRITICAL' THEN 'logs.p0' WHEN severity = 'ERROR' THEN 'logs.p1' ELSE 'logs.p2' END AS topic
  FROM decided)"""
SCORED_VIEWS = (B.EVENTS_SQL, B.DECISIONS_SQL, B.RULES_SQL, B.BEST_RULES_SQL, SCORED_SQL)


@query("b18_confidence", B.sql(*SCORED_VIEWS, select="""
SELECT event_id, final_category AS category, final_action AS action, round(exact_confidence, 8) AS confidence,
       conflict FROM decided"""))
def confidence(spark, sf_dir):
    scored = scored_events(B.events(spark, sf_dir), B.rules(spark, sf_dir))
    return scored.select(
        "event_id", F.col("final_category").alias("category"), F.col("final_action").alias("action"),
        F.round("exact_confidence", 8).alias("confidence"), F.col("review_reason").isNotNull().alias("conflict"),
    )


@query("b18_missing_fields", B.sql(B.EVENTS_SQL, select="""
SELECT event_id, round(greatest(0.0, confidence_score - CASE event_type WHEN 'view' THEN 0.1 WHEN 'click' THEN 0.2
  WHEN 'error' THEN 0.3 ELSE 0.0 END), 8) AS confidence FROM ev"""))
def missing_fields(spark, sf_dir):
    kind = F.col("event_type")
    none = F.lit(None).cast("string")
    score = scoring.combined_confidence(
        F.col("confidence_score"),
        F.when(kind.isin("view", "click", "error"), "unknown").otherwise(F.col("source")),
        F.when(kind.isin("click", "error"), "").otherwise(kind),
        F.when(kind != "error", F.col("message")),
        F.col("ai_category"), F.lit(False), none, F.lit(None).cast("double"),
    )
    return B.events(spark, sf_dir).select("event_id", F.round(score, 8).alias("confidence"))


def _novelty():
    return F.round(F.least(F.lit(1.0), F.floor(F.col("value")) / 100), 2)


@query("b19_review_and_reason", B.sql(B.EVENTS_SQL, select="""
SELECT event_id, confidence_score < 0.7 OR ai_category = 'safety' OR novelty >= 0.72 AS review,
  nullif(concat_ws(' | ', CASE WHEN ai_category = 'safety' THEN 'Rule and AI categorization conflict' END,
    CASE WHEN novelty >= 0.72 THEN 'ML anomaly detected (novelty_score=' || printf('%.2f', novelty) || ')' END), '') AS reason,
  coalesce(nullif(concat_ws(' | ', CASE WHEN ai_category = 'safety' THEN 'Rule and AI categorization conflict' END,
    CASE WHEN novelty >= 0.72 THEN 'ML anomaly detected (novelty_score=' || printf('%.2f', novelty) || ')' END), ''),
    'Low confidence in categorization') AS queue_reason
FROM (SELECT *, round(least(1.0, floor("value") / 100), 2) AS novelty FROM ev)"""))
def review_and_reason(spark, sf_dir):
    """Review predicate, reason composition and anomaly escalation (B19, B20, K3)."""
    reason = scoring.review_reason(F.col("ai_category") == "safety", _novelty())
    return B.events(spark, sf_dir).select(
        "event_id",
        scoring.requires_review(F.col("confidence_score"), reason, _novelty(), threshold=0.7).alias("review"),
        reason.alias("reason"), scoring.queue_reason(reason).alias("queue_reason"),
    )


@query("b20_review_reasons", B.sql(*SCORED_VIEWS, select="""
SELECT event_id, CASE WHEN conflict THEN 'Rule and AI categorization conflict' ELSE 'Low confidence in categorization' END
  AS reason FROM decided WHERE review"""))
def review_reasons(spark, sf_dir):
    """Reasons shown in the queue for the events that go to review after scoring."""
    due = scored_events(B.events(spark, sf_dir), B.rules(spark, sf_dir)).filter("requires_review")
    return due.select("event_id", scoring.queue_reason(F.col("review_reason")).alias("reason"))


@query("b21_route", B.sql(*SCORED_VIEWS, select="SELECT event_id, topic FROM routed"))
def route(spark, sf_dir):
    return scored_events(B.events(spark, sf_dir), B.rules(spark, sf_dir)).select("event_id", "topic")


@query("k3_anomaly_escalation", B.sql(B.EVENTS_SQL, select="""
SELECT event_id, novelty AS novelty_score, 'ML anomaly detected (novelty_score=' || printf('%.2f', novelty) || ')' AS reason
FROM (SELECT *, round(least(1.0, floor("value") / 100), 2) AS novelty FROM ev WHERE NOT requires_review)
WHERE novelty >= 0.72"""))
def anomaly_escalation(spark, sf_dir):
    """Events sent to review by their novelty alone."""
    sure = B.events(spark, sf_dir).filter(~F.col("requires_review")).withColumn("novelty_score", _novelty())
    reason = scoring.review_reason(F.lit(False), F.col("novelty_score"))
    due = scoring.requires_review(F.col("confidence_score"), reason, F.col("novelty_score"))
    return sure.filter(due).select("event_id", "novelty_score", reason.alias("reason"))


_NOVEL_SQL = """novel AS (
  SELECT *, review OR novelty >= 0.72 AS due FROM (
    SELECT *, round(least(1.0, floor("value") / 100), 2) AS novelty FROM decided))"""


@query("p2_scored_events", B.sql(*SCORED_VIEWS, _NOVEL_SQL, select="""
SELECT event_id, due AS requires_review, final_category AS category, round(exact_confidence, 8) AS confidence,
  CASE WHEN due THEN NULL
    WHEN final_confidence < 0.3 OR (final_category = 'unknown' AND severity = 'ERROR') THEN 'logs.deadletter'
    WHEN severity = 'CRITICAL' THEN 'logs.p0' WHEN severity = 'ERROR' THEN 'logs.p1' ELSE 'logs.p2' END AS topic
FROM novel WHERE event_id % 10 <> 3"""))
def scored_from_records(spark, sf_dir):
    """Duplicates split off, rules, a given novelty score, review and route in one entry."""
    events = B.events(spark, sf_dir).withColumns({"novelty_score": _novelty(), "is_duplicate": F.col("event_id") % 10 == 3})
    scored = normalize_logs(events, B.rules(spark, sf_dir))
    return scored.select(
        "event_id", "requires_review", F.col("final_category").alias("category"),
        F.round("exact_confidence", 8).alias("confidence"), "topic",
    )


@query("k3_forest_escalation")
def forest_escalation(spark, sf_dir):
    """The same with the scores of a forest fitted to the events."""
    events = with_features(B.as_events(B.wide_table(spark, sf_dir, "events")))
    pool = joins.approved_pool(events, B.jobs(spark, sf_dir))
    scored = normalize_logs(events, B.rules(spark, sf_dir), pool, iforest.fit_forest(events))
    return scored.select("event_id", "novelty_score", "review_reason", "topic", F.size("examples").alias("n_examples"))


@query("b22_route_decision", B.sql(B.EVENTS_SQL, select="""
SELECT event_id,
  CASE WHEN requires_review THEN NULL WHEN ai_category = 'unknown' AND severity = 'ERROR' THEN 'logs.deadletter'
       WHEN severity = 'CRITICAL' THEN 'logs.p0' WHEN severity = 'ERROR' THEN 'logs.p1' ELSE 'logs.p2' END AS topic,
  CASE WHEN requires_review THEN 'review' ELSE 'routed' END AS status,
  CASE WHEN requires_review THEN 'Low confidence' END AS reason
FROM ev"""))
def route_decision(spark, sf_dir):
    topic = routing.route_topic(
        F.col("requires_review"), F.col("confidence_score"), F.col("ai_category"), F.col("severity")
    )
    decision = routing.route_decision(topic, F.lit(None).cast("string"))
    return B.events(spark, sf_dir).select("event_id", decision.alias("d")).select("event_id", "d.*")


@query("b23_dead_letter_reason", B.sql(B.EVENTS_SQL, select=f"""
SELECT event_id, {_DEAD_REASON} AS reason
FROM (SELECT event_id, confidence_score AS c, ai_category AS k, lower(severity) AS s FROM ev)"""))
def dead_letter_reason(spark, sf_dir):
    reason = routing.dead_letter_reason(F.col("confidence_score"), F.col("ai_category"), F.col("severity"))
    return B.events(spark, sf_dir).select("event_id", reason.alias("reason"))


FEATURE_NAMES = ["severity_code", "confidence", "category_code", "has_source", "has_event_type", "message_length", "review"]


def with_features(events):
    return events.withColumn("features", scoring.feature_vector(
        F.col("severity"), F.col("confidence_score"), F.col("ai_category"), F.col("source"), F.col("event_type"),
        F.col("message"), F.col("requires_review"),
    ))


@query("b24_feature_vector", B.sql(B.EVENTS_SQL, select=f"""
SELECT event_id, {_code_case('severity', C.SEVERITY_CODES, 0)} AS severity_code, confidence_score AS confidence,
  {_code_case('ai_category', C.CATEGORY_CODES, 9)} AS category_code, 1.0::DOUBLE AS has_source,
  1.0::DOUBLE AS has_event_type, round(least(length(message) / 500.0, 1.0), 8) AS message_length,
  CASE WHEN requires_review THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS review FROM ev"""))
def feature_vector(spark, sf_dir):
    rows = with_features(B.events(spark, sf_dir))
    return rows.select("event_id", *[F.round(F.col("features")[i], 8).alias(n) for i, n in enumerate(FEATURE_NAMES)])


@query("b25_category_names", """
SELECT p_partkey, CASE WHEN regexp_matches(lower(trim(n)), '^[a-z][a-z0-9_]{0,31}$') THEN lower(trim(n)) END AS clean
FROM (SELECT p_partkey, CASE WHEN p_size <= 25 THEN ' ' || p_type || '_' || CAST(p_size AS VARCHAR) || ' '
        WHEN p_size <= 40 THEN p_name ELSE CAST(p_size AS VARCHAR) || p_type END AS n FROM part)""")
def category_names(spark, sf_dir):
    size = F.col("p_size")
    name = F.when(size <= 25, F.concat(F.lit(" "), F.col("p_type"), F.lit("_"), size.cast("string"), F.lit(" "))).when(
        size <= 40, F.col("p_name")).otherwise(F.concat(size.cast("string"), F.col("p_type")))
    return B.table(spark, sf_dir, "part").select("p_partkey", classify.valid_category_name(name).alias("clean"))


@query("b26_job_status", B.sql(B.EVENTS_SQL, select="""
SELECT job_id, CASE WHEN n_ok = 0 THEN 'failed' WHEN n_errors > 0 THEN 'partial_success' ELSE 'success' END AS status
FROM (SELECT job_id, count(*) FILTER (event_type = 'signup') AS n_errors, count(*) FILTER (event_type <> 'signup') AS n_ok
      FROM ev GROUP BY job_id)"""))
def job_status(spark, sf_dir):
    broken = F.col("event_type") == "signup"
    jobs = B.events(spark, sf_dir).groupBy("job_id").agg(F.count_if(broken).alias("errors"), F.count_if(~broken).alias("good"))
    return jobs.select("job_id", routing.job_status(F.col("errors"), F.col("good") == 0).alias("status"))


@query("b28_score_bands", B.sql(B.EVENTS_SQL, select="""
SELECT event_id, CASE WHEN confidence_score >= 0.7 THEN 'high' WHEN confidence_score >= 0.5 THEN 'medium' ELSE 'low' END
  AS confidence_band, CASE WHEN round(least(1.0, floor("value") / 100), 2) >= 0.58 THEN 'anomaly' ELSE 'normal' END
  AS novelty_band FROM ev"""))
def score_bands(spark, sf_dir):
    return B.events(spark, sf_dir).select(
        "event_id", scoring.confidence_band(F.col("confidence_score")).alias("confidence_band"),
        scoring.novelty_band(_novelty()).alias("novelty_band"),
    )


@query("b31_severity_filter", B.sql(B.EVENTS_SQL, select="""
SELECT event_id, severity FROM ev WHERE upper(severity) IN ('CRITICAL', 'ERROR')"""))
def severity_filter(spark, sf_dir):
    lowered = B.events(spark, sf_dir)
    return lowered.filter(rollups.severity_is(["critical", "Error"])).select("event_id", "severity")


@query("b32_time_range", B.sql(B.EVENTS_SQL, select="""
SELECT event_id, ts FROM ev WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 168 HOUR"""))
def time_range(spark, sf_dir):
    return rollups.since(B.events(spark, sf_dir), B.AS_OF, 168, inclusive=False).select("event_id", "ts")


@query("b33_queue_filter", B.sql(B.EVENTS_SQL, B.JOBS_SQL, select="""
SELECT event_id, ts, source, severity FROM ev LEFT JOIN jobs USING (job_id)
WHERE requires_review AND coalesce(status, 'pending') = 'pending' AND severity = 'ERROR' AND source = 'tool_ETCH-01'"""))
def queue_filter(spark, sf_dir):
    queue = joins.pending_reviews(B.events(spark, sf_dir), B.jobs(spark, sf_dir), sort=False)
    return joins.filter_queue(queue, "ERROR", "tool_ETCH-01").select("event_id", "ts", "source", "severity")
