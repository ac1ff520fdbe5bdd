"""Order-dependent operators: duplicates (C8, C9, E23, F1), sequences (F), alerts (F8, G3), isolation forest (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fablens import constants as C
from fablens.operators import dedup, iforest, listings, sequences
from fablens.plans import bindings as B
from fablens.plans.registry import query
from fablens.plans.scoring_queries import with_features
from fablens.sources.files import content_hash

# ---- duplicates --------------------------------------------------------------------------------------------

# A chain of registrations per hash: each is the first copy at or after the expiry of the one before.
_CHAIN = """reg(hash, t, job) AS (
  SELECT hash, (m).t, (m).job FROM (SELECT hash, min({{'t': t, 'job': job}}) AS m FROM copies GROUP BY hash)
  UNION ALL
  SELECT hash, (m).t, (m).job FROM (
    SELECT reg.hash, min({{'t': c.t, 'job': c.job}}) AS m FROM reg JOIN copies c
      ON c.hash = reg.hash AND c.t >= reg.t + INTERVAL {ttl} SECOND GROUP BY reg.hash)),
marked AS (
  SELECT c.hash, c.job, c.t, max({{'t': reg.t, 'job': reg.job}}) AS r
  FROM copies c JOIN reg ON reg.hash = c.hash AND (reg.t < c.t OR (reg.t = c.t AND reg.job <= c.job))
  GROUP BY ALL)"""


def chain_sql(copies: str, views: str, select: str, ttl: int = 86_400) -> str:
    return f"WITH RECURSIVE {views},\ncopies AS ({copies}),\n{_CHAIN.format(ttl=ttl)}\n{select.strip()}"


DOC_COPIES = "SELECT sha256(text) AS hash, ts AS t, job_id AS job FROM files WHERE text <> ''"


def _hashed_files(spark, sf_dir):
    files = B.files(spark, sf_dir).filter(F.col("text") != "")
    return files.select("job_id", "ts", "file_name", content_hash(F.col("text")).alias("file_hash"))


@query("f1_first_seen", chain_sql(
    "SELECT sha256(source || '|' || event_type) AS hash, ts AS t, event_id AS job FROM ev", B.EVENTS_SQL, """
SELECT job AS event_id, (r).job AS original_job_id, (r).t AS first_seen, (r).job <> job AS is_duplicate FROM marked"""))
def first_seen(spark, sf_dir):
    """Repeated reports of a machine: long chains with many expiries per key."""
    reports = B.events(spark, sf_dir).select(
        "event_id", "ts", F.sha2(F.concat_ws("|", "source", "event_type"), 256).alias("file_hash")
    )
    marked = dedup.mark_duplicates(reports, job_id="event_id")
    return marked.select("event_id", "original_job_id", "first_seen", "is_duplicate")


@query("c8_duplicate_lookup", chain_sql(
    DOC_COPIES + " UNION ALL SELECT * FROM seen",
    B.FILES_SQL + """, seen AS (
  SELECT sha256(text) AS hash, max(ts) - INTERVAL 36 HOUR AS t, -1 - max(job_id) AS job FROM files
  WHERE text <> '' AND lang <> 'en' GROUP BY 1)""", """
SELECT job AS job_id, (r).job AS original_job_id, (r).t AS first_seen, (r).job <> job AS is_duplicate
FROM marked WHERE job >= 0"""))
def duplicate_lookup(spark, sf_dir):
    """Documents against a table of earlier registrations, with expiry."""
    files = _hashed_files(spark, sf_dir)
    other = B.files(spark, sf_dir).filter((F.col("text") != "") & (F.col("lang") != "en"))
    seen = other.groupBy(content_hash(F.col("text")).alias("file_hash")).agg(
        (F.max("ts") - F.make_dt_interval(hours=F.lit(36))).alias("first_seen"), (-1 - F.max("job_id")).alias("job_id")
    )
    marked = dedup.mark_duplicates(files, seen=seen)
    return marked.select("job_id", "original_job_id", "first_seen", "is_duplicate")


@query("c8_unhashed_files", chain_sql(
    "SELECT hash, t, job FROM given WHERE hash IS NOT NULL AND t IS NOT NULL", B.FILES_SQL + """, given AS (
  SELECT job_id AS job, CASE WHEN text <> '' AND lang <> 'fr' THEN sha256(text) END AS hash,
    CASE WHEN job_id % 7 <> 0 THEN ts END AS t FROM files)""", """
SELECT job AS job_id, 'registered' AS state, (r).t AS first_seen FROM marked WHERE (r).job = job
UNION ALL SELECT job, 'untold', NULL FROM given WHERE hash IS NULL OR t IS NULL"""))
def unhashed_files(spark, sf_dir):
    """The files to go on with, where some have no hash or no time: those pass."""
    known = (F.col("text") != "") & (F.col("lang") != "fr")
    files = B.files(spark, sf_dir).select(
        "job_id", F.when(F.col("job_id") % 7 != 0, F.col("ts")).alias("ts"),
        F.when(known, content_hash(F.col("text"))).alias("file_hash"),
    )
    new = dedup.split_duplicates(dedup.mark_duplicates(files))
    state = F.when(F.col("original_job_id").isNull(), "untold").when(F.col("original_job_id") == F.col("job_id"), "registered")
    return new.select("job_id", state.alias("state"), "first_seen")


@query("c9_active_registrations", chain_sql(DOC_COPIES, B.FILES_SQL, """
SELECT hash AS file_hash, job AS job_id, t AS first_seen, ttl AS ttl_remaining FROM (
  SELECT hash, max_by(job, (t, job)) AS job, max(t) AS t, 86400 - date_diff('second', max(t),
    (SELECT max(ts) FROM files)) AS ttl FROM reg GROUP BY hash) WHERE ttl > 0"""))
def active_registrations(spark, sf_dir):
    files = _hashed_files(spark, sf_dir)
    as_of = B.files(spark, sf_dir).agg(F.max("ts").alias("m")).first()["m"]
    return dedup.active_registrations(dedup.mark_duplicates(files), as_of)


@query("e23_duplicate_summary", chain_sql(DOC_COPIES, B.FILES_SQL, """
SELECT count(*) AS total_checked, count(*) FILTER ((r).job <> job) AS duplicates_found,
       count(*) FILTER ((r).job = job) AS new_files FROM marked"""))
def duplicate_summary(spark, sf_dir):
    return dedup.batch_summary(dedup.mark_duplicates(_hashed_files(spark, sf_dir)))


# ---- sequences ---------------------------------------------------------------------------------------------

_RUNS_SQL = """steps AS (
  SELECT *, lag("value") OVER w AS prev_value, lag(ts) OVER w AS prev_ts,
    CAST(sign("value" - lag("value") OVER w) AS INT) AS direction
  FROM ev WINDOW w AS (PARTITION BY source ORDER BY ts, event_id)),
marked AS (
  SELECT *, CASE WHEN direction <> 0 AND direction = lag(direction) OVER w THEN 0 ELSE 1 END AS starts
  FROM steps WINDOW w AS (PARTITION BY source ORDER BY ts, event_id)),
islands AS (SELECT *, sum(starts) OVER (PARTITION BY source ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (
  SELECT source, max(direction) AS direction, count(*) + 1 AS n_events, min(prev_ts) AS start_ts, max(ts) AS end_ts,
    min_by(prev_value, (ts, event_id)) AS first_value, max_by("value", (ts, event_id)) AS last_value
  FROM islands WHERE direction <> 0 GROUP BY source, run)"""


@query("f4_numeric_runs", B.sql(B.EVENTS_SQL, _RUNS_SQL, select="SELECT * FROM runs WHERE n_events >= 3"))
def numeric_runs(spark, sf_dir):
    return sequences.numeric_runs(B.events(spark, sf_dir), 3)


_NO_MACHINE_SQL = f"""{B.EVENTS_SQL.replace('ev AS (', 'given AS (', 1)},
ev AS (SELECT * EXCLUDE source, CASE WHEN event_id % 5 <> 0 THEN source END AS source FROM given)"""


@query("f4_null_machines", B.sql(_NO_MACHINE_SQL, _RUNS_SQL, select="SELECT * FROM runs WHERE n_events >= 3"))
def null_machines(spark, sf_dir):
    """A fifth of the events without a machine, in the split form for hot machines."""
    events = B.events(spark, sf_dir).withColumn("source", F.when(F.col("event_id") % 5 != 0, F.col("source")))
    return sequences.numeric_runs(events, 3, max_group_rows=100)


_ESCALATIONS_SQL = """esc AS (
  SELECT source, ts, event_id, severity, prev_severity, code - lag_code AS levels FROM (
    SELECT *, lag(severity) OVER w AS prev_severity, lag(code) OVER w AS lag_code FROM (
      SELECT *, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'ERROR' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END AS code FROM ev)
    WINDOW w AS (PARTITION BY source ORDER BY ts, event_id))
  WHERE code > lag_code)"""


@query("f5_severity_escalations", B.sql(B.EVENTS_SQL, _ESCALATIONS_SQL, select="SELECT * FROM esc"))
def severity_escalations(spark, sf_dir):
    return sequences.severity_escalations(B.events(spark, sf_dir))


_GAPS_SQL = """gap AS (
  SELECT source, event_type, ts, event_id, lag(ts) OVER w AS prev_ts, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_us
  FROM ev WINDOW w AS (PARTITION BY source, event_type ORDER BY ts, event_id)),
gapm AS (
  SELECT *, CASE WHEN gap_us < lag(gap_us) OVER (PARTITION BY source, event_type ORDER BY ts, event_id) THEN 0 ELSE 1 END
    AS starts FROM gap),
gapi AS (SELECT *, sum(starts) OVER (PARTITION BY source, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run
  FROM gapm),
shrink AS (
  SELECT source, event_type, count(*) AS n_gaps, min(prev_ts) AS start_ts, max(ts) AS end_ts, max(gap_us) AS first_gap_us,
    min(gap_us) AS last_gap_us FROM gapi WHERE gap_us IS NOT NULL GROUP BY source, event_type, run)"""


@query("f6_shrinking_gaps", B.sql(B.EVENTS_SQL, _GAPS_SQL, select="SELECT * FROM shrink WHERE n_gaps >= 3"))
def shrinking_gaps(spark, sf_dir):
    return sequences.shrinking_gaps(B.events(spark, sf_dir), 3)


_SHIFTS_SQL = """shifts AS (
  SELECT source, ts, event_id, ai_category, severity, prev_category FROM (
    SELECT *, lag(ai_category) OVER (PARTITION BY source ORDER BY ts, event_id) AS prev_category FROM ev)
  WHERE prev_category <> ai_category AND (ai_category = 'safety' OR severity = 'CRITICAL'))"""


@query("f7_safety_shifts", B.sql(B.EVENTS_SQL, _SHIFTS_SQL, select="SELECT * FROM shifts"))
def safety_shifts(spark, sf_dir):
    return sequences.safety_shifts(B.events(spark, sf_dir))


_SLOPE_SQL = f"""slopes AS (
  SELECT source, max_by("value", (ts, event_id)) AS last_value, regr_slope("value", epoch_us(ts) / 3600000000.0) AS slope
  FROM ev WHERE "value" IS NOT NULL GROUP BY source),
estimates AS (
  SELECT source, last_value, round(slope, 6) AS slope_per_hour,
    CASE WHEN last_value >= {B.LIMIT} THEN 'now' WHEN slope > 0 AND last_value < {B.LIMIT}
      THEN '~' || CAST(CAST(round(({B.LIMIT} - last_value) / slope * 60) AS BIGINT) AS VARCHAR) || ' minutes'
      ELSE 'N/A' END AS estimate
  FROM slopes)"""


@query("f10_time_to_critical", B.sql(B.EVENTS_SQL, _SLOPE_SQL, select="SELECT * FROM estimates"))
def time_to_critical(spark, sf_dir):
    return sequences.time_to_critical(B.events(spark, sf_dir), B.LIMIT)


_ALERTS_SQL = f"""found AS (
  SELECT m.source, m.last_severity, m.last_ts, e.estimate,
    coalesce(r.n, 0) AS n_runs, coalesce(c.n, 0) AS n_escalations, coalesce(g.n, 0) AS n_shrinking, coalesce(s.n, 0) AS n_shifts
  FROM (SELECT source, max_by(severity, (ts, event_id)) AS last_severity, max(ts) AS last_ts FROM ev GROUP BY source
        HAVING count(*) >= 2) m
  LEFT JOIN (SELECT source, count(*) AS n FROM runs WHERE n_events >= 5 GROUP BY source) r USING (source)
  LEFT JOIN (SELECT source, count(*) AS n FROM esc GROUP BY source) c USING (source)
  LEFT JOIN (SELECT source, count(*) AS n FROM shrink WHERE n_gaps >= 5 GROUP BY source) g USING (source)
  LEFT JOIN (SELECT source, count(*) AS n FROM shifts GROUP BY source) s USING (source)
  LEFT JOIN estimates e USING (source)),
alerts AS (
  SELECT source AS machine,
    concat_ws('; ', CASE WHEN n_runs > 0 THEN n_runs || ' monotone value runs' END,
      CASE WHEN n_escalations > 0 THEN n_escalations || ' severity escalations' END,
      CASE WHEN n_shrinking > 0 THEN n_shrinking || ' repeats at shrinking gaps' END,
      CASE WHEN n_shifts > 0 THEN n_shifts || ' shifts toward safety or critical' END) AS pattern,
    CASE WHEN last_severity IN ('CRITICAL', 'ERROR') OR n_shifts > 0 THEN 'critical' ELSE 'warning' END AS predicted_severity,
    coalesce(estimate, 'N/A') AS estimated_time_to_critical,
    CASE WHEN last_severity IN ('CRITICAL', 'ERROR') OR n_shifts > 0 THEN 'Inspect ' || source || ' now'
         ELSE 'Monitor ' || source END AS recommended_action,
    round(0.25 * ((n_runs > 0)::INT + (n_escalations > 0)::INT + (n_shrinking > 0)::INT + (n_shifts > 0)::INT), 2)::DOUBLE
      AS confidence,
    last_ts AS created_at
  FROM found WHERE n_runs > 0 OR n_escalations > 0 OR n_shrinking > 0 OR n_shifts > 0)"""
ALERT_VIEWS = (B.EVENTS_SQL, _RUNS_SQL, _ESCALATIONS_SQL, _GAPS_SQL, _SHIFTS_SQL, _SLOPE_SQL, _ALERTS_SQL)


@query("f8_trend_alerts", B.sql(*ALERT_VIEWS, select="SELECT * FROM alerts"))
def trend_alerts(spark, sf_dir):
    return sequences.trend_alerts(B.events(spark, sf_dir), B.LIMIT)


@query("g3_latest_alerts", B.sql(*ALERT_VIEWS, select="SELECT * FROM alerts ORDER BY created_at DESC, machine LIMIT 50"))
def latest_alerts(spark, sf_dir):
    return listings.latest_alerts(sequences.trend_alerts(B.events(spark, sf_dir), B.LIMIT), 50)


@query("f3_rolling_spikes", B.sql(B.EVENTS_SQL, select="""
SELECT DISTINCT ts, count(*) OVER (PARTITION BY ts) AS n_at_ts,
  count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS window_count,
  count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) >= 10 AS spike FROM ev"""))
def rolling_spikes(spark, sf_dir):
    """Trailing counts; the horizon is an hour, as the table has few events per five minutes."""
    return sequences.rolling_counts(B.events(spark, sf_dir), 3600)


@query("f3_rolling_spikes_300s", B.sql(B.EVENTS_SQL, select="""
SELECT ts, 1::BIGINT AS n_at_ts, count(*) OVER w AS window_count, count(*) OVER w >= 3 AS spike FROM ev
WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 300 SECOND PRECEDING AND CURRENT ROW)"""))
def rolling_spikes_300s(spark, sf_dir):
    return sequences.rolling_counts(B.events(spark, sf_dir), 300, 3)


@query("f9_refit_epochs", """
SELECT event_id, ts, n, CASE WHEN n < 50 THEN 0 ELSE n // 20 - 1 END AS epoch
FROM (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS n FROM events)""")
def refit_epochs(spark, sf_dir):
    return sequences.refit_epochs(B.events(spark, sf_dir))


# ---- isolation forest --------------------------------------------------------------------------------------

@query("k1_forest_fit")
def forest_fit(spark, sf_dir):
    """Node table of a forest over the events' feature vectors."""
    return iforest.fit_forest(with_features(B.events(spark, sf_dir)))


@query("k1_tree_samples", B.sql(B.EVENTS_SQL, select="""
SELECT tree, event_id AS row_id, draw FROM (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY draw, event_id) AS n FROM (
    SELECT event_id, g * 13 + k AS tree,
      (CAST('0x' || substr(md5(event_id || '|' || g // 4 || '|42'), 1 + 8 * (g % 4), 8) AS BIGINT) + k * 330382099) % 4294967296 AS draw
    FROM ev, (SELECT unnest(range(8)) AS g), (SELECT unnest(range(13)) AS k)))
WHERE n <= 256 AND tree < 100"""))
def tree_samples(spark, sf_dir):
    """The rows each tree is grown on."""
    rows = with_features(B.events(spark, sf_dir))
    drawn = iforest.tree_samples(rows, "event_id", "features", rows.count())
    return drawn.select(F.col("tree").cast("long").alias("tree"), "row_id", "draw")


@query("k1_forest_shape", "SELECT 100::BIGINT AS trees, least(256, count(*)) AS root_size, true AS shallow FROM events")
def forest_shape(spark, sf_dir):
    nodes = iforest.fit_forest(with_features(B.events(spark, sf_dir)))
    return nodes.agg(
        F.countDistinct("tree").alias("trees"), F.min(F.when(F.col("node") == 0, F.col("size"))).cast("long").alias("root_size"),
        (F.max("depth") <= 8).alias("shallow"),
    )


def _mean_path_sql(size: int) -> str:
    return f"{float(iforest._mean_path(size))!r}::DOUBLE"


# Two literal trees over a sample of eight rows: node, feature, cut, left, right, size, depth.
_LITERAL_FOREST = [
    (0, 0, 0, 1.5, 1, 2, 8, 0), (0, 1, -1, 0.0, -1, -1, 3, 1), (0, 2, -1, 0.0, -1, -1, 5, 1),
    (1, 0, 1, 0.5, 1, 2, 8, 0), (1, 1, -1, 0.0, -1, -1, 4, 1), (1, 2, 5, 0.09, 3, 4, 4, 1),
    (1, 3, -1, 0.0, -1, -1, 1, 2), (1, 4, -1, 0.0, -1, -1, 3, 2),
]


@query("k2_literal_forest", B.sql(B.EVENTS_SQL, select=f"""
SELECT event_id, round(power(2.0, -(a + b) / 2 / {_mean_path_sql(8)}), 4) AS novelty_score FROM (
  SELECT event_id,
    CASE WHEN CASE severity WHEN 'CRITICAL' THEN {C.SEVERITY_CODES['critical']} WHEN 'ERROR' THEN {C.SEVERITY_CODES['error']}
      WHEN 'WARNING' THEN {C.SEVERITY_CODES['warning']} ELSE {C.SEVERITY_CODES['info']} END <= 1.5
      THEN 1 + {_mean_path_sql(3)} ELSE 1 + {_mean_path_sql(5)} END AS a,
    CASE WHEN confidence_score <= 0.5 THEN 1 + {_mean_path_sql(4)}
      WHEN least(length(message) / 500.0, 1.0) <= 0.09 THEN 2 + {_mean_path_sql(1)} ELSE 2 + {_mean_path_sql(3)} END AS b
  FROM ev)"""))
def literal_forest(spark, sf_dir):
    """Path lengths and scores under a small forest that SQL can follow as well."""
    names = iforest.NODE_SCHEMA
    forest = spark.createDataFrame([(*node, 8) for node in _LITERAL_FOREST], names)
    rows = with_features(B.as_events(B.wide_table(spark, sf_dir, "events")))
    return rows.select("event_id", iforest.novelty(forest, F.col("features")).alias("novelty_score"))


@query("k2_forest_score")
def forest_score(spark, sf_dir):
    rows = with_features(B.as_events(B.wide_table(spark, sf_dir, "events")))
    forest = iforest.fit_forest(rows)
    return rows.select("event_id", iforest.novelty(forest, F.col("features")).alias("novelty_score"))


@query("k2_embedding_novelty")
def embedding_novelty(spark, sf_dir):
    """The same on vectors of a larger dimension."""
    rows = B.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    forest = iforest.fit_forest(rows, row_id="vec_id")
    return rows.select("vec_id", iforest.novelty(forest, F.col("features")).alias("novelty_score"))
