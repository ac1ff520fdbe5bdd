"""Sources and sinks (A) and standardisation (B1-B9)."""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark.sql import functions as F

from fablens.functions import standardize, text
from fablens.operators.joins import with_rule_fields
from fablens.plans import bindings as B
from fablens.plans.registry import query
from fablens.session import scratch_path, stored
from fablens.sources import files as S
from fablens.sources import large


# Bytes of a dump's file; larger dumps are written in parts.
DUMP_PART_BYTES = 256 << 20


def _as_of():
    return F.lit(B.AS_OF).cast("timestamp")


def _index():
    """Record index; -1 for an error of the whole document."""
    return F.coalesce("record_index", F.lit(-1)).alias("record_index")


def _as_files(spark, sf_dir):
    """Documents in the form of the binary file source."""
    return B.files(spark, sf_dir).select(
        F.concat(F.lit("/uploads/"), "file_name").alias("path"),
        F.col("ts").cast("timestamp").alias("modificationTime"),
        F.octet_length("text").cast("long").alias("length"),
        F.col("text").cast("binary").alias("content"),
    )


@query("a1_ingest_files", B.sql(B.FILES_SQL, select="""
SELECT job_id, file_name, 'raw_logs/' || job_id || '/' || file_name AS file_key, size AS file_size_bytes, file_hash
FROM (SELECT sha256('/uploads/' || file_name || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S')) AS job_id, file_name,
        octet_length(encode(text)) AS size, sha256(text) AS file_hash
      FROM files WHERE octet_length(encode(text)) > 0)"""))
def ingest_files(spark, sf_dir):
    return S.ingest_files(_as_files(spark, sf_dir)).drop("timestamp")


@query("a2_content_hash", "SELECT doc_id, CASE WHEN text <> '' THEN sha256(text) END AS file_hash FROM documents")
def content_hash(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    return docs.select("doc_id", S.content_hash(F.col("text")).alias("file_hash"))


@query("a3_raw_log_registry", B.sql(B.FILES_SQL, select="""
SELECT job_id, ts AS "timestamp", file_name, lang AS file_format, '' AS raw_content, sha256(text) AS file_hash
FROM files"""))
def raw_log_registry(spark, sf_dir):
    return S.register_raw_logs(B.files(spark, sf_dir), "job_id", "ts", "file_name", "lang", "text")


# The records the five payload shapes must give.
_RECORDS_SQL = """expected AS (
  SELECT event_id, 0 AS record_index, ts AS "timestamp", source, event_type, lower(severity) AS severity, message,
         5 AS n_fields FROM ev WHERE event_type = 'view'
  UNION ALL SELECT event_id, 0, date_trunc('second', ts), source, event_type, lower(severity), message, 5
    FROM ev WHERE event_type = 'click'
  UNION ALL SELECT event_id, 1, TIMESTAMP '2024-01-31 00:00:00', source, ai_category, 'info', '', 4
    FROM ev WHERE event_type = 'click'
  UNION ALL SELECT event_id, 0, TIMESTAMP '2024-01-31 00:00:00', source, event_type, 'info', '', 5
    FROM ev WHERE event_type = 'purchase'
  UNION ALL SELECT event_id, 0, date_trunc('second', ts) - INTERVAL 2 HOUR, source, 'unknown', 'warning', '', 3
    FROM ev WHERE event_type = 'error')"""


def _json_records(spark, sf_dir):
    return S.parse_json_logs(B.payloads(spark, sf_dir), "document")


@query("a4_json_records", B.sql(B.EVENTS_SQL, _RECORDS_SQL, select="""
SELECT event_id, record_index, n_fields, CAST(NULL AS VARCHAR) AS error FROM expected
UNION ALL SELECT event_id, 1, 0, 'item is not a JSON object' FROM ev WHERE event_type = 'error'
UNION ALL SELECT event_id, -1, 0, 'document is not valid JSON' FROM ev WHERE event_type = 'signup'"""))
def json_records(spark, sf_dir):
    parsed = _json_records(spark, sf_dir)
    n_fields = F.when(F.col("error").isNull(), F.size("raw_fields")).otherwise(0)
    return parsed.select("event_id", _index(), n_fields.alias("n_fields"), "error")


@query("a4_deep_records", B.sql(B.EVENTS_SQL, select="""
SELECT event_id, repeat('k_', CAST(event_id % 40 AS INT)) || 'k' AS key, source AS value FROM ev"""))
def deep_records(spark, sf_dir):
    """Records nested up to forty levels deep."""
    levels = (F.col("event_id") % 40 + 1).cast("int")
    document = F.concat(F.repeat(F.lit('{"k":'), levels), F.lit('"'), F.col("source"), F.lit('"'), F.repeat(F.lit("}"), levels))
    documents = B.events(spark, sf_dir).withColumn("document", document).select("event_id", "document")
    parsed = S.parse_json_logs(documents, "document").filter(F.col("error").isNull())
    return parsed.select("event_id", F.explode("raw_fields").alias("key", "value"))


_XML_FIELDS = ["zone", "source", "severity", "message", "reading", "reading_unit", "fault_code", "vendor"]


@query("a5_xml_records", B.sql(B.EVENTS_SQL, select="""
SELECT event_id, 0 AS record_index, 'Z1' AS zone, source, severity, message, printf('%.2f', value) AS reading,
       'mV' AS reading_unit, '007' AS fault_code, CAST(NULL AS VARCHAR) AS vendor, false AS is_error
FROM ev WHERE event_type <> 'signup'
UNION ALL SELECT event_id, 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'V', false FROM ev WHERE event_type <> 'signup'
UNION ALL SELECT event_id, -1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM ev
  WHERE event_type = 'signup'"""))
def xml_records(spark, sf_dir):
    parsed = S.parse_xml_logs(B.xml_documents(spark, sf_dir), "document")
    fields = [F.try_element_at("raw_fields", F.lit(f)).alias(f) for f in _XML_FIELDS]
    return parsed.select("event_id", _index(), *fields, F.col("error").isNotNull().alias("is_error"))


_CSV_FIELDS = ["timestamp", "source", "severity", "value", "message", "_corrupt_record"]


@query("a6_csv_records", B.sql(B.EVENTS_SQL, select="""
SELECT event_id, 0 AS record_index, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", source, severity,
       printf('%.2f', value) AS "value", CAST(NULL AS VARCHAR) AS message, CAST(NULL AS VARCHAR) AS _corrupt_record
FROM ev WHERE event_type <> 'error'
UNION ALL SELECT event_id, 1, '2024-01-01', source, NULL, NULL, NULL, NULL FROM ev WHERE event_type <> 'error'
UNION ALL SELECT event_id, 2, '2024-01-02', 'a', 'INFO', '1.0', NULL, 'surplus,cells' FROM ev WHERE event_type <> 'error'
UNION ALL SELECT event_id, 0, NULL, source, NULL, NULL, message || ', two' || chr(10) || 'lines "x"', NULL
  FROM ev WHERE event_type = 'error'"""))
def csv_records(spark, sf_dir):
    parsed = S.parse_csv_logs(B.csv_documents(spark, sf_dir), "document")
    fields = [F.try_element_at("raw_fields", F.lit(f)).alias(f) for f in _CSV_FIELDS]
    return parsed.select("event_id", "record_index", *fields)


_LINES_SQL = r"""lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS raw
  FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{0085}\x{2028}\x{2029}]') AS parts
        FROM documents)),
trimmed AS (
  SELECT doc_id, line_no, regexp_replace(raw, '^[\s\x0B\x1F]+|[\s\x0B\x1F]+$', '', 'g') AS line FROM lines)"""


@query("a7_line_records", "WITH " + _LINES_SQL + r"""
SELECT doc_id, line_no, md5(line) AS line_md5,
  nullif(regexp_extract(line, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}', 0), '') AS "timestamp",
  upper(nullif(regexp_extract(line, '(?i)\b(ERROR|CRITICAL|WARNING|WARN|INFO|DEBUG)\b', 0), '')) AS severity,
  nullif(regexp_extract(line, '(?i)\b(machine|tool|device|host)_\w+', 0), '') AS source
FROM trimmed WHERE line <> ''""")
def line_records(spark, sf_dir):
    docs = B.wide_table(spark, sf_dir, "documents").select("doc_id", "text")
    raw = lambda name: F.try_element_at("raw_fields", F.lit(name)).alias(name)
    return S.parse_line_logs(docs, "text").select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("line_md5"), raw("timestamp"), raw("severity"), raw("source")
    )


@query("b7_regex_fields", B.sql(B.EVENTS_SQL, select=r"""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp", upper(severity) AS severity,
       regexp_extract(source, 'tool_\w+', 0) AS source FROM ev"""))
def regex_fields(spark, sf_dir):
    line = F.concat(
        F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] "), F.lower("severity"), F.lit(" on "),
        F.col("source"), F.lit(": "), F.col("message"),
    )
    fields = B.events(spark, sf_dir).select("event_id", standardize.line_fields(line).alias("f"))
    return fields.select("event_id", *[F.try_element_at("f", F.lit(n)).alias(n) for n in ("timestamp", "severity", "source")])


@query("a14_raw_view", """
SELECT doc_id, octet_length(encode(text)) > 512000 AS truncated, 'utf-8' AS encoding, md5(text) AS content_md5
FROM documents WHERE octet_length(encode(text)) <= 512000
UNION ALL SELECT doc_id, true, NULL, NULL FROM documents WHERE octet_length(encode(text)) > 512000""")
def raw_view(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    view = docs.select("doc_id", text.raw_view(F.col("text").cast("binary")).alias("v"))
    short = ~F.col("v.truncated")
    return view.select(
        "doc_id", "v.truncated", F.when(short, F.col("v.encoding")).alias("encoding"),
        F.when(short, F.md5("v.content")).alias("content_md5"),
    )


@query("a14_raw_view_cut", """
SELECT doc_id, length(h) > 200 AS truncated, CASE WHEN substr(h, 201, 1) IN ('8', '9', 'A', 'B') THEN 'latin-1' ELSE 'utf-8' END AS encoding,
  substr(h, 1, 200) AS content_hex
FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents)""")
def raw_view_cut(spark, sf_dir):
    """The content of cut texts: of 100 bytes, some of which end inside a character."""
    docs = B.table(spark, sf_dir, "documents")
    view = docs.select("doc_id", text.raw_view(F.col("text").cast("binary"), limit=100).alias("v"))
    given = F.when(F.col("v.encoding") == "utf-8", F.encode("v.content", "UTF-8")).otherwise(F.encode("v.content", "ISO-8859-1"))
    return view.select("doc_id", "v.truncated", "v.encoding", F.hex(given).alias("content_hex"))


@query("a15_csv_export", B.sql(B.EVENTS_SQL, select="""
SELECT ai_category, upper(severity) AS severity, CAST(count(*) AS VARCHAR) AS event_count
FROM ev GROUP BY 1, 2"""))
def csv_export(spark, sf_dir):
    counts = B.events(spark, sf_dir).groupBy("ai_category", F.upper("severity").alias("severity")).agg(
        F.count(F.lit(1)).alias("event_count")
    )
    path = scratch_path(spark, "export")
    S.export_csv(counts, path)
    return spark.read.csv(path, header=True, schema="ai_category string, severity string, event_count string")


@query("a16_dump_load", B.sql(B.EVENTS_SQL, select="""
SELECT job_id, ts, source, message, CASE WHEN NOT requires_review THEN confidence_score END AS confidence_score,
       requires_review FROM ev"""))
def dump_load(spark, sf_dir):
    rows = B.events(spark, sf_dir).select(
        "job_id", "ts", "source", "message",
        F.when(~F.col("requires_review"), F.col("confidence_score")).alias("confidence_score"), "requires_review",
    )
    path = scratch_path(spark, "dump")
    S.write_dump(rows, path)
    return S.read_dump(spark, path, rows.schema)


@query("a16_dump_blocks", B.sql(B.EVENTS_SQL, select="""
SELECT job_id, ts, source, message, CASE WHEN NOT requires_review THEN confidence_score END AS confidence_score,
       requires_review FROM ev WHERE event_type <> 'view'"""))
def dump_blocks(spark, sf_dir):
    """One table of a dump with three, read in many splits; lines of another table look like headers and ends."""
    rows = B.events(spark, sf_dir).filter(F.col("event_type") != "view").select(
        "job_id", "ts", "source", "message",
        F.when(~F.col("requires_review"), F.col("confidence_score")).alias("confidence_score"), "requires_review",
    )
    plain, path = scratch_path(spark, "dump"), scratch_path(spark, "dump-blocks")
    S.write_dump(rows, plain)
    head = "COPY public.{} ({}) FROM stdin;"
    before = [
        "-- seed data", "", head.format("notes", "note"), "first", head.format("events", "job_id, ts"), "\\.", "", "",
        head.format("events", ", ".join(f'"{c}"' for c in rows.columns)),
    ]
    after = ["\\.", "", head.format("empty", "a, b"), "\\.", "-- end"]
    lines = lambda texts, turn: spark.createDataFrame([(turn, i, t) for i, t in enumerate(texts)], "turn int, at long, line string")
    body = spark.read.text(plain).select(F.lit(1).alias("turn"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    every = lines(before, 0).unionByName(body).unionByName(lines(after, 2))
    # The order of the lines is what the reader has to follow: in one file, or through the parts of a large dump.
    size = spark.read.format("binaryFile").load(plain).agg(F.sum("length")).first()[0] or 0
    parts = max(1, math.ceil(size / DUMP_PART_BYTES))
    cut = every.repartitionByRange(parts, "turn", "at") if parts > 1 else every.coalesce(1)
    cut.sortWithinPartitions("turn", "at").select("line").write.text(path)
    with small_splits(spark, 1 << 16):
        table = large.read_dump_table(spark, path, "events", rows.schema, parts=True)
        return stored(table, "dump-table")


@query("a4_large_array", B.sql(B.EVENTS_SQL, select=r"""
SELECT row_number() OVER (ORDER BY event_id) - 1 AS record_index, CAST(event_id AS VARCHAR) AS n, source AS who_name,
  '["[","}"]' AS tags, message || ' } ] , " \' AS note FROM ev"""))
def large_array(spark, sf_dir):
    """One document with all events as its list, read in many splits; strings hold brackets, quotes and backslashes."""
    record = F.to_json(F.struct(
        F.col("event_id").alias("n"), F.struct(F.col("source").alias("name")).alias("who"), F.array(F.lit("["), F.lit("}")).alias("tags"),
        F.concat("message", F.lit(' } ] , " \\')).alias("note"),
    ))
    events = B.events(spark, sf_dir)
    first = events.agg(F.min("event_id")).first()[0]
    rows = events.select("event_id", F.concat(F.when(F.col("event_id") > first, ",").otherwise(""), record).alias("line"))
    edges = spark.createDataFrame([(-1, '{"made": {"by": "["}, "events": ['), (1 << 60, '], "more": [1, 2]}')], "event_id long, line string")
    path = scratch_path(spark, "document")
    rows.unionByName(edges).coalesce(1).sortWithinPartitions("event_id").select("line").write.text(path)
    with small_splits(spark, 1 << 16):
        parsed = stored(large.read_json_documents(spark, path), "records")
    fields = [F.col("raw_fields").getItem(name).alias(name) for name in ("n", "who_name", "tags", "note")]
    return parsed.select(F.col("record_index").cast("long").alias("record_index"), *fields)


@contextmanager
def small_splits(spark, size):
    """Files are cut into splits of `size` bytes inside, so that small ones have many."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


# Byte-wise patterns over the hex form of the first 500 bytes: the detection acts on bytes.
_NOT_NL = "(?:0[0-9B-F]|[1-9A-F][0-9A-F])"
_DETECT_SQL = f"""CASE
  WHEN regexp_matches(h, '^(?:09|0A|0B|0C|0D|20)*(?:7B|5B)') THEN 'json'
  WHEN regexp_matches(h, '^(?:09|0A|0B|0C|0D|20)*3C') THEN 'xml'
  WHEN regexp_matches(h, '^(?:09|0A|0B|0C|0D|20)*(?:{_NOT_NL})*?2C(?:{_NOT_NL})*?2C') THEN 'csv' ELSE 'log' END"""


@query("b1_format_detection", f"""
WITH raw AS (
  SELECT 'documents' AS origin, doc_id AS id, substr(hex(encode(text)), 1, 1000) AS h, CAST(NULL AS VARCHAR) AS hint
  FROM documents
  UNION ALL SELECT 'pages', page_id, substr(hex(encode(html)), 1, 1000), NULL FROM pages
  UNION ALL SELECT 'events', event_id, substr(hex(encode(props)), 1, 1000), CASE WHEN event_type = 'click' THEN 'CSV'
    WHEN event_type = 'view' THEN 'syslog' END FROM events)
SELECT origin, id, coalesce(CASE WHEN lower(hint) IN ('json', 'xml', 'csv', 'log', 'txt') THEN lower(hint) END,
  {_DETECT_SQL}) AS format FROM raw""")
def format_detection(spark, sf_dir):
    no_hint = F.lit(None).cast("string")
    kind = F.col("event_type")
    sources = [
        ("documents", "doc_id", "text", no_hint), ("pages", "page_id", "html", no_hint),
        ("events", "event_id", "props", F.when(kind == "click", "CSV").when(kind == "view", "syslog")),
    ]
    result = None
    for name, key, content, hint in sources:
        part = B.table(spark, sf_dir, name).select(
            F.lit(name).alias("origin"), F.col(key).alias("id"),
            standardize.detect_format(F.col(content).cast("binary"), hint).alias("format"),
        )
        result = part if result is None else result.unionByName(part)
    return result


@query("b2_nested_flatten", B.sql(B.EVENTS_SQL, select="""
SELECT event_id, unnest(['time', 'machine_id', 'event_type', 'event_fault_code', 'severity']) AS key,
       unnest(['invalid-date', source, event_type, '007', 'UNKNOWN_SEV']) AS value
FROM ev WHERE event_type = 'purchase'"""))
def nested_flatten(spark, sf_dir):
    parsed = _json_records(spark, sf_dir)
    nested = parsed.filter(F.array_contains(F.map_keys("raw_fields"), "event_fault_code"))
    return nested.select("event_id", F.explode("raw_fields").alias("key", "value"))


_RECORD_COLUMNS = ["event_id", "record_index", "timestamp", "source", "event_type", "severity", "message"]


def _canonical(parsed, rules=None):
    good = parsed.filter(F.col("error").isNull())
    if rules is None:
        records = standardize.canonical_record(good, _as_of())
    else:
        records = standardize.canonical_record(with_rule_fields(good, rules), _as_of(), rule_fields="rule_fields")
    return records.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).select(*_RECORD_COLUMNS)


@query("b4_canonical_record", B.sql(B.EVENTS_SQL, _RECORDS_SQL, select="SELECT * EXCLUDE n_fields FROM expected"))
def canonical_record(spark, sf_dir):
    """Alias fields, timestamps, severities and defaults (B4, B5, B6, B8) of all payloads."""
    return _canonical(_json_records(spark, sf_dir))


_PLAIN_CSV = """FROM ev WHERE event_type <> 'error'"""


@query("p1_parse_mixed_files", B.sql(B.EVENTS_SQL, _RECORDS_SQL, select=f"""
SELECT 'json' AS format, * EXCLUDE n_fields FROM expected
UNION ALL SELECT 'xml', event_id, 0, TIMESTAMP '{B.AS_OF}', source, 'unknown', lower(severity), message FROM ev WHERE event_type <> 'signup'
UNION ALL SELECT 'xml', event_id, 1, TIMESTAMP '{B.AS_OF}', 'unknown', 'unknown', 'info', '' FROM ev WHERE event_type <> 'signup'
UNION ALL SELECT 'csv', event_id, 0, date_trunc('second', ts), source, 'unknown', lower(severity), '' {_PLAIN_CSV}
UNION ALL SELECT 'csv', event_id, 1, TIMESTAMP '2024-01-01 00:00:00', source, 'unknown', 'info', '' {_PLAIN_CSV}
UNION ALL SELECT 'csv', event_id, 2, TIMESTAMP '2024-01-02 00:00:00', 'a', 'unknown', 'info', '' {_PLAIN_CSV}
UNION ALL SELECT 'csv', event_id, 0, TIMESTAMP '{B.AS_OF}', source, 'unknown', 'info', message || ', two' || chr(10) || 'lines "x"'
  FROM ev WHERE event_type = 'error'
UNION ALL SELECT 'log', event_id, 0, date_trunc('second', ts), split_part(source, '-', 1), 'unknown', lower(severity),
  strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || severity || ' ' || source || ' ' || event_type FROM ev"""))
def parse_mixed_files(spark, sf_dir):
    """One folder of JSON, XML, CSV and line files through one entry, to canonical records."""
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "severity", "source", "event_type")
    kinds = [
        (B.payloads(spark, sf_dir), None), (B.xml_documents(spark, sf_dir), None), (B.csv_documents(spark, sf_dir), "CSV"),
        (B.events(spark, sf_dir).select("event_id", line.alias("document")), None),
    ]
    files = None
    for documents, hint in kinds:
        part = documents.withColumn("hint", F.lit(hint).cast("string"))
        files = part if files is None else files.unionByName(part)
    parsed = S.parse_logs(files, "document", "hint").filter(F.col("error").isNull())
    records = standardize.canonical_record(parsed, _as_of())
    return records.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).select("format", *_RECORD_COLUMNS)


@query("c6_alias_rules", B.sql(B.EVENTS_SQL, _RECORDS_SQL, select="""
SELECT event_id, record_index, x."timestamp", x.source,
  CASE ev.event_type WHEN 'error' THEN 'WARN' WHEN 'view' THEN ev.severity ELSE x.event_type END AS event_type,
  x.severity, x.message
FROM expected x JOIN ev USING (event_id)"""))
def alias_rule_lookup(spark, sf_dir):
    """Rule aliases are tried before the built-in ones; the rules come from a table."""
    given = B.table(spark, sf_dir, "region").select(
        F.when(F.col("r_regionkey") == 0, "source").when(F.col("r_regionkey") == 1, "event_type")
        .when(F.col("r_regionkey") == 2, "event_type").otherwise("other").alias("field"),
        F.when(F.col("r_regionkey") == 0, "MACHINE_ID").when(F.col("r_regionkey") == 1, "log_level")
        .when(F.col("r_regionkey") == 2, "level").otherwise("x").alias("alias"),
    )
    return _canonical(_json_records(spark, sf_dir), given)


@query("b3_xml_merge", B.sql(B.EVENTS_SQL, select="""
SELECT event_id, unnest(['zone', 'source', 'severity', 'message', 'reading', 'reading_unit', 'fault_code']) AS key,
       unnest(['Z1', source, severity, message, printf('%.2f', value), 'mV', '007']) AS value
FROM ev WHERE event_type <> 'signup'
UNION ALL SELECT event_id, 'vendor', 'V' FROM ev WHERE event_type <> 'signup'"""))
def xml_merge(spark, sf_dir):
    parsed = S.parse_xml_logs(B.xml_documents(spark, sf_dir), "document")
    return parsed.filter(F.col("error").isNull()).select("event_id", F.explode("raw_fields").alias("key", "value"))


@query("b5_timestamps", B.sql(B.EVENTS_SQL, select="""
SELECT event_id, CASE WHEN event_type = 'view' THEN ts WHEN event_type = 'click' THEN date_trunc('second', ts)
  WHEN event_type = 'purchase' THEN date_trunc('second', ts) + INTERVAL 330 MINUTE
  WHEN event_type = 'signup' THEN date_trunc('day', ts) ELSE TIMESTAMP '2024-01-31 00:00:00' END AS "timestamp"
FROM ev"""))
def timestamps(spark, sf_dir):
    kind = F.col("event_type")
    given = (
        F.when(kind == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(kind == "click", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(kind == "purchase", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'-05:30'"))
        .when(kind == "signup", F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.date_format("ts", "yyyy"))
    )
    parsed = F.coalesce(standardize.parse_timestamp(given), _as_of()).cast("timestamp_ntz")
    return B.events(spark, sf_dir).select("event_id", parsed.alias("timestamp"))


@query("b6_severities", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'error'
  WHEN '3-MEDIUM' THEN 'warning' ELSE 'info' END AS severity FROM orders""")
def severities(spark, sf_dir):
    urgency = F.substring("o_orderpriority", 1, 1)
    given = (
        F.when(urgency == "1", "Critical").when(urgency == "2", "ERROR").when(urgency == "3", "warn")
        .when(urgency == "4", "debug").otherwise("UNKNOWN_SEV")
    )
    return B.table(spark, sf_dir, "orders").select("o_orderkey", standardize.canonical_severity(given).alias("severity"))


@query("b9_parse_errors", B.sql(B.EVENTS_SQL, select="""
SELECT event_id, 1 AS record_index, 'item is not a JSON object' AS error FROM ev WHERE event_type = 'error'
UNION ALL SELECT event_id, -1, 'document is not valid JSON' FROM ev WHERE event_type = 'signup'"""))
def parse_errors(spark, sf_dir):
    _, bad = S.split_errors(_json_records(spark, sf_dir))
    return bad.select("event_id", _index(), "error")


@query("b27_file_priority", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'P0' WHEN '2-HIGH' THEN 'P1' WHEN '3-MEDIUM' THEN 'P2'
  WHEN '5-LOW' THEN 'DL' ELSE 'UNKNOWN' END AS priority FROM orders""")
def file_priority(spark, sf_dir):
    urgency = F.substring("o_orderpriority", 1, 1)
    token = F.when(urgency == "1", "_p0_").when(urgency == "2", "_P1_").when(urgency == "3", "_P2_").when(
        urgency == "5", "_DL_").otherwise("_P3_")
    name = F.concat(F.lit("json"), token, F.lit("TOOL_20260421_"), F.col("o_orderkey").cast("string"), F.lit(".json"))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", standardize.file_priority(name).alias("priority"))


_CLEAN_SQL = r"""
SELECT conv_id, turn, md5(cleaned) AS cleaned_md5 FROM (
  SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    given, '\r\n?', chr(10), 'g'),
    '\x1b\[[0-?]*[ -/]*[@-~]', '', 'g'),
    '[ \t\r\f\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+(\n|\z)', '\1', 'g'),
    '\n{4,}', chr(10) || chr(10) || chr(10), 'g'),
    '\A[\s\x0B\x{00A0}\x{2028}\x{2029}\x{3000}\x{FEFF}]+|[\s\x0B\x{00A0}\x{2028}\x{2029}\x{3000}\x{FEFF}]+\z', '', 'g')
    AS cleaned
  FROM (SELECT conv_id, turn, '  ' || chr(27) || '[31m' || role || chr(27) || '[0m  ' || chr(13) || chr(10) || chr(10)
          || chr(10) || chr(10) || chr(10) || text || ' ' || chr(9) || chr(13) || text || chr(10) || ' ' AS given
        FROM conversations))"""


@query("b29_clean_text", _CLEAN_SQL)
def clean_text(spark, sf_dir):
    given = F.concat(
        F.lit("  \x1b[31m"), F.col("role"), F.lit("\x1b[0m  \r\n\n\n\n\n"), F.col("text"), F.lit(" \t\r"),
        F.col("text"), F.lit("\n "),
    )
    turns = B.wide_table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.md5(text.clean_log_text(given)).alias("cleaned_md5"))


@query("b30_token_estimate", """
SELECT doc_id, round((length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4.0, 1)
  AS tokens FROM documents""".replace("\\\\", "\\"))
def token_estimate(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("b8_default_fill", B.sql(B.EVENTS_SQL, _RECORDS_SQL, select="""
SELECT source, event_type, severity, message, count(*) AS records FROM expected
WHERE source = 'unknown' OR event_type = 'unknown' OR message = '' GROUP BY ALL"""))
def default_fill(spark, sf_dir):
    """Records that needed a default, by what they became."""
    records = _canonical(_json_records(spark, sf_dir))
    filled = (F.col("source") == "unknown") | (F.col("event_type") == "unknown") | (F.col("message") == "")
    return records.filter(filled).groupBy("source", "event_type", "severity", "message").agg(
        F.count(F.lit(1)).alias("records")
    )
