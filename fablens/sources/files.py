"""Log files as Spark sources: whole files, JSON, XML, CSV and line logs and table dumps.

Two forms exist for each format. `read_*` uses Spark's own splittable readers and is the form for large files.
`parse_*` takes a text column that holds one whole document per row, for small files of mixed shapes.
Every parser gives one row per record with `record_index` and `raw_fields`, or with `error` instead.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, StringType, StructField, StructType

from fablens.functions.standardize import computed_once, detect_format, line_fields
from fablens.operators.skew import first_per_key
from fablens.session import stored

_LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{0085}\x{2028}\x{2029}]"


# ---- whole files -------------------------------------------------------------------------------------------

def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Non-empty files: path, modificationTime, length, content."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).filter(F.col("length") > 0)


def ingest_files(files: DataFrame) -> DataFrame:
    """Job id (from the path, so that a repeated run gives the same), storage key and content hash per file."""
    name = F.element_at(F.split("path", "/"), -1)
    job = F.sha2(F.concat_ws("|", "path", F.col("modificationTime").cast("string")), 256)
    return files.filter(F.col("length") > 0).select(
        job.alias("job_id"),
        name.alias("file_name"),
        F.concat(F.lit("raw_logs/"), job, F.lit("/"), name).alias("file_key"),
        F.col("length").alias("file_size_bytes"),
        content_hash(F.col("content")).alias("file_hash"),
        F.col("modificationTime").alias("timestamp"),
    )


def content_hash(content: Column) -> Column:
    """SHA-256 hex of the content; null for empty content, which has no hash."""
    return F.when(F.octet_length(content) > 0, F.sha2(content.cast("binary"), 256))


def register_raw_logs(
    files: DataFrame, job_id: str, timestamp: str, file_name: str, file_format: str | None, content: str
) -> DataFrame:
    """Raw-file registry rows, the first per (job, timestamp)."""
    rows = files.select(
        F.col(job_id).alias("job_id"),
        F.col(timestamp).alias("timestamp"),
        F.col(file_name).alias("file_name"),
        (F.coalesce(F.col(file_format), F.lit("unknown")) if file_format else F.lit("unknown")).alias("file_format"),
        F.lit("").alias("raw_content"),
        content_hash(F.col(content)).alias("file_hash"),
    )
    return first_per_key(rows, ["job_id", "timestamp"], ["file_name", "file_hash"])


# Levels of nested objects that are flattened by expressions; deeper records go through a function.
_NATIVE_LEVELS = 2


# ---- JSON --------------------------------------------------------------------------------------------------

def _is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def _is_array(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("ARRAY")


def flatten_entries(entries: Column, depth: int) -> Column:
    """Replace object-valued entries (key, value VARIANT) by their members, key parts joined with '_'."""
    for _ in range(depth):
        entries = F.flatten(F.transform(entries, lambda e: F.when(
            _is_object(e["value"]),
            F.transform(
                F.map_entries(e["value"].cast("map<string,variant>")),
                lambda c: F.struct(F.concat_ws("_", e["key"], c["key"]).alias("key"), c["value"].alias("value")),
            ),
        ).otherwise(F.array(e))))
    return entries


def _text_entries(entries: Column) -> Column:
    """Entries with VARIANT values as text; null values are left out."""
    texts = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].cast("string").alias("value")))
    return F.filter(texts, lambda e: e["value"].isNotNull())


def _as_map(entries: Column) -> Column:
    """Entries as a map; of equal keys the last one stays. Only records with equal keys pay for the search."""
    keys = F.transform(entries, lambda e: e["key"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    unique = F.size(F.array_distinct(keys)) == F.size(keys)
    return F.when(unique, F.map_from_entries(entries)).otherwise(F.map_from_entries(last))


def _json_text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _flat_fields(record: dict) -> dict[str, str]:
    """Members of nested objects under joined keys; nulls are left out, of equal keys the last one stays."""
    fields, pending = {}, [("", iter(record.items()))]
    while pending:
        prefix, members = pending[-1]
        for key, value in members:
            if isinstance(value, dict):
                pending.append((f"{prefix}{key}_", iter(value.items())))
                break
            if value is not None:
                fields[prefix + key] = _json_text(value)
        else:
            pending.pop()
    return fields


_FIELDS = MapType(StringType(), StringType())
_RECORDS = ArrayType(StructType([StructField("fields", _FIELDS), StructField("error", StringType())]))


@F.pandas_udf(_RECORDS)
def _json_records_udf(texts: pd.Series) -> pd.Series:
    """Records of JSON documents that the expressions do not read: repeated keys, very long numbers."""

    def records(text: str) -> list[dict]:
        try:
            document = json.loads(text, strict=False)
        except (ValueError, RecursionError):
            return [{"fields": None, "error": "document is not valid JSON"}]
        if isinstance(document, dict):
            document = next((v for v in document.values() if isinstance(v, list)), [document])
        elif not isinstance(document, list):
            document = [document]
        return [
            {"fields": _flat_fields(item), "error": None} if isinstance(item, dict)
            else {"fields": None, "error": "item is not a JSON object"} for item in document
        ]

    return texts.map(records, na_action="ignore")


@F.pandas_udf(_FIELDS)
def _flat_record_udf(items: pd.Series) -> pd.Series:
    """Flat fields of deeply nested records; null if Python cannot read one either."""

    def fields(text: str) -> dict | None:
        try:
            return _flat_fields(json.loads(text, strict=False))
        except (ValueError, RecursionError):
            return None

    return items.map(fields, na_action="ignore")


def parse_json_logs(df: DataFrame, text: str) -> DataFrame:
    """One row per record of a JSON document, or per error.

    An array gives its items, an object the items of its first list-valued member or else itself. Items that
    are no objects are errors of their own; a document that is no JSON is one error. Nested objects are flattened,
    however deep. Expressions read the usual documents; only those with repeated keys in one object or numbers of more
    digits than a decimal holds, and records nested more than a few levels deep, go through a vectorised function.
    """
    doc = F.col(text)
    # A failed parse is costly, so each document is tried only as what its first character allows.
    begins = lambda c, brace: F.ltrim(c, F.lit(" \t\r\n")).startswith(brace)
    as_object = lambda c: F.when(begins(c, "{"), F.from_json(c, "MAP<STRING,VARIANT>"))
    member = F.get(F.filter(F.map_entries("_object"), lambda e: _is_array(e["value"])), F.lit(0))["key"]
    list_text = F.when(begins(doc, "["), doc).when(
        F.col("_member").isNotNull(), F.try_element_at(F.from_json(doc, "MAP<STRING,STRING>"), F.col("_member"))
    )
    items = F.when(F.col("_list").isNotNull(), F.from_json("_list", "ARRAY<STRING>"))
    one = F.when(F.col("_object").isNotNull(), F.array(doc)).when(
        ~begins(doc, "{") & ~begins(doc, "["), F.when(F.try_parse_json(doc).isNotNull(), F.array(doc))
    )
    braced = begins(doc, "{") | begins(doc, "[")
    long_number = F.regexp_like(doc, F.lit(r"\d{38}"))
    hard = braced & (F.col("_items").isNull() | long_number)
    nothing = F.lit(None)
    read = F.transform("_read", lambda r: F.struct(nothing.cast("string").alias("item"), r["fields"].alias("fields"), r["error"].alias("error")))
    plain = F.transform("_items", lambda i: F.struct(i.alias("item"), nothing.cast("map<string,string>").alias("fields"), nothing.cast("string").alias("error")))
    parsed = (
        df.withColumn("_object", as_object(doc))
        .withColumn("_member", member)
        .withColumn("_list", list_text)
        .withColumn("_items", F.coalesce(items, one))
        .withColumn("_read", _json_records_udf(F.when(hard, doc)))
        .withColumn("_all", F.coalesce(read, plain))
        .select(*df.columns, F.col("_all").isNull().alias("_bad"), F.posexplode_outer("_all").alias("record_index", "_one"))
        # An empty list leaves no row: it has neither records nor errors.
        .filter(F.col("_bad") | F.col("record_index").isNotNull())
        .withColumn("record_index", F.when(F.col("_one.error") != "document is not valid JSON", F.col("record_index")).when(
            F.col("_one.error").isNull(), F.col("record_index")
        ))
    )
    nested = lambda entries: F.exists(entries, lambda e: _is_object(e["value"]))
    error = (
        F.when(F.col("_bad"), "document is not valid JSON").when(F.col("_one.error").isNotNull(), F.col("_one.error"))
        .when(F.col("_deep"), F.when(F.col("_deep_fields").isNull(), "item is not valid JSON"))
        .when(F.col("_one.fields").isNull() & F.col("_record").isNull(), "item is not a JSON object")
    )
    fields = (
        F.when(F.col("_one.fields").isNotNull(), F.col("_one.fields")).when(F.col("_deep"), F.col("_deep_fields"))
        .otherwise(_as_map(F.col("_entries")))
    )
    # Step by step, so that no step is evaluated twice.
    return (
        parsed.withColumn("_record", as_object(F.col("_one.item")))
        .withColumn("_flat", flatten_entries(F.map_entries("_record"), _NATIVE_LEVELS))
        # Objects that are still nested, or whose repeated keys the expression does not read.
        .withColumn("_deep", F.coalesce(nested("_flat"), F.col("_record").isNull() & begins(F.col("_one.item"), "{"), F.lit(False)))
        .withColumn("_deep_fields", _flat_record_udf(F.when(F.col("_deep"), F.col("_one.item"))))
        .withColumn("_entries", _text_entries(F.col("_flat")))
        .withColumn("error", error)
        .select(*df.columns, "record_index", computed_once(
            F.col("error"), F.when(F.col("error").isNull(), fields).alias("raw_fields")
        ))
    )


# ---- XML ---------------------------------------------------------------------------------------------------

def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _xml_fields(element) -> dict[str, str]:
    """Attributes and texts of an element's descendants, keys joined with '_'; any depth."""
    fields = {_local(name): value for name, value in element.attrib.items()}
    pending = [("", iter(element))]
    while pending:
        prefix, children = pending[-1]
        for child in children:
            key = prefix + _local(child.tag)
            if len(child):
                fields.update((f"{key}_{_local(name)}", value) for name, value in child.attrib.items())
                pending.append((key + "_", iter(child)))
                break
            fields[key] = child.text or ""
            fields.update((f"{key}_{_local(name)}", value) for name, value in child.attrib.items())
        else:
            pending.pop()
    return fields


_DOCUMENT = StructType([StructField("records", ArrayType(_FIELDS)), StructField("error", StringType())])


def _documents(results: list[tuple[list[dict] | None, str | None]]) -> pd.DataFrame:
    return pd.DataFrame({"records": [r for r, _ in results], "error": [e for _, e in results]}, dtype=object)


def _xml_records(text: str | None) -> tuple[list[dict] | None, str | None]:
    try:
        root = ElementTree.fromstring(text or "")
    except (ElementTree.ParseError, ValueError) as problem:
        return None, str(problem)
    return [_xml_fields(element) for element in list(root) or [root]], None


@F.pandas_udf(_DOCUMENT)
def _xml_records_udf(texts: pd.Series) -> pd.DataFrame:
    return _documents([_xml_records(t) for t in texts])


def _explode_records(df: DataFrame, result: Column) -> DataFrame:
    parsed = df.withColumn("_result", result).select(
        *df.columns, computed_once(F.col("_result.records").alias("_records"), F.col("_result.error").alias("error"))
    )
    rows = parsed.select(*df.columns, F.posexplode_outer("_records").alias("record_index", "raw_fields"), "error")
    # A document without records and without an error leaves no row.
    return rows.filter(F.col("record_index").isNotNull() | F.col("error").isNotNull())


def parse_xml_logs(df: DataFrame, text: str) -> DataFrame:
    """One row per child of the root element (or the root itself); attributes and nested tags are merged.

    No built-in expression walks elements of unknown names, so the walk is a small vectorised Python function.
    """
    return _explode_records(df, _xml_records_udf(F.col(text)))


def read_xml_logs(spark: SparkSession, path: str, row_tag: str, schema: StructType | str) -> DataFrame:
    """Records of a known tag from XML files of any size, read in splits. Declare all fields as STRING."""
    return (
        spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
        .schema(schema).load(path)
    )


# ---- CSV ---------------------------------------------------------------------------------------------------

def _csv_records(text: str | None) -> tuple[list[dict] | None, str | None]:
    if text is None:
        return None, None
    try:
        header, *rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    except (csv.Error, ValueError) as problem:
        return None, str(problem)
    records = []
    for row in rows:
        record = dict(zip(header, row))
        if len(row) > len(header):
            record["_corrupt_record"] = ",".join(row[len(header):])
        records.append(record)
    return records, None


@F.pandas_udf(_DOCUMENT)
def _csv_records_udf(texts: pd.Series) -> pd.DataFrame:
    return _documents([_csv_records(t) for t in texts])


def parse_csv_logs(df: DataFrame, text: str) -> DataFrame:
    """One row per CSV row, fields named by the document's own header; surplus cells go to `_corrupt_record`.

    Documents without quotes are split by expressions; only those with quotes pass through Python's reader. Of repeated
    names in the header the last cell stays.
    """
    quoted = F.coalesce(F.contains(F.col(text), F.lit('"')), F.lit(False))
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda line: line != "")
    nothing = F.lit(None)
    own = F.transform(
        F.slice("_lines", 2, F.greatest(F.size("_lines"), F.lit(1))),
        lambda line: F.struct(line.alias("line"), nothing.cast("map<string,string>").alias("fields")),
    )
    read = F.transform("_read.records", lambda r: F.struct(nothing.cast("string").alias("line"), r.alias("fields")))
    rows = (
        df.withColumn("_quoted", quoted)
        .withColumn("_read", _csv_records_udf(F.when(F.col("_quoted"), F.col(text))))
        .withColumn("_lines", F.when(~F.col("_quoted"), lines))
        .withColumn("_header", F.split(F.get("_lines", F.lit(0)), ","))
        .withColumn("_all", F.when(F.col("_quoted"), read).otherwise(own))
        .select(*df.columns, "_header", F.col("_read.error").alias("error"), F.posexplode_outer("_all").alias("record_index", "_one"))
        .filter(F.col("record_index").isNotNull() | F.col("error").isNotNull())
        .withColumn("_cells", F.split("_one.line", ","))
    )
    width = F.size("_header")
    surplus = F.when(
        F.size("_cells") > width, F.concat_ws(",", F.slice("_cells", width + 1, F.size("_cells")))
    )
    pairs = F.arrays_zip(F.col("_header").alias("key"), F.col("_cells").alias("value"))
    pairs = F.slice(pairs, F.lit(1), F.greatest(F.lit(0), F.least(width, F.size("_cells"))))
    entries = F.concat(
        pairs,
        F.when(surplus.isNotNull(), F.array(F.struct(F.lit("_corrupt_record").alias("key"), surplus.alias("value"))))
        .otherwise(F.array().cast("array<struct<key:string,value:string>>")),
    )
    fields = F.when(F.col("_one.line").isNull(), F.col("_one.fields")).otherwise(_as_map(F.col("_entries")))
    return rows.withColumn("_entries", entries).select(
        *df.columns, "record_index", computed_once(fields.alias("raw_fields"), F.col("error"))
    ).select(*df.columns, "record_index", "raw_fields", "error")


def read_csv_logs(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV files with one common header; rows that do not fit are kept in `_corrupt_record` if it is in the schema."""
    return (
        spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", False)
        .option("columnNameOfCorruptRecord", "_corrupt_record").schema(schema).csv(path)
    )


# ---- plain lines -------------------------------------------------------------------------------------------

def parse_line_logs(df: DataFrame, text: str) -> DataFrame:
    """One row per non-blank line of a text, trimmed, with `line_no` counting from 1."""
    trimmed = F.transform(
        F.split(text, _LINE_END), lambda line: F.regexp_replace(line, r"^[\s\x0B\x1F]+|[\s\x0B\x1F]+$", "")
    )
    rest = [c for c in df.columns if c != text]
    lines = df.select(*rest, F.posexplode(trimmed).alias("_at", "line")).filter(F.col("line") != "")
    return lines.select(
        *rest, "line", (F.col("_at") + 1).alias("line_no"), computed_once(line_fields(F.col("line")).alias("raw_fields"))
    )


def read_line_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files of any size, read in splits, with the file they come from."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"))
    return lines.filter(F.col("line") != "").withColumn("raw_fields", line_fields(F.col("line")))


def parse_logs(files: DataFrame, content: str = "content", hint: str | None = None) -> DataFrame:
    """Records of files of mixed formats: the other columns, format, record_index, raw_fields and error.

    Each file's format comes from the column `hint` or else from its first bytes, and its own parser reads it.
    """
    known = F.col(hint) if hint else None
    rest = [c for c in files.columns if c != content]
    named = files.withColumn("format", detect_format(F.col(content).cast("binary"), known))
    # Stored, so that the files are read and told apart once, not by each parser again.
    named = stored(named.select(*rest, "format", F.col(content).cast("string").alias("_text")), "named-files")
    parsers = {"json": parse_json_logs, "xml": parse_xml_logs, "csv": parse_csv_logs}
    columns = [*rest, "format", "record_index", "raw_fields", "error"]
    parts = [parse(named.filter(F.col("format") == name), "_text").select(*columns) for name, parse in parsers.items()]
    lines = parse_line_logs(named.filter(~F.col("format").isin(list(parsers))), "_text")
    parts.append(lines.withColumns({"record_index": (F.col("line_no") - 1).cast("int"), "error": F.lit(None).cast("string")}).select(*columns))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# ---- errors and dumps --------------------------------------------------------------------------------------

def split_errors(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records and the quarantine of parse errors."""
    good = parsed.filter(F.col("error").isNull()).drop("error")
    bad = parsed.filter(F.col("error").isNotNull()).drop("raw_fields")
    return good, bad


# Escapes of the dump format, in the order in which they are written.
_DUMP_ESCAPES = [("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")]


def read_dump(spark: SparkSession, path: str | Sequence[str], schema: StructType | str) -> DataFrame:
    r"""Tab-separated table dump: \N is null, an empty cell the empty text, t and f are booleans, \. ends a block."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    lines = spark.read.option("lineSep", "\n").text(path).filter(F.col("value") != "\\.")
    return dump_rows(lines, fields)


def dump_rows(lines: DataFrame, fields: StructType) -> DataFrame:
    """Rows of a table from the lines (value) of its dump."""
    cells = lines.select(F.split("value", "\t", -1).alias("cells"))
    # A backslash pair must not be taken for the start of an escape, so it is set aside first.
    mark = "\x00"

    def plain(cell: Column) -> Column:
        cell = F.replace(cell, F.lit("\\\\"), F.lit(mark))
        for char, escape in _DUMP_ESCAPES[1:]:
            cell = F.replace(cell, F.lit(escape), F.lit(char))
        return F.replace(cell, F.lit(mark), F.lit("\\"))

    values = []
    for at, field in enumerate(fields):
        cell = F.get("cells", F.lit(at))
        value = F.when(cell != "\\N", F.when(F.contains(cell, F.lit("\\")), plain(cell)).otherwise(cell))
        values.append(value.cast(field.dataType).alias(field.name))
    return cells.select(*values)


def write_dump(df: DataFrame, path: str) -> None:
    """Write the same form."""

    def cell(field) -> Column:
        value = F.col(field.name)
        if field.dataType == BooleanType():
            text = F.when(value, "t").when(~value, "f")
        else:
            text = value.cast("string")
            for char, escape in _DUMP_ESCAPES:
                text = F.replace(text, F.lit(char), F.lit(escape))
        return F.coalesce(text, F.lit("\\N"))

    df.select(F.concat_ws("\t", *[cell(f) for f in df.schema])).write.mode("overwrite").text(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Result as CSV with a header, every cell quoted."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True)
