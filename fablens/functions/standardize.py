"""Format detection, alias resolution and canonicalisation of raw log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fablens import constants as C

# ISO-8601 dates and times; a bare year is not a timestamp although a cast would take it.
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?([+-]\d{2}(:?\d{2})?|Z)?)?$"
_ISO_HOUR = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}$"
# The basic form without separators, and dates by week, each with an optional time behind.
_BASIC = r"^(\d{4})(\d{2})(\d{2})(?:[T ]?(\d{2})(\d{2})?(\d{2})?([.,]\d{1,9})?([+-]\d{2}:?\d{0,2}|Z)?)?$"
_WEEK = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?(?:[T ](.*))?$"


def computed_once(*columns: Column) -> Column:
    """The columns as output of a generator, for use in select().

    A filter on a parsed field would otherwise be pushed below the projection that computes it, with the whole
    expression copied into it, and parse each document again. Filters stay above a generator.
    """
    return F.inline(F.array(F.struct(*columns)))


def detect_format(content: Column, hint: Column | None = None, sniff_bytes: int = C.FORMAT_SNIFF_BYTES) -> Column:
    """Format of a file from a hint or, without a known hint, from its first `sniff_bytes` bytes. `content` is binary.

    A file that begins with more blanks than that is taken for a log.
    """
    # One character per byte, so that the byte limit and the whitespace trim act on bytes.
    head = F.decode(F.substring(content, 1, sniff_bytes), "ISO-8859-1")
    head = F.regexp_replace(head, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")
    first_line = F.substring_index(head, "\n", 1)
    commas = F.length(first_line) - F.length(F.replace(first_line, F.lit(","), F.lit("")))
    sniffed = (
        F.when(head.startswith("{") | head.startswith("["), "json")
        .when(head.startswith("<"), "xml")
        .when(commas >= 2, "csv")
        .otherwise("log")
    )
    if hint is None:
        return sniffed
    known = F.lower(hint)
    return F.when(known.isin(C.FILE_FORMATS), known).otherwise(sniffed)


def resolve_field(entries: Column, keys: Column, field: str) -> Column:
    """Value of a canonical field by the built-in aliases, ignoring case, from entries of a raw map and their keys in lower case.

    The first alias that occurs wins, and among keys that differ only in case the first in record order. Entries must not
    hold nulls. Both should be columns that are computed once.
    """
    at = lambda alias: (F.array_position(keys, alias.lower()) - 1).cast("int")
    return F.coalesce(*[F.get(entries["value"], at(alias)) for alias in C.FIELD_ALIASES[field]])


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 text as TIMESTAMP; null if it is not a valid one."""
    part = lambda pattern, n: F.regexp_extract(text, pattern, n)
    or_zero = lambda c: F.when(c == "", "00").otherwise(c)
    basic = F.concat(
        part(_BASIC, 1), F.lit("-"), part(_BASIC, 2), F.lit("-"), part(_BASIC, 3), F.lit("T"), or_zero(part(_BASIC, 4)), F.lit(":"),
        or_zero(part(_BASIC, 5)), F.lit(":"), or_zero(part(_BASIC, 6)), F.regexp_replace(part(_BASIC, 7), ",", "."), part(_BASIC, 8),
    )
    # Week 1 holds January 4th; weeks begin on Monday.
    fourth = F.concat(part(_WEEK, 1), F.lit("-01-04")).try_cast("date")
    day = F.when(part(_WEEK, 3) == "", "1").otherwise(part(_WEEK, 3)).try_cast("int")
    monday = F.date_sub(fourth, F.weekday(fourth))
    of_week = F.date_add(monday, (part(_WEEK, 2).try_cast("int") - 1) * 7 + day - 1)
    time = part(_WEEK, 4)
    clock = F.when(F.rlike(time, F.lit(r"^\d{2}$")), F.concat(time, F.lit(":00"))).otherwise(time)
    week = F.when(F.year(F.date_add(of_week, 4 - day)) == part(_WEEK, 1).try_cast("int"), F.concat(
        of_week.cast("string"), F.when(time == "", "").otherwise(F.concat(F.lit("T"), clock))
    ))
    iso = F.when(F.rlike(text, F.lit(_WEEK)), week).when(F.rlike(text, F.lit(_BASIC)), basic).when(F.rlike(text, F.lit(_ISO_HOUR)), F.concat(text, F.lit(":00"))).when(
        F.rlike(text, F.lit(_ISO)), F.regexp_replace(text, ",", ".")
    )
    return iso.try_cast("timestamp")


def canonical_severity(text: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in C.SEVERITY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.upper(text)), F.lit("info"))


def _filled(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def canonical_record(
    df: DataFrame,
    as_of: Column,
    raw: str = "raw_fields",
    rule_fields: str | None = None,
) -> DataFrame:
    """Add the canonical fields resolved from the raw map column. `as_of` replaces missing timestamps.

    `rule_fields` is a column that maps fields to the values that aliases of the rules have found (`joins.with_rule_fields`);
    these come before the built-in aliases.
    """
    def field(name: str) -> Column:
        own = resolve_field(F.col("_entries"), F.col("_keys"), name)
        return own if rule_fields is None else F.coalesce(F.try_element_at(F.col(rule_fields), F.lit(name)), own)

    message = F.coalesce(F.nullif(field("message"), F.lit("")), F.try_element_at(F.col(raw), F.lit("raw_line")), F.lit(""))
    # Step by step: a generator would look each field up as often as its expression names it.
    found = (
        df.withColumn("_entries", F.filter(F.map_entries(raw), lambda e: e["value"].isNotNull()))
        .withColumn("_keys", F.transform("_entries", lambda e: F.lower(e["key"])))
        .withColumns({f"_own_{name}": field(name) for name in ("timestamp", "source", "event_type", "severity")})
        .withColumn("_own_message", message)
        .withColumn("_time", parse_timestamp(F.col("_own_timestamp")))
    )
    return found.select(*df.columns, computed_once(
        F.coalesce("_time", as_of.cast("timestamp")).alias("timestamp"),
        _filled(F.col("_own_source"), "unknown").alias("source"),
        _filled(F.col("_own_event_type"), "unknown").alias("event_type"),
        canonical_severity(F.col("_own_severity")).alias("severity"),
        F.col("_own_message").alias("message"),
    ))


def line_fields(line: Column) -> Column:
    """Raw map of one log line: the line itself plus timestamp, severity and source where a pattern matches."""
    found = lambda pattern: F.nullif(F.regexp_extract(line, pattern, 0), F.lit(""))
    pairs = F.array(
        F.struct(F.lit("raw_line").alias("key"), line.alias("value")),
        F.struct(F.lit("timestamp").alias("key"), found(C.LINE_TIMESTAMP_PATTERN).alias("value")),
        F.struct(F.lit("severity").alias("key"), F.upper(found("(?i)" + C.LINE_SEVERITY_PATTERN)).alias("value")),
        F.struct(F.lit("source").alias("key"), found("(?i)" + C.LINE_SOURCE_PATTERN).alias("value")),
        F.struct(F.lit("message").alias("key"), line.alias("value")),
    )
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def file_priority(file_name: Column) -> Column:
    """Expected priority named by a token in the file name."""
    token = F.regexp_extract(F.upper(file_name), "_(P0|P1|P2|DL)_", 1)
    return F.when(token == "", "UNKNOWN").otherwise(token)
