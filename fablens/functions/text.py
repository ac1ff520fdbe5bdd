"""Text helpers: log clean-up, token estimate and the capped raw view."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fablens import constants as C

# Fixed value: terminal control sequences.
ANSI_ESCAPE_PATTERN = r"\x1b\[[0-?]*[ -/]*[@-~]"
# Whitespace as a browser trims it.
_BLANKS = r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_SPACE = rf"[\s\x0B{_BLANKS}]"
_SPACE_IN_LINE = rf"[ \t\r\f\x0B{_BLANKS}]"


def clean_log_text(text: Column) -> Column:
    """Unix line ends, no terminal escapes, no trailing blanks, at most two blank lines in a row, trimmed."""
    s = F.regexp_replace(text, r"\r\n?", "\n")
    s = F.regexp_replace(s, ANSI_ESCAPE_PATTERN, "")
    s = F.regexp_replace(s, rf"(?<!{_SPACE_IN_LINE}){_SPACE_IN_LINE}+(?=\n|\z)", "")
    s = F.regexp_replace(s, r"\n{4,}", "\n\n\n")
    s = F.regexp_replace(s, rf"\A{_SPACE}+", "")
    return F.regexp_replace(s, rf"(?<!{_SPACE}){_SPACE}+\z", "")


def estimate_tokens(text: Column) -> Column:
    """A quarter token per UTF-16 unit, to one decimal."""
    units = F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.when(text.isNull(), F.lit(0.0)).otherwise(F.round(units / 4.0, 1))


def raw_view(content: Column, limit: int = C.RAW_VIEW_BYTES) -> Column:
    """First `limit` bytes as text, with a flag if more were there. Bytes that are no UTF-8 are read as Latin-1."""
    head = F.substring(content, 1, limit)
    utf8 = F.is_valid_utf8(head.cast("string"))
    return F.struct(
        F.when(utf8, head.cast("string")).otherwise(F.decode(head, "ISO-8859-1")).alias("content"),
        (F.octet_length(content) > limit).alias("truncated"),
        F.when(utf8, "utf-8").otherwise("latin-1").alias("encoding"),
    )
