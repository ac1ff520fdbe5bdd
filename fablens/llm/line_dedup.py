"""Line dedup; DataFrame operations only.

Lines are normalised, exploded and hashed; the documents of each hash are counted; lines whose hash is in too many
documents are dropped, except in the document with the largest id; what is left is put together again by position.

Scale: the count reads each document's distinct keys and combines before its shuffle. Only (id, position) of dropped lines
travels, never the lines. The table of frequent keys, and that of the positions to drop, are broadcast if they are checked
to be small and otherwise joined by a shuffle, in which a hot line is split by adaptive execution.

Defined results: a null or empty text has one empty line. A row is a document; rows that repeat an id count one by one and
are treated alike. A null id is smaller than any other. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fablens.llm.common import SPACES, ascii_lower, broadcast_if_small
from fablens.session import stored

# Positions that may be broadcast together with their documents' ids.
MAX_BROADCAST_POSITIONS = 1_000_000


def _line_keys(text: Column, min_chars: int) -> Column:
    """md5 of each normalised line, null for those shorter than `min_chars`."""
    def key(line: Column) -> Column:
        stripped = F.btrim(line, F.lit(SPACES))
        return F.when(F.char_length(stripped) >= min_chars, F.md5(stripped))

    return F.transform(F.split(ascii_lower(text), "\n", -1), key)


def drop_common_lines(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = 40,
    min_documents: int = 5,
) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = documents.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    keys = rows.select("doc_id", F.xxhash64("text").alias("print"), _line_keys(F.col("text"), min_chars).alias("keys"))

    # The outer forms, as the optimizer would put a filter on the array's size below the others and work out all keys twice.
    common = (
        keys.select("doc_id", F.explode_outer(F.array_distinct("keys")).alias("key")).filter(F.col("key").isNotNull())
        .groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n") >= min_documents).select("key", "keeper")
    )
    common = broadcast_if_small(stored(common, "common-lines"))
    found = (
        keys.select("doc_id", "print", F.posexplode_outer("keys").alias("pos", "key")).filter(F.col("key").isNotNull())
        .join(common, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "print").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
        .select(F.col("doc_id").alias("id"), F.col("print").alias("id_print"), "gone")
    )
    found = stored(found, "dropped-lines")
    size = found.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("n")).first()["n"]
    gone = F.broadcast(found) if size <= MAX_BROADCAST_POSITIONS else found

    lines = rows.select("doc_id", F.xxhash64("text").alias("print"), F.split("text", "\n", -1).alias("lines"))
    joined = lines.join(gone, lines["print"].eqNullSafe(gone["id_print"]) & lines["doc_id"].eqNullSafe(gone["id"]), "left")
    # The lines between two dropped positions stay.
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    ends = F.concat("gone", F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice("lines", a + 1, b - a)))
    return joined.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept), "\n").alias("kept_text"),
    )
