"""Chat formatting from event logs; DataFrame operations only.

A log has conv_id, seq, kind, msg_id, role and text. It is partitioned by conversation and folded in the order of seq:

* message: a message begins, or begins again, with this text
* delta: the text is appended to the message (streamed output)
* edit: the text replaces the message
* regenerate: the text replaces the message, and messages begun after it and before this event are discarded

Events without msg_id are complete messages of their own. A message stands where its first event stands. The role is
that of its first event that has one.

The template writes each turn as ``<turn role="R">T</turn>`` and a newline. In R and T a backslash, < and > become
\\0, \\1 and \\2, so no control string can occur inside a text, and reading back is exact. The loss mask is a list of
spans (start, length in code points) that cover the texts of assistant turns.

Defined results: null texts and roles are empty; a null seq comes first; equal seqs are ordered by role and text; a null
conv_id is one conversation; repeated events are folded one by one. Other columns are not looked at. A conversation's turns
meet in one row, as its formatted text is one value; the folding before that is spread over its messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK_CHARS, MAX_CHUNKS = 256, 64
_ESCAPES = (("\\", "\\0"), ("<", "\\1"), (">", "\\2"))


def escape(text: Column) -> Column:
    for plain, code in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, at (place in the conversation), role, text."""
    named = events.select("conv_id", "seq", "kind", "msg_id", "role", F.coalesce("text", F.lit("")).alias("text"))
    single = named.filter(F.col("msg_id").isNull()).select(
        "conv_id", F.col("seq").alias("at"), F.coalesce("role", F.lit("")).alias("role"), "text"
    )
    logs = named.filter(F.col("msg_id").isNotNull()).groupBy("conv_id", "msg_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "role", "text", "kind"))).alias("log"),
        F.max(F.when(F.col("kind") == "regenerate", F.struct("seq"))).alias("again"),
    )
    reset = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i + 1).otherwise(F.lit(1))))
    texts = F.transform(F.slice("log", reset, F.size("log")), lambda e: e["text"])
    roles = F.transform(F.filter("log", lambda e: e["role"].isNotNull()), lambda e: e["role"])
    folded = logs.select(
        "conv_id",
        F.element_at("log", 1)["seq"].alias("at"),
        F.coalesce(F.try_element_at(roles, F.lit(1)), F.lit("")).alias("role"),
        F.array_join(texts, "").alias("text"),
        "again",
    )
    cuts = (
        logs.filter(F.col("again").isNotNull())
        .groupBy(F.col("conv_id").alias("cut_id"))
        .agg(F.collect_list(F.struct(F.element_at("log", 1)["seq"].alias("low"), F.col("again")["seq"].alias("high"))).alias("cuts"))
    )
    messages = folded.drop("again").unionByName(single)
    between = F.exists("cuts", lambda c: (F.col("at") > c["low"]) & (F.col("at") < c["high"]))
    joined = messages.join(cuts, messages["conv_id"].eqNullSafe(cuts["cut_id"]), "left")
    return joined.filter(F.coalesce(~between, F.lit(True))).select("conv_id", "at", "role", "text")


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans."""
    body, role = escape(F.col("text")), escape(F.col("role"))
    pieces = messages.select(
        "conv_id", "at", "role", "text",
        F.concat(F.lit('<turn role="'), role, F.lit('">')).alias("head"), body.alias("body"),
    ).withColumn("piece", F.concat("head", "body", F.lit("</turn>\n")))
    before = Window.partitionBy("conv_id").orderBy("at", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn(
        "start", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.char_length("head")
    )
    span = F.when(F.col("role") == trained_role, F.struct("start", F.char_length("body").cast("long").alias("length")))
    return placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda p: p["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, "</turn>\n", -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        end = F.instr(piece, ">")
        head = len('<turn role="')
        return F.struct(
            unescape(F.substring(piece, F.lit(head + 1), end - head - 2)).alias("role"),
            unescape(F.substring(piece, end + 1, F.char_length(piece))).alias("text"),
        )

    return F.transform(pieces, turn)


def read_loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def turn_log(conversations: DataFrame) -> DataFrame:
    """The event log of a table of turns (conv_id, turn, role, text), each turn streamed as deltas.

    A row is a message of its own, also if it repeats another. Its number only tells it from others; it comes from the
    place in the scan, which is the same if a task is run again.
    """
    rows = conversations.select(
        "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("msg_id")
    ).withColumn("chunk", F.greatest(F.lit(CHUNK_CHARS), F.ceil(F.char_length("text") / MAX_CHUNKS).cast("int")))
    parts = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.char_length("text") / F.col("chunk")).cast("int"))))
    return parts.select(
        "conv_id",
        F.struct("turn", "role", F.xxhash64("text").alias("print"), "msg_id", "k").alias("seq"),
        F.when(F.col("k") == 0, "message").otherwise("delta").alias("kind"),
        "msg_id", "role",
        F.when(F.col("k") == 0, "").otherwise(F.substring("text", (F.col("k") - 1) * F.col("chunk") + 1, F.col("chunk"))).alias("text"),
    )
