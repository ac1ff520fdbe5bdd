"""One job from uploaded files to routed events: hash, duplicates, formats, canonical records, scores, topics.

Per micro-batch and in this order: files are hashed and marked by the duplicate rule; those to go on with are parsed by
their format; what cannot be parsed goes to the error table; records become canonical events, are classified, scored with
the rules as they are now, and sent to their topics or to the review folder. Every table has one folder per batch, so a
repeated batch replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fablens.functions.classify import keyword_category
from fablens.functions.standardize import canonical_record
from fablens.session import stored
from fablens.sources.files import content_hash, parse_logs, split_errors
from fablens.sources.topics import encode_messages
from fablens.streaming.jobs import AVAILABLE_NOW, for_each_batch, mark_batch, scored_events
from fablens.streaming.tables import append_batch

# Confidence of the keyword classifier, where nothing better is given.
KEYWORD_CONFIDENCE = 0.7


def classified_by_keywords(records: DataFrame) -> DataFrame:
    """Records with ai_category, ai_recommended_action and confidence_score."""
    return records.withColumns({
        "ai_category": keyword_category(F.col("message")), "ai_recommended_action": F.lit(""),
        "confidence_score": F.lit(KEYWORD_CONFIDENCE),
    })


def run_ingest(
    files: DataFrame, rules: Callable[[SparkSession], DataFrame], out: str, checkpoint: str, as_of: Column,
    trigger=AVAILABLE_NOW, classify: Callable[[DataFrame], DataFrame] = classified_by_keywords, hint: str | None = None,
) -> StreamingQuery:
    """Files (job_id, ts, content and, if named, the format in `hint`) to topics, events, errors and duplicates.

    Below `out`: files (marks of the duplicate rule), errors (job_id, record_index, error), events (scored, with topic),
    topics (messages by topic) and review (events without a topic).
    """
    kept = ["job_id", "ts", "content", *([hint] if hint else [])]

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hashed = batch.select(*kept, content_hash(F.col("content")).alias("file_hash"))
        marks = mark_batch(hashed.drop("content"), out, batch_id)
        # Files that this batch marks anew belong to earlier ones; only its own have a content here.
        new = hashed.join(marks.filter(~F.col("is_duplicate")).select("job_id"), "job_id")
        parsed = stored(parse_logs(new.drop("file_hash"), "content", hint), "parsed")
        good, bad = split_errors(parsed)
        append_batch(bad.select("job_id", "record_index", "error"), f"{out}/errors", batch_id)
        records = canonical_record(good, as_of).withColumnRenamed("record_index", "event_index")
        scored = scored_events(classify(records), rules(spark))
        events = stored(scored.select(
            F.col("job_id").cast("string").alias("job_id"), "event_index", "timestamp", "source", "event_type", "severity", "message",
            F.struct(
                F.col("final_category").alias("category"), F.col("final_action").alias("recommended_action"),
                F.col("exact_confidence").alias("confidence"),
            ).alias("ai_normalized"),
            "review_reason", "topic",
        ), "events")
        append_batch(events, f"{out}/events", batch_id)
        append_batch(encode_messages(events), f"{out}/topics", batch_id, ["topic"])
        append_batch(events.filter(F.col("topic").isNull()).drop("topic"), f"{out}/review", batch_id)

    return for_each_batch(files, handle, checkpoint, trigger, "ingest")
