"""Topic of an event and the texts that explain it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fablens import constants as C


def route_topic(review: Column, confidence: Column, category: Column, severity: Column) -> Column:
    """Topic of an event; null means human review. The first condition that holds decides."""
    level = F.lower(F.coalesce(severity, F.lit("info")))
    kind = F.lower(F.coalesce(F.nullif(category, F.lit("")), F.lit("unknown")))
    score = F.coalesce(confidence, F.lit(0.0))
    return (
        F.when(F.coalesce(review, F.lit(False)), F.lit(None).cast("string"))
        .when((score < C.DEAD_LETTER_CONFIDENCE) | ((kind == "unknown") & (level == "error")), C.TOPIC_DEADLETTER)
        .when(level == "critical", C.TOPIC_P0)
        .when(level == "error", C.TOPIC_P1)
        .otherwise(C.TOPIC_P2)
    )


def route_decision(topic: Column, reason: Column) -> Column:
    """Struct of topic, status and, for reviews, the reason."""
    in_review = topic.isNull()
    default = F.coalesce(F.nullif(reason, F.lit("")), F.lit(C.ROUTE_DEFAULT_REASON))
    return F.struct(
        topic.alias("topic"),
        F.when(in_review, "review").otherwise("routed").alias("status"),
        F.when(in_review, default).alias("reason"),
    )


def dead_letter_reason(confidence: Column, category: Column, severity: Column) -> Column:
    score = F.coalesce(confidence, F.lit(0.0))
    percent = F.format_string("%.0f%%", score * 100)
    kind = F.lower(F.coalesce(F.nullif(category, F.lit("")), F.lit("unknown")))
    level = F.lower(F.coalesce(severity, F.lit("")))
    # The three reason texts.
    too_low = F.concat(
        F.lit("AI confidence too low ("), percent, F.lit(") — model could not reliably classify this event")
    )
    unclassifiable = F.concat(
        F.lit("Unclassifiable error: AI returned category='unknown' with severity='"), level,
        F.lit("' — likely an unseen log format"),
    )
    other = F.concat(
        F.lit("Dead-lettered: category='"), kind, F.lit("', confidence="), percent,
        F.lit(", severity='"), level, F.lit("'"),
    )
    return (
        F.when(score < C.DEAD_LETTER_CONFIDENCE, too_low)
        .when((kind == "unknown") & (level == "error"), unclassifiable)
        .otherwise(other)
    )


def approved_topic(severity: Column) -> Column:
    """Topic of an event a reviewer has approved."""
    return F.when(F.upper(severity) == "CRITICAL", C.TOPIC_P0).otherwise(C.TOPIC_P1)


def job_status(n_errors: Column, failed: Column) -> Column:
    return F.when(failed, "failed").when(n_errors > 0, "partial_success").otherwise("success")
