"""Confidence arithmetic, review decision, feature vector and score bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fablens import constants as C


def _missing(value: Column) -> Column:
    return value.isNull() | (value == "") | (value == "unknown")


def rule_conflict(ai_category: Column, rule_category: Column) -> Column:
    """True where a rule names a category and the classifier another one; false without a rule."""
    named = F.coalesce(F.nullif(rule_category, F.lit("")), F.lit(None).cast("string"))
    return named.isNotNull() & ~named.eqNullSafe(ai_category)


def combined_confidence(
    confidence: Column,
    source: Column,
    event_type: Column,
    message: Column,
    ai_category: Column,
    has_rule: Column,
    rule_category: Column,
    rule_boost: Column,
) -> Column:
    """Classifier confidence with field penalties, rule bonus or conflict and feedback boost, clipped to [0, 1]."""
    score = F.coalesce(confidence, F.lit(0.0))
    for field in (source, event_type, message):
        score = score - F.when(_missing(field), C.MISSING_FIELD_PENALTY).otherwise(0.0)
    by_rule = F.when(
        has_rule,
        F.when(rule_conflict(ai_category, rule_category), -C.RULE_CONFLICT_PENALTY).otherwise(C.RULE_AGREEMENT_BONUS),
    ).otherwise(0.0)
    boost = F.when(has_rule, F.coalesce(rule_boost, F.lit(0.0))).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + by_rule + boost))


def requires_review(
    confidence: Column,
    reason: Column | None = None,
    novelty: Column | None = None,
    threshold: float = C.CONFIDENCE_THRESHOLD,
    novelty_alert: float = C.NOVELTY_ALERT,
) -> Column:
    """Review is due for low confidence (not rounded), a given reason or a high novelty score."""
    due = confidence < threshold
    if reason is not None:
        due = due | reason.isNotNull()
    if novelty is not None:
        due = due | F.coalesce(novelty >= novelty_alert, F.lit(False))
    return due


def review_reason(conflict: Column, novelty: Column | None = None, novelty_alert: float = C.NOVELTY_ALERT) -> Column:
    """Conflict text and anomaly text joined by ' | '; null if neither applies."""
    parts = [F.when(conflict, C.CONFLICT_REASON)]
    if novelty is not None:
        parts.append(F.when(
            novelty >= novelty_alert, F.format_string("ML anomaly detected (novelty_score=%.2f)", novelty)
        ))
    return F.nullif(F.concat_ws(" | ", *parts), F.lit(""))


def queue_reason(reason: Column) -> Column:
    return F.coalesce(F.nullif(reason, F.lit("")), F.lit(C.QUEUE_DEFAULT_REASON))


def _code(value: Column, codes: dict[str, int], default: int) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in codes.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, F.lower(value)), F.lit(float(default)))


def severity_code(severity: Column) -> Column:
    return _code(severity, C.SEVERITY_CODES, 0)


def category_code(category: Column) -> Column:
    return _code(category, C.CATEGORY_CODES, 9)


def feature_vector(
    severity: Column, confidence: Column, category: Column, source: Column,
    event_type: Column, message: Column, review: Column,
) -> Column:
    """Seven doubles: severity, confidence, category, known source, known type, message length, review flag."""
    known = lambda c: F.when(F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")) != "unknown", 1.0).otherwise(0.0)
    return F.array(
        severity_code(severity),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0)))),
        category_code(category),
        known(source),
        known(event_type),
        F.least(F.coalesce(F.length(message), F.lit(0)) / F.lit(C.MESSAGE_LENGTH_NORM), F.lit(1.0)),
        F.when(review, 1.0).otherwise(0.0),
    )


def feedback_boost(approvals: Column, rejections: Column) -> Column:
    total = F.greatest(approvals + rejections, F.lit(1))
    return F.round((approvals - rejections) / total * C.FEEDBACK_BOOST_RANGE, 4)


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence.isNull(), "none")
        .when(confidence >= C.CONFIDENCE_HIGH, "high")
        .when(confidence >= C.CONFIDENCE_MEDIUM, "medium")
        .otherwise("low")
    )


def novelty_band(novelty: Column) -> Column:
    return F.when(novelty.isNull(), "none").when(novelty >= C.NOVELTY_HIGH, "anomaly").otherwise("normal")
