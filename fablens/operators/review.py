"""The review loop: enqueue, decide, feed back into rules, forward approved events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fablens.functions.routing import approved_topic
from fablens.functions.scoring import feedback_boost
from fablens.operators.skew import OrderedGroups, first_per_key, lookup_join

DECISIONS = ["approved", "rejected"]


def rows_to_insert(target: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of `new` whose key is not in `target`, the first per key."""
    return first_per_key(new, keys, order).join(target.select(*keys), keys, "left_anti")


def insert_if_absent(target: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Table after inserting: existing rows win over new ones, and the first new row per key over later ones."""
    return target.unionByName(rows_to_insert(target, new, keys, order).select(*target.columns))


def apply_decisions(statuses: DataFrame, decisions: DataFrame) -> DataFrame:
    """Status table after a log of decisions: the last valid one per job sets status, notes and time."""
    latest = decisions.filter(F.col("decision").isin(DECISIONS)).groupBy("job_id").agg(
        F.max(F.struct("decided_at", "decision_id", "decision", "notes")).alias("_last")
    )
    joined = statuses.join(latest, "job_id", "left")
    changed = F.col("_last").isNotNull()
    choose = lambda new, old: F.when(changed, F.col(f"_last.{new}")).otherwise(F.col(old)).alias(old)
    return joined.select(
        "job_id", choose("decision", "status"), choose("notes", "reviewer_notes"), choose("decided_at", "reviewed_at")
    )


def enqueue_reviews(events: DataFrame, statuses: DataFrame) -> DataFrame:
    """Pending rows for jobs that need review and have no status row yet."""
    jobs = events.filter("requires_review").select("job_id").distinct()
    return jobs.join(statuses.select("job_id"), "job_id", "left_anti").withColumn("status", F.lit("pending"))


def feedback_counters(decisions: DataFrame) -> DataFrame:
    """Approvals, rejections and confidence boost per (source, category) of a decision log."""
    category = F.coalesce(F.nullif("category", F.lit("")), F.lit("default"))
    approved = F.col("decision") == "approved"
    counted = decisions.filter(F.col("decision").isin(DECISIONS)).groupBy("source", category.alias("category")).agg(
        F.sum(F.when(approved, 1).otherwise(0)).cast("long").alias("approval_count"),
        F.sum(F.when(approved, 0).otherwise(1)).cast("long").alias("rejection_count"),
    )
    return counted.withColumn("confidence_boost", feedback_boost(F.col("approval_count"), F.col("rejection_count")))


def merge_feedback(rules: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rules after the decisions: counters added, boost recomputed, other fields kept, new pairs added."""
    new = feedback_counters(decisions).select(
        "source", "category", F.col("approval_count").alias("_a"), F.col("rejection_count").alias("_r")
    )
    joined = rules.join(new, ["source", "category"], "full_outer")
    total = lambda old, more: F.coalesce(F.col(old), F.lit(0)) + F.coalesce(F.col(more), F.lit(0))
    counted = joined.withColumns({"approval_count": total("approval_count", "_a"), "rejection_count": total("rejection_count", "_r")})
    boosted = counted.withColumn("confidence_boost", F.when(
        F.col("_a").isNotNull(), feedback_boost(F.col("approval_count"), F.col("rejection_count"))
    ).otherwise(F.col("confidence_boost")))
    return boosted.select(*rules.columns)


def forward_approved(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approved events with the reviewer's severity and category, and the topic they are sent to.

    `decisions` has one row per job.
    """
    approved = decisions.filter(F.col("decision") == "approved").select(
        "job_id", F.col("severity").alias("_severity"), F.col("category").alias("_category")
    )
    joined = lookup_join(events, approved, ["job_id"], "inner", spread_by=["event_id"])
    severity: Column = F.upper(F.coalesce(F.nullif("_severity", F.lit("")), F.col("severity"), F.lit("ERROR")))
    category = F.coalesce(F.nullif("_category", F.lit("")), F.col("ai_category"))
    forwarded = joined.withColumns({"severity": severity, "ai_category": category})
    return forwarded.withColumn("topic", approved_topic(F.col("severity"))).drop("_severity", "_category")


def rules_by_vendor(rules: DataFrame) -> DataFrame:
    """One row per rule, with its place in the order of its vendor's rules and the vendor's rule count beside it.

    A vendor's rules are counted by an aggregate and numbered in blocks, so their number has no bound.
    """
    order = ["field_name", "field_value", "category", "priority"]
    counts = rules.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("rule_count"))
    numbered = OrderedGroups(rules.select("vendor_id", *order), ["vendor_id"], order).evaluate(number="place")
    return lookup_join(numbered, counts, ["vendor_id"], "left", spread_by=["field_name", "field_value"])
