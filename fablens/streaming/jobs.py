"""Streaming jobs: fan-out to topics, the three consumers, deduplication, spikes, rollups, scoring, metrics.

All jobs share one form: a streaming frame in, a started StreamingQuery out. State is kept in tables of which a batch reads
only the files that may hold its keys (`key_index`): hashes, time windows, event keys. The order in which rows arrive does not matter: no job drops late rows, and results that a
late row changes are written again, so that the current rows of the table are those of the batch form. `trigger` is
passed to writeStream.trigger; its default processes what is there and stops.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fablens import constants as C
from fablens.functions import routing, scoring
from fablens.operators import dedup, iforest, rollups, sequences
from fablens.operators.joins import with_examples, with_rule
from fablens.operators.skew import first_per_key, floor_div, lookup_join
from fablens.sources.topics import encode_messages, write_messages
from fablens.session import scratch_scope, stored, write_text
from fablens.streaming.tables import (
    BATCH, append_batch, append_if_absent, append_indexed, current_rows, earlier_rows, keep_last, read_table,
)

AVAILABLE_NOW: Mapping[str, Any] = {"availableNow": True}
# The cold consumer's pace: a batch each 300 seconds, and on a topic of Kafka at most so many rows in it.
COLD_TRIGGER: Mapping[str, Any] = {"processingTime": f"{C.COLD_BATCH_SECONDS} seconds"}
COLD_KAFKA_OPTIONS: Mapping[str, str] = {"maxOffsetsPerTrigger": str(C.COLD_BATCH_ROWS)}


def for_each_batch(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
    trigger: Mapping[str, Any] = AVAILABLE_NOW, name: str | None = None,
) -> StreamingQuery:
    """Start a query that hands each micro-batch, computed once, to `handle`. Scratch tables end with the batch."""

    def handle_cached(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            with scratch_scope(batch.sparkSession):
                handle(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(handle_cached).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return writer.trigger(**trigger).start()


# ---- rows of the event table -------------------------------------------------------------------------------

_ROW_DEFAULTS = {
    # consumer: severity, root cause
    "hot": ("ERROR", "unknown"),
    "cold": ("INFO", ""),
    "deadletter": ("UNKNOWN", ""),
}


def event_rows(events: DataFrame, consumer: str, as_of: Column) -> DataFrame:
    """Rows of the event table from decoded messages; those without a job id are dropped."""
    severity, cause = _ROW_DEFAULTS[consumer]
    filled = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    confidence = filled("ai_normalized.confidence", 0.0)
    dead = consumer == "deadletter"
    reason = {
        "hot": F.lit(""),
        "cold": F.lit(None).cast("string"),
        "deadletter": routing.dead_letter_reason(confidence, F.col("ai_normalized.category"), F.col("severity")),
    }[consumer]
    return events.filter(F.coalesce(F.col("job_id"), F.lit("")) != "").select(
        "job_id",
        "event_index",
        F.coalesce(F.col("timestamp").try_cast("timestamp"), as_of).alias("timestamp"),
        filled("source", "unknown").alias("source"),
        filled("event_type", "unknown").alias("event_type"),
        filled("severity", severity).alias("severity"),
        filled("message", "").alias("message"),
        filled("ai_normalized.category", "unknown").alias("ai_category"),
        filled("ai_normalized.root_cause", cause).alias("ai_root_cause"),
        filled("ai_normalized.recommended_action", "").alias("ai_recommended_action"),
        confidence.alias("confidence_score"),
        F.lit(dead).alias("requires_review"),
        reason.alias("review_reason"),
    )


_EVENT_KEY = ["job_id", "event_index"]


def alert_rows(rows: DataFrame, topic: Column, as_of: Column, keep: Sequence[str] = ()) -> DataFrame:
    """The nine fields of an alert, after the columns to `keep`."""
    return rows.select(
        *keep,
        as_of.alias("timestamp"), "job_id", "source", "severity", "message",
        F.col("ai_category").alias("category"), F.col("confidence_score").alias("confidence"),
        topic.alias("topic"), F.col("ai_recommended_action").alias("action"),
    )


# ---- fan-out and consumers ---------------------------------------------------------------------------------

def with_figures(batch: DataFrame, valid: Column | None = None) -> tuple[DataFrame, Observation]:
    """The batch, and the count of its rows received and of those to be written (with a job id).

    The rows are counted on their way when the frame is first computed; that takes no pass of its own.
    """
    valid = F.coalesce(F.col("job_id").cast("string"), F.lit("")) != "" if valid is None else valid
    counted = Observation()
    columns = F.count(F.lit(1)).alias("total_received"), F.count_if(valid).alias("total_written")
    return batch.observe(counted, *columns), counted


def store_figures(spark: SparkSession, counted: Observation, path: str, batch_id: int) -> None:
    """One small file per batch, written by the driver; a repeated batch writes it again."""
    write_text(spark, f"{path}/{BATCH}={batch_id}/figures.json", json.dumps(counted.get))


def run_fan_out(
    events: DataFrame, out: str, checkpoint: str, trigger=AVAILABLE_NOW, fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> StreamingQuery:
    """Classified events to their topics, and those to be reviewed to the review folder.

    fmt: parquet writes the topics as folders below `out`, kafka sends them with `options`.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        messages = encode_messages(batch)
        if fmt == "kafka":
            write_messages(messages, "", fmt, options)
        else:
            append_batch(messages, f"{out}/topics", batch_id, ["topic"])
        append_batch(batch.filter(F.col("topic").isNull()).drop("topic"), f"{out}/review", batch_id)

    return for_each_batch(events, handle, checkpoint, trigger, "fan_out")


def run_hot(events: DataFrame, out: str, checkpoint: str, as_of: Column, trigger=AVAILABLE_NOW) -> StreamingQuery:
    """Event rows and alerts, as soon as they come. `events` carries the topic each message came from.

    A message that is delivered again makes neither a second row nor a second alert.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        counted, figures = with_figures(batch)
        # One message on two topics is the row and the alert of the first topic by name, the more urgent one.
        topics = first_per_key(batch.select(*_EVENT_KEY, "topic"), _EVENT_KEY, ["topic"]).withColumnRenamed("topic", "_topic")
        rows = event_rows(counted, "hot", as_of)
        rows = first_per_key(rows, _EVENT_KEY, ["timestamp", *[c for c in rows.columns if c not in _EVENT_KEY]])
        append_if_absent(rows, f"{out}/events", batch_id, _EVENT_KEY, ["timestamp"], "hot")
        alerts = rows.join(topics.select(*[F.col(k).alias(f"_{k}") for k in _EVENT_KEY], "_topic"), _same_event(), "left")
        numbered = alert_rows(alerts, F.col("_topic"), as_of, keep=["event_index"])
        append_if_absent(numbered, f"{out}/alerts", batch_id, _EVENT_KEY, ["timestamp"], "hot")
        store_figures(batch.sparkSession, figures, f"{out}/figures/run=hot", batch_id)

    return for_each_batch(events, handle, checkpoint, trigger, "hot")


def _same_event() -> Column:
    return (F.col("job_id") == F.col("_job_id")) & F.col("event_index").eqNullSafe(F.col("_event_index"))


def run_cold(
    events: DataFrame, out: str, checkpoint: str, as_of: Column, trigger=COLD_TRIGGER, run: str = "cold"
) -> StreamingQuery:
    """Event rows in larger batches; the batch size is set on the source (maxFilesPerTrigger, or COLD_KAFKA_OPTIONS).

    A failed batch is run again from the checkpoint, and what is left at a stop is the next start's first batch.
    `run` names the writer in the table; a new checkpoint needs a new name.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        counted, figures = with_figures(batch)
        append_if_absent(event_rows(counted, "cold", as_of), f"{out}/events", batch_id, _EVENT_KEY, ["timestamp"], run)
        store_figures(batch.sparkSession, figures, f"{out}/figures/run={run}", batch_id)

    return for_each_batch(events, handle, checkpoint, trigger, run)


def run_dead_letter(events: DataFrame, out: str, checkpoint: str, as_of: Column, trigger=AVAILABLE_NOW) -> StreamingQuery:
    """Audit rows that require review, and one pending review row per job."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        counted, figures = with_figures(batch)
        rows = event_rows(counted, "deadletter", as_of)
        append_if_absent(rows, f"{out}/events", batch_id, _EVENT_KEY, ["timestamp"], "deadletter")
        pending = rows.select("job_id", F.lit("pending").alias("status"), F.lit(0).alias("at"))
        append_if_absent(pending, f"{out}/reviews", batch_id, ["job_id"], ["at"], "deadletter")
        store_figures(batch.sparkSession, figures, f"{out}/figures/run=deadletter", batch_id)

    return for_each_batch(events, handle, checkpoint, trigger, "dead_letter")


# ---- deduplication -----------------------------------------------------------------------------------------

_FILES = "file_hash STRING, ts TIMESTAMP, job_id LONG, original_job_id LONG, first_seen TIMESTAMP, is_duplicate BOOLEAN"


def run_dedup(files: DataFrame, out: str, checkpoint: str, trigger=AVAILABLE_NOW, ttl: int = C.DEDUP_TTL_SECONDS) -> StreamingQuery:
    """Files (file_hash, ts, job_id) with their duplicate mark, by the exact rule over event time.

    Of the table written so far a batch reads the files that may hold its hashes, whatever their time: of each hash the
    last registration before the batch's first copy, and the copies after it. These are marked again and written as new
    versions; so a late file costs its own hash, however late it is. `marked_files` gives the current marks.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        mark_batch(batch, out, batch_id, ttl)

    return for_each_batch(files, handle, checkpoint, trigger, "dedup")


def mark_batch(batch: DataFrame, out: str, batch_id: int, ttl: int = C.DEDUP_TTL_SECONDS) -> DataFrame:
    """One batch of run_dedup; returns what it has written: the marks of its files, and of those that they change."""
    rows = batch.select("file_hash", F.col("ts").cast("timestamp").alias("ts"), F.col("job_id").cast("long").alias("job_id"))
    rows, seen = stored(rows, "rows"), None
    earlier, _ = earlier_rows(rows, f"{out}/files", _FILES, ["file_hash"], "dedup", batch_id)
    if earlier is not None:
        told = rows.filter(F.col("file_hash").isNotNull() & F.col("ts").isNotNull())
        first = told.groupBy("file_hash").agg(F.min("ts").alias("first"))
        history = lookup_join(earlier.drop("run"), stored(first, "first"), ["file_hash"], "inner", spread_by=["job_id"])
        history = stored(current_rows(history, ["job_id"]), "history")
        before = history.filter(~F.col("is_duplicate") & F.col("first_seen").isNotNull() & (F.col("ts") < F.col("first")))
        last = before.groupBy("file_hash").agg(F.max(F.struct("first_seen", "job_id")).alias("r"))
        seen = last.select("file_hash", "r.job_id", "r.first_seen")
        after = history.filter(F.col("ts") >= F.col("first")).select("file_hash", "ts", "job_id")
        rows = rows.unionByName(after).dropDuplicates(["job_id"])
    marked = dedup.mark_duplicates(rows, seen=seen, ttl_seconds=ttl)
    marked = stored(marked, "marked")
    append_indexed(marked, f"{out}/files", batch_id, ["file_hash"], "dedup")
    return marked


def marked_files(spark: SparkSession, out: str) -> DataFrame:
    """The current marks that run_dedup has written."""
    return current_rows(read_table(spark, f"{out}/files", f"{_FILES}, run STRING").drop("run"), ["job_id"])


# ---- spikes and rollups ------------------------------------------------------------------------------------

def run_spikes(
    events: DataFrame, out: str, checkpoint: str, trigger=AVAILABLE_NOW,
    seconds: int = C.SPIKE_WINDOW_SECONDS, threshold: int = C.SPIKE_THRESHOLD, ts: str = "ts",
) -> StreamingQuery:
    """Exact trailing counts on a stream: a batch plus the stored times in the windows around it.

    Time is cut into windows of `seconds`. A time counts in its own window and in the next one, so a batch reads the files
    that may hold its windows and their neighbours, and writes the counts of its windows and the next ones again. What
    lies between a late row and the newest is not touched. `spike_counts` gives the current counts.
    """
    window = lambda column: floor_div(F.unix_micros(column), seconds * 1_000_000)
    schema = "ts TIMESTAMP, slot LONG"

    def handle(batch: DataFrame, batch_id: int) -> None:
        times = batch.select(F.col(ts).cast("timestamp").alias("ts")).filter(F.col("ts").isNotNull())
        times = stored(times.withColumn("slot", window(F.col("ts"))), "times")
        own = stored(times.select("slot").distinct(), "slots")
        shifted = lambda *by: stored(
            own.select(F.explode(F.array(*[F.col("slot") + k for k in by])).alias("slot")).distinct(), "slots"
        )
        around = times
        needed = shifted(-1, 0, 1)
        earlier, _ = earlier_rows(needed, f"{out}/times", schema, ["slot"], "spikes", batch_id)
        if earlier is not None:
            near = lookup_join(earlier.select("ts", "slot"), needed, ["slot"], "left_semi", spread_by=["ts"])
            around = times.unionByName(near)
        counts = sequences.rolling_counts(around, seconds, threshold, "ts").withColumn("slot", window(F.col("ts")))
        touched = lookup_join(counts, shifted(0, 1), ["slot"], "left_semi").drop("slot")
        append_indexed(times, f"{out}/times", batch_id, ["slot"], "spikes")
        append_batch(touched, f"{out}/counts", batch_id)

    return for_each_batch(events, handle, checkpoint, trigger, "spikes")


def spike_counts(spark: SparkSession, out: str) -> DataFrame:
    """The current counts that run_spikes has written, one row per time."""
    schema = "ts TIMESTAMP, n_at_ts LONG, window_count LONG, spike BOOLEAN"
    return current_rows(read_table(spark, f"{out}/counts", schema), ["ts"])


def run_sliding(events: DataFrame, out: str, checkpoint: str, trigger=AVAILABLE_NOW, slide: int = 30, ts: str = "ts") -> StreamingQuery:
    """Counts per slot of `slide` seconds, added up over batches by `sliding_spikes`; late rows add to their slot."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        slots = batch.groupBy(F.window(ts, f"{slide} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
        append_batch(slots.select(F.col("w.start").alias("slot"), "n"), f"{out}/slots", batch_id)

    return for_each_batch(events, handle, checkpoint, trigger, "sliding")


def sliding_spikes(
    slots: DataFrame, seconds: int = C.SPIKE_WINDOW_SECONDS, slide: int = 30, threshold: int = C.SPIKE_THRESHOLD
) -> DataFrame:
    """Windows on a grid of `slide` seconds that hold at least `threshold` events, from the slots of run_sliding."""
    step = lambda k: F.make_dt_interval(secs=(k * slide).cast("decimal(18,6)"))
    per_slot = slots.groupBy("slot").agg(F.sum("n").alias("n"))
    spread = per_slot.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(seconds // slide - 1))))
    counted = spread.groupBy((F.col("slot") - step(F.col("k"))).alias("window_start")).agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= threshold).select(
        "window_start", (F.col("window_start") + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))).alias("window_end"), "n"
    )


def run_append(stream: DataFrame, out: str, checkpoint: str, trigger=AVAILABLE_NOW, name: str = "append") -> StreamingQuery:
    """Stream to a Parquet folder, exactly once."""
    return (
        stream.writeStream.format("parquet").outputMode("append").queryName(name)
        .option("checkpointLocation", checkpoint).option("path", out).trigger(**trigger).start()
    )


# ---- scoring with feedback and a growing model -------------------------------------------------------------

def scored_events(events: DataFrame, rules: DataFrame, threshold: float = C.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Events with the rules of their source applied: category, confidence, review flag, reason and topic.

    A column novelty_score, if there is one, sends anomalies to review.
    """
    novelty = F.col("novelty_score") if "novelty_score" in events.columns else None
    ruled = with_rule(events, rules)
    conflict = F.col("has_rule") & scoring.rule_conflict(F.col("ai_category"), F.col("rule_category"))
    confidence = scoring.combined_confidence(
        F.col("confidence_score"), F.col("source"), F.col("event_type"), F.col("message"), F.col("ai_category"),
        F.col("has_rule"), F.col("rule_category"), F.col("rule_boost"),
    )
    scored = ruled.withColumns({"exact_confidence": confidence, "review_reason": scoring.review_reason(conflict, novelty)})
    due = scoring.requires_review(F.col("exact_confidence"), F.col("review_reason"), novelty, threshold=threshold)
    return scored.withColumns({
        "requires_review": due,
        "final_category": F.coalesce(F.nullif("rule_category", F.lit("")), F.col("ai_category")),
        "final_action": F.coalesce(F.nullif("rule_action", F.lit("")), F.col("ai_recommended_action")),
        "final_confidence": F.round("exact_confidence", 3),
    }).withColumn("topic", routing.route_topic(
        F.col("requires_review"), F.col("final_confidence"), F.col("final_category"), F.col("severity")
    ))


def normalize_logs(
    events: DataFrame, rules: DataFrame, pool: DataFrame | None = None, forest: DataFrame | None = None,
    features: str = "features", keep_duplicates: bool = False,
) -> DataFrame:
    """From classified events to scored and routed ones.

    Events of duplicate files are left out if they carry `is_duplicate`; rules, novelty under `forest` and review decide
    the topic; with an approved `pool` each event gets the examples of its category.
    """
    if "is_duplicate" in events.columns and not keep_duplicates:
        events = dedup.split_duplicates(events)
    if forest is not None:
        events = events.withColumn("novelty_score", iforest.novelty(forest, F.col(features)))
    scored = scored_events(events, rules)
    return scored if pool is None else with_examples(scored, pool, "final_category")


def run_scoring(
    events: DataFrame, rules: Callable[[SparkSession], DataFrame], out: str, checkpoint: str, trigger=AVAILABLE_NOW
) -> StreamingQuery:
    """Score each batch with the rules as they are when the batch starts, so that feedback takes effect at once."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        append_batch(scored_events(batch, rules(batch.sparkSession)), out, batch_id)

    return for_each_batch(events, handle, checkpoint, trigger, "scoring")


def run_novelty(
    events: DataFrame, out: str, checkpoint: str, trigger=AVAILABLE_NOW,
    min_rows: int = C.FOREST_MIN_ROWS, every: int = C.FOREST_REFIT_EVERY,
) -> StreamingQuery:
    """Novelty of each batch under a forest fitted on all rows so far; refitted whenever enough rows were added.

    `events` has event_id and features. Between batches only the row count, the trees' samples (256 rows per tree)
    and the model are kept, as small tables; earlier events are never read again.
    """

    def latest(table: DataFrame | None, batch_id: int) -> DataFrame | None:
        if table is None:
            return None
        last = table.filter(F.col("batch_id") < batch_id).agg(F.max("batch_id").alias("b")).first()["b"]
        return None if last is None else table.filter(F.col("batch_id") == last)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = latest(read_table(spark, f"{out}/seen"), batch_id)
        before = seen.first()["rows"] if seen is not None else 0
        rows = before + batch.count()
        samples = stored(iforest.tree_samples(
            batch, "event_id", "features", rows, earlier=latest(read_table(spark, f"{out}/samples"), batch_id)
        ), "samples")
        forest, epoch = latest(read_table(spark, f"{out}/models"), batch_id), iforest.refits_due(before, min_rows, every)
        due = iforest.refits_due(rows, min_rows, every)
        if due > epoch:
            forest = stored(iforest.build_trees(samples), "forest")
        if forest is not None:
            append_batch(forest.drop("batch_id"), f"{out}/models", batch_id)
        scored = batch.select(
            "event_id", iforest.novelty(forest, F.col("features")).alias("novelty_score"),
            F.lit(due).cast("long").alias("epoch"),
        )
        append_batch(scored, f"{out}/scores", batch_id)
        append_batch(samples, f"{out}/samples", batch_id)
        append_batch(spark.range(1).select(F.lit(rows).cast("long").alias("rows")), f"{out}/seen", batch_id)
        for state in ("models", "samples", "seen"):
            keep_last(spark, f"{out}/{state}", batch_id)

    return for_each_batch(events, handle, checkpoint, trigger, "novelty")


# ---- metrics -----------------------------------------------------------------------------------------------

def run_measured(stream: DataFrame, out: str, checkpoint: str, trigger=AVAILABLE_NOW, name: str = "measured") -> StreamingQuery:
    """Rows to a table, and the figures of each batch beside them."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        counted, figures = with_figures(batch)
        append_batch(counted, f"{out}/rows", batch_id)
        store_figures(batch.sparkSession, figures, f"{out}/figures", batch_id)

    return for_each_batch(stream, handle, checkpoint, trigger, name)


def consumer_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Rows received and written in each batch of a consumer, from the figures it has stored; of all batches."""
    figures = spark.read.schema(f"total_received LONG, total_written LONG, {BATCH} LONG").json(path)
    return figures.filter(F.col("total_received") > 0).select(BATCH, "total_received", "total_written")


def spike_state(counts: DataFrame, as_of, ts: str = "ts", seconds: int = C.SPIKE_WINDOW_SECONDS,
                threshold: int = C.SPIKE_THRESHOLD) -> DataFrame:
    """Events in the window that ends at `as_of`, and whether a spike is on."""
    recent = rollups.since(counts, as_of, seconds / 3600, ts)
    return recent.agg(F.coalesce(F.sum("n_at_ts"), F.lit(0)).alias("spike_window_count")).withColumn(
        "spike_active", F.col("spike_window_count") >= threshold
    )
