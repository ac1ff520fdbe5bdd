"""Order-dependent analysis per machine: runs, escalations, shrinking gaps, category shifts, spikes and alerts.

All orders end with the event id, so equal times give one fixed result. `OrderedGroups` cuts a machine with very
many events into ordered blocks, and everything after it is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fablens import constants as C
from fablens.functions.scoring import severity_code
from fablens.operators.skew import MAX_GROUP_ROWS, OrderedGroups, floor_div

ORDER = ["ts", "event_id"]
_MICROS = 1_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


# Values and times one and two rows before; a run goes on while the direction stays.
_VALUE_LAGS = {"prev_value": ("value", 1), "earlier_value": ("value", 2), "prev_ts": ("ts", 1)}


def _direction() -> Column:
    return F.signum(F.col("value") - F.col("prev_value")).cast("int")


def _value_run_starts() -> Column:
    before = F.signum(F.col("prev_value") - F.col("earlier_value")).cast("int")
    return ~F.coalesce((_direction() != 0) & (_direction() == before), F.lit(False))


def numeric_runs(
    events: DataFrame, min_events: int = 3, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Longest stretches of strictly rising or strictly falling values per machine, of at least `min_events`."""
    rows = events.select("source", *ORDER, "value")
    ordered = OrderedGroups(rows, ["source"], ORDER, max_group_rows).evaluate(_VALUE_LAGS, _value_run_starts())
    steps = ordered.withColumn("direction", _direction()).filter(F.col("direction") != 0)
    at = F.struct(*ORDER)
    runs = steps.groupBy("source", "run").agg(
        F.max("direction").alias("direction"),
        (F.count(F.lit(1)) + 1).alias("n_events"),
        F.min("prev_ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.min_by("prev_value", at).alias("first_value"),
        F.max_by("value", at).alias("last_value"),
    )
    return runs.filter(F.col("n_events") >= min_events).drop("run")


def _levels_up() -> Column:
    """Severity levels gained since the machine's previous event; null for its first event."""
    gained = (severity_code(F.col("severity")) - severity_code(F.col("prev_severity"))).cast("int")
    return F.when(F.col("prev_severity").isNotNull(), gained)


def _moved_to_safety() -> Column:
    """The category changed, and it is safety now or the event is critical."""
    toward = (F.col("ai_category") == "safety") | (F.upper("severity") == "CRITICAL")
    return (F.col("prev_category") != F.col("ai_category")) & toward


def severity_escalations(events: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Events whose severity is above that of the machine's previous event."""
    rows = events.select("source", *ORDER, "severity")
    ordered = OrderedGroups(rows, ["source"], ORDER, max_group_rows).evaluate({"prev_severity": ("severity", 1)})
    return ordered.withColumn("levels", _levels_up()).filter(F.col("levels") > 0)


def shrinking_gaps(
    events: DataFrame, min_gaps: int = 3, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Stretches in which one event type of a machine repeats at strictly shrinking gaps."""
    rows = events.select("source", "event_type", *ORDER)
    gap = micros(F.col("ts")) - micros(F.col("prev_ts"))
    gap_before = micros(F.col("prev_ts")) - micros(F.col("earlier_ts"))
    ordered = OrderedGroups(rows, ["source", "event_type"], ORDER, max_group_rows).evaluate(
        {"prev_ts": ("ts", 1), "earlier_ts": ("ts", 2)}, ~F.coalesce(gap < gap_before, F.lit(False))
    )
    steps = ordered.withColumn("gap_us", gap).filter(F.col("gap_us").isNotNull())
    runs = steps.groupBy("source", "event_type", "run").agg(
        F.count(F.lit(1)).alias("n_gaps"),
        F.min("prev_ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.max("gap_us").alias("first_gap_us"),
        F.min("gap_us").alias("last_gap_us"),
    )
    return runs.filter(F.col("n_gaps") >= min_gaps).drop("run")


def safety_shifts(events: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Events that move a machine from another category to safety, or to critical severity in a new category."""
    rows = events.select("source", *ORDER, "ai_category", "severity")
    ordered = OrderedGroups(rows, ["source"], ORDER, max_group_rows).evaluate({"prev_category": ("ai_category", 1)})
    return ordered.filter(_moved_to_safety())


def _slope_aggregates() -> list[Column]:
    hours = micros(F.col("ts")) / F.lit(3_600.0 * _MICROS)
    return [
        F.regr_slope(F.col("value"), hours).alias("slope"),
        F.max_by("value", F.struct(*ORDER)).alias("last_value"),
    ]


def _estimate(slope: Column, last_value: Column, limit: float) -> Column:
    minutes = F.when((slope > 0) & (last_value < limit), (F.lit(limit) - last_value) / slope * 60)
    return F.when(last_value >= limit, F.lit("now")).when(
        minutes.isNotNull(), F.concat(F.lit("~"), F.round(minutes).cast("long").cast("string"), F.lit(" minutes"))
    ).otherwise("N/A")


def time_to_critical(events: DataFrame, limit: float) -> DataFrame:
    """Linear extrapolation of each machine's values to a limit, in minutes after its last event."""
    fits = events.filter(F.col("value").isNotNull()).groupBy("source").agg(*_slope_aggregates())
    slope = F.col("slope")
    return fits.select(
        "source", "last_value", F.round(slope, 6).alias("slope_per_hour"),
        _estimate(slope, F.col("last_value"), limit).alias("estimate"),
    )


def trend_alerts(
    events: DataFrame, limit: float, min_run: int = 5, min_gaps: int = 5, as_of=None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """One alert per machine with at least two events and at least one pattern.

    Runs, escalations and shifts share one ordered pass over the machines; it is summed per run first and per
    machine next, so that no machine's rows meet in one task. Repeats need a pass of their own, by event type.
    """
    at = F.struct(*ORDER)
    rows = events.select("source", *ORDER, "value", "severity", "ai_category")
    ordered = OrderedGroups(rows, ["source"], ORDER, max_group_rows).evaluate(
        {**_VALUE_LAGS, "prev_severity": ("severity", 1), "prev_category": ("ai_category", 1)}, _value_run_starts()
    ).withColumn("direction", _direction())
    one = F.lit(1).cast("long")
    per_run = ordered.groupBy("source", "run").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(F.when(F.col("direction") != 0, one)).alias("n_steps"),
        F.sum(F.when(_levels_up() > 0, one)).alias("n_escalations"),
        F.sum(F.when(_moved_to_safety(), one)).alias("n_shifts"),
        F.max_by("severity", at).alias("severity"), F.max(at).alias("last"),
    )
    machines = per_run.groupBy("source").agg(
        F.sum("n_events").alias("n_events"),
        F.sum(F.when(F.col("n_steps") + 1 >= min_run, one)).alias("n_runs"),
        F.sum("n_escalations").alias("n_escalations"), F.sum("n_shifts").alias("n_shifts"),
        F.max_by("severity", "last").alias("last_severity"), F.max("last.ts").alias("last_ts"),
    )
    repeats = shrinking_gaps(events, min_gaps, max_group_rows).groupBy("source").agg(F.count(F.lit(1)).alias("n_shrinking"))
    # Every part has one row per machine; events without a machine are one of them.
    fits = events.filter(F.col("value").isNotNull()).groupBy(F.col("source").alias("_s2")).agg(*_slope_aggregates())
    repeats = repeats.withColumnRenamed("source", "_s1")
    found = machines.join(repeats, F.col("source").eqNullSafe(F.col("_s1")), "left").join(
        fits, F.col("source").eqNullSafe(F.col("_s2")), "left"
    ).drop("_s1", "_s2")
    return rated_alerts(found, limit, as_of)


def rated_alerts(machines: DataFrame, limit: float, as_of=None) -> DataFrame:
    """Alerts from the figures of each machine.

    Columns: source, n_events, n_runs, n_escalations, n_shrinking, n_shifts, last_severity, last_ts, slope (an hour),
    last_value. Counts may be null.
    """
    estimate = _estimate(F.col("slope"), F.col("last_value"), limit)
    found = machines.filter(F.col("n_events") >= 2).withColumn("estimate", estimate)
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_runs", "n_escalations", "n_shrinking", "n_shifts")}
    texts = [
        ("n_runs", "%d monotone value runs"), ("n_escalations", "%d severity escalations"),
        ("n_shrinking", "%d repeats at shrinking gaps"), ("n_shifts", "%d shifts toward safety or critical"),
    ]
    pattern = F.concat_ws("; ", *[F.when(F.col(c) > 0, F.format_string(t, F.col(c))) for c, t in texts])
    kinds = sum(((F.col(c) > 0).cast("int") for c in counts), F.lit(0))
    severe = F.upper("last_severity").isin("CRITICAL", "ERROR") | (F.col("n_shifts") > 0)
    created = F.lit(str(as_of)).cast(machines.schema["last_ts"].dataType) if as_of is not None else F.col("last_ts")
    rated = found.withColumns(counts).withColumn("kinds", kinds)
    return rated.filter(F.col("kinds") > 0).select(
        F.col("source").alias("machine"),
        pattern.alias("pattern"),
        F.when(severe, "critical").otherwise("warning").alias("predicted_severity"),
        F.coalesce("estimate", F.lit("N/A")).alias("estimated_time_to_critical"),
        F.when(severe, F.concat(F.lit("Inspect "), F.col("source"), F.lit(" now")))
        .otherwise(F.concat(F.lit("Monitor "), F.col("source"))).alias("recommended_action"),
        F.round(F.lit(0.25) * F.col("kinds"), 2).alias("confidence"),
        created.alias("created_at"),
    )


def rolling_counts(
    events: DataFrame, seconds: int = C.SPIKE_WINDOW_SECONDS, threshold: int = C.SPIKE_THRESHOLD, ts: str = "ts"
) -> DataFrame:
    """For each distinct time the number of events in the trailing window, both ends included, and a spike flag.

    There is no key to partition by, and one second may hold a large share of all rows. Rows are first combined
    per microsecond. The window is then split at second borders:
      events in [t - s, t] = whole seconds [sec(t) - s, sec(t) - 1]
                             - those in the first of them that lie before t - s
                             + those in the last second up to t.
    The two fractions are running sums inside one second, at most a million distinct times; the whole seconds
    are running sums over per-second totals, cut into chunks of `seconds` that take over the total of the one before.
    """
    us = micros(F.col(ts))
    base = events.groupBy(us.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    marks = base.select(F.explode(F.array(
        F.struct(F.col("at").alias("t"), F.col("at"), F.lit(1).alias("is_event"), F.col("n")),
        F.struct(F.col("at").alias("t"), (F.col("at") - seconds * _MICROS).alias("at"), F.lit(0).alias("is_event"),
                 F.lit(0).cast("long").alias("n")),
    )).alias("m")).select("m.*", floor_div(F.col("m.at"), _MICROS).alias("second"))
    in_second = Window.partitionBy("second").orderBy("at", "is_event").rowsBetween(Window.unboundedPreceding, 0)
    running = marks.withColumn("running", F.sum("n").over(in_second))
    is_event = F.col("is_event") == 1
    parts = running.groupBy("t").agg(
        F.max(F.when(is_event, F.col("n"))).alias("n"),
        F.max(F.when(is_event, F.col("running"))).alias("upto"),
        F.max(F.when(~is_event, F.col("running"))).alias("before"),
    ).withColumn("second", floor_div(F.col("t"), _MICROS))

    # Each second enters the sum with its total and leaves it `seconds` later, which is in the next chunk. So a chunk begins
    # with the total of the one before, which is what leaves in it, and a running sum gives the rest: the work is that of
    # a sort, however many seconds a window holds.
    per_second = base.groupBy(floor_div(F.col("at"), _MICROS).alias("second")).agg(F.sum("n").alias("total"))
    changes = per_second.select("second", F.explode(F.array(
        F.struct(F.col("second").alias("at"), F.col("total").alias("change"), F.lit(True).alias("enters")),
        F.struct((F.col("second") + seconds).alias("at"), (-F.col("total")).alias("change"), F.lit(False).alias("enters")),
    )).alias("c")).select("second", "c.*").withColumn("chunk", floor_div(F.col("at"), seconds))
    in_chunk = Window.partitionBy("chunk").orderBy("at")
    all_of_it = in_chunk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = F.sum("change").over(in_chunk.rangeBetween(Window.unboundedPreceding, -1))
    leaving = F.sum(F.when(~F.col("enters"), F.col("change"))).over(all_of_it)
    whole = (
        changes.withColumn("whole", F.coalesce(so_far, F.lit(0)) - F.coalesce(leaving, F.lit(0)))
        .filter("enters").select("second", "whole")
    )
    counted = parts.join(whole, "second")
    in_window = F.col("whole") - F.col("before") + F.col("upto")
    return counted.select(
        F.timestamp_micros("t").cast(events.schema[ts].dataType).alias("ts"),
        F.col("n").alias("n_at_ts"),
        in_window.alias("window_count"),
        (in_window >= threshold).alias("spike"),
    )


def refit_epochs(
    events: DataFrame, min_rows: int = C.FOREST_MIN_ROWS, every: int = C.FOREST_REFIT_EVERY,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Running index of each event and the model it is scored with: 0 while warming up, then 1, 2, 3, ..."""
    numbered = OrderedGroups(events.select("event_id", "ts"), [], ORDER, max_group_rows).evaluate(number="n")
    n = F.col("n")
    fits = floor_div(n, every) - (min_rows // every) + 1
    return numbered.withColumn("epoch", F.when(n < min_rows, F.lit(0).cast("long")).otherwise(fits))
