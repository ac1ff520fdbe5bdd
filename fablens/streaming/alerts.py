"""Trend alerts on a stream: each machine's sequence is folded as it grows, and its alert is renewed with every batch.

State per machine (RocksDB, `transformWithState`):
* `trend`, a value: what the rows up to a border add up to: counts of patterns, sums of the regression, the last two rows.
* `repeats`, a map by event type: the last two times of that type and the gaps that shrink so far.
* `open`, a list: rows after the border, in any order. A row stays open until the machine's newest row is `delay` younger;
  then it is folded, in order. So rows may come in any order within `delay`.

The time is the machine's own: a machine that is silent waits with its open rows, and another one's clock cannot make its
rows late. A row that comes when its place is folded already is late. It is counted, and from then on the machine's alert
is worked out from its stored events whenever it is read (`stream_alerts`), so no late row is lost either.
"""

from __future__ import annotations

import datetime as dt
from collections import namedtuple
from collections.abc import Iterator, Mapping
from copy import copy
from dataclasses import astuple, dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fablens.functions.scoring import severity_code
from fablens.operators import sequences
from fablens.operators.skew import lookup_join
from fablens.session import stored
from fablens.streaming.jobs import AVAILABLE_NOW, for_each_batch
from fablens.streaming.tables import append_batch, current_rows, read_table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DELAY = dt.timedelta(days=1)
_HOUR = 3_600_000_000

_ROW = "at LONG, event_id LONG, event_type STRING, value DOUBLE, severity STRING, level INT, category STRING"
_TREND = """at LONG, event_id LONG, value DOUBLE, value_before DOUBLE, level INT, category STRING, severity STRING, steps LONG,
    n_events LONG, n_runs LONG, n_escalations LONG, n_shifts LONG, n_shrinking LONG, n_late LONG,
    origin LONG, n LONG, sx DOUBLE, sy DOUBLE, sxx DOUBLE, sxy DOUBLE, last_value DOUBLE"""
_REPEAT = "at LONG, before LONG, gaps LONG"
TRENDS = """source STRING, n_events LONG, n_runs LONG, n_escalations LONG, n_shifts LONG, n_shrinking LONG, n_late LONG,
    last_severity STRING, last_at LONG, slope DOUBLE, last_value DOUBLE"""


Event = namedtuple("Event", [part.split()[0] for part in _ROW.split(", ")])


@dataclass
class Trend:
    """What the rows folded so far add up to. The first seven fields are those of the last rows."""

    at: int | None = None
    event_id: int | None = None
    value: float | None = None
    value_before: float | None = None
    level: int | None = None
    category: str | None = None
    severity: str | None = None
    steps: int = 0
    n_events: int = 0
    n_runs: int = 0
    n_escalations: int = 0
    n_shifts: int = 0
    n_shrinking: int = 0
    n_late: int = 0
    origin: int | None = None
    n: int = 0
    sx: float = 0.0
    sy: float = 0.0
    sxx: float = 0.0
    sxy: float = 0.0
    last_value: float | None = None


def _direction(value: float | None, before: float | None) -> int | None:
    return None if value is None or before is None else (value > before) - (value < before)


@dataclass
class Folding:
    """Folds rows in order into a trend and its repeats. A pattern counts as soon as it is long enough."""

    trend: Trend
    repeats: dict[str, tuple]
    min_run: int
    min_gaps: int

    def add(self, row) -> None:
        t = self.trend
        direction = _direction(row.value, t.value)
        if not direction or direction != _direction(t.value, t.value_before):
            t.steps = 0
        if direction:
            t.steps += 1
            t.n_runs += t.steps + 1 == max(self.min_run, 2)
        t.n_escalations += row.level is not None and t.level is not None and row.level > t.level
        moved = row.category is not None and t.category is not None and row.category != t.category
        t.n_shifts += moved and (row.category == "safety" or (row.severity or "").upper() == "CRITICAL")
        at, before, gaps = self.repeats.get(_type_key(row.event_type), (None, None, 0))
        if at is not None:
            gaps = gaps + 1 if before is not None and row.at - at < at - before else 1
            t.n_shrinking += gaps == max(self.min_gaps, 1)
        self.repeats[_type_key(row.event_type)] = (row.at, at, gaps)
        if row.value is not None:
            t.origin = row.at if t.origin is None else t.origin
            x = (row.at - t.origin) / _HOUR
            t.n, t.sx, t.sy = t.n + 1, t.sx + x, t.sy + row.value
            t.sxx, t.sxy, t.last_value = t.sxx + x * x, t.sxy + x * row.value, row.value
        t.n_events += 1
        t.at, t.event_id, t.value_before, t.value = row.at, row.event_id, t.value, row.value
        t.level, t.category, t.severity = row.level, row.category, row.severity


def _type_key(event_type: str | None) -> str:
    return "-" if event_type is None else "+" + event_type


class TrendProcessor(StatefulProcessor):
    """Rows of a machine -> one row with its figures, for each batch in which it has rows."""

    def __init__(self, delay_us: int, min_run: int, min_gaps: int):
        self.delay_us, self.min_run, self.min_gaps = delay_us, min_run, min_gaps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.trend = handle.getValueState("trend", _TREND)
        self.repeats = handle.getMapState("repeats", "event_type STRING", _REPEAT)
        self.open = handle.getListState("open", _ROW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        trend = Trend(*self.trend.get()) if self.trend.exists() else Trend()
        border = (trend.at, trend.event_id) if trend.n_events else None
        waiting = [Event(*r) for r in self.open.get()] if self.open.exists() else []
        for row in rows:
            if row.at is None or border is not None and (row.at, row.event_id) <= border:
                trend.n_late += 1
            else:
                waiting.append(Event(*(row[c] for c in Event._fields)))
        waiting.sort(key=lambda r: (r.at, r.event_id))
        types = {_type_key(r.event_type) for r in waiting}
        known = {t: tuple(self.repeats.getValue((t,))) for t in types if self.repeats.containsKey((t,))}
        folding = Folding(trend, known, self.min_run, self.min_gaps)
        due = sum(r.at <= waiting[-1].at - self.delay_us for r in waiting) if waiting else 0
        for row in waiting[:due]:
            folding.add(row)
        for name in {_type_key(r.event_type) for r in waiting[:due]}:
            self.repeats.updateValue((name,), folding.repeats[name])
        self.trend.update(astuple(trend))
        if waiting[due:]:
            self.open.put([tuple(event) for event in waiting[due:]])
        elif self.open.exists():
            self.open.clear()
        now = Folding(copy(trend), dict(folding.repeats), self.min_run, self.min_gaps)
        for row in waiting[due:]:
            now.add(row)
        yield _figures(key[0], now.trend)

    def close(self) -> None:
        pass


def _figures(source: str | None, t: Trend) -> Row:
    spread = t.n * t.sxx - t.sx * t.sx
    slope = (t.n * t.sxy - t.sx * t.sy) / spread if t.n > 1 and spread else None
    return Row(
        source=source, n_events=t.n_events, n_runs=int(t.n_runs), n_escalations=int(t.n_escalations), n_shifts=int(t.n_shifts),
        n_shrinking=int(t.n_shrinking), n_late=t.n_late, last_severity=t.severity, last_at=t.at, slope=slope, last_value=t.last_value,
    )


def run_alerts(
    events: DataFrame, out: str, checkpoint: str, trigger: Mapping[str, Any] = AVAILABLE_NOW, delay: dt.timedelta = DELAY,
    min_run: int = 5, min_gaps: int = 5,
) -> StreamingQuery:
    """Figures of each machine that has new events (source, ts, event_id, event_type, value, severity, ai_category).

    `stream_alerts` gives the alerts. A batch's share of one machine is one task, so bound batches at the source.
    """
    spark = events.sparkSession
    severity = F.col("severity")
    rows = events.select(
        "source", sequences.micros(F.col("ts")).alias("at"), F.col("event_id").cast("long").alias("event_id"), "event_type",
        F.col("value").cast("double").alias("value"), "severity",
        F.when(severity.isNotNull(), severity_code(severity)).cast("int").alias("level"), F.col("ai_category").alias("category"),
    )
    processor = TrendProcessor(int(delay / dt.timedelta(microseconds=1)), min_run, min_gaps)
    figures = rows.groupBy("source").transformWithState(processor, TRENDS, "Update", "None")

    def handle(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, out, batch_id)

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:  # a query keeps the settings it was started with
        return for_each_batch(figures, handle, checkpoint, trigger, "alerts")
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def stream_alerts(
    spark: SparkSession, out: str, events: DataFrame, limit: float, min_run: int = 5, min_gaps: int = 5, as_of=None,
) -> DataFrame:
    """The current alerts. Machines with late rows are worked out from `events`, the stored ones; others are not read."""
    last = stored(current_rows(read_table(spark, out, TRENDS), ["source"]), "figures")
    kind = events.schema["ts"].dataType
    on_time = last.filter(F.col("n_late") == 0).withColumn("last_ts", F.timestamp_micros("last_at").cast(kind))
    alerts = sequences.rated_alerts(on_time, limit, as_of)
    late = last.filter(F.col("n_late") > 0).select("source")
    if not late.take(1):
        return alerts
    # A join on plain equality would lose the machine null.
    marked = lambda frame: frame.withColumn("_machine", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")))
    theirs = lookup_join(marked(events), marked(late).select("_machine"), ["_machine"], "left_semi", spread_by=["event_id"])
    again = sequences.trend_alerts(stored(theirs.drop("_machine"), "late-machines"), limit, min_run, min_gaps, as_of)
    return alerts.unionByName(again)
