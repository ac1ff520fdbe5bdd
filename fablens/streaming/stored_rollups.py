"""Rollups that are kept: partial states per batch, merged into day partitions, read without the raw events.

A micro-batch leaves the partial states of its buckets (counts, sums, numbers of values). `refresh` merges what came since
the last refresh into the days it touches, and only those; states of buckets that are not over yet (from `end` on) wait in
a tail, so the bucket in progress is not rewritten each time. A read adds up the days it needs, the tail and the batches
after the last refresh. So late rows count at once, in whatever bucket, and raw events are never read again.

    parts/batch_id=B      states of one batch               states/N     what refresh N has merged (written last)
    days/refresh=N/day=D  states of the days N has touched   tails/refresh=N   states left waiting by N

A refresh takes effect when its state file is there. What it replaces is deleted by the refresh after it, so reads that
began before it end undisturbed; a refresh that stopped half-way is made again under the same number.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fablens.operators.rollups import minutes_bucket
from fablens.session import read_text, remove_path, write_text
from fablens.streaming.jobs import AVAILABLE_NOW, for_each_batch
from fablens.streaming.key_index import BATCH, names_in
from fablens.streaming.tables import append_batch


@dataclass(frozen=True)
class Rollup:
    """Counts and means by bucket and keys. `counts` maps names to SQL conditions, `means` columns to names."""

    ts: str
    minutes: int
    keys: Mapping[str, str]
    counts: Mapping[str, str] = field(default_factory=dict)
    means: Mapping[str, str] = field(default_factory=dict)

    def parts(self, rows: DataFrame) -> DataFrame:
        """Partial states: they can be added up in any order."""
        sums = [a for c in self.means for a in (F.sum(F.col(c).cast("double")).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n"))]
        keys = [F.expr(expression).alias(name) for name, expression in self.keys.items()]
        bucket = minutes_bucket(rows, self.minutes, self.ts).cast("timestamp").alias("bucket")
        return rows.groupBy(bucket, *keys).agg(
            F.count(F.lit(1)).alias("event_count"), *[F.count_if(F.expr(c)).alias(n) for n, c in self.counts.items()], *sums,
        )

    def _states(self) -> list[str]:
        return ["event_count", *self.counts, *[f"{c}{end}" for c in self.means for end in ("_sum", "_n")]]

    def added(self, parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        return parts.groupBy(*by, "bucket", *self.keys).agg(*[F.sum(c).alias(c) for c in self._states()])

    def finished(self, parts: DataFrame) -> DataFrame:
        mean = lambda c: F.round(F.col(f"{c}_sum") / F.nullif(F.col(f"{c}_n"), F.lit(0)), 8)
        return self.added(parts).select(
            "bucket", *self.keys, "event_count", *self.counts, *[mean(c).alias(n) for c, n in self.means.items()]
        )


_LEVEL = {"severity": "upper(severity)"}
_SENSORS = {"temperature_k": "avg_temp_k", "pressure_pa": "avg_pressure_pa"}
HOURLY_CATEGORY = Rollup("ts", 60, {"ai_category": "ai_category", **_LEVEL})
DAILY_MACHINE = Rollup(
    "ts", 24 * 60, {"source": "source", "ai_category": "ai_category", **_LEVEL}, means={"confidence_score": "avg_confidence"}
)


def tool_rollup(minutes: int) -> Rollup:
    """Readings by tool and severity."""
    return Rollup(
        "event_time", minutes, {"tool_id": "tool_id", "severity": "severity"},
        {"critical_count": "severity = 'CRITICAL'", "error_count": "severity = 'ERROR'"},
        {"normalize_confidence": "avg_norm_conf", **_SENSORS, "rf_power_w": "avg_rf_power_w"},
    )


def run_rollup(rows: DataFrame, rollup: Rollup, out: str, checkpoint: str, trigger=AVAILABLE_NOW) -> StreamingQuery:
    """Partial states of each batch, at once."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        append_batch(rollup.parts(batch), f"{out}/parts", batch_id)

    return for_each_batch(rows, handle, checkpoint, trigger, "rollup")


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    return sorted(int(n.removeprefix(prefix)) for n in names_in(spark, path) if n.startswith(prefix) and n.removeprefix(prefix).isdigit())


def _state(spark: SparkSession, out: str) -> tuple[int, int]:
    """(refresh, batch): the last finished refresh and the last batch it has merged; -1 if there is none."""
    for number in reversed(_numbers(spark, f"{out}/states", "")):
        found = read_text(spark, f"{out}/states/{number}")
        if found and found.endswith("}"):
            return number, json.loads(found)["merged"]
    return -1, -1


def _day_folders(spark: SparkSession, out: str, upto: int) -> dict[dt.date, list[int]]:
    """The refreshes up to `upto` that have written each day, in order."""
    found: dict[dt.date, list[int]] = {}
    for number in _numbers(spark, f"{out}/days", "refresh="):
        if number <= upto:
            for name in names_in(spark, f"{out}/days/refresh={number}"):
                if name.startswith("day="):
                    found.setdefault(dt.date.fromisoformat(name.removeprefix("day=")), []).append(number)
    return found


def _read(spark: SparkSession, paths: Sequence[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _pending(spark: SparkSession, out: str, after: int, before: int | None = None) -> list[str]:
    numbers = _numbers(spark, f"{out}/parts", f"{BATCH}=")
    return [f"{out}/parts/{BATCH}={n}" for n in numbers if n > after and (before is None or n < before)]


def _schema(spark: SparkSession, out: str):
    """Of the partial states: that of any folder."""
    refresh, _ = _state(spark, out)
    path = f"{out}/tails/refresh={refresh}" if refresh >= 0 else next(iter(_pending(spark, out, -1)), None)
    return spark.read.parquet(path).schema if path else None


def refresh(spark: SparkSession, out: str, rollup: Rollup, before: int, end: dt.datetime | None = None) -> list[dt.date]:
    """Merge the parts of batches below `before` and the tail into the days they touch; buckets from `end` on wait.

    The last batch of a stream may be repeated, so leave it out with `before`. Returns the days that were written.
    """
    last, merged = _state(spark, out)
    schema = _schema(spark, out)
    paths = _pending(spark, out, merged, before)
    if schema is None or not paths and last < 0:
        return []
    tail = [f"{out}/tails/refresh={last}"] if last >= 0 else []
    pending = _read(spark, [*tail, *paths], schema).withColumn("day", F.to_date("bucket"))
    waits = F.lit(False) if end is None else F.col("bucket") >= _time(end)
    number, folders = last + 1, _day_folders(spark, out, last)
    ready = pending.filter(~waits)
    touched = [r["day"] for r in ready.select("day").distinct().collect()]  # days, one partition each
    old = [f"{out}/days/refresh={folders[day][-1]}/day={day}" for day in touched if day in folders]
    whole = ready.unionByName(_read(spark, old, schema).withColumn("day", F.to_date("bucket")))
    rollup.added(whole, ["day"]).repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{out}/days/refresh={number}")
    rollup.added(pending.filter(waits)).select(schema.names).write.mode("overwrite").parquet(f"{out}/tails/refresh={number}")
    reached = max([merged, *[int(p.rsplit("=", 1)[1]) for p in paths]])
    write_text(spark, f"{out}/states/{number}", json.dumps({"merged": reached}))
    _delete_replaced(spark, out, number - 1)
    return sorted(touched)


def _delete_replaced(spark: SparkSession, out: str, number: int) -> None:
    """What refresh `number` has replaced: nothing that began after it reads that."""
    found = read_text(spark, f"{out}/states/{number}") if number >= 0 else None
    if found is None:
        return
    merged = json.loads(found)["merged"]
    for batch in _numbers(spark, f"{out}/parts", f"{BATCH}="):
        if batch <= merged:
            remove_path(spark, f"{out}/parts/{BATCH}={batch}")
    for earlier in _numbers(spark, f"{out}/tails", "refresh="):
        if earlier < number:
            remove_path(spark, f"{out}/tails/refresh={earlier}")
            remove_path(spark, f"{out}/states/{earlier}")
    for day, numbers in _day_folders(spark, out, number).items():
        for earlier in numbers[:-1]:
            remove_path(spark, f"{out}/days/refresh={earlier}/day={day}")


def stored_parts(spark: SparkSession, out: str, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame | None:
    """All partial states of buckets in the closed range [start, end]: from the days of the range, the tail, and new batches."""
    schema = _schema(spark, out)
    if schema is None:
        return None
    last, merged = _state(spark, out)
    folders = _day_folders(spark, out, last)
    inside = lambda day: (start is None or day >= start.date()) and (end is None or day <= end.date())
    days = [f"{out}/days/refresh={numbers[-1]}/day={day}" for day, numbers in sorted(folders.items()) if inside(day)]
    tail = [f"{out}/tails/refresh={last}"] if last >= 0 else []
    parts = _read(spark, [*days, *tail, *_pending(spark, out, merged)], schema)
    if start is not None:
        parts = parts.filter(F.col("bucket") >= _time(start))
    return parts if end is None else parts.filter(F.col("bucket") <= _time(end))


def _time(value: dt.datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp")


def read_rollup(
    spark: SparkSession, out: str, rollup: Rollup, start: dt.datetime | None = None, end: dt.datetime | None = None,
) -> DataFrame:
    """The rollup, or its buckets in the closed range [start, end]."""
    return rollup.finished(stored_parts(spark, out, start, end))
