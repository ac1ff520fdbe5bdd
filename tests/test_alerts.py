"""Alerts on a stream are those of the batch form, whatever the order of arrival."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fablens.operators.sequences import trend_alerts
from fablens.streaming.alerts import run_alerts, stream_alerts
from fablens.streaming.tables import current_rows, read_table

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, source string, ts timestamp, event_type string, value double, severity string, ai_category string"


def some_events(n, seed):
    rng = random.Random(seed)
    rows, at = [], START
    for i in range(n):
        at += dt.timedelta(minutes=rng.choice([0, 1, 5, 30, 60]))
        rows.append((
            i, rng.choice(["m1", "m2", "m3", None]), at, rng.choice(["a", "b", None]), rng.choice([None, *map(float, range(8))]),
            rng.choice(["INFO", "WARNING", "ERROR", "CRITICAL", "odd", None]), rng.choice(["safety", "process", None]),
        ))
    return rows


@pytest.mark.parametrize("order, delay_hours, some_late", [
    ("in order", 2, False), ("nearly", 40, False), ("shuffled", 10_000, False), ("shuffled", 3, True), ("backwards", 1, True),
])
def test_alerts_follow_the_batch_form(spark, tmp_path, order, delay_hours, some_late):
    rows = some_events(240, 3)
    arrived = list(rows)
    rng = random.Random(4)
    if order == "shuffled":
        rng.shuffle(arrived)
    elif order == "backwards":
        arrived.reverse()
    elif order == "nearly":
        arrived.sort(key=lambda r: r[2] + dt.timedelta(hours=rng.uniform(0, 30)))
    for i in range(0, 240, 60):
        spark.createDataFrame(arrived[i:i + 60], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, delay = str(tmp_path / "out"), dt.timedelta(hours=delay_hours)
    run_alerts(stream, out, str(tmp_path / "ck"), delay=delay, min_run=3, min_gaps=2).awaitTermination()
    events = spark.createDataFrame(rows, SCHEMA)
    got, want = stream_alerts(spark, out, events, 50.0, 3, 2), trend_alerts(events, 50.0, 3, 2)
    as_rows = lambda df: sorted(map(repr, (tuple(r) for r in df.select(sorted(df.columns)).collect())))
    assert as_rows(got) == as_rows(want) and len(as_rows(want)) == 4
    late = current_rows(read_table(spark, out), ["source"]).agg(F.sum("n_late")).first()[0]
    assert (late > 0) == some_late
