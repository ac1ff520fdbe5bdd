"""Streams cut into several micro-batches must give what one batch gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fablens.operators import dedup, iforest, rollups, sequences
from fablens.plans import bindings as B
from fablens.plans.scoring_queries import with_features
from fablens.sources import topics
from fablens.streaming import jobs, stored_rollups
from fablens.streaming.tables import append_if_absent, read_table

START = dt.datetime(2024, 1, 1)


def in_files(df, path, files, order, shuffled=None):
    """Write a frame as files that a stream reads one after the other, in time order or shuffled by a seed."""
    rows = df.orderBy(order).collect()
    if shuffled is not None:
        random.Random(shuffled).shuffle(rows)
    size = -(-len(rows) // files)
    for i in range(files):
        part = df.sparkSession.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1)
        part.write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def values_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


ORDERS = pytest.mark.parametrize("shuffled", [None, 1])


@ORDERS
def test_exact_dedup_over_batches(spark, tmp_path, shuffled):
    rng = random.Random(5)
    rows = [(f"h{rng.randrange(12)}", START + dt.timedelta(hours=rng.uniform(0, 200)), job) for job in range(300)]
    files = spark.createDataFrame(rows, "file_hash string, ts timestamp, job_id long")
    stream = in_files(files, str(tmp_path / "in"), 5, "ts", shuffled)
    jobs.run_dedup(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    columns = ["job_id", "original_job_id", "first_seen", "is_duplicate"]
    assert read_table(spark, str(tmp_path / "out/files")).select("batch_id").distinct().count() == 5
    got = jobs.marked_files(spark, str(tmp_path / "out"))
    assert values(got, *columns) == values(dedup.mark_duplicates(files), *columns)


def test_expired_hashes_register_anew(spark, tmp_path):
    rows = [("a", START + dt.timedelta(hours=h), h) for h in (0, 30, 60, 90)]
    files = spark.createDataFrame(rows, "file_hash string, ts timestamp, job_id long")
    stream = in_files(files, str(tmp_path / "in"), 4, "ts")
    jobs.run_dedup(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = jobs.marked_files(spark, str(tmp_path / "out")).filter("not is_duplicate")
    assert values(got, "job_id") == [(0,), (30,), (60,), (90,)]


def folders_read(df):
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def test_a_very_late_row_touches_its_own_window_and_hash(spark, tmp_path):
    """One row ten years old: the stored rows of the days between are neither read nor written again."""
    for number in range(3):
        rows = [(f"h{number}-{i}", START + dt.timedelta(days=number, minutes=i), number * 50 + i) for i in range(50)]
        spark.createDataFrame(rows, "file_hash string, ts timestamp, job_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if number == 1:
            old = [("h0-0", START - dt.timedelta(days=3650), 999), (None, START - dt.timedelta(days=3650), 1000)]
            spark.createDataFrame(old, "file_hash string, ts timestamp, job_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("file_hash string, ts timestamp, job_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.run_dedup(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        jobs.run_spikes(stream, str(tmp_path / "spikes"), str(tmp_path / "ck2")).awaitTermination()
    files = spark.read.parquet(str(tmp_path / "in"))
    columns = ["job_id", "original_job_id", "first_seen", "is_duplicate"]
    none_first = lambda rows: sorted(rows, key=lambda r: r[0])
    assert none_first(values_of(jobs.marked_files(spark, str(tmp_path / "out")), *columns)) == none_first(
        values_of(dedup.mark_duplicates(files), *columns))
    written = {r["batch_id"]: r["n"] for r in read_table(spark, str(tmp_path / "out/files")).groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    late = next(b for b, n in written.items() if n < 50)
    assert written[late] == 3  # the two old rows, and the one of their hash
    counts = read_table(spark, str(tmp_path / "spikes/counts"))
    assert counts.filter(F.col("batch_id") == late).count() == 1
    got = jobs.spike_counts(spark, str(tmp_path / "spikes"))
    assert values(got, "ts", "window_count") == values(sequences.rolling_counts(files), "ts", "window_count")


def test_refresh_writes_touched_days_only(spark, tmp_path):
    rollup, out, path = stored_rollups.HOURLY_CATEGORY, str(tmp_path / "out"), str(tmp_path / "in")
    schema = "ts timestamp, ai_category string, severity string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        stored_rollups.run_rollup(stream, rollup, out, str(tmp_path / "ck")).awaitTermination()

    def read(**bounds):
        return stored_rollups.read_rollup(spark, out, rollup, **bounds)

    def same():
        whole = rollups.hourly_category_rollup(spark.read.parquet(path))
        columns = ["bucket", "ai_category", "severity", "event_count"]
        assert values(read(), *columns) == values(whole, *columns)

    day = lambda d, h=0: START + dt.timedelta(days=d, hours=h)
    arrive([(day(d, h), "c", "error") for d in range(5) for h in (1, 2, 2)])
    same()
    assert stored_rollups.refresh(spark, out, rollup, before=1, end=day(4)) == [day(d).date() for d in range(4)]
    same()
    arrive([(day(1, 2), "c", "ERROR"), (day(1, 7), "d", "info")])  # late
    same()
    assert stored_rollups.refresh(spark, out, rollup, before=2, end=day(4)) == [day(1).date()]
    same()
    # A read of one day opens its folder, the tail and nothing else.
    assert len(folders_read(read(start=day(1), end=day(1, 23)))) == 2
    arrive([(day(4, 2), "c", "error")])
    same()
    # Refreshing under the same number again, as after a stop, changes nothing.
    state = tmp_path / "out" / "states"
    assert stored_rollups.refresh(spark, out, rollup, before=3) == [day(4).date()]
    last = max(int(p.name) for p in state.iterdir() if p.name.isdigit())
    (state / str(last)).unlink()
    same()
    stored_rollups.refresh(spark, out, rollup, before=3)
    same()


@ORDERS
def test_spikes_over_batches(spark, tmp_path, shuffled):
    rng = random.Random(6)
    rows = [(START + dt.timedelta(seconds=rng.randrange(3000)),) for _ in range(400)]
    events = spark.createDataFrame(rows, "ts timestamp")
    stream = in_files(events, str(tmp_path / "in"), 4, "ts", shuffled)
    jobs.run_spikes(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = jobs.spike_counts(spark, str(tmp_path / "out"))
    columns = ["ts", "n_at_ts", "window_count", "spike"]
    assert values(got, *columns) == values(sequences.rolling_counts(events), *columns)
    state = jobs.spike_state(got, START + dt.timedelta(seconds=2990)).first()
    assert state["spike_window_count"] == sum(2690 <= (r[0] - START).total_seconds() for r in rows)


@ORDERS
def test_rollups_over_batches(spark, tmp_path, shuffled):
    rng = random.Random(7)
    rows = [(START + dt.timedelta(seconds=rng.randrange(9000)), f"t{rng.randrange(3)}", rng.choice(["ERROR", "CRITICAL"]),
             rng.choice([None, rng.random()]), rng.random(), rng.random(), rng.random()) for _ in range(300)]
    names = "event_time timestamp, tool_id string, severity string, normalize_confidence double, temperature_k double, pressure_pa double, rf_power_w double"
    readings = spark.createDataFrame(rows, names)
    stream = in_files(readings, str(tmp_path / "in"), 4, "event_time", shuffled)
    rollup = stored_rollups.tool_rollup(5)
    stored_rollups.run_rollup(stream, rollup, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = stored_rollups.read_rollup(spark, str(tmp_path / "out"), rollup)
    want = rollups.five_minute_rollup(readings)
    columns = ["bucket", "tool_id", "severity", "event_count", "avg_norm_conf", "avg_temp_k", "avg_pressure_pa", "avg_rf_power_w"]
    assert sorted(map(repr, values_of(got, *columns))) == sorted(map(repr, values_of(want, *columns)))
    jobs.run_sliding(stream.select(F.col("event_time").alias("ts")), str(tmp_path / "s"), str(tmp_path / "ck2")).awaitTermination()
    windows = jobs.sliding_spikes(read_table(spark, str(tmp_path / "s/slots")), threshold=2)
    direct = readings.groupBy(F.window("event_time", "300 seconds", "30 seconds").alias("w")).agg(F.count("*").alias("n"))
    direct = direct.filter("n >= 2").select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
    assert values(windows, "window_start", "window_end", "n") == values(direct, "window_start", "window_end", "n")


def test_figures_of_many_batches(spark, tmp_path):
    rows = spark.createDataFrame([(str(i) if i % 5 else "",) for i in range(110)], "job_id string")
    stream = in_files(rows, str(tmp_path / "in"), 110, "job_id")
    jobs.run_measured(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    figures = jobs.consumer_metrics(spark, str(tmp_path / "out/figures"))
    assert figures.agg(F.count("*"), F.sum("total_received"), F.sum("total_written")).first() == (110, 110, 88)


def test_key_on_two_days_is_inserted_once(spark, tmp_path, sf_dir):
    """A message without a valid time, delivered again under a later as_of."""
    from fablens.plans.stream_queries import _classified

    path, out = str(tmp_path / "topics"), str(tmp_path / "out")
    messages = _classified(B.events(spark, sf_dir)).filter("topic in ('logs.p0', 'logs.p1')").withColumn("timestamp", F.lit("no time"))
    topics.write_messages(topics.encode_messages(messages), path)
    for run, as_of in (("one", "2024-01-01 00:00:00"), ("two", "2024-01-05 00:00:00")):
        source = topics.decode_messages(topics.read_topics(spark, path, ["logs.p0", "logs.p1"]))
        jobs.run_cold(source, out, str(tmp_path / run), F.lit(as_of).cast("timestamp"), jobs.AVAILABLE_NOW, run).awaitTermination()
    rows = spark.read.parquet(f"{out}/events")
    assert rows.count() == messages.count() > 0
    for attempt in ("a", "b"):
        source = topics.decode_messages(topics.read_topics(spark, path, ["logs.p0", "logs.p1"]))
        jobs.run_hot(source, f"{out}/hot", str(tmp_path / attempt), F.lit("2024-01-01").cast("timestamp")).awaitTermination()
    alerts = spark.read.parquet(f"{out}/hot/alerts")
    assert alerts.count() == messages.count()
    assert {r.topic for r in alerts.select("topic").distinct().collect()} <= {"logs.p0", "logs.p1"}


def test_unreadable_table_is_an_error(spark, tmp_path):
    assert read_table(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):  # noqa: B017
        read_table(spark, str(tmp_path / "bad")).count()


def test_cold_consumer_restarts_and_redelivery(spark, tmp_path, sf_dir):
    path, out = str(tmp_path / "topics"), str(tmp_path / "out")
    from fablens.plans.stream_queries import _classified

    topics.write_messages(topics.encode_messages(_classified(B.events(spark, sf_dir))).repartition(6), path)
    as_of = F.lit(B.AS_OF).cast("timestamp")
    for run, limit in (("one", "1"), ("one", "1"), ("two", "3")):
        source = topics.read_topics(spark, path, ["logs.p2"], options={"maxFilesPerTrigger": limit})
        jobs.run_cold(
            topics.decode_messages(source), out, str(tmp_path / f"ck-{run}"), as_of, jobs.AVAILABLE_NOW, run
        ).awaitTermination()
    rows = spark.read.parquet(f"{out}/events")
    assert rows.count() == rows.select("job_id", "event_index").distinct().count()
    expected = _classified(B.events(spark, sf_dir)).filter(F.col("topic") == "logs.p2").count()
    assert rows.count() == expected
    assert rows.filter("run = 'one'").select("batch_id").distinct().count() > 1


def test_repeated_batch_overwrites_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1), ("b", 1), ("a", 0)], "k string, at int")
    second = spark.createDataFrame([("a", 5), ("c", 5)], "k string, at int")
    for _ in range(2):
        append_if_absent(first, path, 0, ["k"], ["at"])
    for _ in range(2):
        append_if_absent(second, path, 1, ["k"], ["at"])
    assert values(spark.read.parquet(path), "k", "at") == [("a", 0), ("b", 1), ("c", 5)]


def test_novelty_over_batches(spark, tmp_path, sf_dir):
    events = with_features(B.events(spark, sf_dir)).select("event_id", "features", "ts")
    stream = in_files(events, str(tmp_path / "in"), 4, "ts").select("event_id", "features")
    out = str(tmp_path / "out")
    jobs.run_novelty(stream, out, str(tmp_path / "ck")).awaitTermination()
    total = events.count()
    scores = read_table(spark, f"{out}/scores")
    assert scores.count() == total
    assert scores.agg(F.max("epoch")).first()[0] == iforest.refits_due(total)
    # The samples kept from batch to batch are those one would draw from all rows at once.
    last = read_table(spark, f"{out}/samples").filter("batch_id = 3")
    whole = iforest.tree_samples(events, "event_id", "features", total)
    assert values(last, "tree", "row_id", "draw") == values(whole, "tree", "row_id", "draw")


def test_warm_up_gives_no_scores(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i)] * 7, START) for i in range(40)], "event_id long, features array<double>, ts timestamp")
    stream = in_files(rows, str(tmp_path / "in"), 2, "event_id").select("event_id", "features")
    jobs.run_novelty(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    scores = read_table(spark, str(tmp_path / "out/scores"))
    assert scores.filter("novelty_score is null and epoch = 0").count() == 40
