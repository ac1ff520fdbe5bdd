"""Hot keys: the split forms must give what the plain forms give, and both what brute force gives."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from fablens.operators import dedup, joins, review, sequences, skew
from fablens.plans import bindings as B
from fablens.session import stored

START = dt.datetime(2024, 1, 1)


def same(a, b):
    columns = sorted(a.columns)
    key = lambda rows: sorted((tuple(r[c] for c in columns) for r in rows), key=repr)
    assert columns == sorted(b.columns)
    assert key(a.collect()) == key(b.collect())


def skewed_events(spark, rows=3000, seed=7):
    """Half of all events come from one machine, many at equal times."""
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        source = "hot" if rng.random() < 0.5 else f"m{rng.randrange(40)}"
        ts = START + dt.timedelta(seconds=rng.randrange(rows // 3) * 60)
        data.append((i, i // 8, ts, source, rng.choice("abc"), rng.choice(["INFO", "WARNING", "ERROR", "CRITICAL"]),
                     rng.choice(["safety", "thermal", "software"]), float(rng.randrange(50))))
    schema = ("event_id long, job_id long, ts timestamp_ntz, source string, event_type string, severity string, "
              "ai_category string, value double")
    return spark.createDataFrame(data, schema).repartition(8)


def with_null_machines(events):
    """A fifth of the events has no machine, and some no value."""
    nothing = F.lit(None)
    return events.withColumns({
        "source": F.when(F.col("event_id") % 5 == 0, nothing.cast("string")).otherwise(F.col("source")),
        "value": F.when(F.col("event_id") % 11 == 0, nothing.cast("double")).otherwise(F.col("value")),
    })


@pytest.mark.parametrize("limit", [5, 100])
@pytest.mark.parametrize("keys", [["source"], ["source", "event_type"], []])
def test_ordered_groups(spark, keys, limit):
    events = with_null_machines(skewed_events(spark, 60 * limit if limit < 50 else 1500)).cache()
    order = ["ts", "event_id"]
    lags = {"p": ("value", 1), "q": ("severity", 2), "r": ("value", 2)}
    starts = ~F.coalesce((F.col("value") >= F.col("p")) & (F.col("p") >= F.col("r")), F.lit(False))

    def all_of(limit):
        seq = skew.OrderedGroups(events, keys, order, limit)
        return seq, seq.evaluate(lags, starts, sums={"total": "value"}, number="n")

    plain, expected = all_of(10**6)
    split, got = all_of(limit)
    assert not plain.split and split.split
    assert split.df.groupBy(*keys, "_block").count().agg(F.max("count")).first()[0] < 400
    same(got, expected)
    # Against brute force.
    groups = {}
    for row in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        groups.setdefault(tuple(row[k] for k in keys), []).append(row)
    want = {}
    for rows in groups.values():
        run, total, seen = 0, 0.0, False
        for i, row in enumerate(rows):
            one, two = (rows[i - 1] if i > 0 else None), (rows[i - 2] if i > 1 else None)
            p, r = (one.value if one else None), (two.value if two else None)
            on = None not in (row.value, p, r) and row.value >= p >= r
            run += not on
            total, seen = total + (row.value or 0.0), seen or row.value is not None
            want[row.event_id] = (p, two.severity if two else None, r, run, total if seen else None, i + 1)
    assert {r.event_id: (r.p, r.q, r.r, r.run, r.total, r.n) for r in expected.collect()} == want


def test_sequence_operators_on_hot_machines(spark):
    for rows, limit in ((200, 5), (2000, 200)):
        events = with_null_machines(skewed_events(spark, rows)).cache()
        for operator in (sequences.numeric_runs, sequences.shrinking_gaps):
            same(operator(events, 3, max_group_rows=limit), operator(events, 3))
        for operator in (sequences.severity_escalations, sequences.safety_shifts, sequences.refit_epochs):
            same(operator(events, max_group_rows=limit), operator(events))
    same(sequences.trend_alerts(events, 60.0, 4, 3, max_group_rows=200), sequences.trend_alerts(events, 60.0, 4, 3))


def test_split_form_needs_one_ordered_pass_per_group(spark, monkeypatch):
    """The frames that the split form stores hold all its ordered work: two over rows, for machines and for event types."""
    plans = []
    monkeypatch.setattr(skew, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().toString())) or stored(df, name))
    alerts = sequences.trend_alerts(skewed_events(spark), 60.0, 4, 3, max_group_rows=100)
    ordered = [plan for name, plan in plans if name == "ordered"]
    assert len(ordered) == 2
    for plan in ordered:
        physical = plan.split("== Physical Plan ==")[1]
        assert physical.count("Exchange hashpartitioning") == 1 and physical.count("Sort [") == 1
    assert alerts.count() > 0


def test_small_blocks_share_tasks(spark, monkeypatch):
    """A limit of few rows makes many blocks, not many tasks; rows that repeat may fall into two blocks."""
    tasks = []
    monkeypatch.setattr(skew, "stored", lambda df, name: tasks.append((name, df.rdd.getNumPartitions())) or stored(df, name))
    events = with_null_machines(skewed_events(spark)).filter("event_id < 1000")
    events = events.unionByName(events).unionByName(events).cache()
    lags = {"p": ("value", 1), "r": ("value", 2)}
    starts = ~F.coalesce((F.col("value") >= F.col("p")) & (F.col("p") >= F.col("r")), F.lit(False))
    split = skew.OrderedGroups(events, ["source"], ["ts", "event_id"], 10)
    assert split.df.groupBy("source", "_block").count().agg(F.max("count")).first()[0] <= 5
    same(split.evaluate(lags, starts, number="n"), skew.OrderedGroups(events, ["source"], ["ts", "event_id"]).evaluate(lags, starts, number="n"))
    assert dict(tasks)["blocks"] == 2


def test_trend_alerts_count_what_the_operators_find(spark):
    events = skewed_events(spark)
    found = sequences.severity_escalations(events).groupBy("source").count().collect()
    alerts = {r["machine"]: r["pattern"] for r in sequences.trend_alerts(events, 60.0, 4, 3).collect()}
    for row in found:
        assert f"{row['count']} severity escalations" in alerts[row["source"]]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_lookup(spark, how):
    events = skewed_events(spark)
    table = events.filter(F.col("source") != "m3").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    broadcast = skew.lookup_join(events, table, ["source"], how)
    salted = skew.lookup_join(
        events, table, ["source"], how, spread_by=["event_id"], max_group_rows=100, max_broadcast_rows=20
    )
    same(salted, broadcast)


def test_size_check(spark):
    rows = spark.range(1000).repartition(50)
    assert skew.has_at_most(rows, 1000) and not skew.has_at_most(rows, 999)
    assert skew.has_at_most(rows.filter("id < 0"), 0)


def brute_force_marks(rows, ttl):
    """The rule as it is stated, one file after the other."""
    seen, marks = {}, {}
    for key, at, job in sorted(rows, key=lambda r: (r[1], r[2])):
        entry = seen.get(key)
        if entry is None or at >= entry[0] + ttl:
            seen[key] = entry = (at, job)
        marks[job] = (entry[1], entry[0], entry[1] != job)
    return marks


def test_hot_hash_over_many_slots(spark, monkeypatch):
    rng = random.Random(12)
    rows = [("hot", START + dt.timedelta(hours=rng.uniform(0, 24 * 420)), job) for job in range(4000)]
    rows += [(f"h{job % 9}", START + dt.timedelta(hours=rng.uniform(0, 400)), job) for job in range(4000, 4200)]
    files = spark.createDataFrame(rows, "file_hash string, ts timestamp_ntz, job_id long").repartition(6)
    tables = []
    monkeypatch.setattr(dedup, "stored", lambda df, name: tables.append(name) or stored(df, name))
    marked = dedup.mark_duplicates(files, max_group_rows=500)
    got = {r["job_id"]: (r["original_job_id"], r["first_seen"], r["is_duplicate"]) for r in marked.collect()}
    assert got == brute_force_marks(rows, dt.timedelta(days=1))
    assert tables.count("new") <= 10


@pytest.mark.parametrize("limit", [10**6, 60, 3])
def test_duplicates_against_brute_force(spark, limit):
    rng = random.Random(3)
    rows = []
    for job in range(1500):
        kind = rng.random()
        key = "hot" if kind < 0.4 else f"h{rng.randrange(60)}" if kind < 0.8 else f"once{job}"
        hours = rng.choice([24, 48, rng.uniform(0, 24 * 12), rng.uniform(0, 24 * 12)])
        rows.append((key, START + dt.timedelta(hours=hours), job))
    files = spark.createDataFrame(rows, "file_hash string, ts timestamp_ntz, job_id long").repartition(6)
    marked = dedup.mark_duplicates(files, max_group_rows=limit)
    got = {r["job_id"]: (r["original_job_id"], r["first_seen"], r["is_duplicate"]) for r in marked.collect()}
    assert got == brute_force_marks(rows, dt.timedelta(days=1))


def test_duplicates_expire_at_the_ttl_exactly(spark):
    hour = dt.timedelta(hours=1)
    rows = [("a", START, 1), ("a", START + 24 * hour, 2), ("a", START + 25 * hour, 3), ("b", START, 4),
            ("b", START + 24 * hour - dt.timedelta(microseconds=1), 5)]
    files = spark.createDataFrame(rows, "file_hash string, ts timestamp, job_id long")
    got = {r["job_id"]: r["original_job_id"] for r in dedup.mark_duplicates(files).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4}


@pytest.mark.parametrize("seconds", [1, 60, 300])
def test_rolling_counts_against_brute_force(spark, seconds):
    rng = random.Random(11)
    times = [START + dt.timedelta(seconds=rng.choice([5, 400, 401]), microseconds=rng.randrange(0, 1_000_000, 250_000))
             for _ in range(200)]
    times += [START + dt.timedelta(seconds=rng.randrange(2000)) for _ in range(300)]
    times += [dt.datetime(1969, 12, 31, 23, 59, 59, 500_000), dt.datetime(1970, 1, 1, 0, 0, 0, 250_000)]
    events = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    got = {r["ts"]: (r["n_at_ts"], r["window_count"], r["spike"]) for r in sequences.rolling_counts(events, seconds, 10).collect()}
    reach = dt.timedelta(seconds=seconds)
    expected = {}
    for t in set(times):
        n = sum(t - reach <= other <= t for other in times)
        expected[t] = (times.count(t), n, n >= 10)
    assert got == expected


def test_rolling_counts_of_filled_seconds(spark):
    """No second is empty: the counts are right, and no frame that moves with the row is added up anew for each of them."""
    second = F.timestamp_seconds(F.col("id") - 700)
    events = spark.range(2500).select(F.explode(F.array(second, second + F.expr("interval 250 milliseconds"))).alias("ts"))
    counts = sequences.rolling_counts(events, 1000, 2001)
    frames = re.findall(r"specifiedwindowframe\(\w+, ([^,]+),", counts._jdf.queryExecution().analyzed().toString())
    assert frames and set(frames) == {"unboundedpreceding$()"}
    got = {r["at"]: (r["window_count"], r["spike"]) for r in counts.withColumn("at", F.col("ts").cast("double")).collect()}
    expected = {}
    for i in range(2500):
        expected[i - 700.0] = 2 * min(i, 1000) + 1
        expected[i - 699.75] = min(i + 1, 1000) + min(i, 1000) + 1
    assert got == {at: (n, n >= 2001) for at, n in expected.items()}


def test_insert_if_absent_is_idempotent(spark):
    events = skewed_events(spark, 300)
    target = events.filter("job_id < 10").select("job_id", "source").dropDuplicates(["job_id"])
    new = events.select("job_id", "source", "event_id")
    once = review.insert_if_absent(target, new, ["job_id"], ["event_id"])
    same(review.insert_if_absent(once, new, ["job_id"], ["event_id"]), once)
    assert once.count() == once.select("job_id").distinct().count()


def test_rules_of_a_large_vendor(spark):
    rules = spark.createDataFrame(
        [("v", f"f{i:04d}", str(i), "c", "P1") for i in range(5000)] + [("w", "f", "1", "c", "P0")],
        "vendor_id string, field_name string, field_value string, category string, priority string",
    )
    rows = review.rules_by_vendor(rules).filter("vendor_id = 'v'").orderBy("place").collect()
    assert [(r["place"], r["field_name"]) for r in rows] == [(i + 1, f"f{i:04d}") for i in range(5000)]
    assert {r["rule_count"] for r in rows} == {5000}


def test_examples_of_a_large_pool(spark):
    pool = spark.createDataFrame(
        [("thermal", i, i, "m", f"s{i}", 0.9) for i in range(200)],
        "category string, job_id int, event_id int, message string, source string, confidence double",
    )
    asked = spark.createDataFrame([(1, "thermal", "s199")], "event_id int, category string, source string")
    found = joins.with_examples(asked, pool, "category").first()["examples"]
    assert [e["event_id"] for e in found] == [199, 0, 1]


def test_catalog_ranges_without_broadcast(spark, monkeypatch):
    inf = float("inf")
    catalog = spark.createDataFrame(
        [(v, "f", low, high, f"{v}-{low}") for v in ("a", "b", None) for low, high in ((-inf, 0.0), (0.0, 1.5), (1.5, 90.0), (90.0, inf))],
        "vendor_id string, field_name string, low double, high double, priority string",
    )
    rng = random.Random(3)
    readings = spark.createDataFrame([("a" if i % 2 else "b", "f", rng.uniform(-100, 200)) for i in range(400)], "vendor_id string, field_name string, value double")
    want = joins.catalog_range_match(readings, catalog)
    monkeypatch.setattr(joins, "is_small", lambda df, rows: False)
    same(joins.catalog_range_match(readings, catalog), want)
    assert want.count() == 400


def test_events_view_has_one_row_per_event(spark, sf_dir):
    assert B.events(spark, sf_dir).count() == B.table(spark, sf_dir, "events").count()


def test_scan_of_many_rows_is_spread_over_more_tasks_than_cores(spark, tmp_path):
    spark.range(4000).coalesce(1).write.parquet(str(tmp_path / "rows"))
    scan = spark.read.parquet(str(tmp_path / "rows"))
    assert skew.spread_scan(scan, task_rows=100).rdd.getNumPartitions() == 40
    assert skew.spread_scan(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert skew.spread_scan(scan, task_rows=100).agg(F.sum("id")).first()[0] == 4000 * 3999 // 2
