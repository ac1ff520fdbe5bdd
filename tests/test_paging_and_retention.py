"""Pages by cursor and by day, retention by partition, range joins on segments."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fablens.operators import joins, listings
from fablens.streaming import retention

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def queue(spark, tmp_path_factory):
    rng = random.Random(1)
    # Many items at one time, days with none, and a day that ends a page.
    rows = [(i, START + dt.timedelta(days=rng.choice([0, 1, 4, 9]), minutes=rng.choice([0, 0, 0, 30, 1439]))) for i in range(120)]
    path = str(tmp_path_factory.mktemp("queue") / "q")
    spark.createDataFrame(rows, "event_id long, ts timestamp").write.parquet(path)
    return spark.read.parquet(path)


def ids(df):
    return [r["event_id"] for r in df.orderBy(F.desc("ts"), "event_id").collect()]


def test_pages_by_cursor_are_those_by_offset(queue):
    whole, after, seen = ids(queue), None, []
    for _ in range(4):
        page = listings.queue_page_after(queue, 35, after).orderBy(F.desc("ts"), "event_id").collect()
        seen += [r["event_id"] for r in page]
        after = (page[-1]["ts"], page[-1]["event_id"])
    assert seen == whole
    assert listings.queue_page_after(queue, 35, after).count() == 0
    plan = listings.queue_page_after(queue, 35, after)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(ts" in plan


@pytest.mark.parametrize("offset", [0, 20, 29, 30, 60, 110, 119, 120, 500])
def test_pages_by_day_are_those_by_offset(queue, offset):
    per_day = listings.items_per_day(queue)
    assert ids(listings.queue_page_at(queue, per_day, 15, offset)) == ids(queue)[offset:offset + 15]


def test_expired_days_are_hidden_then_deleted(spark, tmp_path):
    path = str(tmp_path / "t")
    days = [START.date() + dt.timedelta(days=d) for d in range(6)]
    spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id long, event_date date").write.partitionBy("event_date").parquet(path)
    left = lambda: sorted(r["id"] for r in retention.read_retained(spark, path).collect())
    open_reader = retention.read_retained(spark, path)
    first = dt.date(2024, 1, 5)
    for _ in range(2):  # the same run twice
        assert retention.drop_expired(spark, path, first, 2) == {"hidden": days[:2], "deleted": []}
    assert left() == [2, 3, 4, 5]
    assert open_reader.count() == 6  # files are still there
    (tmp_path / "t.tombstones" / "2024-01-06").write_text('["2024-01-03"')  # a writer was stopped
    assert left() == [2, 3, 4, 5]
    (tmp_path / "t.tombstones" / "2024-01-06").unlink()
    assert retention.drop_expired(spark, path, dt.date(2024, 1, 6), 2) == {"hidden": [days[2]], "deleted": days[:2]}
    assert left() == [3, 4, 5]
    assert sorted(p.name for p in (tmp_path / "t").glob("event_date=*")) == [f"event_date={d}" for d in days[2:]]
    assert retention.drop_expired(spark, path, dt.date(2024, 1, 6), 2)["hidden"] == [days[2]]
    assert retention.drop_expired(spark, path, dt.date(2024, 1, 7), 2) == {"hidden": [days[3]], "deleted": [days[2]]}


def test_crowded_readings_are_spread_over_segments(spark):
    """All readings of a vendor within a thousandth of the span, a third of them equal: no segment holds many others."""
    rng = random.Random(2)
    crowded = [("v", "f", 500 + rng.random() / 10) for _ in range(2000)] + [("v", "f", 500.05)] * 1000
    rest = [("w", "f", rng.random() * 1000) for _ in range(50)] + [("v", "g", None), (None, "f", 1.0), ("x", "f", 5.0)]
    readings = spark.createDataFrame(crowded + rest, "vendor_id string, field_name string, value double").withColumn("n", F.monotonically_increasing_id())
    bands = [("v", "f", 500 + k / 1000, 500 + (k + 3) / 1000, f"b{k}") for k in range(100)] + [
        ("v", "f", float("-inf"), 500.01, "low"), ("w", "f", 100.0, 900.0, "mid"), ("w", "f", 900.0, 100.0, "empty"), ("v", "g", 0.0, 1.0, "none")]
    catalog = spark.createDataFrame(bands, "vendor_id string, field_name string, low double, high double, band string")
    placed, _ = joins.with_segments(readings, segment_rows=100)
    sizes = sorted((r["count"] for r in placed.filter("vendor_id = 'v' and field_name = 'f'").groupBy("_segment").count().collect()), reverse=True)
    assert len(sizes) > 15 and sizes[0] < 1400 and sizes[1] < 300
    columns = ["n", "band"]
    whole = joins.catalog_range_match(readings, catalog).select(*columns)
    cut = joins.catalog_range_match(readings, catalog, max_broadcast_rows=0, segment_rows=100).select(*columns)
    as_rows = lambda df: sorted((r["n"], r["band"]) for r in df.collect())
    assert as_rows(cut) == as_rows(whole) and len(as_rows(whole)) > 3000
