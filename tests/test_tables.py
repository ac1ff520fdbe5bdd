"""Insert-if-absent with a key index: exact whatever the filters say, and what a batch reads does not grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fablens.streaming import key_index, tables
from fablens.streaming.tables import Lookup, append_if_absent, compact_batches

KEYS = ["job", "part"]


def batch(spark, low, high):
    return spark.range(low, high, 1, 2).select(
        F.md5(F.col("id").cast("string")).alias("job"), (F.col("id") % 3).alias("part"), F.col("id").alias("at")
    )


def ids(spark, path):
    return sorted(r["at"] for r in spark.read.parquet(path).collect())


def test_a_filter_holds_its_keys_and_few_others():
    rng = np.random.default_rng(1)
    own, others = (rng.integers(-(2**63), 2**63 - 1, 50_000) for _ in range(2))
    bits = key_index.bloom(own)
    assert key_index.may_hold(bits, own).all()
    assert key_index.may_hold(bits, others).sum() <= 3
    assert not key_index.may_hold(key_index.bloom(own[:0]), others[:100]).any()


def test_filters_follow_files_and_are_cut(spark, tmp_path, monkeypatch):
    batch(spark, 0, 1000).repartition(3).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(key_index, "KEYS_PER_FILTER", 1000)
    made = key_index.filters_of(rows, KEYS, "run", 7).groupBy("file").agg(F.sum("keys").alias("n")).collect()
    assert len(made) == 3 and sum(r["n"] for r in made) == 1000


def test_what_a_batch_reads_does_not_grow(spark, tmp_path):
    path, size = str(tmp_path / "t"), 40
    reads = []
    for number in range(50):
        # New keys, and five of an earlier batch delivered again.
        again = batch(spark, max(0, number - 20) * size, max(0, number - 20) * size + 5)
        reads.append(append_if_absent(batch(spark, number * size, (number + 1) * size).unionByName(again), path, number, KEYS, ["at"]))
        if number % 16 == 15:
            compact_batches(spark, path, "run", KEYS, number, target=20_000)
    assert ids(spark, path) == list(range(50 * size))
    largest = 2 * 20_000 + 20_000
    assert all(r.files <= 4 and r.size <= largest for r in reads)
    assert len(key_index.batch_folders(spark, path)) < 25
    assert key_index.batch_folders(spark, path) == key_index.indexed_folders(spark, path)


def test_new_keys_read_nothing_and_null_keys_are_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    assert append_if_absent(batch(spark, 0, 100), path, 0, KEYS, ["at"]) == Lookup(0, 0)
    assert append_if_absent(batch(spark, 100, 200), path, 1, KEYS, ["at"]) == Lookup(0, 0)
    nulls = spark.sql("select cast(null as string) as job, 1L as part, 500L as at")
    for number in (2, 3):
        append_if_absent(nulls, path, number, KEYS, ["at"])
    assert ids(spark, path) == [*range(200), 500]


def test_false_positives_and_folders_without_filters_are_settled(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    append_if_absent(batch(spark, 0, 100), path, 0, KEYS, ["at"])
    append_if_absent(batch(spark, 100, 200), path, 1, KEYS, ["at"])
    key_index.remove_filters(spark, path, "run", 0)
    assert append_if_absent(batch(spark, 50, 250), path, 2, KEYS, ["at"]).files >= 1
    assert ids(spark, path) == list(range(250))
    # Too many keys to send: the whole table is joined.
    monkeypatch.setattr(key_index, "MAX_SENT_KEYS", 10)
    assert append_if_absent(batch(spark, 200, 300), path, 3, KEYS, ["at"]) == Lookup(None, None)
    assert ids(spark, path) == list(range(300))


def test_two_jobs_feed_one_table(spark, tmp_path):
    path = str(tmp_path / "t")
    append_if_absent(batch(spark, 0, 60), path, 0, KEYS, ["at"], "one")
    append_if_absent(batch(spark, 30, 90), path, 0, KEYS, ["at"], "two")
    append_if_absent(batch(spark, 30, 90), path, 0, KEYS, ["at"], "two")  # the same attempt once more
    assert ids(spark, path) == list(range(90))


@pytest.mark.parametrize("stop_before", ["delete", "rename", "index"])
def test_a_stopped_compaction_is_finished_later(spark, tmp_path, monkeypatch, stop_before):
    path = str(tmp_path / "t")
    for number in range(4):
        append_if_absent(batch(spark, number * 50, number * 50 + 50), path, number, KEYS, ["at"])

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as broken, pytest.raises(KeyboardInterrupt):
        if stop_before == "delete":
            broken.setattr(tables, "remove_filters", stop)
        elif stop_before == "rename":
            real = tables.remove_path
            calls = iter([real, real, real])
            broken.setattr(tables, "remove_path", lambda s, p: next(calls, stop)(s, p))
        else:
            broken.setattr(tables, "index_path", stop)
        compact_batches(spark, path, "run", KEYS, 3)
    append_if_absent(batch(spark, 100, 300), path, 4, KEYS, ["at"])
    assert ids(spark, path) == list(range(300))
    assert sorted(key_index.batch_folders(spark, path)) == [("run", 2), ("run", 3), ("run", 4)]
