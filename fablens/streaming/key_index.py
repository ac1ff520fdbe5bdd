"""Key index of insert-if-absent tables: Bloom filters over the keys of every written file, kept beside the table.

A batch looks its keys up in the filters and then reads the key columns of those files only that may hold one of them, so
what it reads of the table depends on the batch, not on the table. A filter covers at most KEYS_PER_FILTER rows of one file
and has BITS_PER_KEY bits per key: a key it does not hold passes it about three times in ten million.

Filters stay where they are: the keys of the batch are sent to the tasks that read them, and only if they are few enough;
a larger batch is joined with the table's key columns. A folder that has no filters yet (its writer was stopped between
the two) counts as one that may hold every key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fablens.session import remove_path

BATCH = "batch_id"
KEYS_PER_FILTER = 1 << 16
BITS_PER_KEY = 32
PROBES = 16
# Keys of a batch that are sent to all tasks: 16 MB.
MAX_SENT_KEYS = 1 << 21
# Files that are read by name.
MAX_NAMED_FILES = 20_000
_SCHEMA = "run STRING, batch_id LONG, file STRING, keys LONG, bits BINARY"


def folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, wherever it is stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if there is no such folder."""
    system, where = folder(spark, path)
    return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []


def batch_folders(spark: SparkSession, path: str) -> set[tuple[str, int]]:
    """(run, batch) of every folder of a table."""
    found = set()
    for name in names_in(spark, path):
        if name.startswith("run="):
            run = name.removeprefix("run=")
            found |= {(run, int(b.split("=")[1])) for b in names_in(spark, f"{path}/{name}") if b.startswith(f"{BATCH}=")}
    return found


def index_path(path: str) -> str:
    return f"{path}.keys"


def indexed_folders(spark: SparkSession, path: str) -> set[tuple[str, int]]:
    split = [name.rsplit("-", 1) for name in names_in(spark, index_path(path))]
    return {(s[0], int(s[1])) for s in split if len(s) == 2}


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def _places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bits of each key, one array per probe."""
    first, step = hashes.view(np.uint64), (hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    for probe in range(PROBES):
        yield (first + np.uint64(probe) * step) % np.uint64(bits)


def bloom(hashes: np.ndarray) -> bytes:
    """A Bloom filter over 64-bit hashes."""
    size = max(1, len(hashes)) * BITS_PER_KEY // 8
    words = np.zeros(size, dtype=np.uint8)
    for at in _places(hashes, size * 8):
        np.bitwise_or.at(words, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return words.tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes the filter may hold."""
    words = np.frombuffer(bits, dtype=np.uint8)
    left = np.arange(len(hashes))
    for at in _places(hashes, len(words) * 8):
        at = at[left]
        left = left[(words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        if not len(left):
            break
    held = np.zeros(len(hashes), dtype=bool)
    held[left] = True
    return held


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, key) in the order of files -> (file, keys, bits)."""
    file, waiting, n = None, [], 0

    def flush() -> pa.RecordBatch:
        hashes = np.concatenate(waiting)
        return pa.RecordBatch.from_arrays(
            [pa.array([file], pa.string()), pa.array([len(hashes)], pa.int64()), pa.array([bloom(hashes)], pa.binary())],
            names=["file", "keys", "bits"],
        )

    for batch in batches:
        names, hashes = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        start = 0
        while start < len(names):
            if names[start] != file or n >= KEYS_PER_FILTER:
                if n:
                    yield flush()
                file, waiting, n = names[start], [], 0
            end = start + min(KEYS_PER_FILTER - n, len(names) - start)
            while names[end - 1] != file:  # the batch goes on with another file
                end = start + names[start:end].index(next(x for x in names[start:end] if x != file))
            waiting.append(hashes[start:end])
            n += end - start
            start = end
    if n:
        yield flush()


def filters_of(rows: DataFrame, keys: Sequence[str], run: str, batch_id: int) -> DataFrame:
    """Index rows of the frame read from one batch folder."""
    own = rows.select(F.col("_metadata.file_name").alias("file"), key_hash(keys).alias("key"))
    made = own.mapInArrow(_filters, "file string, keys long, bits binary")
    return made.select(F.lit(run).alias("run"), F.lit(batch_id).cast("long").alias(BATCH), "file", "keys", "bits")


def write_filters(rows: DataFrame, path: str, keys: Sequence[str], run: str, batch_id: int) -> None:
    filters_of(rows, keys, run, batch_id).write.mode("overwrite").parquet(f"{index_path(path)}/{run}-{batch_id}")


def remove_filters(spark: SparkSession, path: str, run: str, batch_id: int) -> None:
    remove_path(spark, f"{index_path(path)}/{run}-{batch_id}")


def _probed(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = sent.value
        for batch in batches:
            held = [bool(may_hold(bits.as_py(), hashes).any()) for bits in batch.column(3)]
            yield batch.filter(pa.array(held)).select(["run", BATCH, "file"])

    return run


def files_that_may_hold(batch_keys: DataFrame, path: str, keys: Sequence[str], run: str, batch_id: int) -> list[str] | None:
    """Files and folders of the table that may hold a key of the batch; None if the whole table is to be read instead.

    What the batch itself wrote in an attempt that is now repeated is left out.
    """
    spark = batch_keys.sparkSession
    there = batch_folders(spark, path) - {(run, batch_id)}
    indexed = indexed_folders(spark, path)
    found = [f"{path}/run={r}/{BATCH}={b}" for r, b in sorted(there - indexed)]
    if there & indexed:
        sent = batch_keys.select(key_hash(keys).alias("key")).distinct()
        if sent.offset(MAX_SENT_KEYS).take(1):
            return None
        hashes = spark.sparkContext.broadcast(np.sort(sent.toArrow().column("key").to_numpy()))
        index = spark.read.schema(_SCHEMA).parquet(f"{index_path(path)}/*")
        index = index.filter(~((F.col("run") == run) & (F.col(BATCH) == batch_id))).select("run", BATCH, "file", "bits")
        hits = index.mapInArrow(_probed(hashes), "run string, batch_id long, file string").distinct().limit(MAX_NAMED_FILES + 1).collect()
        found += [f"{path}/run={r}/{BATCH}={b}/{file}" for r, b, file in hits if (r, b) in there]
        hashes.destroy()
    return found if len(found) <= MAX_NAMED_FILES else None
