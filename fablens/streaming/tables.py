"""Append-only Parquet tables for foreachBatch sinks.

Every micro-batch writes a folder of its own, named by its batch id, and overwrites it when the batch is run again
after a failure: delivery is at least once, the result is as if it were once. Insert-if-absent tables have an index
beside them (`key_index`), so a batch reads only files that may hold its keys; `compact_batches` merges small folders.
Corrected rows are appended under a later batch id, and `current_rows` takes the last version of each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fablens.operators.skew import first_per_key
from fablens.session import read_text, remove_path, stored, write_text
from fablens.streaming.key_index import (
    BATCH, batch_folders, files_that_may_hold, filters_of, folder, index_path, remove_filters, write_filters,
)

# Folders of fewer bytes are merged by compaction.
COMPACT_BYTES = 128 << 20


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """Table with its batch column, or None if nothing was written yet. Every other problem is an error."""
    system, where = folder(spark, path)
    if not system.exists(where):
        return None
    reader = spark.read.schema(f"{schema}, {BATCH} LONG") if schema else spark.read
    return reader.parquet(path)


def current_rows(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last version of each row, that of the latest batch, without the batch column."""
    return first_per_key(table.withColumn("_age", -F.col(BATCH)), keys, ["_age"]).drop("_age", BATCH)


def append_batch(df: DataFrame, path: str, batch_id: int, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{BATCH}={batch_id}")


def keep_last(spark: SparkSession, path: str, batch_id: int) -> None:
    """Delete the folders of batches before the previous one; for tables of which only the last state counts."""
    system, where = folder(spark, path)
    if not system.exists(where):
        return
    for status in system.listStatus(where):
        name = status.getPath().getName()
        if name.startswith(f"{BATCH}=") and int(name.split("=")[1]) < batch_id - 1:
            remove_path(spark, f"{path}/{name}")


@dataclass(frozen=True)
class Lookup:
    """What an insert read of the table: files (or whole folders) and their bytes; None if it read all of it."""

    files: int | None
    size: int | None


def _size(spark: SparkSession, path: str) -> int:
    system, where = folder(spark, path)
    return system.getContentSummary(where).getLength()


def earlier_rows(
    batch_keys: DataFrame, path: str, schema: str, keys: Sequence[str], run: str, batch_id: int
) -> tuple[DataFrame | None, Lookup]:
    """Rows of an indexed table from the files that may hold a key of the batch, with run and batch_id; what was read.

    Rows that this batch wrote in an attempt that is now repeated are left out. The caller joins on the keys: files hold
    other keys too. None if no file may hold one.
    """
    spark = batch_keys.sparkSession
    files = files_that_may_hold(batch_keys, path, keys, run, batch_id)
    if files == []:
        return None, Lookup(0, 0)
    reader = spark.read.schema(f"{schema}, run STRING, {BATCH} LONG")
    if files is None:
        return reader.parquet(path).filter((F.col(BATCH) != batch_id) | (F.col("run") != run)), Lookup(None, None)
    read = Lookup(len(files), sum(_size(spark, f) for f in files))
    return reader.option("basePath", path).parquet(*files), read


def append_indexed(df: DataFrame, path: str, batch_id: int, keys: Sequence[str], run: str) -> None:
    """Write a batch and the filters over its keys. A repeated batch replaces what it wrote before."""
    spark, target = df.sparkSession, f"{path}/run={run}/{BATCH}={batch_id}"
    remove_filters(spark, path, run, batch_id)
    df.write.mode("overwrite").parquet(target)
    write_filters(spark.read.schema(df.schema).parquet(target), path, keys, run, batch_id)


def append_if_absent(
    df: DataFrame, path: str, batch_id: int, keys: Sequence[str], order: Sequence[str], run: str = "run",
) -> Lookup:
    """Append the rows of a batch whose key is not in the table yet, whenever that was written; the first per key.

    `run` names the job, so that two jobs may feed one table. Rows that the same batch wrote in an attempt that is now
    repeated do not count. Of rows that tie in `order` the other columns decide. A null in a key is a value like others.
    """
    keys = list(keys)
    finish_compaction(df.sparkSession, path, run)
    rest = [f.name for f in df.schema if f.name not in keys and f.name not in order and f.dataType.typeName() not in ("map", "variant")]
    rows = stored(first_per_key(df, keys, [*order, *rest]), "batch")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    earlier, read = earlier_rows(rows, path, names, keys, run, batch_id)
    if earlier is not None:
        held = earlier.select(*[F.col(k).alias(f"_held_{i}") for i, k in enumerate(keys)])
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_held_{i}")) for i, k in enumerate(keys)])
        rows = rows.join(held, same, "left_anti")
    append_indexed(rows, path, batch_id, keys, run)
    return read


# ---- compaction --------------------------------------------------------------------------------------------

def _staging(path: str, run: str) -> str:
    return f"{path}.compact/{run}"


def compact_batches(spark: SparkSession, path: str, run: str, keys: Sequence[str], before: int, target: int = COMPACT_BYTES) -> int:
    """Merge the folders that a job's batches below `before` have written, as far as they are smaller than `target` bytes.

    They become the folder of the last of them. The last batch of a job may be repeated, so leave it out with `before`.
    Files that other jobs are reading go away: call it while no other job feeds the table. Returns how many were merged.

    Rows and filters are made in a staging folder; a plan then says what they replace. If the run stops after that, the
    next insert or compaction finishes it; if it stops before, nothing has changed.
    """
    finish_compaction(spark, path, run)
    small = sorted(b for r, b in batch_folders(spark, path) if r == run and b < before)
    sizes = {b: _size(spark, f"{path}/run={run}/{BATCH}={b}") for b in small}
    small = [b for b in small if sizes[b] < target]
    if len(small) < 2:
        return 0
    staging = _staging(path, run)
    remove_path(spark, staging)
    rows = spark.read.parquet(*[f"{path}/run={run}/{BATCH}={b}" for b in small])
    rows.coalesce(max(1, math.ceil(sum(sizes[b] for b in small) / target))).write.parquet(f"{staging}/rows")
    merged = spark.read.schema(rows.schema).parquet(f"{staging}/rows")
    filters_of(merged, keys, run, small[-1]).write.parquet(f"{staging}/keys")
    write_text(spark, f"{staging}/plan", " ".join([*map(str, small), "end"]))
    finish_compaction(spark, path, run)
    return len(small)


def finish_compaction(spark: SparkSession, path: str, run: str) -> None:
    """Carry out the plan of a compaction, if there is one."""
    staging = _staging(path, run)
    plan = read_text(spark, f"{staging}/plan")
    if plan is None:
        return
    words, system = plan.split(), folder(spark, staging)[0]
    if words[-1:] == ["end"]:
        batches = [int(word) for word in words[:-1]]
        rows, keys = (folder(spark, f"{staging}/{name}")[1] for name in ("rows", "keys"))
        if system.exists(rows):
            for batch in batches:
                remove_filters(spark, path, run, batch)
                remove_path(spark, f"{path}/run={run}/{BATCH}={batch}")
            system.rename(rows, folder(spark, f"{path}/run={run}/{BATCH}={batches[-1]}")[1])
        if system.exists(keys):
            system.rename(keys, folder(spark, f"{index_path(path)}/{run}-{batches[-1]}")[1])
    remove_path(spark, staging)
