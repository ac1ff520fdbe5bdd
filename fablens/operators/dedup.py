"""Duplicate files: a content hash registers its first job for a time to live; later copies are duplicates of it.

A duplicate does not renew the entry, and the first copy at or after the expiry registers anew. Registrations of
one hash are thus at least one TTL apart, so a time slot as long as the TTL holds at most one of them. Everything
below works on that table of registrations, one row per (hash, slot):

1. Hashes that occur in one slot only (almost all) are settled by an aggregate.
2. Hashes in several slots are folded in time order by a vectorised function that keeps one number per hash.
3. Hashes with more copies than a task should hold go by pointer doubling: each distinct time of a copy knows the first
   copy at or after its expiry; the pointers are composed with themselves, and the registrations found so far jump along
   them, so the number of rounds is the logarithm of the number of slots.

Rows then look their slot's registrations up; no group of copies is ever gathered.

A file without a hash or a time cannot be told to be a copy: it passes as new, and registers nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fablens import constants as C
from fablens.operators.skew import MAX_GROUP_ROWS, floor_div, lookup_join
from fablens.session import stored

_MICROS = 1_000_000
_KEYS = "hash string, at long, job long"


def _chain_function(ttl_us: int):
    """Fold over rows sorted by (hash, at, job): yields the rows that register their hash."""

    def registrations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_hash, expires = None, 0
        for batch in batches:
            if batch.empty:
                continue
            hashes, times = batch["hash"].to_numpy(), batch["at"].to_numpy()
            starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            picked = []
            for start, end in zip(starts, np.r_[starts[1:], len(batch)]):
                if hashes[start] != open_hash:
                    open_hash, expires = hashes[start], times[start]
                at = start + int(np.searchsorted(times[start:end], expires))
                while at < end:
                    picked.append(at)
                    expires = times[at] + ttl_us
                    at = start + int(np.searchsorted(times[start:end], expires))
            yield batch.iloc[picked]

    return registrations


# Parts into which a time to live is cut to look up the next copy.
_PARTS = 1024


def _successors(copies: DataFrame, ttl_us: int) -> DataFrame:
    """(hash, at, next): for each copy the time of the first one at or after its expiry, if there is one.

    Time is cut into parts. The copy is looked for in the part of the expiry, by an ordered pass over it, and else is the
    first one of the next part that has any.
    """
    width = max(1, ttl_us // _PARTS)
    part = lambda c: floor_div(c, width)
    expiry = F.col("at") + ttl_us
    marks = copies.select("hash", part(F.col("at")).alias("part"), F.col("at").alias("t"), F.col("at").alias("copy"), F.lit(None).cast("long").alias("asks"))
    marks = marks.unionByName(copies.select("hash", part(expiry).alias("part"), expiry.alias("t"), F.lit(None).cast("long").alias("copy"), F.col("at").alias("asks")))
    from_here = Window.partitionBy("hash", "part").orderBy("t").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    inside = marks.withColumn("found", F.min("copy").over(from_here))
    firsts = marks.groupBy("hash", "part").agg(F.min("copy").alias("first"))
    later = Window.partitionBy("hash").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    after = firsts.select("hash", "part", F.min("first").over(later).alias("later"))
    asked = inside.filter(F.col("asks").isNotNull()).join(after, ["hash", "part"])
    found = asked.select("hash", F.col("asks").alias("at"), F.coalesce("found", "later").alias("next"))
    return found.filter(F.col("next").isNotNull())


def _hot_registrations(copies: DataFrame, ttl_us: int) -> DataFrame:
    """Registrations of hashes with very many copies (hash, at, job), by pointer doubling."""
    times = stored(copies.groupBy("hash", "at").agg(F.min("job").alias("job")), "copy-times")
    reached = stored(times.groupBy("hash").agg(F.min("at").alias("at")), "reached")
    jumps = stored(_successors(times.select("hash", "at"), ttl_us), "jumps")
    while True:
        new = stored(reached.join(jumps, ["hash", "at"]).select("hash", F.col("next").alias("at")), "new")
        if not new.take(1):
            return times.join(reached, ["hash", "at"], "left_semi").select("hash", "at", "job")
        reached = stored(reached.unionByName(new), "reached")
        onwards = jumps.select("hash", F.col("at").alias("next"), F.col("next").alias("beyond"))
        jumps = stored(jumps.join(onwards, ["hash", "next"]).select("hash", "at", F.col("beyond").alias("next")), "jumps")


def _registrations(keys: DataFrame, ttl_us: int, max_group_rows: int) -> DataFrame:
    """(hash, at, job) of every registering row among `keys` (hash, at, job, slot)."""
    sizes = keys.groupBy("hash").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("slot").alias("first_slot"),
        F.max("slot").alias("last_slot"),
        F.min(F.struct("at", "job")).alias("first"),
    )
    sizes = stored(sizes, "hashes")
    several = F.col("first_slot") != F.col("last_slot")
    single = sizes.filter(~several).select("hash", "first.at", "first.job")
    large = several & (F.col("copies") > max_group_rows)
    fold = lookup_join(keys, sizes.filter(several & ~large).select("hash"), ["hash"], "left_semi", spread_by=["job"])
    chained = (
        fold.select("hash", "at", "job").repartition("hash").sortWithinPartitions("hash", "at", "job")
        .mapInPandas(_chain_function(ttl_us), _KEYS)
    )
    result = single.unionByName(chained)
    large_hashes = sizes.filter(large).select("hash")
    if large_hashes.take(1):
        copies = lookup_join(keys, large_hashes, ["hash"], "left_semi", spread_by=["job"])
        result = result.unionByName(_hot_registrations(copies.select("hash", "at", "job"), ttl_us))
    return result


def mark_duplicates(
    files: DataFrame,
    file_hash: str = "file_hash",
    job_id: str = "job_id",
    ts: str = "ts",
    seen: DataFrame | None = None,
    ttl_seconds: int = C.DEDUP_TTL_SECONDS,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add `original_job_id`, `first_seen` and `is_duplicate` to each file; the first two are null where hash or time is.

    `seen` holds earlier registrations (file_hash, job_id, first_seen); of each hash only the last one counts.
    `job_id` must be a number that is unique per file. Hash, time and job are stored once, so the contents behind
    the hash are read once; pass narrow rows, without the contents.
    """
    ttl_us = ttl_seconds * _MICROS
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    every = stored(files.withColumns({"_at": at(ts), "_slot": floor_div(at(ts), ttl_us)}), "files")
    told = F.col(file_hash).isNotNull() & F.col("_at").isNotNull()
    keyed = every.filter(told)
    keys = keyed.select(F.col(file_hash).alias("hash"), F.col("_at").alias("at"), F.col(job_id).cast("long").alias("job"))
    if seen is not None:
        last = seen.filter(F.col("file_hash").isNotNull() & F.col("first_seen").isNotNull()).groupBy("file_hash").agg(F.max(F.struct(at("first_seen").alias("at"), "job_id")).alias("r"))
        keys = keys.unionByName(last.select(
            F.col("file_hash").alias("hash"), F.col("r.at").alias("at"), F.col("r.job_id").cast("long").alias("job")
        ))
    keys = keys.withColumn("slot", floor_div(F.col("at"), ttl_us))
    found = _registrations(keys, ttl_us, max_group_rows).withColumn("slot", floor_div(F.col("at"), ttl_us))

    # Per (hash, slot): the registration inside the slot and the last one before it.
    slots = keys.groupBy("hash", "slot").agg(F.count(F.lit(1)).alias("n")).drop("n")
    inside = found.select("hash", "slot", F.struct("at", "job").alias("inside"))
    earlier = Window.partitionBy("hash").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    table = slots.join(inside, ["hash", "slot"], "left").withColumn(
        "before", F.last("inside", ignorenulls=True).over(earlier)
    ).select(F.col("hash").alias(file_hash), F.col("slot").alias("_slot"), "inside", "before")
    joined = lookup_join(keyed, stored(table, "registrations"), [file_hash, "_slot"], "left", spread_by=[job_id])
    own, own_type = F.struct(F.col("_at").alias("at"), F.col(job_id).cast("long").alias("job")), "struct<at: long, job: long>"
    registered = F.when(F.col("inside").isNotNull() & (F.col("inside") <= own), F.col("inside")).otherwise(F.col("before"))
    # Apart from the join, where they would all meet under the key null.
    untold = every.filter(~told).withColumn("_r", F.lit(None).cast(own_type))
    marked = joined.withColumn("_r", registered).select(*files.columns, "_r").unionByName(untold.select(*files.columns, "_r"))
    return marked.select(
        *files.columns,
        F.col("_r.job").alias("original_job_id"),
        F.timestamp_micros("_r.at").cast(files.schema[ts].dataType).alias("first_seen"),
        F.coalesce(F.col("_r.job") != F.col(job_id).cast("long"), F.lit(False)).alias("is_duplicate"),
    )


def active_registrations(marked: DataFrame, as_of, ttl_seconds: int = C.DEDUP_TTL_SECONDS) -> DataFrame:
    """Entries still alive at `as_of`: job, first_seen and remaining seconds per hash."""
    kind = marked.schema["first_seen"].dataType
    now = F.unix_micros(F.lit(str(as_of)).cast(kind).cast("timestamp"))
    last = marked.filter(~F.col("is_duplicate") & F.col("first_seen").isNotNull()).groupBy("file_hash").agg(
        F.max(F.struct("first_seen", F.col("original_job_id").alias("job_id"))).alias("r")
    )
    left = F.lit(ttl_seconds) - floor_div(now - F.unix_micros(F.col("r.first_seen").cast("timestamp")), _MICROS)
    return last.select(
        "file_hash", F.col("r.job_id").alias("job_id"), F.col("r.first_seen").alias("first_seen"),
        left.alias("ttl_remaining"),
    ).filter((F.col("ttl_remaining") > 0) & (F.col("ttl_remaining") <= ttl_seconds))


def split_duplicates(marked: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    """Files to go on with: without duplicates unless they are wanted. A row whose mark is null goes on."""
    return marked if keep_duplicates else marked.filter(~F.coalesce(F.col("is_duplicate"), F.lit(False)))


def batch_summary(marked: DataFrame) -> DataFrame:
    copies = F.sum(F.col("is_duplicate").cast("long"))
    return marked.agg(
        F.count(F.lit(1)).alias("total_checked"),
        F.coalesce(copies, F.lit(0)).alias("duplicates_found"),
        (F.count(F.lit(1)) - F.coalesce(copies, F.lit(0))).alias("new_files"),
    )
