"""Skew-safe building blocks used by all other operators.

One key may hold a third of all rows. Three tools keep every task small then:

* ``lookup_join`` joins a large frame to a table with one row per key: broadcast when the table's size is
  checked to be small, otherwise a shuffle join in which only the hot keys are salted.
* ``OrderedGroups`` evaluates lags, run numbers, running sums and row numbers per key. Groups of checked size use a
  plain window. Otherwise rows are range-partitioned on (key, order), so that one key is cut into several ordered
  blocks; one ordered pass evaluates each block on its own, and a table with one row per (key, block) then carries
  over what the first rows of a block need from the blocks before. Both forms give the same rows, null keys included.
* ``first_per_key`` replaces row_number() = 1 by an aggregate, which combines on the map side.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fablens.session import stored

# Rows one task may hold for a single key before the key is split.
MAX_GROUP_ROWS = 2_000_000
# Rows a task has at least when keys are split: smaller blocks share one.
MIN_TASK_ROWS = 100_000
# Rows a task takes of a scan whose work is heavy per row.
SCAN_TASK_ROWS = 100_000
# Rows and bytes of values a table may have to be broadcast.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 32 << 20
_BLOCK, _NUMBER, _LAST = "_block", "_number", "_last_two"


def has_at_most(df: DataFrame, rows: int) -> bool:
    """True if `df` has at most `rows` rows. Partitions are tried a few at a time, so a large table ends it early."""
    return not df.select(F.lit(1).cast("byte").alias("x")).offset(rows).take(1)


def is_small(table: DataFrame, rows: int = MAX_BROADCAST_ROWS, size: int = MAX_BROADCAST_BYTES) -> bool:
    """True if `table` has at most `rows` rows, and texts and arrays of at most `size` bytes in them.

    One pass tells: the widths of at most rows + 1 rows are fetched, partitions a few at a time as in `has_at_most`.
    """
    wide = [f.name for f in table.schema if f.dataType.typeName() in ("string", "binary")]
    nested = [f.name for f in table.schema if f.dataType.typeName() in ("array", "map", "struct", "variant")]
    widths = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in wide]
    widths += [F.coalesce(F.octet_length(F.to_json(F.struct(F.col(c)))), F.lit(0)) for c in nested]
    if not widths:
        return has_at_most(table, rows)
    found = table.select(reduce(lambda a, b: a + b, widths).alias("n")).limit(rows + 1).collect()
    return len(found) <= rows and sum(r["n"] for r in found) <= size


def spread_scan(scan: DataFrame, task_rows: int = SCAN_TASK_ROWS) -> DataFrame:
    """Redistribute a table that is read in fewer tasks than there are cores, or in tasks of very many rows, for work that is
    heavy per row.

    A few files that cannot be split would otherwise keep most cores idle, and a well packed file holds millions of rows in
    one split. A scan with enough splits is left as it is. `scan` must be a plain read, so that its splits and rows are
    known from its files.
    """
    if scan.isStreaming:
        return scan
    splits = scan.rdd.getNumPartitions()
    tasks = max(scan.sparkSession.sparkContext.defaultParallelism, math.ceil(scan.count() / task_rows))
    return scan if splits >= tasks else scan.repartition(tasks)


def hot_keys(df: DataFrame, keys: Sequence[str], max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Keys with more than `max_rows` rows and the number of salts each needs; at most rows/max_rows keys."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > max_rows)
        .select(*keys, F.ceil(F.col("_rows") / F.lit(max_rows)).cast("int").alias("_salts"))
    )


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread_by: Sequence[str] = (),
    max_group_rows: int = MAX_GROUP_ROWS,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Join `rows` to `table`, which has at most one row per key in `on`.

    The size check reads `table`; a table that is costly to derive should be passed as a stored one.
    how: left, inner, left_semi or left_anti. `spread_by` names columns that differ between rows of one key;
    hot keys are salted on them when `table` is too large to broadcast.
    """
    on = list(on)
    if is_small(table, max_broadcast_rows):
        return rows.join(F.broadcast(table), on, how)
    if not spread_by:
        return rows.join(table, on, how)
    hot = stored(hot_keys(rows, on, max_group_rows), "hot-keys")
    if not has_at_most(hot, max_broadcast_rows):
        return rows.join(table, on, how)
    hot = F.broadcast(hot)
    salted_rows = rows.join(hot, on, "left").withColumn(
        "_salt",
        F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_salts")), F.lit(0)).cast("int"),
    )
    salted_table = (
        table.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted_rows.drop("_salts").join(salted_table, [*on, "_salt"], how).drop("_salt")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key by `order`, as an aggregate with map-side combine."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])
    )


class OrderedGroups:
    """Rows of each key in a total order, with values that depend on the rows before.

    `order` must be unique within a key (end it with an id). An empty `keys` means one global sequence.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], max_group_rows: int = MAX_GROUP_ROWS):
        self.df, self.keys, self.order = df, list(keys), list(order)
        sizes = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n"))
        size = sizes.agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
        self.split = (size["largest"] or 0) > max_group_rows
        if self.split:
            half = max(1, max_group_rows // 2)
            ranged = df.repartitionByRange(
                max(2, math.ceil(size["total"] / max(half, MIN_TASK_ROWS))), *self.keys, *self.order
            )
            block = F.spark_partition_id().cast("long")
            if half < MIN_TASK_ROWS:
                # A range would be too few rows for a task: it is sorted, and each `half` rows in it are a block.
                ranged = ranged.sortWithinPartitions(*self.keys, *self.order)
                block = floor_div(F.monotonically_increasing_id(), half)
            # The block number must not change when a task is run again, so it is stored with the rows.
            self.df = stored(ranged.withColumn(_BLOCK, block), "blocks")

    def evaluate(
        self,
        lags: Mapping[str, tuple[str, int]] | None = None,
        starts: Column | None = None,
        run: str = "run",
        sums: Mapping[str, str] | None = None,
        number: str | None = None,
    ) -> DataFrame:
        """The rows with more columns.

        lags: name -> (column, 1 or 2): its value one or two rows before. starts: condition over the columns and lags
        that tells whether a row begins a new run, true for the first row of a key; `run` is then the number of the run.
        sums: name -> column: its sum up to this row. number: 1, 2, 3, ... in the order of the key.
        """
        lags, sums = dict(lags or {}), dict(sums or {})
        begins = F.when(starts, 1).otherwise(0).cast("long") if starts is not None else None
        groups = [*self.keys, _BLOCK] if self.split else self.keys
        window = Window.partitionBy(*groups).orderBy(*self.order)
        upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = {name: F.lag(column, k).over(window) for name, (column, k) in lags.items()}
        local |= {name: F.sum(column).over(upto) for name, column in sums.items()}
        if number or self.split:
            local[number or _NUMBER] = F.row_number().over(window).cast("long")
        if self.split:
            local[_LAST] = F.lead(F.lit(1), 2).over(window).isNull()
        rows = self.df.withColumns(local)
        if begins is not None:
            rows = rows.withColumn(run, F.sum(begins).over(upto))
        return self._across(rows, lags, begins, run, sums, number) if self.split else rows

    def _across(self, rows, lags, begins, run, sums, number) -> DataFrame:
        """Put right what a block could not know: lags of its first two rows, and what to add to its sums."""
        own_number = number or _NUMBER
        rows = stored(rows.withColumn("_begins", begins) if begins is not None else rows, "ordered")
        at = [*self.keys, _BLOCK]
        # First and last two rows of each block: where blocks meet, they are neighbours as in the whole.
        ends = rows.filter((F.col(own_number) <= 2) | F.col(_LAST))
        before = Window.partitionBy(*self.keys).orderBy(_BLOCK, own_number)
        heads = ends.withColumns({name: F.lag(column, k).over(before) for name, (column, k) in lags.items()})
        heads = heads.filter(F.col(own_number) <= 2)
        values = {name: F.col(name) for name in lags}
        if begins is not None:
            values["_less"] = F.col("_begins") - begins
        head = F.struct(F.lit(True).alias("_known"), *[v.alias(n) for n, v in values.items()])
        nth = lambda n: F.max_by(F.when(F.col(own_number) == n, head), F.col(own_number) == n)
        fixes = heads.groupBy(*at).agg(nth(1).alias("_first"), nth(2).alias("_second"))
        totals = {"_rows": F.count(F.lit(1)), **{f"_sum_{n}": F.sum(c) for n, c in sums.items()}}
        if begins is not None:
            totals["_runs"] = F.sum("_begins")
        blocks = rows.groupBy(*at).agg(*[v.alias(n) for n, v in totals.items()])
        names = [F.col(k).alias(f"_at{i}") for i, k in enumerate(at)]
        fixes = fixes.select(*names, "_first", "_second")
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_at{i}")) for i, k in enumerate(at)])
        summary = blocks.join(fixes, same).drop(*[f"_at{i}" for i in range(len(at))])
        if begins is not None:
            wrong = F.coalesce(F.col("_first._less"), F.lit(0)) + F.coalesce(F.col("_second._less"), F.lit(0))
            summary = summary.withColumn("_runs", F.col("_runs") - wrong)
        # One row per key and block; without keys that is one row per block, a few thousand at most.
        earlier = Window.partitionBy(*self.keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        offsets = {n: F.sum(n).over(earlier) for n in totals}
        summary = summary.withColumns(offsets).select(*names, "_first", "_second", *totals)
        joined = rows.join(summary, same)
        position = F.col(own_number)
        final: dict[str, Column] = {}
        for name in lags:
            final[name] = F.when(position == 1, F.col(f"_first.{name}")).when(
                position == 2, F.col(f"_second.{name}")
            ).otherwise(F.col(name))
        add = lambda own, offset: F.when(own.isNull(), F.col(offset)).otherwise(own + F.coalesce(F.col(offset), F.lit(0)))
        for name in sums:
            final[name] = add(F.col(name), f"_sum_{name}")
        if begins is not None:
            less = F.coalesce(F.col("_first._less"), F.lit(0)) + F.when(
                position >= 2, F.coalesce(F.col("_second._less"), F.lit(0))
            ).otherwise(0)
            final[run] = add(F.col(run), "_runs") - less
        if number:
            final[number] = add(position, "_rows")
        kept = [c for c in rows.columns if c not in (_BLOCK, _LAST, _NUMBER, "_begins")]
        return joined.withColumns(final).select(*kept)


def any_of(conditions: Sequence[Column]) -> Column:
    """OR of the conditions."""
    return reduce(lambda a, b: a | b, conditions)


def floor_div(value: Column, by: int) -> Column:
    """Whole-number division that rounds down, exact for all LONG values of use here."""
    return ((value - F.pmod(value, F.lit(by))) / F.lit(by)).cast("long")
