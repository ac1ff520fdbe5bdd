"""Mixing sources to target weights by weighted fair queueing; DataFrame operations only.

Each source queues its documents in a shuffled, repeatable order (by the md5 of the id), and once more for each repeat.
A document is served in packets of words. A packet's virtual finish time is the number of words of its source up to and
including it, divided by the source's target; all packets are range-sorted by finish time and the queue is cut where the
total budget is used up. At any time all sources have then received the same fraction of their targets, to a packet.

Targets: sources in code point order, null last, get the weights in turn and share `share` times all words; a target stops
at `repeats` times its source's words and the excess is shared again by weight until no target is above that.

Scale: running totals are computed in buckets of the shuffled order, whose number grows with the root of the largest
source, and offset by bucket totals; a source with a third of all rows is many buckets. The global sort cuts virtual time
into slices: whole slices are settled by their sums, and only the slice in which the budget ends is sorted. Tables with one
row per source, bucket or slice are the only ones that meet in one task. Texts are read once and never shuffled.

Defined results: a null text has no words; a document without words, or any in a source without words, is taken 0 times.
A null id sorts first in the shuffle; repeated rows are documents of their own. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fablens.llm.common import broadcast_if_small
from fablens.session import stored

WORD = r"[^\x20\x09-\x0D]+"
# A packet has at most this many words, and at most 1/PACKETS of its source's words or target.
MAX_PACKET, PACKETS = 512, 1024
MAX_SLICES = 1 << 20


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """One row per source: source, s (its number), n documents, source_size, target. `sizes` has source and size."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    ranked = per_source.withColumn(
        "s", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    ).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("s") % len(weights) + 1).cast("int")))
    capped = ranked.withColumn("cap", F.lit(repeats) * F.col("source_size"))
    # Water-filling: in the order of cap / weight, sources are full until the level of the others stays below their cap.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "s")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / F.sum("weight").over(onwards)
    levels = capped.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    final = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "s")))
    return levels.withColumn("final", final.over(everything)).select(
        "source", "s", "n", "source_size",
        F.coalesce(F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight")), F.col("cap").cast("double")).alias("target"),
    )


def _queue(sizes: DataFrame, targets: DataFrame, buckets: int) -> DataFrame:
    """Rows with the words of their source before them (`before`), in shuffled order."""
    named = sizes.withColumnRenamed("source", "of")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    hinted = broadcast_if_small(targets)
    rows = named.join(hinted, named["of"].eqNullSafe(hinted["source"])).select(
        "doc_id", "size", "s", "source_size", "target", key.alias("key")
    ).withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(float(1 << 32))))
    totals = rows.groupBy("s", "bucket").agg(F.sum("size").alias("words"))
    over_buckets = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("s", "bucket", F.coalesce(F.sum("words").over(over_buckets), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("s", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["s", "bucket"])
    packet = F.greatest(F.lit(1), F.least(F.lit(MAX_PACKET), F.floor(F.least(F.col("source_size").cast("double"), "target") / PACKETS)))
    return placed.select(
        "doc_id", "size", "s", "source_size", "target", (F.col("before") + F.col("offset")).alias("before"),
        packet.cast("long").alias("packet"),
    ).withColumn("in_copy", F.ceil(F.col("size") / F.col("packet")).cast("long"))


def _packet(j):
    """Of the packet with number `j` in its document's queue of copies: words, words of the source up to its end, finish time."""
    k = j % F.col("in_copy")
    start = k * F.col("packet")
    end = F.least(F.col("size"), start + F.col("packet"))
    upto = F.col("before") + F.floor(j / F.col("in_copy")).cast("long") * F.col("source_size") + end
    return end - start, upto, upto / F.col("target")


def mix(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    repeats: int = 2,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's) and taken, the words the mix takes of it."""
    words = F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = stored(documents.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), words.alias("size")
    ), "sizes")
    targets = stored(source_targets(sizes, weights, share, repeats), "targets")
    whole = targets.agg(F.max("n").alias("n"), F.sum("source_size").alias("words")).first()
    rows, total = whole["n"] or 0, whole["words"] or 0
    budget = math.floor(min(share, repeats) * total)
    root = max(1, math.isqrt(rows))
    queue = stored(_queue(sizes, targets, root), "queue")

    numbers = F.sequence(F.lit(0).cast("long"), F.col("in_copy") * repeats - 1)
    queued = queue.filter((F.col("size") > 0) & (F.col("target") > 0))
    n, upto, finish = _packet(F.col("j"))
    packets = queued.withColumn("j", F.explode(numbers)).select("s", n.alias("words"), upto.alias("upto"), finish.alias("finish"))
    slices = min(MAX_SLICES, max(64, 8 * root))
    packets = packets.withColumn("slice", F.least(F.floor(F.col("finish") * slices), F.lit(2 * slices).cast("long")))
    in_order = lambda *by: Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        packets.groupBy("slice").agg(F.sum("words").alias("words"))
        .withColumn("running", F.sum("words").over(in_order("slice")))
        .filter(F.col("running") >= budget).orderBy("slice").select("slice", (F.col("running") - F.col("words")).alias("spent")).first()
    )
    if last is None or budget == 0:
        return queue.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    rest = budget - last["spent"]
    cut = (
        packets.filter(F.col("slice") == last["slice"])
        .withColumn("running", F.sum("words").over(in_order("finish", "s", "upto")))
        .filter(F.col("running") >= rest).orderBy("running")
        .select("finish", "s", (F.lit(rest) - F.col("running") + F.col("words")).alias("part")).first()
    )

    def served(j):
        n, _, finish = _packet(j)
        at, source = F.lit(cut["finish"]), F.lit(cut["s"])
        return (
            F.when((finish < at) | ((finish == at) & (F.col("s") < source)), n)
            .when((finish == at) & (F.col("s") == source), F.lit(cut["part"])).otherwise(F.lit(0)).cast("long")
        )

    taken = F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, j: acc + served(j))
    return queue.select(
        "doc_id", "size", "source_size", "target",
        F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(F.lit(0).cast("long")).alias("taken"),
    )
