"""Near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

SuperMinHash: every element of a set runs through the registers in an order of its own (a permutation), and its value in
the j-th one is j plus a fraction. So an element gives each register another rank, which makes the registers' errors
cancel, and the walk stops as soon as every register holds a smaller rank than the next one: after one round for a long
text. All documents of a batch take their steps together. The permutations are (start + odd step * j) mod REGISTERS.

Documents with equal sets are one class, found by a digest of the set; everything below works on classes.

Banding: ROWS registers make a band; the number of bands follows from the threshold, so that a linked pair shares no band
with a chance below MISS. Within a bucket not all pairs are compared: each class is compared with the bucket's pivot, on
the full sets. The pivot is the class that shares most buckets with others, so in a cloud of copies that of the common
original. Then the links are grouped.

What is left are buckets whose classes lie in several groups. Among their classes, linked pairs are found exactly by a
prefix filter: tokens are ordered from rare to frequent (by counts in a fixed number of hash buckets; any order is right),
and two sets can only reach the threshold if they share a token so early in both orders that enough tokens follow. What
makes a copy too different from its original are rare tokens, so these pairs are few. They are compared on the full sets
too. So every pair that shares a bucket is compared, grouped already, or ruled out by the bound.

Scale: texts are read once for signatures; only texts of classes that share a bucket travel. A pivot with very many
classes is dealt out over salts, and holds one set per task. No group of copies is gathered.

Defined results: a text without words has no shingles and is linked with nothing; a text shorter than a shingle is one
shingle; null is empty. Rows with equal sets are linked. A null id is never the smallest unless all of the group are null.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablens.llm.common import (
    SPACE_WORDS, broadcast_if_small, mix, one_of_each, portions, shingle_hashes, text_print, without, word_hashes,
)
from fablens.llm.components import components
from fablens.session import stored

REGISTERS = 128
ROWS = 4
MISS = 1e-7
CLASSES_PER_SALT = 2048
# Text that one step of a task works on.
PORTION_BYTES = 1 << 20
TOKEN_BUCKETS_BITS = 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_FRACTION_BITS = 48


def n_bands(percent: int) -> int:
    """Bands so that a pair at the threshold shares none with a chance below MISS."""
    same = (percent / 100) ** ROWS
    bands = REGISTERS // ROWS if same >= 1 else math.ceil(math.log(MISS) / math.log(1 - same))
    if bands * ROWS > REGISTERS:
        raise ValueError(f"{percent} percent is too low for {REGISTERS} registers")
    return bands


def shingles(text: str | None, size: int) -> np.ndarray:
    return shingle_hashes(word_hashes((text or "").encode("utf-8", "replace").translate(SPACE_WORDS)), size)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash registers, one row per set; values of an empty set are all ones."""
    registers = np.full(len(sets) * REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    elements = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    seed = mix(elements ^ _GOLDEN)
    start = (seed & np.uint64(REGISTERS - 1)).astype(np.int64)
    step = ((seed >> np.uint64(32)) | np.uint64(1)).astype(np.int64)
    open_sets = sizes > 0
    for rank in range(REGISTERS):
        at = owner * REGISTERS + ((start + step * rank) & (REGISTERS - 1))
        fraction = mix(elements + np.uint64((rank + 1) * int(_GOLDEN) % (1 << 64))) >> np.uint64(64 - _FRACTION_BITS)
        np.minimum.at(registers, at, (np.uint64(rank) << np.uint64(_FRACTION_BITS)) | fraction)
        highest = registers.reshape(len(sets), REGISTERS).max(axis=1)
        open_sets &= highest >= (np.uint64(rank + 1) << np.uint64(_FRACTION_BITS))
        stays = open_sets[owner]
        if not stays.any():
            break
        elements, owner, start, step = elements[stays], owner[stays], start[stays], step[stays]
    return registers.reshape(len(sets), REGISTERS)


def band_keys(registers: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per set and band; keys of different bands differ."""
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(registers), bands))
    for row in range(ROWS):
        key = mix(key * _GOLDEN + registers[:, row:bands * ROWS:ROWS])
    return key


def _describe(size: int, bands: int):
    """Rows (doc_id, print, text) -> (doc_id, print, n_shingles, node, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, PORTION_BYTES):
                sets = [shingles(t.as_py(), size) for t in part.column(2)]
                keys = band_keys(signatures(sets), bands).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([k if len(s) else k[:0] for k, s in zip(keys, sets)], pa.list_(pa.int64())),
                ], names=["doc_id", "print", "n_shingles", "node", "keys"])

    return run


def _compare(size: int, percent: int):
    """Rows (pivot, salt, other, text), a pivot's own row (other is null) before those to compare with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, None
        for batch in (p for b in batches for p in portions(b, PORTION_BYTES)):
            pivots, others, linked = [], [], []
            for pivot, salt, other, text in zip(*(c.to_pylist() for c in batch.columns)):
                if other is None:
                    if (pivot, salt) != group:
                        group, own = (pivot, salt), shingles(text, size)
                    continue
                if (pivot, salt) != group:
                    raise ValueError("a pivot's text is missing")
                theirs = shingles(text, size)
                small, large = (own, theirs) if len(own) < len(theirs) else (theirs, own)
                # The smaller set is a bound for what is shared.
                shared = 0
                if 100 * len(small) >= percent * len(large):
                    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    shared = int((large[place] == small).sum())
                pivots.append(pivot)
                others.append(other)
                linked.append(100 * shared >= percent * (len(own) + len(theirs) - shared))
            yield pa.RecordBatch.from_arrays(
                [pa.array(pivots, pa.binary()), pa.array(others, pa.binary()), pa.array(linked, pa.bool_())],
                names=["a", "b", "linked"],
            )

    return run


def _token_counts(size: int):
    """Texts of a task -> (bucket, n): how many sets have a token in each hash bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << TOKEN_BUCKETS_BITS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, _bucket(shingles(text.as_py(), size)), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    return run


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - TOKEN_BUCKETS_BITS)).astype(np.int64)


def _prefixes(shared, size: int, percent: int):
    """Rows (node, root, text) -> the rarest tokens of each: (token, place, n, node, root).

    A partner shares at least percent/100 of this set's n tokens, so one token among the first n - that + 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in (p for b in batches for p in portions(b, PORTION_BYTES)):
            tokens, places, sizes, nodes, roots = [], [], [], [], []
            for node, root, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = shingles(text, size)
                length = len(own) - -(-percent * len(own) // 100) + 1
                tokens.append(own[np.lexsort((own, counts[_bucket(own)]))[:length]])
                places.append(np.arange(len(tokens[-1])))
                sizes.append(np.full(len(tokens[-1]), len(own)))
                nodes += [node] * len(tokens[-1])
                roots += [root] * len(tokens[-1])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(places)), pa.array(np.concatenate(sizes)),
                pa.array(nodes, pa.binary()), pa.array(roots, pa.binary()),
            ], names=["token", "place", "n", "node", "root"])

    return run


def _pairs_across(left: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(pivot, other): all pairs of classes in `left` (node, root) with different roots that may reach the threshold."""
    own = texts.join(broadcast_if_small(left), "node").select("node", "root", "text")
    counts = np.zeros(1 << TOKEN_BUCKETS_BITS, dtype=np.int32)
    summed = own.select("text").mapInArrow(_token_counts(size), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[summed.column("bucket").to_numpy()] = np.minimum(summed.column("n").to_numpy(), np.iinfo(np.int32).max)
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    rows = own.mapInArrow(_prefixes(shared, size, percent), "token long, place long, n long, node binary, root binary")
    rows = stored(rows, "prefixes")
    # Of the groups that meet at a token, the largest is compared with the others, and those with each other.
    per_root = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("members"))
    meeting = per_root.groupBy("token").agg(
        F.max_by("root", F.struct("members", "root")).alias("main"), F.count(F.lit(1)).alias("groups")
    ).filter(F.col("groups") > 1).select("token", "main")
    met = stored(rows.join(meeting, "token"), "meetings")
    side = lambda name: met.select("token", *[F.col(c).alias(f"{c}_{name}") for c in ("place", "n", "node", "root", "main")])
    few, every = side("a").filter(F.col("root_a") != F.col("main_a")).drop("main_a"), side("b")
    needed = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))
    reachable = (F.col("place_a") + needed <= F.col("n_a")) & (F.col("place_b") + needed <= F.col("n_b"))
    once = (F.col("root_b") == F.col("main_b")) | (F.col("node_a") < F.col("node_b"))
    found = few.join(every, (few["token"] == every["token"]) & (F.col("root_a") != F.col("root_b")) & once & reachable)
    return found.select(F.col("node_a").alias("pivot"), F.col("node_b").alias("other")).distinct()


def _verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among `pairs` (pivot, other), by full sets: (a, b). `texts` has node and text."""
    load = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / CLASSES_PER_SALT).alias("salts"))
    load = stored(load, "pivots")
    dealt = pairs.join(broadcast_if_small(load), "pivot").select(
        "pivot", F.pmod(F.xxhash64("other"), F.col("salts")).alias("salt"), "other"
    )
    asked = dealt.join(texts.withColumnRenamed("node", "other"), "other").select("pivot", "salt", "other", "text")
    own = load.join(texts.withColumnRenamed("node", "pivot"), "pivot").select(
        "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
        F.lit(None).cast("binary").alias("other"), "text",
    )
    rows = own.unionByName(asked).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("other").asc_nulls_first())
    compared = rows.mapInArrow(_compare(size, percent), "a binary, b binary, linked boolean")
    return compared.filter("linked").select("a", "b")


def _grouped(documents: DataFrame, id_column: str, text_column: str, shingle_words: int, percent: int) -> DataFrame:
    """near_groups with `keeper`: whether the row has the smallest id (null last), then print, of its group."""
    bands = n_bands(percent)
    own = documents.select(
        F.col(id_column).cast("long").alias("doc_id"), text_print(text_column).alias("print"), F.col(text_column).alias("text")
    )
    described = own.mapInArrow(
        _describe(shingle_words, bands), "doc_id long, print long, n_shingles long, node binary, keys array<long>"
    )
    rows = stored(described, "signatures")

    in_bands = rows.select(F.explode("keys").alias("key"), "node")
    buckets = in_bands.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n"))
    buckets = stored(buckets.filter(F.col("low") != F.col("high")).select("key", "n"), "buckets")
    members = stored(in_bands.join(broadcast_if_small(buckets), "key").select("key", "node", "n").distinct(), "members")
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    pivots = members.join(company, "node").groupBy("key").agg(F.max_by("node", F.struct("company", "node")).alias("pivot"))
    members = stored(members.join(pivots, "key").filter(F.col("node") != F.col("pivot")).select("key", "node", "pivot"), "members")

    involved = members.select("node").unionByName(members.select(F.col("pivot").alias("node"))).distinct()
    speaker = F.min(F.struct("doc_id", "print"))
    speakers = rows.join(involved, "node", "left_semi").groupBy("node").agg(speaker.alias("s"))
    speakers = stored(speakers.select("node", F.col("s.doc_id").alias("s_id"), F.col("s.print").alias("s_print")), "speakers")
    hint = broadcast_if_small(speakers)
    texts = own.join(hint, own["doc_id"].eqNullSafe(hint["s_id"]) & (own["print"] == hint["s_print"]))
    # Repeated rows have the same text; one of them speaks for the class.
    texts = stored(texts.select("node", "text"), "texts").dropDuplicates(["node"])

    pairs = stored(members.select("pivot", F.col("node").alias("other")).distinct(), "pairs")
    links = stored(_verify(pairs, texts, shingle_words, percent), "links")
    groups = components(links)
    # Classes that were not pivots where classes of another group were not either.
    placed = members.join(groups, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    placed = stored(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter(F.col("low") != F.col("high"))
    left = stored(placed.join(mixed.select("key"), "key", "left_semi").select("node", "root").distinct(), "left")
    if left.take(1):
        pairs = stored(_pairs_across(left, texts, shingle_words, percent), "pairs")
        found = stored(_verify(pairs, texts, shingle_words, percent), "links")
        if found.take(1):
            known = groups.select(F.col("node").alias("a"), F.col("root").alias("b"))
            groups = components(known.unionByName(found))

    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "print"))
    classes = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(first.alias("least"))
    rooted = classes.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("least"))
    named = least.select("root", F.col("least.doc_id").alias("component_id"), F.col("least.print").alias("keeper_print"))
    named = stored(rooted.select("node", "root").join(named, "root").drop("root"), "named")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    return rows.select("doc_id", "print", "n_shingles", "node").join(named, "node", "left").select(
        "doc_id", "print", "n_shingles", component.alias("component_id"), kept.alias("kept"),
        (kept & (F.col("node").isNull() | (F.col("print") == F.col("keeper_print")))).alias("keeper"),
    )


def near_groups(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
) -> DataFrame:
    """One row per document: doc_id, print (of its text), n_shingles, component_id, kept."""
    return _grouped(documents, id_column, text_column, shingle_words, percent).drop("keeper")


def drop_near_copies(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
) -> DataFrame:
    """`documents` with one row of each group: the one with the smallest id, and of these with the smallest print of its text."""
    groups = stored(_grouped(documents, id_column, text_column, shingle_words, percent), "groups")
    mark = text_print(text_column)
    return one_of_each(without(documents, groups.filter("not keeper"), id_column, mark), groups.filter("keeper"), id_column, mark)
