"""N-gram Jaccard join by set relations: block-skip lists by position, answers derived from a similar set's answers.

Sets are the shingles of a text; equal sets are one class, and everything below works on numbered classes.

1. Order. Tokens are ordered from rare to frequent. Any order gives right results; counts are kept in a fixed number of
   hash buckets, and a task reports only buckets it met REPORT times or more, so the table is of bounded size.
2. Lists. Two sets can reach the threshold only if they share a token so early in both orders that enough tokens are left
   after it. So each set stands in the lists of its first tokens only, with its size n and the token's position; tokens in
   one list only are dropped.
3. Leaders. In each list the set with the smallest position leads: the common original of a cloud of copies, which has the
   fewest tokens of its own. It is compared on the full sets with the list's others, where sizes and positions allow a
   link. These are the leader's answers: the overlap, and how the other set differs from it. Links are grouped.
4. Blocks. In the lists whose sets lie in several groups, the sets of one group, size and position are one block. What
   position and size rule out is ruled out once for two blocks, and all their sets are skipped; so is a group with itself.
5. Derived answers. What blocks leave over are pairs of sets in different groups. If both are answers of one leader L, the
   overlap follows from what is known: |X n Z| = |L| - |L-X| - |L-Z| + |(L-X) n (L-Z)| + |(X-L) n (Z-L)|. Only the
   differences are intersected. The others are compared on the full sets. Links found are grouped with the known ones.

Every pair of sets that meets in a list is thus compared, derived, in one group already, or ruled out by a bound, so the
groups are exact (up to 64-bit hashes of shingles). No list, group of copies or leader is gathered: lists are joined,
leaders with many sets are dealt out over salts with one set per task in memory.

Defined results: null is empty; a text without words has no shingles and is linked with nothing; a text shorter than a
shingle is one shingle. Rows with equal sets are linked. Repeated rows and ids keep a row each. A null id is never the
smallest unless all of the group are null. An empty table gives no rows. Other columns are not looked at. Ids must be
whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fablens.llm.common import (
    SPACE_WORDS, broadcast_if_small, numbered, portions, shingle_hashes, text_print, word_hashes,
)
from fablens.llm.components import components
from fablens.session import stored

PORTION_BYTES = 1 << 20
# Buckets in which tokens are counted: 16 MB of counts. Of the few million tokens of a task, about one falls into each.
BUCKET_BITS = 22
REPORT = 4
SETS_PER_SALT = 512
# Differences from a leader are kept for answers of this similarity or more.
ANSWER_PERCENT = 60


def shingles(data: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words of a text in UTF-8."""
    return shingle_hashes(word_hashes((data or b"").translate(SPACE_WORDS)), size)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _describe(size: int):
    """Rows (doc_id, print, text) -> (doc_id, print, n, digest), the digest naming the set, and (bucket, times) of the task."""
    names = ["doc_id", "print", "n", "digest", "bucket", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, dtype=np.int32)
        for part in (p for b in batches for p in portions(b, PORTION_BYTES)):
            sets = [shingles(t.as_py(), size) for t in part.column(2)]
            for tokens in sets:
                counts[_bucket(tokens)] += 1
            n = len(sets)
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()),
            ], names=names)
        often = np.flatnonzero(counts >= REPORT)
        for start in range(0, len(often), 1 << 16):
            part = often[start:start + (1 << 16)]
            n = len(part)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                pa.array(part.astype(np.int32)), pa.array(counts[part].astype(np.int64)),
            ], names=names)

    return run


def _postings(shared, size: int, percent: int):
    """Rows (node, text) -> (token, place, n, node) of each set's first tokens in the order from rare to frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for part in (p for b in batches for p in portions(b, PORTION_BYTES)):
            tokens, places, sizes = [], [], []
            for text in part.column(1):
                own = shingles(text.as_py(), size)
                first = len(own) - -(-percent * len(own) // 100) + 1
                order = np.lexsort((own, counts[_bucket(own)]))[:first]
                tokens.append(own[order])
                places.append(np.arange(len(order), dtype=np.int32))
                sizes.append(len(own))
            lengths = [len(t) for t in tokens]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(places)),
                pa.array(np.repeat(np.array(sizes, dtype=np.int32), lengths)),
                pa.array(np.repeat(part.column(0).to_numpy(), lengths)),
            ], names=["token", "place", "n", "node"])

    return run


def _inside(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Which items of `small` are in `large`; both sorted."""
    if not len(large):
        return np.zeros(len(small), dtype=bool)
    return large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small


def _answers(size: int, percent: int):
    """Rows (leader, salt, other, text), a leader's own row (other is null) before the others: the leader's answers.

    Gives (leader, other, linked, leader_n, missing, extra): what the other set lacks of the leader's, and has beyond it.
    """
    names = ["leader", "other", "linked", "leader_n", "missing", "extra"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, None
        for part in (p for b in batches for p in portions(b, PORTION_BYTES)):
            found: list[list] = [[] for _ in names]
            for leader, salt, other, text in zip(*(c.to_pylist() for c in part.columns)):
                if other is None:
                    if (leader, salt) != group:
                        group, own = (leader, salt), shingles(text, size)
                    continue
                if (leader, salt) != group:
                    raise ValueError("a leader's text is missing")
                theirs = shingles(text, size)
                extra = theirs[~_inside(theirs, own)]
                shared = len(theirs) - len(extra)
                union = len(own) + len(extra)
                if 100 * shared < min(percent, ANSWER_PERCENT) * union:
                    continue
                missing = own[~_inside(own, theirs)]
                row = leader, other, 100 * shared >= percent * union, len(own), missing.view(np.int64), extra.view(np.int64)
                for values, value in zip(found, row):
                    values.append(value)
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(found, kinds)], names=names)

    return run


def _compared(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The answers among `pairs` (leader, other), on full sets. `texts` has node and text; repeated rows do no harm."""
    load = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / SETS_PER_SALT).alias("salts"))
    load = stored(load, "leaders")
    dealt = pairs.join(broadcast_if_small(load), "leader").select(
        "leader", F.pmod(F.xxhash64("other"), F.col("salts")).alias("salt"), "other"
    )
    asked = dealt.join(texts.withColumnRenamed("node", "other"), "other").select("leader", "salt", "other", "text")
    own = load.join(texts.withColumnRenamed("node", "leader"), "leader").select(
        "leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
        F.lit(None).cast("long").alias("other"), "text",
    )
    rows = own.unionByName(asked).repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.col("other").asc_nulls_first())
    schema = "leader long, other long, linked boolean, leader_n long, missing array<long>, extra array<long>"
    return rows.mapInArrow(_answers(size, percent), schema)


def _allowed(n_a: Column, place_a: Column, n_b: Column, place_b: Column, percent: int) -> Column:
    """Sizes, and tokens left from the two positions on, allow a link."""
    needed = F.ceil(percent * (n_a + n_b) / F.lit(100 + percent))
    sizes = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    return sizes & (place_a + needed <= n_a) & (place_b + needed <= n_b)


def _key(node: Column) -> Column:
    """A class number as bytes in the same order."""
    return F.unhex(F.lpad(F.hex(node), 16, "0"))


def _groups(links: DataFrame) -> DataFrame:
    """(node, root) of the classes that `links` (a, b) connect, without the roots."""
    found = components(links.select(_key(F.col("a")).alias("a"), _key(F.col("b")).alias("b")))
    number = lambda c: F.conv(F.hex(c), 16, 10).cast("long").alias(c)
    return found.select(number("node"), number("root"))


def _across(members: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of classes of different groups that meet in a list where their blocks allow a link."""
    placed = members.join(broadcast_if_small(groups), "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stored(placed, "placed")
    mixed = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter(F.col("low") != F.col("high"))
    mixed = stored(mixed.select("token"), "mixed")
    placed = stored(placed.join(broadcast_if_small(mixed), "token"), "placed")
    block = ["token", "root", "n", "place"]
    blocks = stored(placed.groupBy(*block).agg(F.count(F.lit(1)).alias("sets")).drop("sets"), "blocks")
    side = lambda name: blocks.select("token", *[F.col(c).alias(f"{c}_{name}") for c in block[1:]])
    a, b = side("a"), side("b")
    once = F.struct("n_a", "root_a") < F.struct("n_b", "root_b")
    meet = a.join(b, "token").filter(
        (F.col("root_a") != F.col("root_b")) & once
        & _allowed(F.col("n_a"), F.col("place_a"), F.col("n_b"), F.col("place_b"), percent)
    )
    meet = stored(meet, "meetings")
    of = lambda name: placed.select("token", *[F.col(c).alias(f"{c}_{name}") for c in [*block[1:], "node"]])
    found = meet.join(of("a"), ["token", "root_a", "n_a", "place_a"]).join(of("b"), ["token", "root_b", "n_b", "place_b"])
    return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _derived(pairs: DataFrame, answers: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of the `pairs` (a, b) that are answers of one leader, from its answers alone."""
    side = lambda name: answers.select(
        F.col("other").alias(name), "leader", F.col("leader_n").alias("n"),
        F.col("missing").alias(f"missing_{name}"), F.col("extra").alias(f"extra_{name}"),
    )
    both = pairs.join(side("a"), "a").join(side("b").drop("n"), ["b", "leader"])
    size = lambda c: F.size(c).cast("long")
    shared = (
        F.col("n") - size("missing_a") - size("missing_b")
        + size(F.array_intersect("missing_a", "missing_b")) + size(F.array_intersect("extra_a", "extra_b"))
    )
    n_a = F.col("n") - size("missing_a") + size("extra_a")
    n_b = F.col("n") - size("missing_b") + size("extra_b")
    linked = both.select("a", "b", (100 * shared >= percent * (n_a + n_b - shared)).alias("linked"))
    return linked.distinct()  # each common leader gives the same answer


def join_groups(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 5, percent: int = 80,
) -> DataFrame:
    """One row per document: doc_id, print (of its text), n_shingles, component_id.

    component_id is the smallest id that links of at least `percent` Jaccard similarity reach.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    spark = documents.sparkSession
    own = documents.select(
        F.col(id_column).cast("long").alias("doc_id"), text_print(text_column).alias("print"),
        F.col(text_column).cast("binary").alias("text"),
    )
    described = stored(own.mapInArrow(
        _describe(shingle_words), "doc_id long, print long, n long, digest binary, bucket int, times long"
    ), "described")
    rows = described.filter(F.col("bucket").isNull()).select("doc_id", "print", "n", "digest")
    summed = described.filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("times").alias("times")).toArrow()
    counts = np.zeros(1 << BUCKET_BITS, dtype=np.int32)
    counts[summed.column("bucket").to_numpy()] = np.minimum(summed.column("times").to_numpy(), np.iinfo(np.int32).max)
    shared_counts = spark.sparkContext.broadcast(counts)

    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "print"))
    classes = rows.filter(F.col("digest").isNotNull()).groupBy("digest").agg(first.alias("least"))
    classes = numbered(classes.select("digest", "least.doc_id", "least.print"), "classes", "node")
    speakers = broadcast_if_small(classes.select(F.col("doc_id").alias("s_id"), F.col("print").alias("s_print"), "node"))
    speaks = own["doc_id"].eqNullSafe(speakers["s_id"]) & (own["print"] == speakers["s_print"])
    texts = own.join(speakers, speaks).select("node", "text")

    postings = texts.mapInArrow(_postings(shared_counts, shingle_words, percent), "token long, place int, n int, node long")
    postings = stored(postings, "postings")
    often = postings.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).filter(F.col("sets") > 1).select("token")
    members = stored(postings.join(often, "token"), "members")
    leads = F.min(F.struct("place", "n", "node")).alias("l")
    leaders = members.groupBy("token").agg(leads).select(
        "token", F.col("l.node").alias("leader"), F.col("l.n").alias("leader_n"), F.col("l.place").alias("leader_place")
    )
    allowed = _allowed(F.col("n"), F.col("place"), F.col("leader_n"), F.col("leader_place"), percent)
    led = members.join(stored(leaders, "list-leaders"), "token").filter((F.col("node") != F.col("leader")) & allowed)
    pairs = stored(led.select("leader", F.col("node").alias("other")).distinct(), "pairs")

    involved = pairs.select("leader").unionByName(pairs.select(F.col("other").alias("leader"))).distinct()
    involved = broadcast_if_small(stored(involved.select(F.col("leader").alias("node")), "involved"))
    full = stored(texts.join(involved, "node"), "texts")
    answers = stored(_compared(pairs, full, shingle_words, percent), "answers")
    links = stored(answers.filter("linked").select(F.col("leader").alias("a"), F.col("other").alias("b")).distinct(), "links")
    groups = stored(_groups(links), "groups")

    known = pairs.select(F.least("leader", "other").alias("a"), F.greatest("leader", "other").alias("b")).distinct()
    open_pairs = stored(_across(members, groups, percent).join(known, ["a", "b"], "left_anti"), "open-pairs")
    if open_pairs.take(1):
        derived = stored(_derived(open_pairs, answers, percent), "derived")
        rest = open_pairs.join(derived, ["a", "b"], "left_anti").select(F.col("a").alias("leader"), F.col("b").alias("other"))
        rest = stored(rest, "rest")
        named = broadcast_if_small(stored(
            rest.select(F.col("leader").alias("node")).unionByName(rest.select(F.col("other").alias("node"))).distinct(), "named"
        ))
        compared = _compared(rest, stored(texts.join(named, "node"), "texts"), shingle_words, percent).filter("linked")
        more = derived.filter("linked").select("a", "b").unionByName(
            compared.select(F.col("leader").alias("a"), F.col("other").alias("b"))
        )
        more = stored(more.distinct(), "links")
        if more.take(1):
            links = stored(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "links")
            groups = stored(_groups(links), "groups")

    rooted = classes.join(broadcast_if_small(groups), "node", "left").select(
        "digest", F.coalesce("root", "node").alias("root"), F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id").alias("least")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("least")).select("root", F.col("least.doc_id").alias("component_id"))
    named = stored(rooted.select("digest", "root").join(least, "root").drop("root"), "named")
    return rows.join(broadcast_if_small(named), "digest", "left").select(
        "doc_id", "print", F.col("n").alias("n_shingles"),
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
