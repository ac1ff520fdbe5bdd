"""Filter interaction audit: which of five filters removes what, in every order, from a sparse document-term matrix.

1. Shards: a task turns some MB of texts into a sparse matrix in CSR form: one row per document, one column per word, with
   the shard's own word list.
2. Global dictionary: the shards' word lists are dealt out by a hash of the word, a list per shard and bucket; a bucket
   numbers its words, and the buckets' sizes make the numbers dense. Documents do not travel, and a frequent word is one
   entry per shard. The number of buckets follows from the number of entries, so a bucket is of bounded size.
3. The shards' columns are put into global numbers, a shard at a time. Row sums (words) and nonzero counts (distinct words)
   decide filters A and B; C and D come from the bytes of the text, E from a table with the smallest id of each repeated text.
4. Documents are counted by part and set of failed filters, at most 32 rows per part. All orders follow from these rows: a
   filter removes those that fail it and none before it, and a document that fails k filters is removed first by each of
   them in 120 / k of the 120 orders.

Filters (a document that meets a condition fails): A under 100 words; B fewer than 80 distinct words in 100; C over 10
upper-case letters A-Z in 100 code points; D any of # $ % & * |; E the same text as a document with a smaller id.

Defined results: null text is empty: it fails A only (and E if another is empty or null). A null id is smaller than no
other and never fails E; rows that share id and text pass E together, if no id is smaller. Equal texts are told by sha256.
A null part is the empty string. Of repeated labels of an id, any 1 counts. An empty table has no parts and no rows. Other
columns are not looked at. A text longer than a shard is a shard of its own and is cut into words piece by piece.

Memory: a task holds one shard, and texts come to it in batches of BATCH_BYTES. Between the stages a shard is packed: gaps
between a row's columns in 16 bits, counts in 8, larger numbers behind them. Row groups of the shards are of ROW_GROUP_BYTES,
as a reader holds all of a row group's shards.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fablens.llm.common import arrow_batches, broadcast_if_small, portions, word_hashes
from fablens.session import stored

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_UPPER_PERCENT = 10
SHARD_BYTES = 8 << 20
SHARD_ROWS = 1 << 14
PIECE_BYTES = 1 << 20
BATCH_BYTES = 2 << 20
ROW_GROUP_BYTES = 8 << 20
WORDS_PER_BUCKET = 1 << 18
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = b"#$%&*|"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(data: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE_BYTES, cut at white space."""
    start = 0
    while start < len(data):
        cut = _SPACE.search(data, start + PIECE_BYTES)
        end = cut.start() if cut else len(data)
        yield data[start:end]
        start = end


def _one(values: pa.Array) -> pa.Array:
    """A list array with the one list `values`."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(values: np.ndarray, kind: str) -> bytes:
    """Numbers from 0 on in the small type `kind`; its highest value stands for a number that follows behind all."""
    most = np.iinfo(kind).max
    return np.minimum(values, most).astype(kind).tobytes() + values[values >= most].astype("<i8").tobytes()


def _unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    values = np.frombuffer(data, kind, n).astype(np.int64)
    values[values == np.iinfo(kind).max] = np.frombuffer(data, "<i8", offset=n * np.dtype(kind).itemsize)
    return values


def _shards(size: int, most_rows: int):
    """Rows (at, doc_id, part, print, text) -> one row per shard: its documents and its matrix in local word numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bytes, held_rows = [], 0, 0
        for batch in (p for b in batches for p in portions(b, size, most_rows)):
            if held and (held_bytes + batch.nbytes > size or held_rows + batch.num_rows > most_rows):
                yield _shard(held)
                held, held_bytes, held_rows = [], 0, 0
            held.append(batch)
            held_bytes, held_rows = held_bytes + batch.nbytes, held_rows + batch.num_rows
        if held:
            yield _shard(held)

    return run


def _shard(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    gaps, counts, ends, upper, symbols = [], [], [0], [], []
    for text in (text for batch in batches for text in batch.column(4)):
        data = text.as_py() or b""
        found = [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)) for words in map(bytes.split, _pieces(data))]
        own, times = np.unique(np.concatenate(found) if found else np.empty(0, np.int32), return_counts=True)
        gaps.append(np.diff(own, prepend=np.int32(0)))
        counts.append(times.astype(np.int32))
        ends.append(ends[-1] + len(own))
        points = len(data.translate(None, _CONTINUATION))
        upper.append(100 * (len(data) - len(data.translate(None, _UPPER))) > MAX_UPPER_PERCENT * points)
        symbols.append(len(data.translate(None, _SYMBOLS)) < len(data))
    known = (pa.concat_arrays([batch.column(i) for batch in batches]) for i in range(1, 4))
    rows = pa.StructArray.from_arrays([*known, pa.array(upper), pa.array(symbols)], names=["doc_id", "part", "print", "fails_c", "fails_d"])
    packed = [_packed(np.concatenate(gaps), "<u2"), _packed(np.concatenate(counts), "u1"), b" ".join(numbers)]
    return pa.RecordBatch.from_arrays([
        batches[0].column(0).slice(0, 1), _one(rows), _one(pa.array(ends, pa.int64())),
        *(pa.array([data], pa.binary()) for data in packed), pa.array([len(numbers)], pa.int64()),
    ], names=["shard", "rows", "ends", "gaps", "counts", "words", "n_words"])


def _buckets(words: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each of the words, and the order that brings those of a bucket together."""
    at = (word_hashes(words) % np.uint64(buckets)).astype(np.int64)
    return at, np.argsort(at, kind="stable")


def _dealt(buckets: int):
    """Rows (shard, words) -> (shard, bucket, words): a shard's words of each bucket, in the shard's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, words in zip(*(c.to_pylist() for c in batch.columns)):
                at, order = _buckets(words, buckets)
                every, cuts = np.array(words.split(), dtype=object)[order], np.flatnonzero(np.diff(at[order])) + 1
                dealt = [b" ".join(part) for part in np.split(every, cuts)] if len(every) else []
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * len(dealt), pa.int64()), pa.array(np.unique(at)), pa.array(dealt, pa.binary()),
                ], names=["shard", "bucket", "words"])

    return run


def _number(table: pa.Table) -> pa.Table:
    """The rows (shard, bucket, words) of a bucket -> each shard's word numbers within the bucket; without a shard, the words."""
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    coded = [np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)) for w in (words.as_py().split() for words in table.column("words"))]
    shards = table.column("shard").to_pylist()
    return pa.table({
        "shard": pa.array([*shards, None], pa.int64()),
        "bucket": pa.array([table.column("bucket")[0].as_py()] * (len(shards) + 1), pa.int64()),
        "numbers": pa.array([*(own.astype("<i4").tobytes() for own in coded), None], pa.binary()),
        "size": pa.array([len(numbers)] * (len(shards) + 1), pa.int64()),
        "words": pa.array([None] * len(shards) + [b" ".join(numbers)], pa.binary()),
    })


def _encode(buckets: int, then: Callable[[pa.Table], pa.Table] | None):
    """A shard and its codes by bucket -> the same matrix with global columns, each once in a row, or what `then` makes of it."""

    def run(shard: pa.Table, codes: pa.Table) -> pa.Table:
        ends = shard.column("ends").combine_chunks().flatten().to_numpy()
        gaps, counts, words = (shard.column(name)[0].as_py() for name in ("gaps", "counts", "words"))
        codes, (_, order) = codes.sort_by("bucket"), _buckets(words, buckets)
        own = codes.column("numbers").to_pylist()
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.repeat(codes.column("first").to_numpy(), np.array([len(x) // 4 for x in own], np.int64)) + np.frombuffer(b"".join(own), "<i4")
        upto = np.concatenate(([0], np.cumsum(_unpacked(gaps, ends[-1], "<u2"))))
        local = upto[1:] - np.repeat(upto[ends[:-1]], np.diff(ends))
        matrix = shard.select(["shard", "rows", "ends"]).append_column("columns", _one(pa.array(number[local]))).append_column(
            "counts", _one(pa.array(_unpacked(counts, ends[-1], "u1"), pa.int32()))
        )
        return matrix if then is None else then(matrix)

    return run


def _row_sums(matrix: pa.Table) -> pa.Table:
    """A shard's matrix -> (doc_id, part, print, fails_c, fails_d, n_words, n_distinct): sums and nonzero counts of its rows."""
    rows, ends, counts = (matrix.column(name).combine_chunks().flatten() for name in ("rows", "ends", "counts"))
    ends = ends.to_numpy()
    upto = np.concatenate(([0], np.cumsum(counts.to_numpy(), dtype=np.int64)))
    sums = pa.array(upto[ends[1:]] - upto[ends[:-1]]), pa.array(np.diff(ends))
    names = ["doc_id", "part", "print", "fails_c", "fails_d", "n_words", "n_distinct"]
    return pa.table([*rows.flatten(), *sums], names=names)


def _row_type(documents: DataFrame, id_column: str) -> str:
    return f"doc_id: {documents.schema[id_column].dataType.simpleString()}, part: string, print: binary, fails_c: boolean, fails_d: boolean"


def document_term_matrix(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang",
    then: tuple[Callable[[pa.Table], pa.Table], str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(matrix, dictionary): CSR shards (shard, rows, ends, columns, counts) and the words in the order of their numbers.

    Row i of a shard has the entries ends[i] to ends[i + 1] of `columns` (word numbers, each once) and `counts`. A row of
    the dictionary (first, size, words) has `size` words, joined by blanks, with the numbers from `first` on. With `then`, a
    function and its schema, the first frame has what the function makes of each shard's matrix, where it is made.
    """
    own = documents.select(
        F.monotonically_increasing_id().alias("at"), F.col(id_column).alias("doc_id"),
        F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text_column), F.lit("")), 256)).alias("print"),
        F.col(text_column).cast("binary").alias("text"),
    )
    row = _row_type(documents, id_column)
    cut = {"parquet.block.size": ROW_GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    with arrow_batches(documents.sparkSession, BATCH_BYTES):
        shards = stored(own.mapInArrow(
            _shards(SHARD_BYTES, SHARD_ROWS),
            f"shard long, rows array<struct<{row}>>, ends array<long>, gaps binary, counts binary, words binary, n_words long",
        ), "shards", **cut)
        buckets = max(1, math.ceil((shards.agg(F.sum("n_words")).first()[0] or 0) / WORDS_PER_BUCKET))
        dealt = shards.select("shard", "words").mapInArrow(_dealt(buckets), "shard long, bucket long, words binary")
        coded = stored(dealt.groupBy("bucket").applyInArrow(
            _number, "shard long, bucket long, numbers binary, size long, words binary"
        ), "coded")
    # One row per bucket: some millionth of the words.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    dictionary = coded.filter(F.col("shard").isNull())
    first = dictionary.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    placed = coded.filter(F.col("shard").isNotNull()).select("shard", "bucket", "numbers").join(broadcast_if_small(stored(first, "first")), "bucket")
    # A shard has at most as many numbers as words, so its size bounds the group.
    together = shards.drop("n_words").groupBy("shard").cogroup(placed.select("shard", "bucket", "first", "numbers").groupBy("shard"))
    made, schema = then or (None, f"shard long, rows array<struct<{row}>>, ends array<long>, columns array<long>, counts array<int>")
    words = dictionary.join(first, "bucket").select("first", "size", "words")
    return together.applyInArrow(_encode(buckets, made), schema), words


def failures(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang",
) -> DataFrame:
    """One row per document: doc_id, part, n_words, n_distinct, failed (the letters of the filters it fails, in order)."""
    row = _row_type(documents, id_column).replace(":", "")
    sums, _ = document_term_matrix(documents, id_column, text_column, part_column, then=(_row_sums, f"{row}, n_words long, n_distinct long"))
    rows = stored(sums, "row-sums")
    repeated = rows.groupBy("print").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    repeated = broadcast_if_small(stored(repeated.drop("n"), "repeated"))
    fails = {
        "A": F.col("n_words") < MIN_WORDS,
        "B": 100 * F.col("n_distinct") < MIN_DISTINCT_PERCENT * F.col("n_words"),
        "C": F.col("fails_c"),
        "D": F.col("fails_d"),
        "E": F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)),
    }
    failed = F.concat(*[F.when(condition, letter).otherwise("") for letter, condition in fails.items()])
    return rows.join(repeated, "print", "left").select("doc_id", "part", "n_words", "n_distinct", failed.alias("failed"))


def interactions(counted: DataFrame) -> DataFrame:
    """Counts by part and failed filters (part, failed, n, good, toxic) -> one row per part, order and step."""
    orders = F.array(*[F.lit("".join(order)) for order in permutations(FILTERS)])
    steps = counted.select("*", F.explode(orders).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")
    ).withColumns({
        "own": F.expr("substring(filter_order, step, 1)"),
        # What is left of the failed filters when those applied before are taken away.
        "open": F.expr("translate(failed, substring(filter_order, 1, step - 1), '')"),
    })
    fails = F.expr("contains(failed, own)")
    removed = fails & (F.col("open") == F.col("failed"))
    kept = ~fails & (F.col("open") == F.col("failed"))
    first_in = F.lit(120) / F.greatest(F.length("failed"), F.lit(1))
    total = lambda condition, column="n": F.sum(F.when(condition, F.col(column)).otherwise(0)).cast("long")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(kept).alias("kept"), total(removed).alias("removed"), total(fails & ~removed).alias("redundant"),
        total(F.col("failed") == F.col("own")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * first_in.cast("long")).otherwise(0)).cast("long").alias("shapley"),
    )


def audit(
    documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang",
    good: Column | None = None, toxic: Column | None = None,
) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    `labels` has the ids in `id_column`; `good` and `toxic` are conditions on it (quality = 1 and toxic = 1).
    """
    good = F.col("quality") == 1 if good is None else good
    toxic = F.col("toxic") == 1 if toxic is None else toxic
    flag = lambda condition: F.max(F.coalesce(condition, F.lit(False)).cast("int"))
    marks = labels.filter(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("doc_id")).agg(
        flag(good).alias("good"), flag(toxic).alias("toxic")
    ).filter((F.col("good") == 1) | (F.col("toxic") == 1))
    marks = broadcast_if_small(stored(marks, "marks"))
    rows = failures(documents, id_column, text_column, part_column).join(marks, "doc_id", "left")
    counted = rows.groupBy("part", "failed").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )
    return interactions(stored(counted, "counted"))
