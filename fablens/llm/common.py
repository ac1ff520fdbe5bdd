"""Helpers shared by the operators: text normalisation, checked broadcasts, word hashing in numpy."""

from __future__ import annotations

import string
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fablens.session import stored

# Rows of a narrow table (a few numbers each) that may be broadcast. 400,000 rows of 24 bytes are some 10 MB.
MAX_BROADCAST_ROWS = 400_000
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches that go to Python functions run inside have about `size` bytes, or one row that is longer."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if `df` has at most `max_rows` rows; beyond that the join shuffles. Pass a stored, narrow table."""
    return F.broadcast(df) if not df.select(F.lit(1)).offset(max_rows).take(1) else df


def text_print(text_column: str) -> Column:
    """64-bit print of a text, null as empty. With the id it names a row; rows that share both are repeats."""
    return F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))


def _keyed(documents: DataFrame, id_column: str, mark: Column) -> DataFrame:
    """(row, id, print): the row as one struct, so that its columns may have any names."""
    row = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in documents.columns])
    return documents.select(row.alias("row"), F.col(id_column).cast("long").alias("id"), mark.alias("print"))


def _named(names: DataFrame, what: str) -> DataFrame:
    """(name, name_print) of the rows that `names` lists by doc_id and print, stored, broadcast if they are few."""
    return broadcast_if_small(stored(names.select(F.col("doc_id").alias("name"), F.col("print").alias("name_print")), what))


def _same() -> Column:
    return F.col("id").eqNullSafe(F.col("name")) & (F.col("print") == F.col("name_print"))


def without(documents: DataFrame, gone: DataFrame, id_column: str, mark: Column) -> DataFrame:
    """`documents` without the rows that `gone` names by doc_id and print; `mark` computes the print. All columns stay."""
    names = _named(gone.select("doc_id", "print").distinct(), "gone")
    return _keyed(documents, id_column, mark).join(names, _same(), "left_anti").select("row.*")


def one_of_each(documents: DataFrame, names: DataFrame, id_column: str, mark: Column) -> DataFrame:
    """`documents` with repeats of rows that `names` (doc_id, print) lists more than once cut to one row."""
    tied = names.groupBy("doc_id", "print").count().filter("count > 1")
    tied = _named(tied, "tied")
    if not tied.take(1):
        return documents
    keyed = _keyed(documents, id_column, mark)
    once = keyed.join(tied, _same(), "left_semi").dropDuplicates(["id", "print"])
    return keyed.join(tied, _same(), "left_anti").unionByName(once).select("row.*")


def numbered(df: DataFrame, name: str, column: str) -> DataFrame:
    """`df`, stored, with dense numbers from 0 in `column`: in the order of its partitions, so a sorted frame in its order.

    The numbers are fixed once written. What is broadcast has one row per partition.
    """
    rows = stored(df.withColumn(column, F.monotonically_increasing_id()), name)
    task = F.shiftright(column, 33)
    sizes = rows.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    first = sizes.select("_task", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    dense = (F.col("_first") + F.col(column).bitwiseAND(F.lit((1 << 33) - 1))).alias(column)
    return rows.join(F.broadcast(first), task == F.col("_task")).select(*df.columns, dense)


# --- words of byte strings, in numpy -------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PREFIX = np.uint64(0xA5A5A5A55A5A5A5A)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[kind] = have
    return have[:n]


def delimiter_table(delimiters: bytes) -> bytes:
    """Translation table: A-Z to lower case, every delimiter to a space."""
    upper, lower = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
    return bytes(32 if c in delimiters else lower[upper.index(c)] if c in upper else c for c in range(256))


SPACE_WORDS = delimiter_table(SPACES.encode())
# Words of ASCII letters, digits and anything beyond ASCII.
PLAIN_WORDS = delimiter_table(bytes(c for c in range(128) if not chr(c).isalnum()))


def word_hashes(data: bytes, prefixes: tuple[int, ...] = (), limit: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the space-separated words of `data`, in order.

    Polynomial prefix sums over pieces of about `limit` bytes, cut at spaces, so memory is bounded whatever the length. With
    `prefixes`, hashes of the words' beginnings of so many bytes follow those of each piece, for words longer than that.
    """
    found, start = [], 0
    while start < len(data):
        end = start + limit
        if end < len(data):
            cut = data.rfind(b" ", start, end)
            if cut < 0:
                stop = data.find(b" ", end)
                stop = len(data) if stop < 0 else stop
                found.append(_long_word(data[start:stop], prefixes, limit))
                start = stop
                continue
            end = cut + 1
        found.append(_piece_hashes(data[start:end], prefixes))
        start = end
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)


def _long_word(word: bytes, prefixes: tuple[int, ...], limit: int) -> np.ndarray:
    """The same hashes for a word that is longer than a piece, summed up part by part."""
    value = 0
    for at in range(0, len(word), limit):
        letters = np.frombuffer(word[at:at + limit], dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        part = int((letters * _power("up", _BASE, len(letters))).sum(dtype=np.uint64))
        value = (value + part * pow(int(_BASE), at, 1 << 64)) % (1 << 64)
    whole = mix(np.array([(value + len(word)) % (1 << 64)], dtype=np.uint64))
    return np.concatenate([whole, *[_piece_hashes(word[:k + 1], (k,))[1:] for k in prefixes]])


def _piece_hashes(data: bytes, prefixes: tuple[int, ...]) -> np.ndarray:
    letters = np.frombuffer(data, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], letters != 32, [False])).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    n = len(letters)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n), out=sums[1:])
    down = _power("down", _INVERSE, n)
    value = (sums[ends] - sums[starts]) * down[starts]
    hashes = mix(value + (ends - starts).astype(np.uint64))
    if not prefixes:
        return hashes
    found = [hashes]
    for k in prefixes:
        longer = starts[ends - starts > k]
        found.append(mix((sums[longer + k] - sums[longer]) * down[longer] + np.uint64(k)) ^ _PREFIX)
    return np.concatenate(found)


def portions(batch, size: int, rows: int = 128):
    """Slices of an Arrow batch of at most `rows` rows and about `size` bytes (a longer row is a slice of its own)."""
    start = 0
    while start < batch.num_rows:
        count = min(rows, batch.num_rows - start)
        while count > 1 and batch.slice(start, count).nbytes > size:
            count = (count + 1) // 2
        yield batch.slice(start, count)
        start += count


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words; a shorter text is one shingle, an empty one has none."""
    if not len(words):
        return words
    if len(words) < size:
        size = len(words)
    runs = len(words) - size + 1
    value = np.full(runs, size, dtype=np.uint64)
    for k in range(size):
        value = mix(value * np.uint64(0xD6E8FEB86659FD93) + words[k:k + runs])
    return np.unique(value)
