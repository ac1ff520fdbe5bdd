"""Spelling variants: words one edit apart, found with pairs of trie nodes, each led to its frequent form.

1. Words: runs of letters are counted over all texts. A word's number is its place in code-point order.
2. Two tries: each prefix of a word is a node of the forward trie, each suffix one of the reversed trie. Nodes that at
   least two words pass are numbered; others have no neighbour behind them.
3. Pair dictionary: a word stands under the pairs (prefix node, suffix node) that leave out one position ("skip"), and
   under those that leave out none ("split"). Words that differ by one replaced letter share a skip pair; a word and the
   same word with a letter less share the former's skip pair and the latter's split pair. Pairs are compared as integers,
   and two words that share one are neighbours without further check. A letter in a run of equal letters is skipped for a
   deletion at its first place only, so no two words share two pairs.
4. A pair's words differ in one letter of the alphabet (90 letters), so at most 91 words stand under it, whatever the
   data. Counts and the best neighbour are summed up per word; no lists of neighbours are kept.
5. A word's form is its most frequent neighbour, if that is frequent enough; roots follow by pointer doubling. A form is
   at least `ratio` times as frequent as its word, so few rounds are needed.

Defined results: null texts have no runs; a null id counts as an empty one. Repeated rows count again. Ties between
neighbours go to the first in code-point order. An empty table gives no rows. Very long runs are words like others: tries
go by 16-byte digests of prefixes and suffixes beyond LONG bytes. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fablens.llm.common import numbered
from fablens.session import stored

MIN_LETTERS = 7
MIN_COUNT = 2
RATIO = 10
# One run in NOISE of a document loses a letter (the noise of the input is part of the operator's definition).
NOISE = 31
LONG = 64
PIECE = 1 << 20
FLUSH_WORDS = 1 << 17
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_BETWEEN = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SPLIT, SKIP = 0, 1


def runs(text: str) -> Iterator[list[str]]:
    """The runs of letters of a text, A-Z in lower case, in portions of about PIECE characters."""
    start = 0
    while start < len(text):
        cut = _BETWEEN.search(text, start + PIECE)
        end = cut.start() if cut else len(text)
        piece = text[start:end]
        yield _RUN.findall(piece.lower() if piece.isascii() else piece.translate(_LOWER))
        start = end


def spelled(run: str, crc: int) -> str:
    """A run as it counts: without one letter if its checksum, continued from that of `<doc_id>:`, says so."""
    h = zlib.crc32(run.encode(), crc)
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) -> (word, n) of the task."""
    total: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return batch

    for batch in batches:
        for name, text in zip(*batch.columns):
            crc = zlib.crc32(((name.as_py() or "") + ":").encode())
            for found in runs((text.as_py() or b"").decode("utf-8", "replace")):
                for run, n in Counter(found).items():
                    if len(run) >= MIN_LETTERS:
                        word = spelled(run, crc)
                        if len(word) >= MIN_LETTERS:
                            total[word] += n
                if len(total) >= FLUSH_WORDS:
                    yield flush()
    yield flush()


def word_counts(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of at least MIN_LETTERS letters found at least `min_count` times."""
    own = documents.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("binary").alias("text"))
    return own.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _beginnings(word: str) -> Iterator[bytes]:
    """A key for each prefix, the empty one first: the prefix itself, or the digest of a long one."""
    digest, own = hashlib.blake2b(digest_size=16), b""
    yield own
    for letter in word:
        code = letter.encode()
        digest.update(code)
        own = own + code if len(own) <= LONG else own
        yield own if len(own) <= LONG else b"\0" + digest.digest()


def _trie_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, word, n) -> (forward, key, id, n, at, fresh): the word's nodes in both tries.

    `at` is the length of the prefix, or the place where the suffix begins; `fresh` tells that the letter at `at` does not
    repeat the one before. The two roots are left out: they are the nodes 0.
    """
    for batch in batches:
        rows: list[tuple] = []
        for number, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            for at, key in enumerate(_beginnings(word)):
                rows.append((True, key, number, n, at, at < len(word) and (at == 0 or word[at] != word[at - 1])))
            for back, key in enumerate(_beginnings(word[::-1])):
                rows.append((False, key, number, n, len(word) - back, False))
            if len(rows) > FLUSH_WORDS:
                yield _paths(rows)
                rows = []
        yield _paths(rows)


def _paths(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 6
    kinds = [pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["forward", "key", "id", "n", "at", "fresh"])


def pair_dictionary(words: DataFrame) -> DataFrame:
    """(prefix, suffix, kind, id, n, fresh): the node pairs of words (id, word, n) that more than one word may stand under."""
    paths = stored(words.select("id", "word", "n").mapInArrow(
        _trie_paths, "forward boolean, key binary, id long, n long, at int, fresh boolean"
    ), "paths")
    root = F.octet_length("key") == 0
    inner = paths.filter(~root)
    nodes = inner.groupBy("forward", "key").agg(F.count(F.lit(1)).alias("words")).filter(F.col("words") > 1).drop("words")
    nodes = numbered(nodes, "nodes", "node").withColumn("node", F.col("node") + 1)
    placed = inner.join(nodes, ["forward", "key"]).unionByName(paths.filter(root).withColumn("node", F.lit(0).cast("long")))
    # The suffix nodes at a prefix's own end and one letter further.
    ends = Window.partitionBy("id").orderBy("at")
    suffix = lambda step: F.max(F.when(~F.col("forward"), F.col("node"))).over(ends.rangeBetween(step, step))
    met = placed.withColumns({"split": suffix(0), "skip": suffix(1)}).filter("forward")
    pairs = met.select(F.col("node").alias("prefix"), "id", "n", "fresh", F.explode(F.array(
        F.struct(F.lit(SPLIT).alias("kind"), F.col("split").alias("suffix")), F.struct(F.lit(SKIP).alias("kind"), F.col("skip").alias("suffix")),
    )).alias("s"))
    return pairs.select("prefix", "s.suffix", "s.kind", "id", "n", "fresh").filter(F.col("suffix").isNotNull())


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words are one edit away from each of `words` (id, word, n), and the most frequent.

    `best` is (n, -id): ids are in code-point order, so the largest pair is the first of the most frequent words. Words
    without a neighbour have no row.
    """
    member = F.struct("kind", "id", "n", "fresh")
    # At most one word per letter of the alphabet and one more: see 4. above.
    met = pair_dictionary(words).groupBy("prefix", "suffix").agg(F.collect_list(member).alias("members"))
    met = met.filter(F.size("members") > 1).select("members", F.explode("members").alias("own"))

    def near(other):
        mine = F.col("own")
        replaced = (mine["kind"] == SKIP) & (other["kind"] == SKIP) & (other["id"] != mine["id"])
        shorter = (mine["kind"] == SKIP) & mine["fresh"] & (other["kind"] == SPLIT)
        longer = (mine["kind"] == SPLIT) & (other["kind"] == SKIP) & other["fresh"]
        return replaced | shorter | longer

    found = met.select(F.col("own.id").alias("id"), F.filter("members", near).alias("near"))
    best = F.array_max(F.transform("near", lambda x: F.struct(x["n"].alias("n"), (-x["id"]).alias("minus"))))
    found = found.filter(F.size("near") > 0).select("id", F.size("near").cast("long").alias("k"), best.alias("best"))
    return found.groupBy("id").agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of `forms` (id, form): the last word that forms lead to. Each round doubles the steps."""
    now = stored(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        if not now.join(onward, "root", "left_semi").take(1):
            return now
        now = stored(now.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "roots")


def variant_groups(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_count: int = MIN_COUNT, ratio: int = RATIO,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    counted = word_counts(documents, id_column, text_column, min_count)
    words = stored(numbered(counted.orderBy("word"), "words", "id"), "words")
    near = stored(near_words(words), "near")
    led = words.join(near, "id", "left").withColumn("leads", F.col("best.n") >= ratio * F.col("n"))
    led = stored(led.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("leads"), -F.col("best.minus")).alias("form_id"), F.when(F.col("leads"), F.col("best.n")).alias("form_n"),
    ), "led")
    last = roots(led.filter(F.col("form_id").isNotNull()).select("id", F.col("form_id").alias("form")))
    named = led.filter(F.col("form_id").isNotNull()).join(last, "id")
    name = lambda column, alias: words.select(F.col("id").alias(column), F.col("word").alias(alias))
    named = named.join(name("form_id", "form"), "form_id").join(name("root", "root_word"), "root")
    plain = led.filter(F.col("form_id").isNull()).select(
        "word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n"
    )
    return plain.unionByName(named.select("word", "form", F.col("root_word").alias("root"), "n", "n_near", "form_n"))
