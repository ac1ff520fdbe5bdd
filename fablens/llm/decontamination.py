"""Benchmark decontamination over a distributed positional inverted index.

The index is split by documents into shards of about SHARD_WORDS words, stored as a table with one row per shard: sorted
term hashes, the length of each term's posting list, and all positions, term by term, as compressed gaps. Positions of
different documents lie GAP apart, so no phrase or neighbourhood reaches from one into the next.

A query block of benchmark items is broadcast (its size is bounded by BLOCK_WORDS). Corpus-wide posting counts order each
window's terms; every shard takes the posting list of the rarest term, shifted by its offset in the window, and intersects
it with the shifted lists of the next rarer terms. What survives all of them are exact phrase matches. Proximity matches
start from the postings of an item's rarest term in the corpus and keep those with its other rare terms nearby. Benchmarks that
are larger than one block take several passes over the index, never over the texts.

Only terms of the benchmark are indexed if their number is checked to be small; otherwise all terms are. 64-bit hashes
stand for terms: that two words of a window and ten consecutive words of a text collide has a chance below 2^-600, one
word alone (an item of one word) 2^-64.

Defined results: null texts have no words; a null item id counts as an empty string; repeated item ids are one item with
all their texts. A document is a row; rows that repeat id and text get equal results. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablens.llm.common import PLAIN_WORDS, text_print, without, word_hashes
from fablens.session import stored

SHARD_WORDS = 1 << 19
BLOCK_WORDS = 1 << 20
MAX_VOCABULARY = 1 << 21
GAP = 64
CANDIDATES = 1 << 20
MIN_NEAR_TERMS = 3
_INDEX = (
    "shard long, ids array<long>, prints array<long>, starts array<long>, lengths array<long>, "
    "terms binary, counts binary, gaps binary, gap_bytes long"
)


def words_of(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8", "replace").translate(PLAIN_WORDS))


def _gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def _build(vocabulary):
    """Rows (doc_id, print, text) of a task -> index shards."""
    kind = pa.schema([
        ("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("prints", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.binary()),
        ("counts", pa.binary()), ("gaps", pa.binary()), ("gap_bytes", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        wanted = vocabulary.value if vocabulary is not None else None
        ids, prints, starts, lengths, terms, places, at = [], [], [], [], [], [], 0

        def flush():
            nonlocal number, ids, prints, starts, lengths, terms, places, at
            every, where = np.concatenate(terms), np.concatenate(places)
            order = np.argsort(every, kind="stable")
            distinct, first, counts = np.unique(every[order], return_index=True, return_counts=True)
            where = where[order]
            gaps = np.diff(where, prepend=0)
            gaps[first] = where[first]
            packed = gaps.astype(np.uint32).tobytes()
            row = {
                "shard": number, "ids": ids, "prints": prints, "starts": starts, "lengths": lengths,
                "terms": distinct.tobytes(), "counts": counts.astype(np.uint32).tobytes(),
                "gaps": pa.compress(packed, codec="zstd", asbytes=True), "gap_bytes": len(packed),
            }
            number += 1
            ids, prints, starts, lengths, terms, places, at = [], [], [], [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=kind)

        for batch in batches:
            for doc_id, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = words_of(text.as_py())
                if ids and at + len(words) > SHARD_WORDS:
                    yield flush()
                ids.append(doc_id)
                prints.append(mark)
                starts.append(at)
                lengths.append(len(words))
                if wanted is not None and len(words):
                    place = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, words), len(wanted) - 1)] == words)
                else:
                    place = np.arange(len(words))
                terms.append(words[place])
                places.append(place + at)
                at += len(words) + GAP
        if ids:
            yield flush()

    return run


def build_index(documents: DataFrame, vocabulary: np.ndarray | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The stored index of `documents`; `vocabulary` is a sorted array of term hashes, None for all terms."""
    shared = None
    if vocabulary is not None:
        filled = vocabulary if len(vocabulary) else np.zeros(1, dtype=np.uint64)
        shared = documents.sparkSession.sparkContext.broadcast(filled)
    rows = documents.select(
        F.col(id_column).cast("long"), text_print(text_column).alias("print"), F.col(text_column)
    )
    return stored(rows.mapInArrow(_build(shared), _INDEX), "postings")


class Block:
    """Benchmark items as arrays: the windows' terms (numbers in `vocabulary`, -1 beyond a short window) and items."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int, near_terms: int):
        self.near_terms = near_terms
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.vocabulary = np.unique(np.concatenate([words for _, words in items] or [np.empty(0, np.uint64)]))
        rows, owners, self.words_of_item = [], [], [np.empty(0, np.int64)] * len(self.names)
        for name, words in items:
            if not len(words):
                continue
            own = np.searchsorted(self.vocabulary, words)
            i = number[name]
            self.words_of_item[i] = np.union1d(self.words_of_item[i], own).astype(np.int64)
            size = min(window, len(own))
            padded = np.full((len(own) - size + 1, window), -1, dtype=np.int64)
            padded[:, :size] = np.lib.stride_tricks.sliding_window_view(own, size)
            rows.append(padded)
            owners.append(np.full(len(padded), i))
        windows = np.concatenate(rows) if rows else np.empty((0, window), np.int64)
        both = np.unique(np.column_stack([windows, np.concatenate(owners) if owners else np.empty(0, np.int64)]), axis=0)
        self.windows, self.owners = both[:, :-1], both[:, -1]

    def order(self, counts: np.ndarray) -> None:
        """Sort each window's offsets from its rarest term on, and pick each item's rarest terms."""
        known = self.windows >= 0
        rarity = np.where(known, counts[np.maximum(self.windows, 0)] if len(counts) else 0, np.iinfo(np.int64).max)
        self.offsets = np.argsort(rarity, axis=1, kind="stable")
        known = [w[counts[w] > 0] for w in self.words_of_item]
        rarest = [w[np.argsort(counts[w], kind="stable")][: self.near_terms] for w in known]
        self.near = [w if len(w) >= MIN_NEAR_TERMS else w[:0] for w in rarest]


def _counts(block):
    """Shards -> (number of the term in the block's vocabulary, postings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = block.value.vocabulary
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1)):
                own = np.frombuffer(terms.as_py(), dtype=np.uint64)
                _, mine, theirs = np.intersect1d(own, vocabulary, assume_unique=True, return_indices=True)
                total[theirs] += np.frombuffer(counts.as_py(), dtype=np.uint32)[mine]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["term", "n"])

    return run


class _Shard:
    """Posting lists of one shard for a block's vocabulary."""

    def __init__(self, block: Block, row: dict):
        own = np.frombuffer(row["terms"], dtype=np.uint64)
        sizes = np.frombuffer(row["counts"], dtype=np.uint32).astype(np.int64)
        gaps = np.frombuffer(pa.decompress(row["gaps"], row["gap_bytes"], codec="zstd"), dtype=np.uint32).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        upto = np.cumsum(gaps)
        base = np.repeat(upto[first] - gaps[first], sizes) if len(sizes) else upto
        every = upto - base
        _, mine, theirs = np.intersect1d(own, block.vocabulary, assume_unique=True, return_indices=True)
        self.count = np.zeros(len(block.vocabulary), dtype=np.int64)
        self.count[theirs] = sizes[mine]
        self.first = np.cumsum(self.count) - self.count
        self.postings = every[_gather(first[mine], sizes[mine])]
        self.span = int(row["starts"][-1] + row["lengths"][-1] + 2 * GAP)
        # One sorted list for all terms: the number of the term, then the position.
        self.keys = np.repeat(theirs, sizes[mine]) * self.span + self.postings
        self.starts = np.array(row["starts"])

    def has(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(at), dtype=bool)
        wanted = terms * self.span + at
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (self.keys[place] == wanted) & (at >= 0)

    def phrases(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, item) of every occurrence of a window."""
        if not len(block.windows):
            return (np.empty(0, np.int64),) * 3
        rows = np.arange(len(block.windows))
        rarest = block.windows[rows, block.offsets[:, 0]]
        amounts = self.count[rarest]
        live = rows[amounts > 0]
        starts, lengths, items = [], [], []
        # In portions of about CANDIDATES postings; a single list may be longer, but not longer than the shard.
        portions = np.cumsum(amounts[live]) // CANDIDATES
        for portion in np.unique(portions):
            chosen = live[portions == portion]
            row = np.repeat(chosen, amounts[chosen])
            at = self.postings[_gather(self.first[rarest[chosen]], amounts[chosen])] - block.offsets[row, 0]
            for k in range(1, block.windows.shape[1]):
                offset = block.offsets[row, k]
                term = block.windows[row, offset]
                stays = (term < 0) | self.has(np.maximum(term, 0), at + offset)
                row, at = row[stays], at[stays]
                if not len(row):
                    break
            starts.append(at)
            lengths.append((block.windows[row] >= 0).sum(axis=1))
            items.append(block.owners[row])
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, lengths, items))

    def near(self, block: Block, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, item) of the rarest terms that have all other rare terms of their item within `span` words."""
        places, items = [], []
        for item, terms in enumerate(block.near):
            if not len(terms) or (self.count[terms] == 0).any():
                continue
            at = self._list(terms[0])
            for term in terms[1:]:
                others = self._list(term)
                right = np.searchsorted(others, at)
                after = others[np.minimum(right, len(others) - 1)]
                before = others[np.maximum(right - 1, 0)]
                at = at[np.minimum(np.abs(after - at), np.abs(at - before)) <= span]
            places.append(at)
            items.append(np.full(len(at), item))
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (places, items))

    def _list(self, term: int) -> np.ndarray:
        return self.postings[self.first[term]:self.first[term] + self.count[term]]


def _search(block, near_span: int):
    """Shards -> one row per matching document: items, hit spans (in words of the document), items found near."""
    kind = pa.schema([
        ("shard", pa.int64()), ("place", pa.int64()), ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("near_items", pa.list_(pa.string())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        for batch in batches:
            for number in range(batch.num_rows):  # a row is a whole shard
                row = batch.slice(number, 1).to_pylist()[0]
                shard = _Shard(items, row)
                start, length, item = shard.phrases(items)
                document = np.searchsorted(shard.starts, start, side="right") - 1
                near_at, near_item = shard.near(items, near_span)
                near_document = np.searchsorted(shard.starts, near_at, side="right") - 1
                found = []
                for place in np.union1d(document, near_document):
                    own = document == place
                    order = np.argsort(start[own], kind="stable")
                    low = start[own][order] - shard.starts[place]
                    high = low + length[own][order]
                    reach = np.maximum.accumulate(high) if len(high) else high
                    new = np.r_[True, low[1:] > reach[:-1]] if len(low) else np.empty(0, bool)
                    firsts = np.flatnonzero(new)
                    found.append({
                        "shard": row["shard"], "place": int(place),
                        "items": [items.names[i] for i in np.unique(item[own])],
                        "spans": [
                            {"start": int(low[a]), "stop": int(reach[b - 1])}
                            for a, b in zip(firsts, np.r_[firsts[1:], len(low)])
                        ],
                        "near_items": [items.names[i] for i in np.unique(near_item[near_document == place])],
                    })
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=kind)

    return run


def _blocks(benchmark: DataFrame, item_column: str, text_column: str) -> Iterator[list[tuple[str, np.ndarray]]]:
    """The benchmark's items in blocks of at most BLOCK_WORDS words (or one item)."""
    items, words = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")), F.col(text_column))
    for name, text in rows.toLocalIterator():
        own = words_of(text)
        if items and words + len(own) > BLOCK_WORDS:
            yield items
            items, words = [], 0
        items.append((name, own))
        words += len(own)
    if items:
        yield items


def _vocabulary(benchmark: DataFrame, item_column: str, text_column: str) -> np.ndarray | None:
    """Sorted term hashes of the benchmark, None if there are more than MAX_VOCABULARY."""
    known = np.empty(0, dtype=np.uint64)
    for block in _blocks(benchmark, item_column, text_column):
        known = np.union1d(known, np.concatenate([words for _, words in block]))
        if len(known) > MAX_VOCABULARY:
            return None
    return known


def find_matches(
    documents: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = 10,
    near_terms: int = 5,
    near_span: int = 20,
) -> DataFrame:
    """One row per document: doc_id, print (of its text), n_words, items, spans and near_items.

    items: ids with a window of `window` consecutive words in the document (a shorter item is one window); spans: the words
    covered by them, merged, as [start, stop); near_items: ids whose `near_terms` rarest words all occur within `near_span`
    (at most GAP) words of an occurrence of the rarest. Words that the corpus does not have are left out; an item with
    fewer than MIN_NEAR_TERMS others is never near.
    """
    if near_span >= GAP or window >= GAP:
        raise ValueError(f"window and near_span must be below {GAP}")
    context = documents.sparkSession.sparkContext
    index = build_index(documents, _vocabulary(benchmark, item_column, item_text_column), id_column, text_column)
    found, blocks = None, 0
    for items in _blocks(benchmark, item_column, item_text_column):
        blocks += 1
        block = Block(items, window, near_terms)
        terms = index.select("terms", "counts").mapInArrow(_counts(context.broadcast(block)), "term long, n long")
        counts = np.zeros(len(block.vocabulary), dtype=np.int64)
        for row in terms.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[row["term"]] = row["n"]
        block.order(counts)
        part = index.drop("ids", "prints").mapInArrow(
            _search(context.broadcast(block), near_span),
            "shard long, place long, items array<string>, spans array<struct<start:long,stop:long>>, near_items array<string>",
        )
        part = stored(part, "matches")
        found = part if found is None else found.unionByName(part)
    rows = index.select("shard", F.posexplode(F.arrays_zip("ids", "prints", "lengths")).alias("place", "row")).select(
        "shard", F.col("place").cast("long").alias("place"), F.col("row.ids").alias("doc_id"),
        F.col("row.prints").alias("print"), F.col("row.lengths").alias("n_words"),
    )
    empty = F.array().cast("array<string>")
    if found is None:
        return rows.drop("shard", "place").withColumns({
            "items": empty, "spans": F.array().cast("array<struct<start:long,stop:long>>"), "near_items": empty,
        })
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    per_document = found.groupBy("shard", "place").agg(
        united("items").alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("parts"),
        united("near_items").alias("near_items"),
    )
    joined = rows.join(per_document, ["shard", "place"], "left")
    # Spans of several blocks may overlap: each part counts from where the earlier ones have reached.
    reached = lambda s, i: F.greatest(s["start"], F.coalesce(F.array_max(F.transform(F.slice("parts", 1, i), lambda e: e["stop"])), F.lit(0)))
    clipped = F.col("parts")
    if blocks > 1:
        moved = F.transform("parts", lambda s, i: F.struct(reached(s, i).alias("start"), s["stop"].alias("stop")))
        clipped = F.filter(moved, lambda s: s["start"] < s["stop"])
    return joined.select(
        "doc_id", "print", "n_words", F.coalesce("items", empty).alias("items"),
        F.coalesce(clipped, F.array().cast("array<struct<start:long,stop:long>>")).alias("spans"),
        F.coalesce("near_items", empty).alias("near_items"),
    )


def n_hit(spans) -> F.Column:
    """Words covered by `spans`."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`documents` without those that hold a window of a benchmark item."""
    matches = find_matches(documents, benchmark, id_column, text_column)
    return without(documents, matches.filter(F.size("spans") > 0), id_column, text_print(text_column))
