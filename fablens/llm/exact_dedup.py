"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Each task reads its documents and packs their 64-bit fingerprints into blocks. A block sends every owner (a range of
   the fingerprint space) its sorted, distinct fingerprints as Golomb-Rice coded gaps.
2. An owner decodes what it got, finds fingerprints that came from more than one block and answers each block with a
   bitmap. A fingerprint that is frequent in one block was sent once, so no key can flood an owner.
3. A block marks the rows whose bit is set, or whose fingerprint it holds twice itself: the suspects.
4. Only suspects' texts are shuffled. They are grouped by their bytes, with partial aggregation, so of the copies in one
   task one text travels.

Defined results: a null text counts as empty; texts are equal when identical after lower-casing A-Z. A null doc_id is
smaller than any other. Rows that repeat both doc_id and text are all returned, with the same values. Other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablens.llm.common import ascii_lower, broadcast_if_small, one_of_each, without
from fablens.session import stored

ROWS_PER_BLOCK = 1 << 16
FINGERPRINTS_PER_OWNER = 1 << 19
_BLOCKS = (
    "block long, ids array<long>, shas binary, prints binary, "
    "sent array<struct<owner:int, n:int, rice:int, gaps:binary>>"
)


def golomb_encode(gaps: np.ndarray, rice: int) -> bytes:
    """Golomb-Rice code: quotients in unary (zeros closed by a one), then all remainders of `rice` bits each."""
    quotients = (gaps >> np.uint64(rice)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(gaps), dtype=np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    shifts = np.arange(rice, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def golomb_decode(data: bytes, n: int, rice: int) -> np.ndarray:
    rest_bytes = (n * rice + 7) // 8
    raw = np.frombuffer(data, dtype=np.uint8)
    unary = np.unpackbits(raw[:len(raw) - rest_bytes])
    ends = np.flatnonzero(unary)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    rest = np.unpackbits(raw[len(raw) - rest_bytes:])[:n * rice].reshape(n, rice).astype(np.uint64)
    return (quotients.astype(np.uint64) << np.uint64(rice)) + (rest << np.arange(rice, dtype=np.uint64)).sum(
        axis=1, dtype=np.uint64
    )


def _rice_bits(n: int, owner_bits: int) -> int:
    """Bits that suit `n` uniform values in an owner's range."""
    return max(0, 64 - owner_bits - int(max(1, n)).bit_length())


def _pack(owner_bits: int):
    """Rows (doc_id, fp, sha) of one task -> blocks of at most ROWS_PER_BLOCK rows."""

    def block(number: int, ids: list, prints: np.ndarray, shas: list) -> dict:
        distinct = np.unique(prints)
        owners = (distinct >> np.uint64(64 - owner_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owners, prepend=-1))
        sent = []
        for start, end in zip(cuts, np.r_[cuts[1:], len(distinct)]):
            rice = _rice_bits(end - start, owner_bits)
            low = np.uint64(int(owners[start]) << (64 - owner_bits))
            gaps = np.diff(distinct[start:end] - low, prepend=np.uint64(0))
            sent.append({
                "owner": int(owners[start]), "n": int(end - start), "rice": rice, "gaps": golomb_encode(gaps, rice),
            })
        return {"block": number, "ids": ids, "shas": b"".join(shas), "prints": prints.tobytes(), "sent": sent}

    kind = pa.schema([
        ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("shas", pa.binary()), ("prints", pa.binary()),
        ("sent", pa.list_(pa.struct([
            ("owner", pa.int32()), ("n", pa.int32()), ("rice", pa.int32()), ("gaps", pa.binary()),
        ]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, prints, shas = [], [], []

        def flush():
            nonlocal number, ids, prints, shas
            row = block(number, ids, np.concatenate(prints), shas)
            number, ids, prints, shas = number + 1, [], [], []
            return pa.RecordBatch.from_pylist([row], schema=kind)

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BLOCK):
                part = batch.slice(start, ROWS_PER_BLOCK)
                ids += part.column(0).to_pylist()
                prints.append(part.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                shas += part.column(2).to_pylist()
                if len(ids) >= ROWS_PER_BLOCK:
                    yield flush()
        if ids:
            yield flush()

    return run


def _own(owner_bits: int):
    """All blocks' fingerprints of one owner -> a bitmap of the repeated ones for each block."""

    def run(sent: pd.DataFrame) -> pd.DataFrame:
        owner = int(sent["owner"].iloc[0])
        values = [golomb_decode(g, n, r) for g, n, r in zip(sent["gaps"], sent["n"], sent["rice"])]
        every = np.concatenate([np.cumsum(v, dtype=np.uint64) for v in values])
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        same = ordered[1:] == ordered[:-1]
        repeated = np.zeros(len(every), dtype=bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        parts = np.split(repeated, np.cumsum([len(v) for v in values])[:-1])
        return pd.DataFrame({
            "block": sent["block"].to_numpy(), "owner": owner, "bits": [np.packbits(p).tobytes() for p in parts],
        })

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their bitmaps -> rows with the suspect mark."""
    for batch in batches:
        for number in range(batch.num_rows):  # a row is a whole block
            row = batch.slice(number, 1).to_pylist()[0]
            prints = np.frombuffer(row["prints"], dtype=np.uint64)
            distinct, place, count = np.unique(prints, return_inverse=True, return_counts=True)
            answers = sorted(row["answers"] or [], key=lambda a: a["owner"])
            counts = {s["owner"]: s["n"] for s in row["sent"]}
            bits = [np.unpackbits(np.frombuffer(a["bits"], dtype=np.uint8))[:counts[a["owner"]]] for a in answers]
            suspect = (np.concatenate(bits).astype(bool) | (count > 1))[place]
            shas = np.frombuffer(row["shas"], dtype="V32")
            yield pa.RecordBatch.from_arrays([
                pa.array(row["ids"], pa.int64()), pa.array(prints.view(np.int64)),
                pa.array([s.tobytes() for s in shas], pa.binary()), pa.array(suspect),
            ], names=["doc_id", "fp", "sha", "suspect"])


def _norm(text_column: str):
    return ascii_lower(F.coalesce(F.col(text_column), F.lit("")))


def _texts(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return documents.select(F.col(id_column).cast("long").alias("doc_id"), _norm(text_column).alias("norm")).withColumn(
        "fp", F.xxhash64("norm")
    )


def suspects(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, sha (32 bytes) and whether its fingerprint occurs more than once."""
    rows = documents.count()
    owner_bits = max(6, (rows // FINGERPRINTS_PER_OWNER).bit_length())
    texts = _texts(documents, id_column, text_column).select("doc_id", "fp", F.unhex(F.sha2("norm", 256)).alias("sha"))
    blocks = stored(texts.mapInArrow(_pack(owner_bits), _BLOCKS), "print-blocks")
    sent = blocks.select("block", F.inline("sent"))
    answers = sent.groupBy("owner").applyInPandas(_own(owner_bits), "block long, owner int, bits binary")
    per_block = answers.groupBy("block").agg(F.collect_list(F.struct("owner", "bits")).alias("answers"))
    asked = blocks.select("block", "ids", "shas", "prints", F.transform("sent", lambda s: F.struct(s["owner"], s["n"])).alias("sent"))
    marked = asked.join(per_block, "block", "left").mapInArrow(
        _mark, "doc_id long, fp long, sha binary, suspect boolean"
    )
    return stored(marked, "prints")


def exact_groups(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    marked = suspects(documents, id_column, text_column)
    prints = stored(marked.filter("suspect").select("fp").distinct(), "suspects")
    copies = _texts(documents, id_column, text_column).join(broadcast_if_small(prints), "fp", "left_semi")
    groups = copies.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep")).filter("n > 1")
    groups = stored(groups.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "n", "keep"), "copy-groups")
    joined = marked.join(groups, "sha", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`documents` with one row of each group of equal texts: the one with the largest doc_id.

    Rows that repeat both doc_id and text are cut to one of them.
    """
    groups = stored(exact_groups(documents, id_column, text_column).filter("group_size > 1"), "groups")
    mark = F.xxhash64(_norm(text_column))
    rows = documents.select(
        F.col(id_column).cast("long").alias("doc_id"), mark.alias("print"), F.sha2(_norm(text_column), 256).alias("sha")
    )
    hint = broadcast_if_small(groups.select(F.col("doc_id").alias("id"), "text_sha256", "kept").distinct())
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("text_sha256"))
    named = stored(rows.join(hint, same).select("doc_id", "print", "kept"), "copies")
    left = without(documents, named.filter("not kept"), id_column, mark)
    return one_of_each(left, named.filter("kept"), id_column, mark)
