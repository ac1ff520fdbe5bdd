"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of all training texts, per task in numpy and then summed by Spark per (language, bucket). The
matrix of log probabilities has one row per bucket and one column per language. It is broadcast in blocks of at most
BLOCK_LANGUAGES columns (50 MB). Prediction adds up the rows of a text's n-grams, batch by batch. With one block that is all;
with more, each block gives every text its best language and the sum of its probabilities, and these are put together.

Texts are lower-cased; every run of other characters than letters is one space; n-grams of 1 to 3 characters, spaces
included, are hashed into BUCKETS buckets.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text if nothing can be learned.
Rows with a null text or language are not learned from. Repeated rows count and are predicted one by one. Languages may be
any number of values; of equally likely ones the first in order is predicted. Long texts go through in pieces of about
PIECE characters, cut at a character that is no letter. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from fablens.llm.common import broadcast_if_small, numbered
from fablens.session import stored

BITS = 15
BUCKETS = 1 << BITS
GRAMS = (1, 2, 3)
PIECE = 1 << 18
BLOCK_LANGUAGES = 200
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0][codes]


def _codes(text: str) -> np.ndarray:
    """Lower-case letters as code points, with one space (32) around and between words; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = np.concatenate(([32], np.where(_is_letter(codes), codes, 32), [32])).astype(np.uint32)
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
    return codes if len(codes) > 2 else codes[:0]


def _buckets(codes: np.ndarray) -> list[np.ndarray]:
    """For each n, the bucket of the n-gram that starts at each place (len(codes) - n + 1 of them)."""
    found, value = [], np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if n > len(codes):
            break
        value = value[:len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1:] * np.uint32(0x9E3779B1)
        mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA77)
        found.append(((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - BITS)).astype(np.int64))
    return found


def _pieces(text: str) -> Iterator[str]:
    """Pieces of about PIECE characters. A cut stands at a character that is no letter, so it falls into no n-gram anew."""
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[start:end]
        start = end


def _grouped(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, document number of each code): documents together up to PIECE characters, long ones in pieces."""
    codes, owners, held = [], [], 0
    for number, text in enumerate(texts):
        for piece in _pieces(text or ""):
            own = _codes(piece)
            if not len(own):
                continue
            codes.append(own)
            owners.append(np.full(len(own), number))
            held += len(own)
            if held >= PIECE:
                yield np.concatenate(codes), np.concatenate(owners)
                codes, owners, held = [], [], 0
    if held:
        yield np.concatenate(codes), np.concatenate(owners)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) of a task -> (lang, bucket, n); the last bucket number counts the documents."""
    totals: dict[str, np.ndarray] = {}

    def flush():
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])],
                names=["lang", "bucket", "n"],
            )
        totals.clear()

    for batch in batches:
        langs = batch.column(0).to_pylist()
        names = sorted(set(langs))
        number = {name: i for i, name in enumerate(names)}
        of_document = np.array([number[name] for name in langs], dtype=np.int64)
        for name in names:
            totals.setdefault(name, np.zeros(BUCKETS + 1, dtype=np.int64))[BUCKETS] += langs.count(name)
        for codes, owners in _grouped(batch.column(1).to_pylist()):
            languages = of_document[owners]
            for n, bucket in enumerate(_buckets(codes), 1):
                inside = owners[:len(bucket)] == owners[n - 1:]
                for i in np.unique(languages):
                    chosen = inside & (languages[:len(bucket)] == i)
                    totals[names[i]] += np.bincount(bucket[chosen], minlength=BUCKETS + 1)
        if len(totals) > 64:
            yield from flush()
    yield from flush()


@dataclass
class LanguageBlock:
    """Some languages, in order, with their shares and weights (languages x buckets)."""

    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray


@dataclass
class LanguageModel:
    """Counts by language and bucket (number, bucket, n), and the languages (lang, number, documents) in order."""

    counts: DataFrame
    names: DataFrame
    size: int
    documents: int
    smoothing: float
    block_languages: int

    def blocks(self) -> Iterator[LanguageBlock]:
        """The blocks one after the other; only one is on the driver at a time."""
        for first in range(0, self.size, self.block_languages):
            inside = F.col("number").between(first, first + self.block_languages - 1)
            names = self.names.filter(inside).orderBy("number").select("lang", "documents").toArrow()
            grams = np.full((names.num_rows, BUCKETS), self.smoothing)
            counts = self.counts.filter(inside).toArrow()
            place = counts.column("number").to_numpy() - first, counts.column("bucket").to_numpy()
            grams[place] += counts.column("n").to_numpy()
            yield LanguageBlock(
                names.column("lang").to_pylist(), np.log(names.column("documents").to_numpy() / self.documents),
                np.log(grams / grams.sum(axis=1, keepdims=True)),
            )


def train(
    documents: DataFrame, text_column: str = "text", lang_column: str = "lang", smoothing: float = 0.5,
    block_languages: int = BLOCK_LANGUAGES,
) -> LanguageModel:
    """Learn from all rows that have a text and a language."""
    rows = documents.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text")).dropna()
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = stored(counts, "language-counts")
    names = counts.filter(F.col("bucket") == BUCKETS).select("lang", F.col("n").alias("documents"))
    names = stored(numbered(names.orderBy("lang"), "languages", "number"), "languages")
    total = names.agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents")).first()
    grams = counts.filter(F.col("bucket") < BUCKETS).join(broadcast_if_small(names.select("lang", "number")), "lang")
    grams = stored(grams.select("number", "bucket", "n"), "language-grams")
    return LanguageModel(grams, names, total["size"], total["documents"], smoothing, block_languages)


def _score(shared):
    """Rows with a text in the last column -> lang, top (its score) and rest (sum of exp(score - top)); null without a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: LanguageBlock = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            scores = np.zeros((len(texts), len(block.languages)))
            known = np.zeros(len(texts), dtype=bool)
            for codes, owners in _grouped(texts):
                known[owners] = True
                low, size = owners[0], owners[-1] - owners[0] + 1
                for n, bucket in enumerate(_buckets(codes), 1):
                    inside = owners[:len(bucket)] == owners[n - 1:]
                    owner, bucket = owners[:len(bucket)][inside] - low, bucket[inside]
                    for i, weights in enumerate(block.weights):
                        scores[low:low + size, i] += np.bincount(owner, weights=weights[bucket], minlength=size)
            scores += block.prior
            best = scores.argmax(axis=1)
            top = scores.max(axis=1)
            rest = np.exp(scores - top[:, None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:-1], pa.array([block.languages[i] if k else None for i, k in zip(best, known)], pa.string()),
                pa.array(top), pa.array(rest),
            ], names=[*batch.schema.names[:-1], "lang", "top", "rest"])

    return run


def predict(documents: DataFrame, model: LanguageModel, keep: dict[str, F.Column], text_column: str = "text") -> DataFrame:
    """Columns `keep` of each row, with lang_pred and score (the posterior probability of lang_pred)."""
    # What is kept travels as one struct, so that it may have any names.
    kept = F.struct(*[value.alias(name) for name, value in keep.items()]).alias("kept")
    rows = documents.select(kept, F.col(text_column).alias("text"))
    if not model.size:
        return rows.select("kept.*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    context = documents.sparkSession.sparkContext
    scores = [StructField("lang", StringType()), StructField("top", DoubleType()), StructField("rest", DoubleType())]
    if model.size <= model.block_languages:
        scored = rows.mapInArrow(_score(context.broadcast(next(model.blocks()))), StructType([rows.schema["kept"], *scores]))
        return scored.select("kept.*", *_posterior(F.col("lang"), F.col("rest")))
    # Texts are stored with a number once; each block makes a narrow table of its own.
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
    parts = None
    for block in model.blocks():
        shared = context.broadcast(block)
        part = rows.select("row", "text").mapInArrow(_score(shared), StructType([rows.schema["row"], *scores]))
        part = stored(part, "block")
        shared.destroy()
        parts = part if parts is None else parts.unionByName(part)
    # One entry per block and text.
    met = parts.groupBy("row").agg(F.max("top").alias("most"), F.collect_list(F.struct("top", "rest", "lang")).alias("blocks"))
    total = F.aggregate("blocks", F.lit(0.0), lambda s, b: s + b["rest"] * F.exp(b["top"] - F.col("most")))
    lang = F.array_min(F.transform(F.filter("blocks", lambda b: b["top"] == F.col("most")), lambda b: b["lang"]))
    met = met.select("row", lang.alias("lang"), total.alias("rest"))
    return rows.drop("text").join(met, "row").select("kept.*", *_posterior(F.col("lang"), F.col("rest")))


def _posterior(lang, rest) -> list:
    return [
        F.coalesce(lang, F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(lang.isNotNull(), F.round(1 / rest, 6)).otherwise(0.0).alias("score"),
    ]


def held_out(id_column: str = "doc_id") -> F.Column:
    """True for a fifth of all ids; a null id is held out."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 == 0
