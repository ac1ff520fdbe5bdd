"""Toxicity by a classifier chain.

Categories are label columns, in the order of the chain. Each has a linear (logistic) model; the models of later categories
also get the probabilities of the earlier ones. In training those are out-of-fold predictions, so that a later model sees
them as uncertain as they will be on new texts; in prediction they come from the model fitted to all folds.

Features of a text, all of it: its distinct words (lower case, ASCII letters and digits and anything beyond ASCII), the
distinct beginnings of 4, 5 and 6 bytes of longer words, which catch inflected forms, and three shape figures. Words count
by their 64-bit hashes; a model keeps at most FEATURES hashes, those with the strongest association with any category, and none that may be chance.

Fitting uses a bounded sample of labelled texts, about `sample_rows`, drawn by a hash of the id; if ids have many texts or
these are long, by one of the text too (see `train`). It is collected as word hashes. Prediction covers all rows. The cut for each category maximises F1 on the out-of-fold predictions.

Defined results: a null text is empty. Null labels leave a row out of that category's training; a category without both
labels among the sample gets the constant share of its positives (0 if there are none) and never rejects. Labels join
by id; null ids have no labels, repeated label rows are averaged and rounded, repeats of a document are one sample. Ids
must be whole numbers. Very long texts are read whole, a portion at a time. Other columns are not looked at, whatever their
names; `drop_toxic` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablens.llm.common import PLAIN_WORDS, broadcast_if_small, portions, text_print, without, word_hashes
from fablens.session import stored

SAMPLE_ROWS = 8192
SAMPLE_BYTES = 256 << 20
FEATURES = 8192
# Chi-squared with one degree of freedom at a chance of 1e-7: one in a hundred for the best of 100,000 unrelated features.
MIN_ASSOCIATION = 28.0
PREFIXES = (4, 5, 6)
FOLDS = 3
SHAPES = 3
# Text that one step of a task works on.
PORTION_BYTES = 1 << 21


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of words and beginnings; figures: log number of words, share of distinct ones, share of repeats."""
    data = (text or "").encode("utf-8", "replace").translate(PLAIN_WORDS)
    words = word_hashes(data)
    if not len(words):
        return words, np.zeros(SHAPES)
    distinct = np.unique(word_hashes(data, PREFIXES))
    shape = np.array([np.log1p(len(words)) / 10, len(np.unique(words)) / len(words), np.mean(words[1:] == words[:-1]) if len(words) > 1 else 0.0])
    return distinct, shape


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class _Rows:
    """Sparse 0/1 rows with a few dense columns behind them."""

    def __init__(self, rows: list[np.ndarray], dense: np.ndarray, width: int):
        self.lengths = np.array([len(r) for r in rows], dtype=np.int64)
        self.columns = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.owner = np.repeat(np.arange(len(rows)), self.lengths)
        self.dense, self.width = dense, width

    def take(self, chosen: np.ndarray) -> "_Rows":
        part = object.__new__(_Rows)
        keep = chosen[self.owner]
        part.lengths, part.columns = self.lengths[chosen], self.columns[keep]
        part.owner = np.repeat(np.arange(chosen.sum()), part.lengths)
        part.dense, part.width = self.dense[chosen], self.width
        return part

    def times(self, weights: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.owner, weights=weights[self.columns], minlength=len(self.dense))
        return sparse + self.dense @ weights[self.width:-1] + weights[-1]

    def gradient(self, error: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.columns, weights=error[self.owner], minlength=self.width)
        return np.concatenate([sparse, self.dense.T @ error, [error.sum()]])


def _fit_linear(rows: _Rows, labels: np.ndarray, decay: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Logistic regression by Adam on all rows at once; classes weigh the same; the last weight is the constant."""
    weights = np.zeros(rows.width + rows.dense.shape[1] + 1)
    share = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
    balance = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)) / max(1, len(labels))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        slope = rows.gradient((_sigmoid(rows.times(weights)) - labels) * balance)
        slope[:-1] += decay * weights[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        weights -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


@dataclass
class Chain:
    categories: list[str]
    hashes: np.ndarray  # sorted; their places are the columns of the linear models
    weights: list[np.ndarray | float]
    cuts: list[float]


def _choose(found: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Sorted hashes with the largest chi-squared of presence against any category."""
    every = np.concatenate(found) if found else np.empty(0, np.uint64)
    every.sort()  # in place: this is the largest array here
    starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][:len(every)])
    count = np.diff(starts, append=len(every))
    distinct, count = every[starts[count >= 3]], count[count >= 3]
    del every, starts
    known = ~np.isnan(labels)
    present = np.zeros((labels.shape[1], len(distinct)))
    both = np.zeros_like(present)
    for first in range(0, len(found), 256):  # in portions, as all rows together are large
        part = slice(first, first + 256)
        columns = [_columns(distinct, f) for f in found[part]]
        place, sizes = np.concatenate(columns), [len(c) for c in columns]
        for k in range(labels.shape[1]):
            present[k] += np.bincount(place, np.repeat(known[part, k].astype(float), sizes), len(distinct))
            both[k] += np.bincount(place, np.repeat(np.nan_to_num(labels[part, k]), sizes), len(distinct))
    best = np.zeros(len(distinct))
    for k, label in enumerate(labels.T):
        total, positive = known[:, k].sum(), np.nansum(label)
        if positive in (0, total):
            continue
        expected = present[k] * positive / total
        spread = np.maximum(expected * (1 - positive / total) * (1 - present[k] / total), 1e-9)
        best = np.maximum(best, (both[k] - expected) ** 2 / spread)
    best[best < MIN_ASSOCIATION] = 0
    order = np.lexsort((distinct, -best))[:FEATURES]
    return np.sort(distinct[order[best[order] > 0]])


def _columns(hashes: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(hashes) or not len(found):
        return np.empty(0, np.int64)
    place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
    return place[hashes[place] == found]


def _best_cut(labels: np.ndarray, guesses: np.ndarray) -> float:
    """The middle between the two neighbouring probabilities where F1 is largest."""
    order = np.argsort(-guesses, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    ends = np.r_[guesses[order][1:] < guesses[order][:-1], True]
    at = int(np.argmax(np.where(ends, f1, -1)))
    low = guesses[order][at + 1] if at + 1 < len(order) else 0.0
    return float((guesses[order][at] + low) / 2)


def fit_chain(found: list[np.ndarray], shapes: np.ndarray, labels: np.ndarray, folds: np.ndarray, categories: Sequence[str]) -> Chain:
    """`labels`: rows x categories, nan where unknown; `folds`: fold number of each row."""
    hashes = _choose(found, labels)
    columns = [_columns(hashes, f) for f in found]
    earlier = np.empty((len(found), 0))
    weights, cuts = [], []
    for label in labels.T:
        known = ~np.isnan(label)
        rows = _Rows(columns, np.hstack([shapes, earlier]), len(hashes))
        if len(np.unique(label[known])) < 2:
            constant = float(label[known].mean()) if known.any() else 0.0
            weights.append(constant)
            cuts.append(2.0)
            earlier = np.hstack([earlier, np.full((len(found), 1), constant)])
            continue
        guesses = np.empty(len(found))
        for fold in range(FOLDS):
            inside = known & (folds != fold)
            part = _fit_linear(rows.take(inside), label[inside]) if len(np.unique(label[inside])) == 2 else None
            guesses[folds == fold] = label[known].mean() if part is None else _sigmoid(rows.take(folds == fold).times(part))
        weights.append(_fit_linear(rows.take(known), label[known]))
        cuts.append(_best_cut(label[known], guesses[known]))
        earlier = np.hstack([earlier, guesses[:, None]])
    return Chain(list(categories), hashes, weights, cuts)


def chain_scores(chain: Chain, found: list[np.ndarray], shapes: np.ndarray) -> np.ndarray:
    """Probabilities, rows x categories."""
    columns = [_columns(chain.hashes, f) for f in found]
    earlier = np.empty((len(found), 0))
    for weights in chain.weights:
        if isinstance(weights, float):
            guess = np.full(len(found), weights)
        else:
            guess = _sigmoid(_Rows(columns, np.hstack([shapes, earlier]), len(chain.hashes)).times(weights))
        earlier = np.hstack([earlier, guess[:, None]])
    return earlier


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, labels, text) -> (doc_id, labels, hashes, shape)."""
    for batch in (p for b in batches for p in portions(b, PORTION_BYTES)):
        both = [features(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1),
            pa.array([h.view(np.int64) for h, _ in both], pa.list_(pa.int64())), pa.array([list(s) for _, s in both], pa.list_(pa.float64())),
        ], names=["doc_id", "labels", "hashes", "shape"])


def train(
    documents: DataFrame,
    labels: DataFrame,
    categories: dict[str, F.Column],
    id_column: str = "doc_id",
    text_column: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
) -> Chain:
    """`categories`: name -> 0/1 column over `labels`, in the order of the chain.

    The driver gets the features of about `sample_rows` texts if each id has one, and of about twice as many and
    `sample_bytes` bytes of text at most.
    """
    known = labels.filter(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("__id")).agg(
        F.array(*[F.round(F.avg(value)).cast("double") for value in categories.values()]).alias("__labels")
    )
    share = min(1.0, sample_rows / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    drawn = broadcast_if_small(stored(drawn, "labels"), 2 * sample_rows)
    text = F.coalesce(F.col(text_column), F.lit(""))
    own = documents.select(F.col(id_column).cast("long").alias("__id"), text_print(text_column).alias("__print"), text.alias("__text"))
    # One row for each text of an id, however often it is repeated. An id may have very many texts, so they are drawn too.
    texts = own.join(drawn, "__id").groupBy("__id", "__print").agg(F.max(F.octet_length("__text")).alias("__size"))
    texts = stored(texts, "drawn-texts")
    found = texts.agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("size")).first()
    fits = min(1.0, 2 * sample_rows / max(1, found["n"]), sample_bytes / max(1, found["size"] or 0))
    texts = texts.filter(F.pmod(F.xxhash64("__print", "__id"), F.lit(1 << 20)) < int(fits * (1 << 20))).drop("__size")
    texts = broadcast_if_small(stored(texts.join(drawn, "__id"), "sample"), 3 * sample_rows)
    rows = own.join(texts, ["__id", "__print"]).dropDuplicates(["__id", "__print"])
    sample = rows.select("__id", "__labels", "__text").mapInArrow(
        _extract, "doc_id long, labels array<double>, hashes array<long>, shape array<double>"
    ).toArrow()
    ids = sample.column("doc_id").to_numpy()
    # The rows' order must not depend on that of the tasks. The hashes stay where they are, in the collected table.
    order = np.lexsort((np.array([len(h) for h in sample.column("hashes")], dtype=np.int64), ids))
    hashes = [h.values.to_numpy().view(np.uint64) for h in sample.column("hashes")]
    found = [hashes[i] for i in order]
    shapes = np.array(sample.column("shape").to_pylist(), dtype=float).reshape(len(ids), SHAPES)[order]
    given = np.array(sample.column("labels").to_pylist(), dtype=float).reshape(len(ids), len(categories))[order]
    ids = ids[order]
    folds = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % FOLDS
    return fit_chain(found, shapes, given, folds, list(categories))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            for part in portions(batch, PORTION_BYTES, 256):
                both = [features(t.as_py()) for t in part.column(part.num_columns - 1)]
                scores = chain_scores(chain, [h for h, _ in both], np.array([s for _, s in both]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *[pa.array(np.round(column, 6)) for column in scores.T]],
                    names=[*part.schema.names[:-1], *[f"p_{c}" for c in chain.categories]],
                )

    return run


def score(documents: DataFrame, chain: Chain, keep: dict[str, F.Column], text_column: str = "text") -> DataFrame:
    """Columns `keep` of each row, with p_<category> and reject: whether the last category reaches its cut."""
    rows = documents.select(*[value.alias(name) for name, value in keep.items()], F.col(text_column).alias("__text"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"p_{c} double" for c in chain.categories]
    shared = documents.sparkSession.sparkContext.broadcast(chain)
    scored = rows.mapInArrow(_score(shared), ", ".join(kinds))
    return scored.withColumn("reject", F.col(f"p_{chain.categories[-1]}") >= F.lit(chain.cuts[-1]))


def label_categories() -> dict[str, F.Column]:
    """The chain over the labels table: low quality first, then toxic."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def drop_toxic(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`documents` without those that the chain rejects."""
    chain = train(documents, labels, label_categories(), id_column, text_column)
    keep = {"doc_id": F.col(id_column).cast("long"), "print": text_print(text_column)}
    rejected = score(documents, chain, keep, text_column).filter("reject")
    return without(documents, rejected, id_column, text_print(text_column))
