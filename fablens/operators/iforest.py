"""Isolation forest (Liu, Ting and Zhou, 2008): fit on small seeded samples, score in vectorised batches.

Fitting needs 256 rows per tree, whatever the size of the data. Each row has one seeded number for every thirteen trees,
four of them from one hash; those thirteen read it from starting points a thirteenth of its range apart, so that their
samples are drawn without replacement. A comparison of each number tells first whether any tree may draw the row; only such
rows go on. Of each tree's candidates the 256 with the smallest draw are kept. A tree is built from
its 256 rows in one Python call, trees run in parallel. The model, at most 511 nodes per tree, is a small table
that is sent to the scoring tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from fablens import constants as C

NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, size int, depth int, sample int"
_EULER_GAMMA = 0.5772156649015329
# Candidates per tree, as a multiple of the sample size: far above the spread of a binomial draw.
_OVERSAMPLING = 1.5
# Draws are below _RANGE; the trees that share a number read it _STEP apart. A hash has four numbers of eight digits.
_TREES_PER_NUMBER, _NUMBERS_PER_HASH, _RANGE = 13, 4, 1 << 32
_STEP = _RANGE // _TREES_PER_NUMBER


def _mean_path(size: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of `size` rows."""
    size = np.asarray(size, dtype=float)
    big = np.maximum(size, 3.0)
    length = 2.0 * (np.log(big - 1.0) + _EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(size <= 1, 0.0, np.where(size <= 2, 1.0, length))


def tree_samples(
    df: DataFrame, row_id: str, features: str, rows: int, trees: int = C.FOREST_TREES,
    sample: int = C.FOREST_SUBSAMPLE, seed: int = C.FOREST_SEED, earlier: DataFrame | None = None,
) -> DataFrame:
    """(row_id, features, tree, draw): the `sample` rows of each tree with the smallest draws, fixed by the seed.

    `rows` is the number of rows the model covers. Samples merge: with `earlier`, the samples of rows seen before,
    the result is the sample of all rows, so a growing data set need not be read again.
    """
    fraction = min(1.0, _OVERSAMPLING * sample / max(rows, 1))
    limit = math.ceil(fraction * _RANGE)
    numbers = math.ceil(trees / _TREES_PER_NUMBER)
    row_hash = lambda h: F.md5(F.concat_ws("|", F.col("row_id").cast("string"), F.lit(f"{h}|{seed}")))
    hashes = {f"_hash{h}": row_hash(h) for h in range(math.ceil(numbers / _NUMBERS_PER_HASH))}

    def number(n: int) -> Column:
        h, at = divmod(n, _NUMBERS_PER_HASH)
        return F.conv(F.substring(f"_hash{h}", 1 + 8 * at, 8), 16, 10).cast("long")

    def drawn(value: Column, group: Column) -> Column:
        places = F.sequence(F.lit(0), F.lit(_TREES_PER_NUMBER - 1))
        draws = F.transform(places, lambda k: F.struct(
            (group * _TREES_PER_NUMBER + k).alias("tree"), ((value + k.cast("long") * _STEP) % _RANGE).alias("draw")
        ))
        return F.filter(draws, lambda d: (d["draw"] < limit) & (d["tree"] < trees))

    # Hashes and numbers are columns of their own, so that none is worked out again for each tree.
    own = df.select(F.col(row_id).alias("row_id"), F.col(features).alias("features"))
    hashed = own.withColumns(hashes).select("row_id", "features", F.array(*[number(n) for n in range(numbers)]).alias("_numbers"))
    # A draw below the limit leaves a rest below it, or at most what the steps leave of the range beyond it.
    rest = _RANGE - _STEP * _TREES_PER_NUMBER
    if limit + rest < _STEP:
        hashed = hashed.filter(F.exists("_numbers", lambda v: v % _STEP < limit + rest))
    candidates = hashed.select("row_id", "features", F.inline(F.flatten(F.transform("_numbers", drawn))))
    if earlier is not None:
        candidates = candidates.unionByName(earlier.select("row_id", "features", "tree", "draw"))
    # A fixed number of tasks: the rows are few, but growing a tree takes time.
    tasks = min(trees, df.sparkSession.sparkContext.defaultParallelism)
    candidates = candidates.repartition(tasks, "tree")
    smallest = Window.partitionBy("tree").orderBy("draw", "row_id")
    return candidates.withColumn("_rank", F.row_number().over(smallest)).filter(F.col("_rank") <= sample).drop("_rank")


def _tree_builder(seed: int):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "row_id"])
        tree = int(rows["tree"].iloc[0])
        data = np.vstack(rows["features"].to_numpy())
        rng = np.random.default_rng([seed, tree])
        limit = math.ceil(math.log2(max(len(data), 2)))
        nodes: list[list] = []
        pending = [(np.arange(len(data)), 0, -1, "")]
        while pending:
            members, depth, parent, side = pending.pop()
            number = len(nodes)
            nodes.append([tree, number, -1, 0.0, -1, -1, len(members), depth, len(data)])
            if parent >= 0:
                nodes[parent][4 if side == "left" else 5] = number
            part = data[members]
            low, high = part.min(axis=0), part.max(axis=0)
            varying = np.flatnonzero(high > low)
            if depth >= limit or len(members) <= 1 or len(varying) == 0:
                continue
            feature = int(rng.choice(varying))
            cut = float(rng.uniform(low[feature], high[feature]))
            goes_left = part[:, feature] <= cut
            nodes[number][2:4] = [feature, cut]
            pending.append((members[~goes_left], depth + 1, number, "right"))
            pending.append((members[goes_left], depth + 1, number, "left"))
        names = ["tree", "node", "feature", "cut", "left", "right", "size", "depth", "sample"]
        return pd.DataFrame(nodes, columns=names)

    return build


def build_trees(samples: DataFrame, seed: int = C.FOREST_SEED) -> DataFrame:
    """Node table of the forest grown on the samples, one tree per task."""
    return samples.groupBy("tree").applyInPandas(_tree_builder(seed), NODE_SCHEMA)


def fit_forest(
    df: DataFrame, row_id: str = "event_id", features: str = "features", trees: int = C.FOREST_TREES,
    sample: int = C.FOREST_SUBSAMPLE, seed: int = C.FOREST_SEED, min_rows: int = C.FOREST_MIN_ROWS,
) -> DataFrame | None:
    """Node table of the forest; None while there are fewer than `min_rows` rows."""
    rows = df.count()
    if rows < min_rows:
        return None
    return build_trees(tree_samples(df, row_id, features, rows, trees, sample, seed), seed)


def score_udf(forest: DataFrame):
    """Scoring function of a forest as a vectorised UDF over an ARRAY<DOUBLE> column."""
    nodes = forest.toPandas().sort_values(["tree", "node"])  # at most 511 rows per tree
    models = []
    for _, tree in nodes.groupby("tree"):
        leaf_length = (tree["depth"] + _mean_path(tree["size"])).to_numpy()
        models.append((
            tree["feature"].to_numpy(), tree["cut"].to_numpy(), tree["left"].to_numpy(), tree["right"].to_numpy(),
            leaf_length, int(tree["depth"].max()),
        ))
    scale = float(_mean_path(nodes["sample"].max())) or 1.0

    def score(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype=float)
        data = np.vstack(vectors.to_numpy())
        everyone = np.arange(len(data))
        total = np.zeros(len(data))
        for feature, cut, left, right, leaf_length, depth in models:
            at = np.zeros(len(data), dtype=np.int64)
            for _ in range(depth):
                inner = feature[at] >= 0
                goes_left = data[everyone, np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            total += leaf_length[at]
        return pd.Series(np.power(2.0, -total / len(models) / scale))

    return F.pandas_udf(score, DoubleType())


def novelty(forest: DataFrame | None, features: Column) -> Column:
    """Novelty in [0, 1], four digits; null without a model."""
    if forest is None:
        return F.lit(None).cast("double")
    raw = score_udf(forest)(features)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)


def refits_due(rows: int, min_rows: int = C.FOREST_MIN_ROWS, every: int = C.FOREST_REFIT_EVERY) -> int:
    """Number of fits that are due once `rows` rows have been seen."""
    return 0 if rows < min_rows else rows // every - min_rows // every + 1
