"""Connected components of a graph given as a table of edges, without gathering the graph anywhere.

Each task first contracts its own edges, at most about EDGES_PER_FOREST, with a union-find. If all edges fit into one such
task, that is the result. Otherwise what is left is contracted by alternating large-star and small-star steps: in turn, every node hands its larger (then its smaller) neighbours over to the smallest node it knows.
Both are an aggregate and a join on one endpoint; a node with very many edges is a skewed join, which adaptive execution
splits. The number of edges never grows, and the steps end when nothing changes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablens.session import stored

EDGES_PER_FOREST = 1 << 19


class UnionFind:
    """Sets of hashable, ordered items; the smallest item of a set is its root."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, item):
        path = []
        while (above := self.parent.get(item, item)) != item:
            path.append(item)
            item = above
        for step in path:
            self.parent[step] = item
        return item

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        low, high = (a, b) if a < b else (b, a)
        self.parent.setdefault(low, low)
        self.parent[high] = low


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task -> as few edges, node to root, with the same components."""
    found = UnionFind()

    def flush():
        nodes = [n for n in found.parent if found.root(n) != n]
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.binary()), pa.array([found.root(n) for n in nodes], pa.binary())], names=["a", "b"]
        )

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.join(a, b)
    yield flush()


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        moved = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(low.select("a", F.col("m").alias("b")))
    return moved.distinct()


def _print(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """One row per node that has an edge and is not its component's smallest: node, root.

    `edges` is (a, b), binary; they are counted and read again, so pass stored ones.
    """
    tasks = math.ceil(edges.count() / EDGES_PER_FOREST)
    own = edges.select("a", "b").filter(F.col("a") != F.col("b"))
    dealt = own.coalesce(1) if tasks <= 1 else own.repartition(tasks, "a", "b")
    now = stored(dealt.mapInArrow(_contract, "a binary, b binary").distinct(), "edges")
    if tasks <= 1:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = _print(now)
    while True:
        now = stored(_stars(_stars(now, large=True), large=False), "edges")
        after = _print(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
