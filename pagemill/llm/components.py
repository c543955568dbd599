"""Connected components of a distributed edge table, by alternating stars."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Scratch, batches_of

#: Edges that a task joins by itself.
TOGETHER = 1 << 20
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges that are not the smallest of what they reach by these, and that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[left], label[right]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def stars(edges: DataFrame) -> DataFrame:
    """Edges with the same components: those that one task reads become stars, in bounded parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def joined() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = least_reachable(*(np.concatenate([h[c].to_numpy() for h in held]) for c in ("a", "b")))
                yield from batches_of({"a": a, "b": b}, _EDGES)

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= TOGETHER:
                yield from joined()
                held, n = [], 0
        yield from joined()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _downward(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    A round links, first, every larger neighbour of a node with its smallest
    neighbour (or itself), then every node and its smaller neighbours with the
    smallest of them.  Each is a join of the edges with the minima.  Before, what a
    task reads becomes stars by itself, so a few edges take two rounds; the rounds
    grow with the logarithm of the longest path.  A node with very many neighbours
    is one row per input partition in the minima; these are written, so that the
    join is one of two tables, which adaptive execution splits at such a node.
    """
    now = scratch.save(edges.where("a <> b").select("a", "b").distinct(), f"{name}-0")
    mark, step = None, 0
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            break
        mark, step = tuple(seen), step + 1
        both = _both_ways(scratch.save(stars(now), f"{name}-stars"))
        least = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.save(large.distinct(), f"{name}-large")
        down = _downward(large)
        least = scratch.save(down.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least-down")
        moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = scratch.save(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def forest(n: int, pairs_a, pairs_b) -> list[tuple[int, int]]:
    """The pairs that join different trees, of links between nodes 0 to n - 1 of one task."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(pairs_a, pairs_b, strict=True):
        ra, rb = root(int(a)), root(int(b))
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((int(a), int(b)))
    return kept
