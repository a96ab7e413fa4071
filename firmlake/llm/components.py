"""Connected components of a graph too large for one machine: alternating large and small stars.

Every step is a join or an aggregation of the edge table, written to the shared folder. Nothing is gathered
on the driver but a row count and a checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlake.llm.common import discard, written

LOCAL = 200_000  # edges, 16 bytes each, up to which one task finishes: the same result without further rounds


def _minima(pairs: DataFrame, name: str) -> DataFrame:
    """(a, m), the smallest b of a; a written table, so that a hub's rows may be split when it is joined."""
    return written(pairs.groupBy("a").agg(F.min("b").alias("m")), name)


def _finished(edges: DataFrame) -> DataFrame:
    """(a, b) long, few enough for one task -> (node, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) for batch in batches]
        if parts:
            nodes, at = np.unique(np.concatenate(parts, 1), return_inverse=True)
            at = at.reshape(2, -1)
            root = local_roots(len(nodes), at[0], at[1])
            moved = root != np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["node", "root"])

    return written(edges.repartition(1).mapInArrow(run, "node long, root long"), "roots")


def components(edges: DataFrame, most: int = 60, local: int = LOCAL) -> DataFrame:
    """Edges (a, b) of any sortable type -> (node, root): for each node with an edge to another, the smallest node reachable.

    Repeated edges, both directions and self-loops may occur; self-loops and nulls are ignored. An empty table
    gives an empty one. No more than ``local`` edges of whole numbers are finished in one task. Should ``most`` rounds not suffice, which takes a diameter beyond reason, it raises.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(edges.distinct(), "edges")
    if edges.schema["a"].dataType == T.LongType() and edges.count() <= local:
        return _finished(edges)
    seen = None
    for _ in range(most):
        both = written(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        near = _minima(both, "large")
        large = both.join(near, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = written(large.distinct(), "large-star")
        below = _minima(large, "small")
        small = large.join(below, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        before, edges = edges, written(small.where("a <> b").distinct(), "small-star")
        discard(before, both, near, large, below)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {most} rounds")


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and the edges a[i]-b[i], the smallest node reachable from each."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        least = np.minimum(ra, rb)
        np.minimum.at(root, ra, least)
        np.minimum.at(root, rb, least)
        while not np.array_equal(up := root[root], root):
            root = up
    while not np.array_equal(up := root[root], root):
        root = up
    return root
