"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HOT_ROWS, discard, join_facts, stored

#: So many edges at most (16 bytes each) are connected in one task; more of them by steps over all tasks.
TASK_EDGES = 200_000


def _least(edges: DataFrame, to: str) -> DataFrame:
    """The smallest neighbour of each node a, as ``to``, and its number of edges: combined before the shuffle."""
    return edges.groupBy("a").agg(F.min("b").alias(to), F.count("*").alias("n"))


def _star_step(edges: DataFrame, n: int) -> DataFrame:
    """A large-star step, then a small-star step, over n edges.  A hub's least neighbour is broadcast to its edges."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    larger = join_facts(both.where("b > a"), _least(both, "m"), ["a"], "n", n)
    star = larger.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    if n >= HOT_ROWS:
        star = stored(star, "edges")
    lowest = _least(star, "m")
    moved = join_facts(star, lowest, ["a"], "n", n).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return stored(moved.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and component of all edges (a, b)."""
    edges = [np.stack([batch.column(k).to_numpy() for k in range(2)]) for batch in batches]
    if not edges:
        return
    nodes, at = np.unique(np.concatenate(edges, 1), return_inverse=True)
    left, right = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while (root[left] != root[right]).any():
        x, y = root[left], root[right]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of edges (a, b: long); self-loops and null ends are ignored."""
    oriented = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = stored(oriented, "edges"), None
    if now.count() <= TASK_EDGES:
        found = stored(now.coalesce(1).mapInArrow(_connected, "node long, component long"), "components")
        discard(now)
        return found
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, old = state, now
        now = _star_step(old, state[0])
        discard(old)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
