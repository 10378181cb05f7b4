"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .textkernel import lean


#: Edges that one task may finish alone.
LOCAL = 10_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node with the smallest one that it reaches, for those that reach a smaller one."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        label = new[label]
        left = label[a] != label[b]
        a, b = a[left], b[left]
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _local_stars(whole: bool):
    """A spanning star in place of the edges of a batch, or of all of a task's."""

    @lean
    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches) if whole else []
        for part in [held] if held else ([b] for b in batches):
            table = pa.Table.from_batches(part)
            u, v = forest(table.column(0).to_numpy(), table.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return stars


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", max_rounds: int = 60, local: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes that have edges.

    Alternating large-star and small-star rounds on (u, v) with u > v.  A node's
    neighbours are never gathered: rounds are minima (combined before the
    shuffle) and equi-joins that adaptive execution may split where a hub is
    hot.  The edge list is staged after each round, so a lost executor costs one
    round at most.  Edges that are few enough (`local`, or LOCAL) one task finishes.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    current = scratch.put(f"{name}-0", pairs.mapInArrow(_local_stars(False), "u long, v long").distinct())
    if current.count() <= (LOCAL if local is None else local):
        return _with_roots(scratch.put(f"{name}-1", current.repartition(1).mapInArrow(_local_stars(True), "u long, v long")))
    before = None
    for k in range(1, max_rounds + 1):
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: each neighbour above u joins u's smallest; u itself is such a neighbour of its own smaller ones
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: smaller neighbours of u, and u, join the smallest
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        current = scratch.put(f"{name}-{k}", small.unionAll(least.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        row = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        state = (row["n"], row["h"])
        scratch.drop(f"{name}-{k - 1}")
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    return _with_roots(current)


def _with_roots(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
