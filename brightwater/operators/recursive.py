"""Recursion and graph traversal by frontiers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch, shared_dir


def _cut(df: DataFrame) -> DataFrame:
    """Without its lineage, in the checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def union_distinct(seed: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = 1000) -> DataFrame:
    """WITH RECURSIVE ... UNION: rows new in each round feed the next, until there are none."""
    seen = [_cut(seed.distinct())]  # a frontier a round, each written once
    for _ in range(limit):
        frontier = _cut(step(seen[-1]).distinct().join(_all(seen), [*seen[0].columns], "left_anti"))
        if frontier.isEmpty():
            return _all(seen)
        seen.append(frontier)
    raise RuntimeError(f"recursion did not end in {limit} rounds")


#: Nodes that are sent to all tasks to pick the rows seen before that a step can meet.
FEW = 100_000


def _written(df: DataFrame) -> DataFrame:
    place = scratch(df.sparkSession, "frontier")
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def reachable(edges: DataFrame, start: DataFrame, low: int = 1, high: int = 32) -> DataFrame:
    """(start, node, depth): nodes within low..high hops over (src, dst), at their least depth.

    Edges are written once.  Where a step comes to few nodes, only the rows seen
    before at these nodes are held against it.
    """
    if high > 32:
        raise ValueError("at most 32 hops")
    edges = _written(edges.select("src", "dst"))
    seen = [_written(start.select(F.col(start.columns[0]).alias("start"), F.col(start.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0)))]
    for depth in range(1, high + 1):
        step = _written(seen[-1].join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct())
        before, nodes = _all(seen).select("start", "node"), step.select("node").distinct()
        if nodes.limit(FEW + 1).count() <= FEW:
            before = before.join(F.broadcast(nodes), "node", "left_semi")
        frontier = _written(step.join(before, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen.append(frontier)
    return _all(seen).where((F.col("depth") >= low) & (F.col("depth") <= high))


def simple_paths(edges: DataFrame, start: DataFrame, low: int = 1, high: int = 4, limit: int = 1_000_000) -> DataFrame:
    """(start, node, path): paths of low..high hops that repeat no node; over `limit` paths raise."""
    rows = start.select(F.col(start.columns[0]).alias("start")).select("start", F.col("start").alias("node"), F.array("start").alias("path"))
    out = None
    for depth in range(1, high + 1):
        rows = _cut(rows.join(edges, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path")))
        if rows.count() > limit:
            raise RuntimeError(f"more than {limit} paths")
        if depth >= low:
            out = rows if out is None else out.unionAll(rows)
    return out


def match_path(edges: DataFrame, start: DataFrame, steps: list[tuple[str, str | None]]) -> DataFrame:
    """(start, node): a fixed path; each step is a direction (out, in or both) and a condition on the edge's columns."""
    rows = start.select(F.col(start.columns[0]).alias("start"), F.col(start.columns[0]).alias("node")).distinct()
    for direction, condition in steps:
        kept = edges.where(condition) if condition else edges
        ways = [kept.select(F.col("src").alias("_a"), F.col("dst").alias("_b"))] if direction in ("out", "both") else []
        if direction in ("in", "both"):
            ways.append(kept.select(F.col("dst").alias("_a"), F.col("src").alias("_b")))
        rows = rows.join(_all(ways), F.col("node") == F.col("_a")).select("start", F.col("_b").alias("node")).distinct()
    return rows
