"""Frames that Spark's parser lacks, composed from those it has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, partition: list[str], order: list[str], start: int, end: int, values: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """GROUPS BETWEEN start AND end: peers are numbered densely and framed by RANGE over the number.

    Both windows share partitioning, so they take one shuffle.
    """
    numbered = df.withColumn("_g", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)).cast("long"))
    w = Window.partitionBy(*partition).orderBy("_g").rangeBetween(start, end)
    return numbered.withColumns({name: make(w) for name, make in values.items()}).drop("_g")


def exclude(df: DataFrame, partition: list[str], order: str, value: str, name: str, kind: str, start: int, end: int, aggregate: str = "sum") -> DataFrame:
    """sum, count, avg, min or max of value over RANGE BETWEEN start AND end of `order`, EXCLUDE current, group, ties or no others.

    Sums and counts have what is excluded subtracted; where nothing is left a sum is
    null.  min and max exclude groups of peers, as the better of the frames before
    and after them; `order` is whole numbers there.  The frame must hold the current
    row's peers (start <= 0 <= end).
    """
    window = Window.partitionBy(*partition).orderBy(order)
    frame = window.rangeBetween(start, end)
    if aggregate in ("min", "max"):
        best, pick = (F.min, F.least) if aggregate == "min" else (F.max, F.greatest)
        if kind == "no others":
            return df.withColumn(name, best(value).over(frame))
        if kind != "group":
            raise ValueError("min and max exclude groups only")
        sides = [best(value).over(window.rangeBetween(a, b)) for a, b in ((start, -1), (1, end)) if a <= b]
        return df.withColumn(name, pick(*sides) if len(sides) > 1 else sides[0] if sides else F.lit(None).cast(dict(df.dtypes)[value]))
    peers = window.rangeBetween(0, 0)
    own, own_n = F.coalesce(F.col(value), F.lit(0)), F.col(value).isNotNull().cast("long")
    group, group_n = F.coalesce(F.sum(value).over(peers), F.lit(0)), F.count(value).over(peers)
    out, out_n = {"current": (own, own_n), "group": (group, group_n), "ties": (group - own, group_n - own_n), "no others": (F.lit(0), F.lit(0))}[kind]
    left, total = F.count(value).over(frame) - out_n, F.sum(value).over(frame) - out
    result = {"count": left, "sum": F.when(left > 0, total), "avg": F.when(left > 0, total / left)}[aggregate]
    return df.withColumn(name, result)


def filter_over(aggregate: Callable[[Column], Column], value: Column, condition: Column) -> Column:
    """agg(value) FILTER (WHERE condition), for use over a window."""
    return aggregate(F.when(condition, value))
