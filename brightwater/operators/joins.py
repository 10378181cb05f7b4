"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, time: str, value: str, name: str) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before its time.

    One shuffle by key over the union of both sides: no join, so a key's rows are
    never paired.  At equal times right rows come first.
    """
    a = left.withColumns({"_side": F.lit(1), name: F.lit(None).cast(dict(right.dtypes)[value])})
    b = right.select(key, time, F.col(value).alias(name)).withColumn("_side", F.lit(0))
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(name, F.last(F.when(F.col("_side") == 0, F.col(name)), ignorenulls=True).over(w)).where("_side = 1").drop("_side")


def or_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key) of rows equal in any of the column pairs: a union of equi-joins without repeats."""
    out = None
    for a, b in pairs:
        x = left.select(F.col(left_key).alias("_l"), F.col(a).alias("_k"))
        y = right.select(F.col(right_key).alias("_r"), F.col(b).alias("_k"))
        part = x.join(y, "_k").select("_l", "_r")
        out = part if out is None else out.unionAll(part)
    return out.distinct().select(F.col("_l").alias(left_key), F.col("_r").alias(right_key))
