"""Aggregates of the user's own: init, step, merge and finish, combined before the shuffle; exact percentiles."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def user_aggregate(df: DataFrame, keys: list[str], value: str, name: str, kind: str, init: Callable, step: Callable, merge: Callable, finish: Callable) -> DataFrame:
    """(*keys, name): step(state, value) over the rows of each partition, then merge(state, state) over partitions.

    A key's partial states, one a partition, meet in one task; its rows never do.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, object] = {}
        for batch in batches:
            for *key, x in batch[[*keys, value]].itertuples(index=False, name=None):
                at = tuple(key)
                states[at] = step(states[at] if at in states else init(), x)
        rows = [(*key, pickle.dumps(state)) for key, state in states.items()]
        yield pd.DataFrame(rows, columns=[*keys, "_state"])

    def final(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        states = [pickle.loads(s) for s in parts["_state"]]
        out = states[0]
        for s in states[1:]:
            out = merge(out, s)
        return pd.DataFrame([(*key, finish(out))], columns=[*keys, name])

    kinds = dict(df.dtypes)
    shape = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    parts = df.select(*keys, value).mapInPandas(partial, f"{shape}, _state binary")
    return parts.groupBy(*keys).applyInPandas(final, f"{shape}, `{name}` {kind}")


def exact_percentile(df: DataFrame, column: str, p: float, slack: float = 0.001) -> DataFrame:
    """(percentile): as percentile(), without a map of all values in one task.

    A sketch brackets the rank sought; only the bracket's values are ordered, and the
    bracket is widened to all values if the rank is not in it.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    n, ends = x.agg(F.count("*"), F.percentile_approx("x", [max(0.0, p - slack), min(1.0, p + slack)], 10_000)).first()
    if not n:
        return df.sparkSession.sql("SELECT CAST(NULL AS DOUBLE) AS percentile")
    place = p * (n - 1)
    low, high = math.floor(place), math.ceil(place)
    below, within = x.agg(F.count_if(F.col("x") < ends[0]), F.count_if(F.col("x").between(*ends))).first()
    if below > low or below + within <= high:
        below, kept = 0, x
    else:
        kept = x.where(F.col("x").between(*ends))
    counts = kept.groupBy("x").count()
    upto = F.sum("count").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))  # the bracket only
    at = lambda rank: F.min(F.when(F.col("upto") > rank - below, F.col("x")))
    values = counts.withColumn("upto", upto).agg(at(low).alias("a"), at(high).alias("b"))
    return values.select(F.when((F.col("a") == F.col("b")) | F.lit(low == high), F.col("a")).otherwise((high - place) * F.col("a") + (place - low) * F.col("b")).alias("percentile"))
