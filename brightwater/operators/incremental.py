"""Deltas with weights, change capture and maintained views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch


def consolidate(delta: DataFrame, weight: str = "weight") -> DataFrame:
    """Sum the weights of equal rows and drop those at zero."""
    keys = [c for c in delta.columns if c != weight]
    return delta.groupBy(*keys).agg(F.sum(weight).alias(weight)).where(F.col(weight) != 0)


def apply_changes(changes: DataFrame, key: str, order: list[str], operation: str = "op") -> DataFrame:
    """The last state of each key in a change log; deleted keys are gone."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return changes.withColumn("_r", last).where((F.col("_r") == 1) & (F.col(operation) != "delete")).drop("_r", operation)


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """ON CONFLICT DO UPDATE: source rows replace target rows of their key."""
    return target.join(source.select(key).distinct(), key, "left_anti").unionByName(source)


def view_sum_count(view: DataFrame, delta: DataFrame, keys: list[str], value: str, weight: str = "weight") -> DataFrame:
    """A grouped sum and count after a weighted delta."""
    change = delta.groupBy(*keys).agg(F.sum(F.col(value) * F.col(weight)).alias("s"), F.sum(weight).alias("n"))
    return view.unionByName(change).groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n != 0")


class View:
    """A view kept up with weighted deltas: filter, project, join, union and grouped sums, with its state in files.

    A delta is a table with a column `weight` (1 in, -1 out).  apply() takes one delta
    for each source, works out the view's own delta from them and the state, and
    writes the next state; a state counts once it is committed whole.  Comparisons
    with null are neither true nor false, as in a batch query, so rows with nulls
    enter and leave like others.
    """

    def __init__(self, spark, sources: dict[str, str], plan: Callable[[dict[str, DataFrame]], DataFrame], joined: tuple[str, str, str] | None = None, keys: list[str] | None = None, sums: dict[str, str] | None = None):
        """sources: name to schema; plan: of the sources (a join's result for joined) to rows; joined: two sources and the column they share; keys and sums: of a grouped view."""
        self.spark, self.sources, self.plan, self.joined, self.keys, self.sums = spark, sources, plan, joined, keys, sums
        self.path, self.version = scratch(spark, "view"), -1

    def _state(self, name: str, empty: Callable[[], DataFrame]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/v={self.version}") if self.version >= 0 else empty()

    def _delta(self, changes: dict[str, DataFrame]) -> DataFrame:
        if not self.joined:
            return self.plan(changes)
        left, right, key = self.joined
        # what is new on one side meets all of the other, and what is new on both meets once
        old = {n: self._state(n, lambda n=n: changes[n].limit(0)) for n in (left, right)}

        def pair(a: DataFrame, b: DataFrame) -> DataFrame:
            return a.join(b.withColumnRenamed("weight", "_w"), key).withColumn("weight", F.col("weight") * F.col("_w")).drop("_w")

        both = pair(changes[left], old[right]).unionByName(pair(old[left], changes[right])).unionByName(pair(changes[left], changes[right]))
        return self.plan({"joined": both})

    def apply(self, **changes: DataFrame) -> DataFrame:
        """The view's delta; the state moves on."""
        for name, schema in self.sources.items():
            if name not in changes:
                changes[name] = self.spark.createDataFrame([], f"{schema}, weight long")
        delta = consolidate(self._delta(changes))
        place = f"{self.path}/out/v={self.version + 1}"
        old = self._state("out", lambda: self._grouped(delta).limit(0) if self.keys else delta.limit(0))
        if self.keys:
            new = old.unionByName(self._grouped(delta)).groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in [*(self.sums or {}), "weight"]]).where("weight <> 0")
        else:
            new = consolidate(old.unionByName(delta))
        new.write.parquet(place)
        for name in self.joined[:2] if self.joined else ():
            consolidate(self._state(name, lambda name=name: changes[name].limit(0)).unionByName(changes[name])).write.parquet(f"{self.path}/{name}/v={self.version + 1}")
        self.version += 1
        return delta

    def _grouped(self, delta: DataFrame) -> DataFrame:
        return delta.groupBy(*self.keys).agg(*[F.sum(F.col(c) * F.col("weight")).alias(name) for name, c in (self.sums or {}).items()], F.sum("weight").alias("weight"))

    def rows(self) -> DataFrame:
        """The view as it stands: for a grouped one keys, sums and weight (the count); else each row as often as its weight."""
        out = self.spark.read.parquet(f"{self.path}/out/v={self.version}")
        return out if self.keys else out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))).drop("_n", "weight")


def capture(before: DataFrame, after: DataFrame, key: str, name: str, mode: str = "full", version: int = 1) -> DataFrame:
    """Changes between two states of a table: (change_type, table_name, id, before, after, updates).

    change_type is 1 for an insert, 0 for an update and -1 for a delete.  mode: id
    gives neither image, before and after one of them, full both and the changed
    columns.  version 2 adds change_txn_id and one row of change_type 2 for the commit.
    """
    if mode not in ("id", "before", "after", "full"):
        raise ValueError(f"no mode {mode}")
    columns = [c for c in before.columns if c != key]
    a = before.select(F.col(key).alias("id"), F.struct(*before.columns).alias("a"))
    b = after.select(F.col(key).alias("id"), F.struct(*after.columns).alias("b"))
    both = a.join(b, "id", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    kind = F.when(F.col("a").isNull(), 1).when(F.col("b").isNull(), -1).otherwise(0)
    text = lambda c: F.to_json(F.col(c), {"ignoreNullFields": "false"})
    none = F.lit(None).cast("string")
    changed = F.concat_ws(",", *[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns])
    out = both.select(
        kind.alias("change_type"),
        F.lit(name).alias("table_name"),
        "id",
        (text("a") if mode in ("before", "full") else none).alias("before"),
        (text("b") if mode in ("after", "full") else none).alias("after"),
        (F.when(kind == 0, changed) if mode == "full" else none).alias("updates"),
    )
    if version == 1:
        return out
    commit = before.sparkSession.range(1).select(F.lit(2).alias("change_type"), *[F.lit(None).cast(t).alias(c) for c, t in out.dtypes[1:]])
    return out.unionByName(commit).withColumn("change_txn_id", F.lit(1).cast("long"))
