"""Tables that change: versions in a folder, with INSERT, REPLACE, UPDATE, DELETE, RETURNING, constraints, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch, shared_dir


class Table:
    """Versions v=0, v=1 and on of a table in a folder; a version counts once its writer has committed it.

    Readers see the last whole version: a write that fails leaves no trace.  Each
    change returns the changed rows, as RETURNING does.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v=*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName()[2:]) for f in found or [])

    def rows(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={self._versions()[-1] if version is None else version}")

    def commit(self, df: DataFrame) -> Table:
        """The rows as the next version."""
        version = (self._versions() or [-1])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        return self

    def insert(self, new: DataFrame, key: str | None = None, conflict: str = "abort") -> DataFrame:
        """INSERT ... SELECT; on a key that is there: abort, ignore, or replace."""
        old = self.rows()
        if key:
            new = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.monotonically_increasing_id().desc() if conflict == "replace" else F.monotonically_increasing_id()))).where("_n = 1").drop("_n") if conflict != "abort" else new
            if conflict == "abort":
                if not new.join(old, key, "left_semi").isEmpty() or not unique(new, key).isEmpty():
                    raise ValueError(f"UNIQUE constraint failed: {key}")
            elif conflict == "ignore":
                new = new.join(old, key, "left_anti")
            else:
                old = old.join(new, key, "left_anti")
        new = new.select(*[F.col(c).cast(t).alias(c) for c, t in old.dtypes])
        self.commit(old.unionAll(new))
        return new

    def update(self, condition: Column, **values: Column) -> DataFrame:
        """UPDATE ... SET ... WHERE ... RETURNING *."""
        old = self.rows()
        hit = F.coalesce(condition, F.lit(False))
        set_to = {c: (F.when(hit, values[c].cast(t)).otherwise(F.col(c)) if c in values else F.col(c)) for c, t in old.dtypes}
        version = (self._versions() or [-1])[-1]
        self.commit(old.select(*[e.alias(c) for c, e in set_to.items()]))
        return self.rows(version).where(hit).select(*[(values[c].cast(t) if c in values else F.col(c)).alias(c) for c, t in old.dtypes])

    def delete(self, condition: Column) -> DataFrame:
        """DELETE ... WHERE ... RETURNING *."""
        version = self._versions()[-1]
        hit = F.coalesce(condition, F.lit(False))
        self.commit(self.rows(version).where(~hit))
        return self.rows(version).where(hit)


def create_as(df: DataFrame, label: str = "table") -> Table:
    """CREATE TABLE AS, in the shared folder."""
    return Table(df.sparkSession, scratch(df.sparkSession, label)).commit(df)


def not_null(df: DataFrame, column: str) -> DataFrame:
    """Rows that break NOT NULL."""
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """Keys that break UNIQUE, with their number of rows; a null never clashes."""
    return df.where(" AND ".join(f"{c} IS NOT NULL" for c in columns)).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def check(df: DataFrame, condition: str) -> DataFrame:
    """Rows that break CHECK: the condition is false, not null."""
    return df.where(f"NOT ({condition})")


def foreign(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows that break a foreign key."""
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def numbered(df: DataFrame, *order: Column | str, name: str = "n", start: int = 0, step: int = 1) -> DataFrame:
    """Rows with a number in a total order over the whole table, without one task for all.

    Rows are dealt into ranges of the order, counted, and numbered within their range
    from where the ranges before it end.  The dealt rows are checkpointed, so that
    count and numbers are of the same ranges.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_p", F.spark_partition_id()).checkpoint()
    # a row a partition
    ends = dealt.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_from", F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    found = dealt.withColumn("_r", own).join(F.broadcast(ends), "_p")
    return found.withColumn(name, F.lit(start) + F.lit(step) * (F.col("_r") - 1 + F.coalesce("_from", F.lit(0)))).drop("_p", "_r", "_c", "_from")


def statistics(df: DataFrame) -> DataFrame:
    """ANALYZE: (column, rows, nulls, distinct) of each column, from one scan."""
    parts = [x for c in df.columns for x in (F.count(c).alias(f"n_{c}"), F.countDistinct(c).alias(f"d_{c}"))]
    one = df.agg(F.count("*").alias("_rows"), *parts)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), (F.col("_rows") - F.col(f"n_{c}")).alias("nulls"), F.col(f"d_{c}").alias("distinct")) for c in df.columns]))
    return one.select(rows.alias("r")).select("r.*")


def table_info(df: DataFrame) -> DataFrame:
    """PRAGMA table_info: (cid, name, type)."""
    return df.sparkSession.createDataFrame([(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "cid int, name string, type string")
