"""What the operators share: reading tables, staged tables in the shared folder, clean-up."""

from __future__ import annotations

import contextlib
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir
from ..session import ship as _ship

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the package to the workers; Arrow batches of 4 MB where the session leaves Spark's default of 64 MB.

    A batch stands in the JVM and in Python, once each way; texts are long.
    """
    _ship(spark)
    if spark.conf.get(_BATCH, None) == "67108864b":
        spark.conf.set(_BATCH, "4m")


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Queries that run inside leave no shuffle files: what they wrote takes their place."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables written as Parquet under one folder of the shared directory.

    A table written here cuts lineage: losing executors costs no more than
    re-reading it.  Results are lazy, so the folder lives until close() or the
    end of the driver's JVM, whichever comes first.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.root))

    def put(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with _shuffles_dropped(self.spark):
            writer.parquet(f"{self.root}/{name}")
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def has(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def close(self) -> None:
        self._fs.delete(self._path(self.root), True)


def release(spark: SparkSession) -> None:
    """Let the driver drop shuffle files of finished jobs now.

    Spark deletes them only once the JVM has collected the driver's objects;
    between the rounds of an iterative operator that may be far too late.
    """
    gc.collect()
    with contextlib.suppress(AttributeError):
        spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
