"""Materialized views over streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch


def _available(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there now and give its result, written as Parquet in the shared folder.

    In complete mode each batch takes the place of the one before; otherwise batches
    add up.  A batch that is run again after a failure writes its own folder anew.
    """
    spark, place = df.sparkSession, scratch(df.sparkSession, "view")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out" if mode == "complete" else f"{place}/out/batch={number}")

    query = df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{place}/out").select(*df.columns)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files of a folder, or of the one file named."""
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder) if file.endswith(".parquet") else spark.readStream.schema(schema).parquet(path)


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Counts by window and keys."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counts = stamped.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
    return _available(counts.select(F.col("window.start").alias("start"), *keys, "n"), "complete")


def sessions(events: DataFrame, time: str, gap: str, key: str) -> DataFrame:
    """Counts by session: a key's events with less than `gap` between them."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, "1 day")
    counts = stamped.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return _available(counts.select(F.col("session_window.start").alias("start"), key, "n"), "complete")


def deduplicated(events: DataFrame, time: str, keys: list[str]) -> DataFrame:
    """Each key once, however far apart its events are: the state holds the keys seen."""
    return _available(events.select(*keys).dropDuplicates(keys), "append")
