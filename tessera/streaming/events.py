"""Structured Streaming forms of the log operators: windowed counts, latest per key, distinct events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a scale folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    plain = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return plain.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})  # watermarks need it


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; works on a stream (with a watermark) and on a table."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def drain(updates: DataFrame, folder: str, mode: str = "update") -> DataFrame:
    """Run a stream over what there is; its output rows as a table, with the number of the batch (`epoch`) that gave them.

    Each batch writes a folder of its own under `folder`, which driver and executors share, so a batch that is run again replaces its rows.
    """
    spark = updates.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    updates.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(StructType([*updates.schema.fields, StructField("epoch", LongType())])).parquet(f"{folder}/rows")


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def upsert_batches(path: str, key: list[str], order: list[str]):
    """A foreachBatch function that keeps the last row of each key at `path`, switching between two versions."""
    from tessera.operators.stores import latest

    def write(batch: DataFrame, epoch: int) -> None:
        new = latest(batch, key, order)
        try:
            old = batch.sparkSession.read.parquet(f"{path}/v{epoch - 1}")
        except Exception as e:  # the first batch has no version before it
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = new.limit(0)
        latest(old.unionByName(new), key, order).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return write
