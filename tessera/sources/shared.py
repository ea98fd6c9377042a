"""Tables written to the folder that driver and executors share, to cut lineage or to be read more than once."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tessera-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder for a local session and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_folder()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "t", *by: str) -> DataFrame:
    """`df` written as Parquet (in folders by the columns `by`) and read back: a lost executor costs a retry, and no reader computes it again."""
    path = new_path(df.sparkSession, label)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def spread(df: DataFrame) -> DataFrame:
    """`df` over as many tasks as a shuffle has, for rows that take long each: a small compressed file holds many of them and is read by one or two tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """`df` by its keys over all partitions of a shuffle, not fewer: for small rows of which much is made in the same task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
