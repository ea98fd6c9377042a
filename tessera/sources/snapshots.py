"""Versions of a table under one folder, each visible only once it is whole.

A version's rows are written first, to a folder of its own; then one row is appended to the manifest, by a single file that is renamed into place. A
reader sees the versions of the manifest and nothing else, so a writer that dies leaves rows that nobody reads. Versions are never changed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "version long, folder string, rows long, label string, fields string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The whole versions: version, folder, rows, label, fields (the schema as JSON). Empty where nothing was saved yet."""
    try:
        spark.read.parquet(f"{path}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def save(rows: DataFrame, path: str, label: str = "", kind: str = "parquet", by: tuple[str, ...] = ()) -> int:
    """Write a new version (its rows as `kind`, in folders by the columns `by`) and enter it; its number. Versions of two writers at once get numbers of their own or share one; the
    last that was entered counts."""
    spark = rows.sparkSession
    version = (manifest(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    folder, seen = f"version-{version}-{uuid.uuid4().hex}", Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*by).format(kind).save(f"{path}/{folder}")
    entry = spark.createDataFrame([(version, folder, seen.get["rows"], label, rows.schema.json())], MANIFEST)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def load(spark: SparkSession, path: str, version: int | None = None, kind: str = "parquet") -> DataFrame:
    """The rows of a version, or of the last. An error where there is none."""
    whole = manifest(spark, path)
    whole = whole if version is None else whole.where(F.col("version") == version)
    found = whole.agg(F.max_by(F.struct("folder", "fields"), F.struct("version", "folder")).alias("m")).select("m.*").first()
    if found["folder"] is None:
        raise ValueError(f"no {'version' if version is None else f'version {version}'} at {path}")
    schema = StructType.fromJson(json.loads(found["fields"]))
    return spark.read.schema(schema).format(kind).load(f"{path}/{found['folder']}").select(*schema.names)


def fresh(entries: DataFrame, as_of: Column, created: str = "created", ttl: str = "ttl_seconds") -> DataFrame:
    """Entries of a loaded cache that have not outlived their own time; without a time to live they never do."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp(created)
    return entries.where(F.col(ttl).isNull() | (age <= F.col(ttl)))
