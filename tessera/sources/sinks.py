"""Sinks: appends, truncation, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def truncate(like: DataFrame, path: str) -> None:
    """Replace what stands at `path` by no rows of the same columns."""
    like.limit(0).write.mode("overwrite").parquet(path)


def snapshot(rows: DataFrame, path: str, created: str, ttl_seconds: int, as_of: Column) -> None:
    """Write the rows that have not outlived their time."""
    rows.where(F.unix_timestamp(as_of) - F.unix_timestamp(created) <= ttl_seconds).write.mode("overwrite").parquet(path)


def export_lines(rows: DataFrame, columns: list[str], quoted: str) -> DataFrame:
    """CSV lines in which only the last column is quoted and nothing is escaped."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return rows.select(F.concat_ws(",", *plain, F.concat(F.lit('"'), F.coalesce(F.col(quoted).cast("string"), F.lit("")), F.lit('"'))).alias("line"))


def export_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("line"))
