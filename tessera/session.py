"""Session factory with the settings every operator assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "tessera", master: str | None = None, **extra: str) -> SparkSession:
    """A session with UTC timestamps, AQE and last-wins maps; `extra` keys use '__' for '.'."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()
