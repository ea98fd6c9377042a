"""Small made-up dictionaries that the validation and lookup operators work with, as DataFrames.

Every table here is a fixed handful of rows, so operators may broadcast it. Values are invented for the driver's tables
(units of the events stream, nations, parts); they are no medical knowledge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: test, least, most, unit
PLAUSIBLE = [("click", 5.0, 95.0, "u"), ("view", 10.0, 90.0, "u"), ("purchase", 2.0, 98.0, "u"), ("signup", 20.0, 80.0, "v")]
#: test, group (a sex, 'adult' or another), low, high
REFERENCE = [("click", "male", 20.0, 60.0), ("click", "female", 15.0, 55.0), ("view", "adult", 25.0, 75.0), ("purchase", "male", 30.0, 70.0), ("signup", "fasting", 35.0, 65.0)]
#: test, low or null, high or null
CRITICAL = [("click", 10.0, 90.0), ("view", None, 85.0), ("purchase", 12.0, None)]
#: test, from unit, to unit, factor
CONVERSIONS = [("AIR", "kg", "lb", 2.20462), ("RAIL", "kg", "g", 1000.0), ("R", "kg", "lb", 2.20462), ("A", "kg", "g", 1000.0), ("N", "kg", "oz", 35.274)]
#: a, b, severity: pairs that should not meet; symmetric
INTERACTIONS = [("Brand#11", "Brand#12", "major"), ("Brand#13", "Brand#21", "moderate"), ("Brand#22", "Brand#23", "minor"), ("Brand#31", "Brand#32", "major"), ("Brand#41", "Brand#42", "moderate")]


def _literal(v: object) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else (f"CAST('{v!r}' AS DOUBLE)" if abs(v) == float("inf") else f"CAST({v!r} AS DOUBLE)") if isinstance(v, float) else repr(v)


def values_sql(rows: list[tuple]) -> str:
    """The rows as a VALUES list both engines read."""
    return ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)


def frame(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {values_sql(rows)} AS t({', '.join(names)})")


def plausible(spark: SparkSession) -> DataFrame:
    return frame(spark, PLAUSIBLE, "test", "min_ok", "max_ok", "unit_ok")


def reference(spark: SparkSession) -> DataFrame:
    return frame(spark, REFERENCE, "test", "grp", "low", "high")


def critical(spark: SparkSession) -> DataFrame:
    return frame(spark, [(t, lo if lo is not None else float("-inf"), hi if hi is not None else float("inf")) for t, lo, hi in CRITICAL], "test", "crit_low", "crit_high")


def conversions(spark: SparkSession) -> DataFrame:
    return frame(spark, CONVERSIONS, "test", "from_unit", "to_unit", "factor")


def interactions(spark: SparkSession) -> DataFrame:
    return frame(spark, INTERACTIONS, "a", "b", "severity")
