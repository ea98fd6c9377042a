"""Strengths that a drug is made in, and whether a prescription's strength is one of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Signs that scanners read for digits, in the order they are put right.
DIGITS = [("Z", "2"), ("O", "0"), ("L", "1"), ("I", "1"), ("S", "5")]
MORE_SIGNS = [("B", "8"), ("MY", "MG")]
WRITTEN = r"(?i)^([A-Z\d.]+)\s*(MG|MY|MCG|G|ML|%|UNIT|UNITS)?(.*)$"


def known_strengths(dosages: DataFrame, entries: DataFrame) -> DataFrame:
    """(code, strength, place): the strengths of every code of `entries` (code, text, kind), in order of their numbers, then as written.

    Those of `dosages` (code, strength) where there are any; else what the names of clinical and branded drugs (SCD, SBD) that begin with the code's first word say. All such names
    are read.
    """
    number = F.coalesce(F.regexp_extract(F.replace(F.replace("strength", F.lit(" MG"), F.lit("")), F.lit(" MCG"), F.lit("")), r"^\s*(-?[\d.]+)", 1).try_cast("double"), F.lit(0.0))
    listed = dosages.where("code is not null and strength is not null").select("code", "strength").distinct().withColumn("number", number)
    low, pattern = F.lower("text"), r"(?i)(\d+(?:\.\d+)?)\s*(MG|MCG|G|ML|%)"
    base = entries.groupBy("code").agg(F.min(low).alias("name")).join(listed.select("code").distinct(), "code", "left_anti").select("code", F.split("name", " ")[0].alias("word"))
    named = entries.where(F.col("kind").isin("SCD", "SBD") & low.contains(" ") & F.col("text").rlike(pattern))
    named = named.select(F.split(low, " ")[0].alias("word"), F.regexp_extract("text", pattern, 1).alias("n"), F.upper(F.regexp_extract("text", pattern, 2)).alias("unit")).distinct()
    said = base.join(named, "word").select("code", F.concat_ws(" ", "n", "unit").alias("strength"), F.col("n").cast("double").alias("number")).distinct()
    order = Window.partitionBy("code").orderBy("number", "strength")  # the strengths of one drug
    return listed.unionByName(said).withColumn("place", F.row_number().over(order)).select("code", "strength", "place")


def read_strength(strength: Column) -> Column:
    """A strength as it is compared: capitals, digits for what scanners read, one blank before its unit."""
    up = F.upper(F.trim(strength))
    swap = lambda c, pairs: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)
    number, unit, rest = (F.regexp_extract(up, WRITTEN, k) for k in (1, 2, 3))
    parts = F.concat(swap(number, DIGITS), F.lit(" "), F.when(unit == "MY", "MG").otherwise(unit), rest)
    out = F.trim(F.when(up.rlike(WRITTEN), parts).otherwise(swap(up, DIGITS + MORE_SIGNS)))
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"(\d+)(MG|MCG|G|ML|%)", "$1 $2")


def validated_strengths(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(code, strength, valid, boost) of each distinct pair asked: the first known strength that matches counts: .20 as written, .18 with the same number and both in MG or both in MCG, .10 with the
    same number; none is not valid."""
    a = asked.select("code", "strength").distinct().withColumn("said", read_strength(F.col("strength")))
    k = known.select(F.col("code").alias("k"), F.upper(F.trim("strength")).alias("told"), "place")
    number = lambda c: F.regexp_extract(c, r"([\d.]+)", 1).try_cast("double")
    both = lambda unit: F.col("said").contains(unit) & F.col("told").contains(unit)
    boost = F.when(F.col("said") == F.col("told"), 0.20).when(number("said") == number("told"), F.when(both("MG") | both("MCG"), 0.18).otherwise(0.10))
    hit = a.where("strength <> ''").join(k, F.col("code") == F.col("k")).withColumn("boost", boost).where("boost is not null").groupBy("code", "strength").agg(F.min_by("boost", "place").alias("boost"))
    out = a.join(hit, ["code", "strength"], "left")
    return out.select("code", "strength", F.col("boost").isNotNull().alias("valid"), F.coalesce("boost", F.lit(0.0)).alias("boost"))
