"""Row and group validation: plausibility, reference and critical ranges, units, cross-field rules, conflicting verdicts.

Dictionaries are small fixed tables (`tessera.knowledge`) and are broadcast; every rule is a column expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_ranges(rows: DataFrame, plausible: DataFrame, test: str = "test") -> DataFrame:
    """Adds min_ok, max_ok, unit_ok (null for unknown tests)."""
    return rows.join(F.broadcast(plausible.withColumnRenamed("test", "__t")), F.col(test) == F.col("__t"), "left").drop("__t")


def is_plausible(value: Column, unit: Column, check_unit: bool = True) -> Column:
    """Unknown tests pass; else the unit must match (if checked) and the value lie in range."""
    ok = value.between(F.col("min_ok"), F.col("max_ok"))
    if check_unit:
        ok = ok & F.coalesce(unit == F.col("unit_ok"), F.lit(False))
    return F.when(F.col("min_ok").isNull(), True).otherwise(ok)


def implausible_reason(value: Column, unit: Column) -> Column:
    return (
        F.when(F.col("min_ok").isNull(), F.lit(None).cast("string"))
        .when(~F.coalesce(unit == F.col("unit_ok"), F.lit(False)), F.concat(F.lit("unit "), unit, F.lit(" is not "), F.col("unit_ok")))
        .when(value < F.col("min_ok"), "below range")
        .when(value > F.col("max_ok"), "above range")
    )


def decimal_correction(value: Column) -> Column:
    """A tenth or hundredth of a value above range, ten times one below, if that lies in range."""
    lo, hi = F.col("min_ok"), F.col("max_ok")
    return F.when((value > hi) & (value / 10).between(lo, hi), value / 10).when((value > hi) & (value / 100).between(lo, hi), value / 100).when((value < lo) & (value * 10).between(lo, hi), value * 10)


def with_reference(rows: DataFrame, reference: DataFrame, test: str = "test", group: str = "sex") -> DataFrame:
    """Adds ref_low and ref_high: the group's range, else 'adult', else 'male'; null if the test has none of these."""
    r = reference.groupBy("test").pivot("grp", ["male", "female", "adult", "fasting"]).agg(F.first(F.struct("low", "high")))
    j = rows.join(F.broadcast(r.withColumnRenamed("test", "__t")), F.col(test) == F.col("__t"), "left")
    own = F.when(F.col(group) == "male", F.col("male")).when(F.col(group) == "female", F.col("female")).when(F.coalesce(F.col(group), F.lit("adult")) == "adult", F.col("adult")).when(F.col(group) == "fasting", F.col("fasting"))
    pick = F.coalesce(own, "adult", "male")
    return j.withColumn("__r", pick).withColumn("ref_low", F.col("__r.low")).withColumn("ref_high", F.col("__r.high")).drop("__t", "__r", "male", "female", "adult", "fasting")


def with_critical(rows: DataFrame, critical: DataFrame, test: str = "test") -> DataFrame:
    return rows.join(F.broadcast(critical.withColumnRenamed("test", "__t")), F.col(test) == F.col("__t"), "left").drop("__t")


def is_critical(value: Column) -> Column:
    return F.coalesce((value < F.col("crit_low")) | (value > F.col("crit_high")), F.lit(False))


def reference_flag(value: Column) -> Column:
    """N, L, H or CRITICAL LOW / CRITICAL HIGH; null without a range."""
    return (
        F.when(F.col("ref_low").isNull(), F.lit(None).cast("string"))
        .when(value < F.col("ref_low"), F.when(value < F.col("crit_low"), "CRITICAL LOW").otherwise("L"))
        .when(value > F.col("ref_high"), F.when(value > F.col("crit_high"), "CRITICAL HIGH").otherwise("H"))
        .otherwise("N")
    )


def rule_validate(rows: DataFrame, plausible: DataFrame, reference: DataFrame, critical: DataFrame, value: str = "value", unit: str = "unit") -> DataFrame:
    """valid, flag and warnings of each row; an implausible value stops there, as later rules mean nothing for it."""
    r = with_critical(with_reference(with_ranges(rows, plausible), reference), critical)
    v, u = F.col(value), F.col(unit)
    in_range = F.when(F.col("min_ok").isNull(), True).otherwise(v.between(F.col("min_ok"), F.col("max_ok")))
    unit_fits = F.coalesce(u == F.col("unit_ok"), F.lit(True))
    flag = reference_flag(v)
    flag = F.when(is_critical(v) & ~F.coalesce(flag.startswith("CRITICAL"), F.lit(False)), "CRITICAL").otherwise(flag)
    r = r.withColumn("plausible", in_range & unit_fits)
    warnings = F.when(
        F.col("plausible"),
        F.array_compact(F.array(F.when(F.coalesce(reference_flag(v).startswith("CRITICAL"), F.lit(False)), "critical flag"), F.when(is_critical(v), "critical value"))),
    ).otherwise(F.array_compact(F.array(F.lit("implausible"), F.when(decimal_correction(v).isNotNull(), "correction"))))
    return r.withColumn("flag", F.when(F.col("plausible"), flag)).withColumn("warnings", warnings).withColumn("valid", F.col("plausible"))


def wide(rows: DataFrame, key: list[str], test: str, value: str, tests: list[str]) -> DataFrame:
    """One row a key with a column a test (the greatest value)."""
    return rows.groupBy(*key).agg(*[F.max(F.when(F.col(test) == t, F.col(value))).alias(t) for t in tests])


def cross_field(rows: DataFrame, a: str, b: str, factor: float = 1.0, tolerance: float = 0.15) -> DataFrame:
    """Rows whose b differs from factor * a by more than the tolerance (0 expected: not judged)."""
    off = F.abs(F.try_divide(F.col(b) - F.col(a) * factor, F.col(a) * factor))
    return rows.withColumn("off", off).where(F.col("off") > tolerance)


def gap_outside(rows: DataFrame, a: str, b: str, low: float, high: float) -> DataFrame:
    """Rows whose a - b lies outside [low, high]; values of 0 count as missing."""
    gap = F.when((F.col(a) != 0) & (F.col(b) != 0), F.col(a) - F.col(b))
    return rows.withColumn("gap", gap).where((F.col("gap") < low) | (F.col("gap") > high))


def first_hit(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds, else null."""
    out = None
    for name, rule in rules:
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out


def resolve_conflict(rule_ok: Column, other_ok: Column, confidence: Column, implausible: Column, review_below: float = 0.7, trust_above: float = 0.85) -> Column:
    """What two verdicts (true, false or null) come to: agreement counts nulls as equal, and null agreement rejects."""
    return (
        F.when(rule_ok.eqNullSafe(other_ok), F.when(F.coalesce(rule_ok, F.lit(False)), "ACCEPT_BOTH").otherwise("REJECT_BOTH"))
        .when(confidence < review_below, "HUMAN_REVIEW")
        .when(rule_ok.eqNullSafe(False) & implausible, "ACCEPT_RULE")
        .when(other_ok.eqNullSafe(False) & (confidence > trust_above), "ACCEPT_OTHER")
        .when(rule_ok.eqNullSafe(False) & other_ok.eqNullSafe(True) & (confidence > trust_above), "ACCEPT_OTHER")
        .otherwise("HUMAN_REVIEW")
    )


def suspicious(rows: DataFrame, key: list[str], value: str, unit: str, least: int = 3) -> DataFrame:
    """Per key: too few values, no unit at all, or more than five values with fewer than three distinct."""
    g = rows.groupBy(*key).agg(F.count(value).alias("n"), F.count_if(F.col(unit).isNotNull() & (F.col(unit) != "")).alias("n_units"), F.countDistinct(value).alias("n_distinct"))
    return g.withColumn("suspicious", (F.col("n") < least) | (F.col("n_units") == 0) | ((F.col("n") > 5) & (F.col("n_distinct") < 3)))


def peers(rows: DataFrame, key: list[str], order: list[str], value: str, most: int = 5) -> DataFrame:
    """Up to `most` other values of the key before each row, oldest first (context for a second opinion)."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-most, -1)
    return rows.withColumn("peers", F.collect_list(value).over(w))


def dual_validation(rules: DataFrame, model: DataFrame, key: Sequence[str], dual: bool = True) -> DataFrame:
    """(key, rule_ok, model_ok, conflict, rejected, warnings) of every value that either side has judged.

    rules: key, ok; model: key, ok; each one row a key. A side without a verdict on a value says null. They conflict where both have judged and disagree; a value is rejected
    where none that has judged accepts it: false and false, false and null, null and false. With `dual` off only the rules count: their false rejects and nothing conflicts.
    A conflict and a rejection each leave a warning.
    """
    j = rules.select(*key, F.col("ok").alias("rule_ok")).join(model.select(*key, F.col("ok").alias("model_ok")), list(key), "full_outer")
    if not dual:
        j = j.withColumn("model_ok", F.lit(None).cast("boolean"))
    conflict = F.coalesce(F.col("rule_ok") != F.col("model_ok"), F.lit(False))
    rejected = ~(F.coalesce("rule_ok", F.lit(False)) | F.coalesce("model_ok", F.lit(False))) & (F.col("rule_ok").isNotNull() | F.col("model_ok").isNotNull())
    said = lambda c: F.when(F.col(c), "True").otherwise("False")
    clash = F.when(conflict, F.concat(F.lit("Validation conflict: rules="), said("rule_ok"), F.lit(", AI="), said("model_ok")))
    told = F.array_compact(F.array(clash, F.when(rejected, "Failed validation - verify manually")))
    return j.select(*key, "rule_ok", "model_ok", conflict.alias("conflict"), rejected.alias("rejected"), told.alias("warnings"))


def validation_summary(judged: DataFrame, by: Sequence[str]) -> DataFrame:
    """Values, conflicts and rejections of a document, and confidence: 1 less .1 a conflict and .2 a rejection, between 0 and 1."""
    g = judged.groupBy(*by).agg(F.count("*").alias("n_values"), F.count_if("conflict").alias("n_conflicts"), F.count_if("rejected").alias("n_rejected"))
    return g.withColumn("confidence", F.greatest(F.lit(0.0), F.round(1 - F.col("n_conflicts") * 0.1 - F.col("n_rejected") * 0.2, 9)))
