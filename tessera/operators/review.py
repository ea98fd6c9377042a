"""Confidence scores, levels and review decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_scores(scores: Column) -> Column:
    return F.filter(scores, lambda s: (s >= 0) & (s <= 1))


def combine(scores: Column, method: str, weights: Column | None = None) -> Column:
    """minimum, average, weighted, harmonic or product of an array's scores in [0, 1]; 0 without any.

    Weights count only if there is one for every valid score; else the plain average is taken.
    """
    v = valid_scores(scores)
    n = F.size(v)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    mean = total(v) / n
    out = {
        "minimum": lambda: F.array_min(v),
        "average": lambda: mean,
        "weighted": lambda: F.when((F.size(weights) == n) & (total(weights) > 0), total(F.zip_with(v, weights, lambda a, b: a * b)) / total(weights)).otherwise(mean),
        "harmonic": lambda: F.when(F.array_min(v) == 0, 0.0).otherwise(n / F.aggregate(v, F.lit(0.0), lambda x, y: x + F.try_divide(F.lit(1.0), y))),
        "product": lambda: F.aggregate(v, F.lit(1.0), lambda x, y: x * y),
    }[method]()
    return F.when(n == 0, 0.0).otherwise(out)


def weighted(parts: Sequence[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are not null."""
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    low = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.when(low > 0, top / low).otherwise(0.0)


def level(confidence: Column, high: float = 0.85, medium: float = 0.70) -> Column:
    return F.when(confidence >= high, "high").when(confidence >= medium, "medium").otherwise("low")


def extraction(template: Column, quality: Column, validated: Column, conflict: Column) -> Column:
    base = combine(F.array(template, quality), "harmonic")
    return F.when(conflict, F.least(base, F.lit(0.5))).when(validated.isNull(), base).when(validated, F.least(base * 1.1, F.lit(1.0))).otherwise(base * 0.6)


def review_priority(confidence: Column, conflicts: Column, critical: Column, flags: Column) -> Column:
    """low (no review), medium, high or critical; three flags or more make it high, whatever came before."""
    p = F.when(critical, "critical").when(conflicts, "high").when(level(confidence) == "low", "medium").otherwise("low")
    return F.when(flags >= 3, "high").when((flags > 0) & (p == "low"), "medium").otherwise(p)


def review_reasons(confidence: Column, conflicts: Column, critical: Column, flags: Column) -> Column:
    return F.array_compact(F.array(F.when(level(confidence) == "low", "low_confidence"), F.when(conflicts, "validation_conflict"), F.when(critical, "critical_findings"), F.when(flags > 0, F.concat(F.lit("quality_flags ("), flags.cast("string"), F.lit(")")))))


def stage_confidence(least: Column, conflicts: Column, flags: Column, warnings: Column, rejected: Column) -> Column:
    c = least - 0.1 * conflicts - 0.05 * flags - 0.02 * warnings
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(rejected, F.least(c, F.lit(0.3))).otherwise(c)))


def signal_score(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of signal times weight over the sum of all weights, cut to [0, 1]; a signal without a weight counts nothing."""
    top = sum((F.coalesce(c, F.lit(0.0)) * weights.get(k, 0.0) for k, c in signals.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), top / sum(weights.values())))


def item_priority(critical: Column, conflict: Column, confidence: Column, warnings: Column, flag: Column) -> Column:
    return F.when(critical, 100).otherwise(0) + F.when(conflict, 50).otherwise(0) + F.when(confidence < 0.7, 30).otherwise(0) + 20 * warnings + F.when(flag.isin("H", "L"), 10).otherwise(0)


def queue_priority(status: Column, confidence: Column, critical: Column) -> Column:
    """The first that holds: failed, below .5 (both CRITICAL), below .7 (HIGH), critical findings (CRITICAL), else MEDIUM."""
    return F.when(status == "failed", "CRITICAL").when(confidence < 0.5, "CRITICAL").when(confidence < 0.7, "HIGH").when(critical, "CRITICAL").otherwise("MEDIUM")


def in_order(value: Column, names: Sequence[str]) -> Column:
    """Place of a value in a list; those not listed come after."""
    p = F.array_position(F.array(*map(F.lit, names)), value)
    return F.when(p == 0, len(names) + 1).otherwise(p)
