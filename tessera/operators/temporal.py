"""Series analytics: trends, drops, rises, normalisations, significance, quality-ranked duplicates.

A series is the rows of one key (say, patient and test) in time order, ties by a sequence column. Whole days are
elapsed 24-hour periods, not calendar dates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RISING, FALLING, STABLE = "rising", "falling", "stable"
URGENCY = {"critical": "immediate", "high": "urgent", "medium": "routine", "low": "routine"}


def whole_days(start: Column, end: Column) -> Column:
    return F.timestamp_diff("DAY", start, end)


def direction(slope: Column, flat: float = 0.01) -> Column:
    return F.when(slope > flat, RISING).when(slope < -flat, FALLING).otherwise(STABLE)


def trends(points: DataFrame, key: Sequence[str], ts: str = "ts", value: str = "value", seq: str | None = None, least_points: int = 3) -> DataFrame:
    """Line fit of each series with enough points: n, slope a day, intercept, r2 (0 for constant values), first and last.

    The first time of each series is an aggregate with map-side combine that is joined back, so a long series may be split.
    """
    seq = seq or ts
    p = points.where(F.col(value).isNotNull())
    first = p.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.min(ts).alias("__first"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    p = p.join(first, same).withColumn("day", whole_days(F.col("__first"), F.col(ts)).cast("double"))
    order = F.struct(F.col(ts), F.col(seq))
    a = p.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.coalesce(F.regr_slope(value, "day"), F.lit(0.0)).alias("slope"),
        F.avg(value).alias("mean_value"),
        F.avg("day").alias("mean_day"),
        F.when(F.var_pop(value) == 0, 0.0).otherwise(F.coalesce(F.regr_r2(value, "day"), F.lit(0.0))).alias("r2"),
        F.min_by(value, order).alias("first_value"),
        F.max_by(value, order).alias("last_value"),
        F.max("day").cast("long").alias("days"),
    )
    a = a.where(F.col("n") >= least_points)
    change = F.col("last_value") - F.col("first_value")
    return a.select(
        *key,
        "n",
        "slope",
        (F.col("mean_value") - F.col("slope") * F.col("mean_day")).alias("intercept"),
        F.least(F.greatest("r2", F.lit(0.0)), F.lit(1.0)).alias("r2"),
        direction(F.col("slope")).alias("direction"),
        F.when(F.col("days") > 0, change / F.col("days")).otherwise(0.0).alias("rate"),
        F.when(F.col("first_value") == 0, 0.0).otherwise(change / F.col("first_value") * 100).alias("pct"),
        "days",
    )


def detected(found: DataFrame, least_r2: float = 0.5, least_pct: float = 5.0) -> DataFrame:
    return found.where((F.col("r2") >= least_r2) & (F.abs("pct") >= least_pct))


def series_window(key: Sequence[str], ts: str, seq: str) -> Window:
    return Window.partitionBy(*key).orderBy(ts, seq)


def acute_drop(points: DataFrame, key: Sequence[str], ts: str = "ts", seq: str = "event_id", value: str = "value", drop: float = -2.0, within_days: int = 30) -> DataFrame:
    w = series_window(key, ts, seq)
    p = points.withColumn("prev", F.lag(value).over(w)).withColumn("gap_days", whole_days(F.lag(ts).over(w), F.col(ts)))
    return p.where((F.col(value) - F.col("prev") < drop) & (F.col("gap_days") <= within_days))


def monotone_rise(points: DataFrame, key: Sequence[str], ts: str = "ts", seq: str = "event_id", value: str = "value", chronological: bool = True) -> DataFrame:
    """Rows at which the three values before and this one rise.

    With `chronological` off, the earlier three are compared newest first (each older one is greater), and the row must top all.
    """
    w = series_window(key, ts, seq)
    a, b, c = (F.lag(value, k).over(w) for k in (1, 2, 3))
    v = F.col(value)
    rises = (c < b) & (b < a) & (a < v) if chronological else (a < b) & (b < c) & (c < v)
    return points.withColumn("rises", rises).where("rises").drop("rises")


def sudden_normalisation(points: DataFrame, key: Sequence[str], low: Column, high: Column, ts: str = "ts", seq: str = "event_id", value: str = "value", pct: float = 50.0) -> DataFrame:
    """Rows back inside [low, high] by a jump of over `pct` per cent from a value outside; a bound of 0 switches it off."""
    w = series_window(key, ts, seq)
    prev = F.lag(value).over(w)
    p = points.withColumn("prev", prev).withColumn("pct", F.try_divide(F.col(value) - prev, prev) * 100)
    inside = (F.col(value) >= low) & (F.col(value) <= high) & (low != 0) & (high != 0)
    return p.where((F.abs("pct") > pct) & inside & ((F.col("prev") < low) | (F.col("prev") > high)))


def dispatch(points: DataFrame, key: Sequence[str], low: Column, high: Column, ts: str = "ts", seq: str = "event_id", value: str = "value") -> DataFrame:
    """The first rule each row meets, in the order acute drop, steady rise, sudden normalisation; needs two earlier values."""
    w = series_window(key, ts, seq)
    v, a, b, c = F.col(value), F.lag(value).over(w), F.lag(value, 2).over(w), F.lag(value, 3).over(w)
    near = whole_days(F.lag(ts).over(w), F.col(ts)) <= 30
    acute = (v - a < -2.0) & near
    rise = (c < b) & (b < a) & (a < v)
    normal = (F.abs(F.try_divide(v - a, a) * 100) > 50) & v.between(low, high) & ((a < low) | (a > high))
    rule = F.when(acute, "acute_drop").when(rise, "chronic_rise").when(normal, "sudden_normalisation")
    return points.withColumn("earlier", F.row_number().over(w) - 1).withColumn("rule", rule).where("rule is not null and earlier >= 2").drop("earlier")


def deltas(points: DataFrame, key: Sequence[str], ts: str = "ts", seq: str = "event_id", value: str = "value") -> DataFrame:
    prev = F.lag(value).over(series_window(key, ts, seq))
    p = points.withColumn("prev", prev)
    return p.withColumn("delta", F.col(value) - F.col("prev")).withColumn("delta_pct", F.when(F.col("prev") == 0, 0.0).otherwise((F.col(value) - F.col("prev")) / F.col("prev") * 100))


def last_n(points: DataFrame, key: Sequence[str], n: int = 10, ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """The latest n rows of each key, `recency` 1 being the newest."""
    w = Window.partitionBy(*key).orderBy(F.desc(ts), F.desc(seq))
    return points.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def significance(patterns: DataFrame, rules: DataFrame, test: str = "test", kind: str = "kind", change: str = "change", default: str = "medium") -> DataFrame:
    """Severity and urgency of each pattern: its rule with the greatest threshold below the change, else the rule without one.

    `rules` (test, kind, threshold or null, severity) is a knowledge table; its size is that of the rule book, so it is broadcast.
    """
    r = rules.groupBy(F.col("test").alias("__t"), F.col("kind").alias("__k")).agg(F.collect_list(F.struct(F.col("threshold").alias("over"), F.col("severity").alias("says"))).alias("__r"))
    cols = patterns.columns
    j = patterns.join(F.broadcast(r), (F.col(test) == F.col("__t")) & (F.col(kind) == F.col("__k")), "left")
    fits = F.filter("__r", lambda x: x["over"].isNull() | (F.abs(change) > x["over"]))
    best = F.array_max(F.transform(fits, lambda x: F.struct(F.coalesce(x["over"], F.lit(-1.0)).alias("over"), x["says"].alias("says"))))
    severity = F.coalesce(best["says"], F.lit(default))
    urgency = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in URGENCY.items() for x in kv]), severity), F.lit("routine"))
    return j.select(*cols, severity.alias("severity"), urgency.alias("urgency"))


def best_per_field(rows: DataFrame, key: Sequence[str], score: Column, seq: str) -> DataFrame:
    """The row of best score of each key; the first wins a tie."""
    w = Window.partitionBy(*key).orderBy(score.desc(), F.col(seq))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def document_order(rows: DataFrame, key: Sequence[str], page: str, row: str, box_top: str, label: str) -> DataFrame:
    """Position of each row of a key: page (0 if null), then row index, box top, or the number in 'Row n' (else last)."""
    named = F.expr(f"try_cast(regexp_extract({label}, 'Row ([0-9]+)', 1) as double)")
    place = F.coalesce(F.col(row).cast("double"), F.col(box_top), named, F.lit(float("inf")))
    w = Window.partitionBy(*key).orderBy(F.coalesce(F.col(page), F.lit(0)), place, label)
    return rows.withColumn("position", F.row_number().over(w))
