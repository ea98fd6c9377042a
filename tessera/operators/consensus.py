"""Agreement of several sources about fields: votes, priorities, merges, grading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFIDENCE = {"unanimous": 0.98, "majority": 0.92, "minority": 0.75, "conflict": 0.50}


def normalised(value: Column) -> Column:
    """What is voted on: a number to two places, or the trimmed text in lower case."""
    number = F.replace(value, F.lit(","), F.lit("")).try_cast("double")
    return F.coalesce(F.round(number, 2).cast("string"), F.lower(F.trim(value)))


def vote(rows: DataFrame, key: Sequence[str], method: str, value: str, priority: Column) -> DataFrame:
    """One row a key: winning value (most votes, then first by priority), its level of agreement, confidence and review flag.

    Two aggregates: votes of a (key, value), then the best value of a key; no key's rows are gathered.
    """
    p = rows.withColumn("__p", priority)
    votes = p.groupBy(*key, value).agg(F.countDistinct(method).alias("votes"), F.min("__p").alias("first"))
    best = votes.groupBy(*key).agg(F.max_by(F.struct(value, "votes"), F.struct("votes", -F.col("first"))).alias("b"), F.count("*").alias("n_values"), F.sum("votes").alias("n_votes"))
    top = F.col("b.votes")
    agreement = F.when((F.col("n_values") == 1) & (F.col("n_votes") > 1), "unanimous").when(top * 2 > F.col("n_votes"), "majority").when(top > 1, "minority").otherwise("conflict")
    out = best.select(*key, F.col(f"b.{value}").alias(value), agreement.alias("agreement"), top.alias("votes"))
    confidence = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.col("agreement"))
    return out.withColumn("confidence", confidence).withColumn("needs_review", F.col("agreement").isin("minority", "conflict"))


def grade(truth: DataFrame, found: DataFrame, key: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """(key, outcome) of truth and found values: correct, incorrect, missing or extra; numbers agree within a relative tolerance."""
    j = truth.join(found, list(key), "full_outer")
    t, v = F.col("truth"), F.col("found")
    same = F.when(t == 0, F.abs(v) <= tolerance).otherwise(F.abs(v - t) <= F.abs(t) * tolerance)
    outcome = F.when(v.isNull(), "missing").when(t.isNull(), "extra").when(same, "correct").otherwise("incorrect")
    return j.withColumn("outcome", outcome)


def scores(graded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of graded rows; 0 where nothing is to divide by."""
    n = {o: F.count_if(F.col("outcome") == o) for o in ("correct", "incorrect", "missing", "extra")}
    g = graded.groupBy(*by).agg(*[c.alias(o) for o, c in n.items()])
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = F.col("correct")
    g = g.withColumn("precision", zero(c, c + F.col("incorrect") + F.col("extra"))).withColumn("recall", zero(c, c + F.col("incorrect") + F.col("missing")))
    return g.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def merged_maps(left: Column, right: Column) -> Column:
    """Right wins; keys that begin with '_' are dropped."""
    both = F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)
    return F.map_filter(both, lambda k, v: ~k.startswith("_"))


def most_complete(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The fullest row with a value of each key: 10 for the value, 2 for unit and range, 1 for a flag; the first wins a tie."""
    score = sum((F.when(F.col(c).isNotNull(), w).otherwise(0) for c, w in (("value", 10), ("unit", 2), ("range", 2), ("flag", 1))), F.lit(0))
    w = Window.partitionBy(*key).orderBy(score.desc(), order)
    return rows.where("value is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
