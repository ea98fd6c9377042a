"""Findings by place, results read from table rows, structured records, progress of jobs, and how far back a history is read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.tables import first_match

# What stands for a result that was not reported.
NOT_REPORTED = ["dnr", "did not report", "not reported", "not performed", "tnp", "qns", "quantity not sufficient", "cancelled", "see note", "see comment", "pending"]


def enrich_findings(findings: DataFrame, key: str, text: str, critical: Sequence[tuple[str, str]], places: Sequence[tuple[str, str]], follow: Sequence[tuple[str, str]]) -> DataFrame:
    """One row a document: counts of findings, of those with a place and of those with a follow-up, kinds of critical findings,
    confidence (.8 with any finding, else .5) and whether review is asked for. Null texts are no findings.

    Kinds come from a fixed list, so the set a document keeps is bounded whatever the number of its findings.
    """
    t = F.col(text)
    f = findings.select(key, t.isNotNull().alias("known"), *[first_match(t, rules).alias(name) for name, rules in (("critical", critical), ("place", places), ("advice", follow))])
    g = f.groupBy(key).agg(F.count_if("known").alias("n_findings"), F.count("place").alias("n_places"), F.count("advice").alias("n_advice"), F.array_join(F.array_sort(F.collect_set("critical")), ",").alias("critical"))
    return g.withColumn("confidence", F.when(F.col("n_findings") > 0, 0.8).otherwise(0.5)).withColumn("review", F.col("critical") != "")


def table_results(rows: DataFrame, key: str, order: str, name: Column, value: Column, usable: Column) -> DataFrame:
    """(key, name, value, confidence) of a document's table rows: the last usable row of a name wins; .80 and .01 a name, at most .95.

    The names of a document are counted by a second aggregate over one row a name and joined back, so no document's rows are gathered.
    """
    kept = rows.where(F.coalesce(usable, F.lit(False)) & value.isNotNull()).select(key, name.alias("name"), value.alias("value"), order)
    last = kept.groupBy(key, "name").agg(F.max_by("value", order).alias("value"))
    sure = last.groupBy(key).agg(F.least(F.lit(0.95), 0.80 + F.count("*") * 0.01).alias("confidence"))
    return last.join(sure, key)


def reported(value: Column) -> Column:
    """Whether a value is there and was reported; one letter before "dnr" is taken for a page's margin."""
    v = F.lower(F.trim(value))
    return F.coalesce((v != "") & ~v.isin("null", "none") & ~F.regexp_replace(v, "^[a-z](?=dnr)", "").isin(*NOT_REPORTED), F.lit(False))


def completeness(fields: Sequence[Column]) -> Column:
    """.5, and .5 times the share of the fields that are filled, to two places."""
    return F.round(0.5 + 0.5 * sum((F.coalesce(f != "", F.lit(False)).cast("int") for f in fields), F.lit(0)) / len(fields), 2)


def structured_tests(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the reported (name, value, unit, range) rows of a document, the fullest of each name and value; the first wins a tie; of rows
    that `order` does not tell apart, the one of the greater unit, then range (null as empty)."""
    r = rows.where(reported(F.col("value")) & F.coalesce(F.col("name") != "", F.lit(False))).withColumn("confidence", completeness([F.col(c) for c in ("value", "unit", "range")]))
    same = [F.lower(F.trim(c)).alias(f"__{c}") for c in ("name", "value")]
    best = F.max_by(F.struct(order, "name", "value", "unit", "range", "confidence"), F.struct("confidence", -F.col(order), *[F.coalesce(c, F.lit("")) for c in ("unit", "range")])).alias("b")
    return r.groupBy(key, *same).agg(best).select(key, "b.*")


def progress(events: DataFrame, job: str, stage: Column, order: Sequence[str]) -> DataFrame:
    """Where each job stands: its last stage and how many stage events it had. Works on a table or a stream (in update mode)."""
    return events.groupBy(job).agg(F.max_by(stage, F.struct(*order)).alias("stage"), F.count("*").alias("steps"))


def looked_back(history: DataFrame, time: str, as_of: Column, days: int = 365) -> DataFrame:
    """Rows of at most `days` before `as_of`, and none after it."""
    return history.where((F.col(time) <= as_of) & (F.col(time) >= as_of - F.make_dt_interval(F.lit(days))))
