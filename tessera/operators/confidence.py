"""Confidence of contexts, pipelines and readings, routing to review, merged classes and resolved dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import iso_date
from tessera.operators.review import level, weighted

REVIEW_BELOW = 0.70


def context(classification: Column, extraction: Column, validation: Column) -> Column:
    """A quarter classification, half extraction (the mean of confidences above 0), a quarter validation, which is the extraction's
    where it is missing; parts that are null do not count."""
    return weighted([(classification, 0.25), (extraction, 0.50), (F.coalesce(validation, extraction), 0.25)])


def context_level(confidence: Column, conflict: Column) -> Column:
    return F.when(conflict, "conflict").otherwise(level(confidence))


def pipeline(extraction: Column, classification: Column, reading: Column, enrichment: Column) -> Column:
    """Mean of the parts above 0, weights 5, 2, 1 and 2; a half without any."""
    parts = [(F.when(c > 0, c), float(w)) for c, w in ((extraction, 5), (classification, 2), (reading, 1), (enrichment, 2))]
    return F.round(F.when(F.coalesce(*[c for c, _ in parts]).isNull(), 0.5).otherwise(weighted(parts)), 3)


def validation(conflicts: Column, rejections: Column) -> Column:
    return F.greatest(F.least(1 - 0.1 * conflicts - 0.2 * rejections, F.lit(1.0)), F.lit(0.0))


def reading(base: Column, short_pages: Column, pages: Column) -> Column:
    """How sure a text is: its method's base, less up to .3 for pages with little text; between .1 and 1."""
    return F.greatest(F.least(base - 0.3 * short_pages / F.greatest(pages, F.lit(1)), F.lit(1.0)), F.lit(0.1))


def content(sections: Sequence[tuple[Column, Column, int]], coverage: Column) -> Column:
    """Mean confidence of the sections that have items, each weighed by its number of items up to a cap, and .03 more a section (up to
    .15); times the share of the expected items that were found. .2 without any section.

    `sections`: mean confidence, number of items, cap.
    """
    there = [n > 0 for _, n, _ in sections]
    weight = [F.when(t, F.least(n, F.lit(cap))).otherwise(0) for t, (_, n, cap) in zip(there, sections)]
    total = sum(weight, F.lit(0))
    mean = sum((F.when(t, c * w).otherwise(0.0) for t, (c, _, _), w in zip(there, sections, weight)), F.lit(0.0)) / F.nullif(total, F.lit(0))
    bonus = F.least(F.lit(0.15), 0.03 * sum((t.cast("int") for t in there), F.lit(0)))
    return F.round(F.when(total == 0, 0.2).otherwise(F.least(mean + bonus, F.lit(1.0)) * coverage), 3)


def coverage(found: Sequence[tuple[Column, Column, int]]) -> Column:
    """Share of the items a text makes one expect, by the kind of which it promises most; 1 where no kind promises enough.

    `found`: items found, items expected, and the number above which an expectation counts.
    """
    sure = [F.when((e > least) & (n > 0), F.struct(e.alias("expected"), (-F.lit(i)).alias("place"), F.least(n / e, F.lit(1.0)).alias("share"))) for i, (n, e, least) in enumerate(found)]
    return F.coalesce(F.array_max(F.array(*sure))["share"], F.lit(1.0))


def routing(already: Column, confidence: Column, conflicts: Column, rejected: Column, critical: Column, flags: Column) -> Column:
    """struct(review, priority, reasons): every ground adds a reason and may raise the priority; what is under review stays as it is."""
    low = confidence < REVIEW_BELOW
    priority = F.when(already, "low").when(rejected | critical, "critical").when(conflicts | low, "high").when(flags > 0, "medium").otherwise("low")
    why = [(low, F.lit("low confidence")), (conflicts, F.lit("conflicts")), (rejected, F.lit("rejected")), (critical, F.lit("critical findings")), (flags > 0, F.concat(flags.cast("string"), F.lit(" quality flags")))]
    reasons = F.array_compact(F.array(*[F.when(~already & ground, text) for ground, text in why]))
    return F.struct((already | low | conflicts | rejected | critical | (flags > 0)).alias("review"), priority.alias("priority"), reasons.alias("reasons"))


def final(rejected: Column, critical: Column, confidence: Column, conflicts: Column, flags: Column) -> Column:
    """struct(priority, reason): the first ground alone decides."""
    grounds = [
        (rejected, "critical", F.lit("rejected")),
        (critical > 0, "critical", F.concat(critical.cast("string"), F.lit(" critical findings"))),
        (confidence < REVIEW_BELOW, "high", F.lit("low confidence")),
        (conflicts, "high", F.lit("conflicts")),
        (flags > 0, "medium", F.lit("quality flags")),
    ]
    priority, reason = F.lit("low"), F.lit(None).cast("string")
    for ground, p, text in reversed(grounds):
        priority, reason = F.when(ground, p).otherwise(priority), F.when(ground, text).otherwise(reason)
    return F.struct(priority.alias("priority"), reason.alias("reason"))


def merged_classification(kind: Column, category: Column, confidence: Column) -> tuple[Column, Column]:
    """An item's category, filled in by the kind of document where it is empty, and its confidence, lifted in a prescription."""
    own = F.nullif(category, F.lit(""))
    filled = F.when(kind == "lab", F.coalesce(own, F.lit("lab"))).when(kind == "radiology", F.coalesce(own, F.lit("impression"))).otherwise(category)
    return filled, F.when((kind == "prescription") & (confidence < 0.9), F.least(confidence + 0.1, F.lit(0.95))).otherwise(confidence)


def best_method(methods: Sequence[tuple[str, Column, float | None]]) -> Column:
    """struct(method, confidence) of the first method that is there and above its bar (None: any)."""
    out = F.struct(F.lit("none").alias("method"), F.lit(0.0).alias("confidence"))
    for name, best, bar in reversed(methods):
        out = F.when(best.isNotNull() if bar is None else F.coalesce(best > bar, F.lit(False)), F.struct(F.lit(name).alias("method"), best.alias("confidence"))).otherwise(out)
    return out


def mean_of(*parts: Column) -> Column:
    """Mean of the parts that are not null; 0 without any."""
    return weighted([(p, 1.0) for p in parts])


def resolved_dates(rows: DataFrame, doc: str, kind: str, written: str, order: str, kinds: Sequence[str]) -> DataFrame:
    """(doc, date): of the last date of each kind ("Study Date" is study_date), the first in the order of `kinds` that can be read."""
    r = rows.where((F.trim(kind) != "") & (F.trim(written) != "")).withColumn("__k", F.replace(F.lower(F.trim(kind)), F.lit(" "), F.lit("_")))
    last = r.groupBy(doc, "__k").agg(F.max_by(F.trim(written), order).alias("__s"))
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("__k"))
    iso = iso_date(F.col("__s"))
    usable = (place > 0) & iso.isNotNull()
    return last.groupBy(doc).agg(F.min_by(F.when(usable, iso), F.when(usable, place)).alias("date"))
