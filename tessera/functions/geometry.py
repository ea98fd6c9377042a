"""Boxes as structs (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")
SOURCE_WEIGHTS = {"table": 0.95, "pdfplumber": 0.93, "camelot": 0.85, "ocr": 0.8, "merged": 0.75, "medgemma": 0.6}


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip((x0, y0, x1, y1), SIDES)])


def is_valid(b: Column) -> Column:
    finite = F.lit(True)
    for s in SIDES:
        finite = finite & b[s].isNotNull() & ~F.isnan(b[s]) & (F.abs(b[s]) != float("inf"))
    return F.coalesce(finite & (b["x0"] <= b["x1"]) & (b["y0"] <= b["y1"]), F.lit(False))


def in_order(b: Column) -> Column:
    return box(F.least(b["x0"], b["x1"]), F.least(b["y0"], b["y1"]), F.greatest(b["x0"], b["x1"]), F.greatest(b["y0"], b["y1"]))


def normalise(b: Column, width: Column, height: Column, from_bottom: bool = False) -> Column:
    """To shares of the page, sides in order and cut to [0, 1]."""
    y0, y1 = b["y0"] / height, b["y1"] / height
    n = in_order(box(b["x0"] / width, 1 - y1 if from_bottom else y0, b["x1"] / width, 1 - y0 if from_bottom else y1))
    cut = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.when((width > 0) & (height > 0), box(*[cut(n[s]) for s in SIDES]))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where neither has an area."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def confidence(b: Column, source: Column, extraction: Column) -> Column:
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHTS.items() for x in kv]), F.lower(source)), F.lit(0.5))
    return F.when(is_valid(b), weight * F.when(area(b) < 0.0001, 0.5).when(area(b) > 0.5, 0.7).otherwise(1.0) * extraction).otherwise(0.0)
