"""Two readings of one document (by recognition and by a model): how alike they are, and which text and fields are taken."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.consensus import merged_maps

WEIGHTS = {"ocr": 0.4, "vlm": 0.6}


def heaviest_rise(places: list[int], weights: list[int]) -> int:
    """The greatest total weight of a run whose places rise, of items in order (places distinct), by a tree of prefix maxima."""
    order = sorted(places)
    best = [0] * (len(order) + 1)
    for p, w in zip(places, weights):
        i = bisect_left(order, p)
        total, k = w, i
        while k > 0:
            total = max(total, w + best[k])
            k -= k & -k
        k = i + 1
        while k < len(best):
            best[k] = max(best[k], total)
            k += k & -k
    top, k = 0, len(order)
    while k > 0:
        top = max(top, best[k])
        k -= k & -k
    return top


def likeness(rows: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, likeness) of two texts: twice the signs of the lines that they share in order, over the signs of both.

    Lines are taken without case and doubled white space. Lines that stand once in each text are anchors, met by an equi-join of lines; of the anchors the heaviest run that rises in
    both texts counts. Alike texts are 1, a text without any line is unlike anything (0).
    """
    kind = rows.schema[key].dataType.simpleString()
    tidy = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))

    def lines(side: str) -> DataFrame:
        each = rows.select(key, F.posexplode(F.split(side, "\n")).alias("at", "line")).select(key, "at", tidy(F.col("line")).alias("line"))
        return each.where("line <> ''").groupBy(key, F.md5("line").alias("line")).agg(F.count("*").alias("n"), F.min("at").alias("at"), F.first(F.length("line")).alias("size"))

    a, b = lines(left), lines(right)
    sizes = a.select(key, (F.col("n") * F.col("size")).alias("a"), F.lit(0).cast("long").alias("b")).unionByName(b.select(key, F.lit(0).cast("long").alias("a"), (F.col("n") * F.col("size")).alias("b")))
    sizes = sizes.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    anchors = a.where("n = 1").select(key, "line", F.col("at").alias("l"), "size").join(b.where("n = 1").select(key, "line", F.col("at").alias("r")), [key, "line"])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("l")
        return pa.table({key: group[key].slice(0, 1), "shared": pa.array([heaviest_rise(group["r"].to_pylist(), group["size"].to_pylist())], pa.int64())})

    shared = anchors.groupBy(key).applyInArrow(run, f"{key} {kind}, shared long")
    both = (F.col("a") > 0) & (F.col("b") > 0)
    found = sizes.join(shared, key, "left").select(key, F.when(both, 2 * F.coalesce("shared", F.lit(0)) / (F.col("a") + F.col("b"))).otherwise(0.0).alias("likeness"))
    same = tidy(F.regexp_replace(F.coalesce(left, F.lit("")), "\n", " ")) == tidy(F.regexp_replace(F.coalesce(right, F.lit("")), "\n", " "))
    out = rows.select(key, same.alias("same")).join(found, key, "left")
    return out.select(key, F.when(F.col("same") & (F.col("likeness") > 0), 1.0).otherwise(F.coalesce("likeness", F.lit(0.0))).alias("likeness"))


def merged_reading(ocr: Column, vlm: Column, ocr_fields: Column, vlm_fields: Column, ocr_conf: Column, vlm_conf: Column, alike: Column) -> Column:
    """struct(source, text, confidence, ocr_share, vlm_share, fields, warnings) of two readings; a null text is a reading that failed.

    Alike by over .7: consensus, weighted .4 and .6. Else the model's where recognition is under .5 sure, has fewer than two thirds of the fields or is less sure by .2; recognition's
    where it is over .8 sure with a fifth more text, or surer by .2; else the longer by a tenth, or consensus. Of a consensus the longer text counts over .9, the model's if it has
    nine tenths of the length under that.
    """
    m, n = F.length(F.trim(ocr)), F.length(F.trim(vlm))
    near, far = F.when(F.length(vlm) >= F.length(ocr), vlm).otherwise(ocr), F.when(F.length(vlm) > F.length(ocr) * 0.9, vlm).otherwise(ocr)
    agreed = F.when(alike > 0.9, near).otherwise(far)
    prefer_vlm = (ocr_conf < 0.5) | (F.size(vlm_fields) > F.size(ocr_fields) * 1.5) | (vlm_conf > ocr_conf + 0.2)
    prefer_ocr = ((ocr_conf > 0.8) & (m > n * 1.2)) | (ocr_conf > vlm_conf + 0.2)
    both = ocr_conf * WEIGHTS["ocr"] + vlm_conf * WEIGHTS["vlm"]
    shape = lambda source, text, conf, x, y: F.struct(F.lit(source).alias("source"), text.alias("text"), conf.alias("confidence"), F.lit(x).alias("ocr_share"), F.lit(y).alias("vlm_share"))
    pick = (
        F.when(ocr.isNull() & vlm.isNull(), shape("none", F.lit(""), F.lit(0.0), 0.0, 0.0))
        .when(vlm.isNull(), shape("ocr", ocr, ocr_conf, 1.0, 0.0))
        .when(ocr.isNull(), shape("vlm", vlm, vlm_conf, 0.0, 1.0))
        .when(alike > 0.7, shape("consensus", agreed, both, 0.5, 0.5))
        .when(prefer_vlm, shape("vlm", vlm, vlm_conf, 0.2, 0.8))
        .when(prefer_ocr, shape("ocr", ocr, ocr_conf, 0.8, 0.2))
        .when(n > m * 1.1, shape("vlm", vlm, vlm_conf, 0.3, 0.7))
        .when(m > n * 1.1, shape("ocr", ocr, ocr_conf, 0.7, 0.3))
        .otherwise(shape("consensus", agreed, both, 0.5, 0.5))
    )
    fields = F.when(ocr.isNull() & vlm.isNull(), F.create_map().cast("map<string,string>")).when(vlm.isNull(), ocr_fields).when(ocr.isNull(), vlm_fields).otherwise(merged_maps(ocr_fields, vlm_fields))
    low = lambda c: F.format_string("%.2f", c)
    told = F.array(
        F.when(alike < 0.3, F.concat(F.lit("Low agreement between VLM and OCR (similarity="), low(alike), F.lit(")"))),
        F.when(ocr_conf < 0.5, F.concat(F.lit("Low OCR confidence ("), low(ocr_conf), F.lit(")"))),
        F.when(vlm_conf < 0.5, F.concat(F.lit("Low VLM confidence ("), low(vlm_conf), F.lit(")"))),
    )
    one = lambda text: F.array(F.lit(text))
    warnings = F.when(ocr.isNull() & vlm.isNull(), one("Both VLM and OCR extraction failed")).when(vlm.isNull(), one("VLM extraction failed, using OCR only")).when(ocr.isNull(), one("OCR extraction failed, using VLM only"))
    return F.struct(*[pick[c].alias(c) for c in ("source", "text", "confidence", "ocr_share", "vlm_share")], fields.alias("fields"), F.coalesce(warnings, F.array_compact(told)).alias("warnings"))
