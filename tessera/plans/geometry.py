"""Box queries: boxes made of the first four components of each embedding."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators.boxes import nearest_values, values_of_fields
from tessera.plans.registry import query, table
from tessera.sources.shared import dealt

B = "b AS (SELECT vec_id, label, least(embedding[1], embedding[3])::DOUBLE AS x0, least(embedding[2], embedding[4])::DOUBLE AS y0, greatest(embedding[1], embedding[3])::DOUBLE AS x1, greatest(embedding[2], embedding[4])::DOUBLE AS y1 FROM embeddings)"


def boxes(spark, sf):
    e = [F.col("embedding")[i].cast("double") for i in range(4)]
    return table(spark, sf, "embeddings").select("vec_id", "label", G.in_order(G.box(*e)).alias("b"))


@query("iou_pairs", f"""WITH {B}, p AS (SELECT a.vec_id AS a, c.vec_id AS b, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) AS s
    FROM b a JOIN b c ON c.vec_id = a.vec_id + 1) SELECT a, b, round(i / (s - i), 6) AS iou FROM p""")
def iou_pairs(spark, sf):
    x = boxes(spark, sf)
    y = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("b").alias("c"))
    return x.join(y, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.round(G.overlap(F.col("b"), F.col("c")), 6).alias("iou"))


@query("bbox_normalise", f"""WITH {B} SELECT vec_id, round(greatest(0, least(1, x0 / 0.2)), 6) AS x0, round(greatest(0, least(1, 1 - y1 / 0.2)), 6) AS y0, round(greatest(0, least(1, x1 / 0.2)), 6) AS x1, round(greatest(0, least(1, 1 - y0 / 0.2)), 6) AS y1 FROM b""")
def bbox_normalise(spark, sf):
    n = boxes(spark, sf).select("vec_id", G.normalise(F.col("b"), F.lit(0.2), F.lit(0.2), from_bottom=True).alias("n"))
    return n.select("vec_id", *[F.round(f"n.{s}", 6).alias(s) for s in G.SIDES])


@query("bbox_merge", f"WITH {B} SELECT label, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM b GROUP BY 1")
def bbox_merge(spark, sf):
    v = boxes(spark, sf).where(G.is_valid(F.col("b")))
    return v.groupBy("label").agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"), F.count("*").alias("n"))


@query("bbox_confidence", f"WITH {B} SELECT vec_id, round(CASE vec_id % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.8 ELSE 0.5 END * CASE WHEN (x1 - x0) * (y1 - y0) < 0.0001 THEN 0.5 WHEN (x1 - x0) * (y1 - y0) > 0.5 THEN 0.7 ELSE 1 END * 0.9, 6)::DOUBLE AS confidence FROM b")
def bbox_confidence(spark, sf):
    source = F.when(F.col("vec_id") % 3 == 0, "table").when(F.col("vec_id") % 3 == 1, "OCR").otherwise("else")
    return boxes(spark, sf).select("vec_id", F.round(G.confidence(F.col("b"), source, F.lit(0.9)), 6).alias("confidence"))


@query("value_box_match", f"""WITH {B}, j AS (SELECT f.vec_id AS field, v.vec_id AS value, (1 - abs(f.y0 - v.y0)) * CASE WHEN v.x0 >= f.x1 THEN 1.1 ELSE 1 END * CASE WHEN abs(f.y0 - v.y0) > 0.02 THEN 0.7 ELSE 1 END AS score
    FROM b f JOIN b v ON f.label = v.label AND f.vec_id % 20 = 0 AND v.vec_id <> f.vec_id) SELECT field, value, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY score DESC, value) AS k FROM j) WHERE k = 1""")
def value_box_match(spark, sf):
    """The stated fields against all other boxes."""
    x = boxes(spark, sf)
    ask = x.where("vec_id % 20 = 0").select(F.col("label").alias("page"), F.col("vec_id").alias("field"), F.col("b").alias("box"))
    best = nearest_values(ask, x.select(F.col("label").alias("page"), F.col("vec_id").alias("value"), F.col("b").alias("box")))
    return best.select("field", "value", F.round("score", 6).alias("score"))


# Every order is a page: its lines are words in two columns, read in the order of their numbers, a number beside or below each name.
PAGE_WORDS = [
    "l_orderkey AS page", "l_linenumber AS place", "CASE l_partkey % 6 WHEN 0 THEN 'Steel' WHEN 1 THEN 'bolt' WHEN 2 THEN 'stele' WHEN 3 THEN '12.5' WHEN 4 THEN '12.50' ELSE 'Widget' END AS text",
    "l_linenumber % 3 * 0.3D AS x0", "l_partkey % 7 * 0.025D + l_suppkey % 3 * 0.004D AS y0",
]
PAGE_WANTED = [("steel", "12.5"), ("widget", "12.5"), ("absent", "bolt"), ("bolt", "STEEL"), ("bolt", "widget bolt"), ("steel", " ")]
_words_sql = re.sub(r"(0\.\d+)D", r"\1::DOUBLE", f"SELECT {', '.join(PAGE_WORDS)} FROM lineitem")
_alike = lambda a, b: f"(1 - levenshtein(lower({a}), lower({b})) / greatest(length({a}), length({b}))::DOUBLE)"


@query("field_value_boxes", f"""WITH w AS (SELECT page, place, text, x0, y0, x0 + 0.2 AS x1, y0 + 0.01 AS y1 FROM (SELECT *, row_number() OVER (PARTITION BY page, place ORDER BY text, x0, y0) AS i FROM ({_words_sql})) WHERE i = 1),
    a AS (SELECT unnest([{", ".join("'" + f + "'" for f, _ in PAGE_WANTED)}]) AS field, unnest([{", ".join("'" + v + "'" for _, v in PAGE_WANTED)}]) AS value), q AS (SELECT DISTINCT field AS want, 0.7 AS least FROM a UNION ALL SELECT DISTINCT value, 0.8 FROM a WHERE trim(value) <> ''),
    o AS (SELECT page, want, least, place, text, x0, y0, x1, y1, CASE WHEN lower(text) = lower(want) THEN 1 WHEN {_alike('text', 'want')} >= least THEN 2 WHEN abs(TRY_CAST(text AS DOUBLE) - TRY_CAST(want AS DOUBLE)) < 0.001 THEN 4 END AS tier,
            CASE WHEN lower(text) = lower(want) THEN 1.0 WHEN {_alike('text', 'want')} >= least THEN {_alike('text', 'want')} * 0.9 ELSE 0.95 END AS confidence FROM w, q
        UNION ALL SELECT x.page, want, least, x.place, x.text || ' ' || y.text, least(x.x0, y.x0), least(x.y0, y.y0), greatest(x.x1, y.x1), greatest(x.y1, y.y1), 3, {_alike("(x.text || ' ' || y.text)", 'want')} * 0.85
            FROM w x JOIN w y ON x.page = y.page AND y.place = x.place + 1, q WHERE contains(want, ' ') AND {_alike("(x.text || ' ' || y.text)", 'want')} >= least),
    m AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY page, want, least) AS t FROM o WHERE tier IS NOT NULL) WHERE tier = t),
    f AS (SELECT page, want AS field, arg_max({{'x1': x1, 'y': (y0 + y1) / 2}}, (confidence, -place)) AS f FROM m WHERE least = 0.7 GROUP BY 1, 2),
    c AS (SELECT m.page, a.field, a.value, place, text, confidence AS sure, tier, x0, f, abs((y0 + y1) / 2 - f.y) AS gap FROM m JOIN a ON m.want = a.value LEFT JOIN f ON f.page = m.page AND f.field = a.field WHERE least = 0.8),
    s AS (SELECT *, CASE WHEN f IS NULL THEN sure ELSE round(least(1.0, sure * (1 - least(gap * 5, 0.5)) * CASE WHEN gap > 0.02 THEN 0.7 WHEN x0 > f.x1 THEN 1.1 ELSE 1 END), 9) END AS confidence FROM c)
    SELECT page, field, value, place, text, confidence::DOUBLE AS confidence, CASE tier WHEN 2 THEN 'fuzzy' WHEN 3 THEN 'partial' ELSE 'exact' END AS match
    FROM (SELECT *, row_number() OVER (PARTITION BY page, field, value ORDER BY confidence DESC, sure DESC, place) AS i FROM s) WHERE i = 1""")
def field_value_boxes(spark, sf):
    """The boxes of six wanted values on every order's page of words, by their fields and edit distance."""
    got = values_of_fields(page_words(spark, sf), page_wanted(spark, sf), edit_likeness)
    return got.select("page", "field", "value", "place", "text", "confidence", "match")


def page_words(spark, sf):
    """Dealt out by page at once, as all that follows is by page."""
    words = dealt(table(spark, sf, "lineitem").selectExpr(*PAGE_WORDS), "page")
    words = words.groupBy("page", "place").agg(F.min(F.struct("text", "x0", "y0")).alias("m")).select("page", "place", "m.*")
    return words.select("page", "place", "text", G.box(F.col("x0"), F.col("y0"), F.col("x0") + 0.2, F.col("y0") + 0.01).alias("box"))


def page_wanted(spark, sf):
    asked = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("value")) for f, v in PAGE_WANTED])
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page")).distinct().select("page", F.explode(asked).alias("a")).select("page", "a.*")


def edit_likeness(a, b):
    """1 - edits / the longer length; 0 where the lengths alone bring it under .7, the least that any wanted text asks for."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(1 - F.abs(F.length(a) - F.length(b)) / longer < 0.7, 0.0).otherwise(1 - F.levenshtein(a, b) / longer)
