"""Which box on a page shows a field's value: by nearness to the field's own box, and over tables and recognised words.

Boxes alone are met by bands of height, never page by page: a box belongs to one band, a field asks its own and both neighbours. Words and wanted texts meet by page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators.tables import sequence_similarity
from tessera.operators.transfer import boxes_of_text, most_words, texts_shown
from tessera.sources.shared import written

RIGHT, OTHER_ROW = 1.1, 0.7  # bonus right of the field on its row, malus on another row
AROUND = "explode(array(-1, 0, 1)) as d"


def centre(box: str) -> Column:
    return (F.col(f"{box}.y0") + F.col(f"{box}.y1")) / 2


def band(y: Column, height) -> Column:
    return F.floor(y / height).cast("long")


def nearest_values(fields: DataFrame, values: DataFrame, row: float = 0.02, crowd: int = 16) -> DataFrame:
    """(field, value, score): of each field's page, the value box nearest in height, better to the right, worse on another row.

    `fields`: page, field, box; `values`: page, value, box; a field is not its own value. The score is 1 - the gap of the upper sides,
    x 1.1 right of the field, x .7 where the gap is over `row`; ties go to the smaller value. Bands begin at a height that holds about `crowd` boxes of the
    fullest row and grow fourfold; a field is done as soon as nothing outside its band can score as much, so the rows joined grow with the fields, not with
    fields x boxes. Null sides find nothing.
    """
    f = fields.select("page", "field", F.col("box").alias("f")).where("f.y0 is not null and f.x1 is not null")
    v = values.select("page", "value", F.col("box").alias("v")).where("v.y0 is not null and v.x0 is not null")
    fullest = v.groupBy("page", band(F.col("v.y0"), row)).count().agg(F.max("count")).first()[0]
    ends = f.select(F.col("f.y0").alias("y")).union(v.select("v.y0")).agg(F.max("y") - F.min("y")).first()[0]
    if not fullest or ends is None:
        return f.join(v, "page").select("field", "value", F.lit(0.0).alias("score")).limit(0)
    height, found, left = row, None, written(f, "fields")
    while height > row * crowd / fullest and height > 1e-9:
        height /= 4
    gap = F.abs(F.col("f.y0") - F.col("v.y0"))
    score = (1 - gap) * F.when(F.col("v.x0") >= F.col("f.x1"), RIGHT).otherwise(1.0) * F.when(gap > row, OTHER_ROW).otherwise(1.0)
    while True:
        whole = height > ends
        beyond = (1 - height) * RIGHT * (1.0 if height < row else OTHER_ROW)  # nothing outside the band scores more
        asks = left.selectExpr("*", AROUND).select("page", "field", "f", (band(F.col("f.y0"), height) + F.col("d")).alias("band"))
        met = asks.join(v.withColumn("band", band(F.col("v.y0"), height)), ["page", "band"]).where((gap <= height) & (F.col("field") != F.col("value")))
        best = met.groupBy("field").agg(F.max_by(F.struct("value", score.alias("score")), F.struct(score, -F.col("value"))).alias("m")).select("field", "m.value", "m.score")
        best = written(best.where(F.lit(whole) | (F.col("score") > beyond)), "nearest")
        found = best if found is None else found.unionByName(best)
        left = written(left.join(best.select("field"), "field", "left_anti").select("page", "field", "f"), "fields")
        if whole or left.isEmpty():
            return found
        height *= 4


def values_of_fields(words: DataFrame, wanted: DataFrame, alike: Callable[[Column, Column], Column] = sequence_similarity, row: float = 0.02) -> DataFrame:
    """(page, field, value, place, text, box, confidence, match): the box of each wanted value that belongs to its field.

    `words`: page, place, text, box; `wanted`: page, field, value. The field's box is the best of those that show its name (.7 alike or more), a value's are those
    of `boxes_of_text` (.8). On the field's row (centres within `row`) confidence is that of the match x (1 - 5 x the distance, .5 at least), x 1.1 to the right of
    field; elsewhere x .7; 1 at most. Ties go to the surer match, then the earlier place. A field that the page does not show takes the value's
    best match as it is. Names and values are looked for at once, and each match of a value is judged by the box of every field that asks for it; all of it
    stays where words and wanted texts met by page.
    """
    asked = wanted.where("trim(field) <> '' and trim(value) <> ''").select("page", "field", "value")
    text = lambda want, least, field: F.struct(want.alias("want"), F.lit(least).alias("least"), field.alias("field"))
    texts = asked.select("page", F.explode(F.array(text(F.col("field"), 0.7, F.lit(None).cast("string")), text(F.col("value"), 0.8, F.col("field")))).alias("a"))
    texts = texts.select("page", "a.*").groupBy("page", "want", "least").agg(F.collect_set("field").alias("fields"))
    shown = texts_shown(words, texts, most_words(asked, "field", "value"), alike).withColumnRenamed("confidence", "sure")
    name = F.size("fields") == 0
    rows = shown.select("page", F.explode(F.when(name, F.array("want")).otherwise(F.col("fields"))).alias("field"), F.when(~name, F.col("want")).alias("value"), "place", "text", "box", "sure", "match")
    is_name = F.col("value").isNull()
    own = F.max_by(F.when(is_name, F.struct("box")), F.when(is_name, F.struct("sure", -F.col("place")))).over(Window.partitionBy("page", "field"))
    gap = F.coalesce(F.abs(centre("own.box") - centre("box")), F.lit(float("inf")))
    conf = F.col("sure") * (1 - F.least(gap * 5, F.lit(0.5))) * F.when(gap > row, OTHER_ROW).when(F.col("box.x0") > F.col("own.box.x1"), RIGHT).otherwise(1.0)
    conf = F.when(F.col("own").isNull(), F.col("sure")).otherwise(F.round(F.least(conf, F.lit(1.0)), 9))  # so that equal distances tie
    rows = rows.withColumn("own", own).where("value is not null").withColumn("confidence", conf)
    best = F.max_by(F.struct("place", "text", "box", "confidence", "match"), F.struct("confidence", "sure", -F.col("place"))).alias("m")
    return rows.groupBy("page", "field", "value").agg(best).select("page", "field", "value", "m.*")


def placed_values(words: DataFrame, cells: DataFrame, wanted: DataFrame, alike: Callable[[Column, Column], Column] = sequence_similarity) -> DataFrame:
    """(doc, id, box, confidence, source, match, page): where each extracted value stands, over all pages of its document.

    `words`: doc, page, place, text, box, width, height; `cells`: doc, page, text, box (of tables, in shares of the page); `wanted`: doc, id, field (may be null),
    value, page (null: any), box. A valid box that a value brings stays. Else the best counts of the table cells whose text it is (case-blind) and of the words, by
    `values_of_fields` or, without a field, by `boxes_of_text`; a word's confidence is its match's times `geometry.confidence` of its box. Boxes with a side over 1 are
    divided by the page's size. Ties go to tables, then the earlier page and place. Values that nothing shows give no row.
    """
    blank = F.coalesce(F.trim("value"), F.lit("")) == ""
    has = G.is_valid(F.col("box"))
    given = wanted.where(has).select("doc", "id", "box", F.lit(1.0).alias("confidence"), F.lit("given").alias("source"), F.lit("exact").alias("match"), "page")
    asked = wanted.where(~has & ~blank).select("doc", "id", "field", F.trim("value").alias("value"), F.col("page").alias("asked_page"))
    here = F.col("asked_page").isNull() | (F.col("page") == F.col("asked_page"))
    in_cells = asked.withColumn("low", F.lower("value")).join(cells.where(G.is_valid(F.col("box"))).select("doc", "page", "box", F.lower(F.trim("text")).alias("low")), ["doc", "low"]).where(here)
    kept = ["doc", "id", "box", "confidence", "source", "match", "page", "place"]
    in_cells = in_cells.withColumn("confidence", G.confidence(F.col("box"), F.lit("table"), F.lit(1.0))).selectExpr("doc", "id", "box", "confidence", "'table' as source", "'exact' as match", "page", "-1 as place")
    on_pages = words.select(F.struct("doc", F.col("page").alias("number")).alias("page"), "place", "text", "box")
    pages = words.groupBy("doc", "page").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    each = written(asked.join(pages, "doc").where(here).withColumn("at", F.struct("doc", F.col("page").alias("number"))), "asked")
    named = values_of_fields(on_pages, each.where("trim(field) <> ''").select(F.col("at").alias("page"), "field", "value"), alike)
    named = each.join(named.withColumnRenamed("page", "at"), ["at", "field", "value"])
    plain = boxes_of_text(on_pages, each.where("coalesce(trim(field), '') = ''").select(F.col("at").alias("page"), F.col("value").alias("want")), alike)
    plain = each.where("coalesce(trim(field), '') = ''").join(plain.withColumnRenamed("page", "at").withColumnRenamed("want", "value"), ["at", "value"])
    cols = ["doc", "id", "page", "place", "box", "width", "height", "confidence", "match"]
    seen = named.select(*cols).unionByName(plain.select(*cols))
    over = F.exists(F.array(*[F.col(f"box.{s}") for s in G.SIDES]), lambda s: s > 1) & (F.col("width") > 0) & (F.col("height") > 0)
    share = G.box(*[F.col(f"box.{s}") / F.col(d) for s, d in zip(G.SIDES, ("width", "height") * 2)])
    seen = seen.withColumn("box", F.when(over, share).otherwise(F.col("box"))).where(G.is_valid(F.col("box")))
    seen = seen.select("doc", "id", "box", (F.col("confidence") * G.confidence(F.col("box"), F.lit("ocr"), F.lit(1.0))).alias("confidence"), F.lit("ocr").alias("source"), "match", "page", "place")
    every = in_cells.select(*kept).unionByName(seen)
    order = F.struct("confidence", F.col("source") == "table", -F.col("page"), -F.col("place"))
    best = every.groupBy("doc", "id").agg(F.max_by(F.struct("box", "confidence", "source", "match", "page"), order).alias("m"))
    return given.unionByName(best.select("doc", "id", "m.*"))
