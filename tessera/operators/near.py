"""Texts within a few edits of each other, met by what edits leave.

Short texts: two texts within k edits come to be the same if up to k signs are taken out of each, so both are keyed by all that is left of them after that. Long texts have
too many such rests (their number grows with the length to the power k), but large pieces: cut into k + 1 even pieces, a text keeps at least one whole through k edits. A stored text is
keyed by its length and its pieces, and a name asks, for each length within k of its own, for the parts of itself that stand where the piece can have moved to: both sides
of the piece need edits for the shift, so it is at most (k - d) / 2 to the left and (k + d) / 2 to the right, d the difference of the lengths.
All that are within k edits are met either way; the distance is left to the caller.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to which length of the stored text rests are taken, by the number of edits: at most some hundred a text. Longer texts, and more edits, go by pieces.
RESTS = {1: 40, 2: 20, 3: 13}


def _limit(k: Column) -> Column:
    return reduce(lambda out, kv: F.when(k == kv[0], kv[1]).otherwise(out), RESTS.items(), F.lit(-1))


def rests(rows: DataFrame, text: str, most: int) -> DataFrame:
    """`rows` with `rest` and `out`: each text after up to column `k` (at most `most`) of its signs are taken out, from left to right, and how many."""
    level = F.array(F.struct(F.col(text).alias("rest"), F.lit(1).alias("start")))
    every = []

    def shorter(x: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(x["rest"]), F.lit(1))), lambda i: (i >= x["start"]) & (i <= F.length(x["rest"])))
        return F.transform(places, lambda i: F.struct(F.concat(F.substring(x["rest"], F.lit(1), i - 1), F.substring(x["rest"], i + 1, F.length(x["rest"]))).alias("rest"), i.alias("start")))

    for out in range(most + 1):
        kept = F.when(F.col("k") >= out, level).otherwise(F.array().cast("array<struct<rest:string,start:int>>"))
        every.append(_counted(kept, out))
        level = F.flatten(F.transform(kept, shorter))
    return rows.select("*", F.inline(F.concat(*every)))


def _counted(level: Column, out: int) -> Column:
    return F.transform(level, lambda x: F.struct(x["rest"].alias("rest"), F.lit(out).alias("out")))


def _cut(length: Column, k: Column, i: Column) -> Column:
    return F.floor(i * length / (k + 1)).cast("int")


def _by_pieces(names: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    t = texts.select("*", F.explode(F.array(*[F.lit(k) for k in range(1, most + 1)])).alias("k")).where(F.col("length") > _limit(F.col("k")))
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    begin, end = (_cut(F.col("length"), F.col("k"), F.col("i") + d) for d in (0, 1))
    stored = t.select("text", "length", "k", "i", F.substring(F.col("text"), begin + 1, end - begin).alias("piece"), "head")
    n = names.select("*", F.explode(F.sequence(F.greatest(F.col("own") - F.col("k"), F.lit(0)), F.col("own") + F.col("k"))).alias("length")).where(F.col("length") > _limit(F.col("k")))
    n = n.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    n = n.select("*", begin.alias("begin"), (end - begin).alias("size"), (F.col("own") - F.col("length")).alias("d"))
    first = F.greatest(F.lit(0), F.col("begin") - F.floor((F.col("k") - F.col("d")) / 2).cast("int"))
    last = F.least(F.col("own") - F.col("size"), F.col("begin") + F.floor((F.col("k") + F.col("d")) / 2).cast("int"))
    n = n.withColumns({"first": first, "last": last}).where("first <= last").select("*", F.explode(F.sequence("first", "last")).alias("at"))
    asked = n.select("name", "length", "k", "i", F.substring(F.col("name"), F.col("at") + 1, F.col("size")).alias("piece"), "head").distinct()
    return asked.join(stored, ["head", "length", "k", "i", "piece"]).select("name", "text")


def near_candidates(names: DataFrame, texts: DataFrame, most: int, block: int = 1) -> DataFrame:
    """(name, text), each once, of all names (name, k; k at most `most`) and texts (text) that begin with the same `block` signs and may be within k edits.

    Names and texts are taken once each; nulls meet nothing.
    """
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as a small table of names has large tables of rests
    t = texts.select("text").where("text is not null").repartition(parts, "text").distinct().select("text", F.length("text").alias("length"), F.substring("text", 1, block).alias("head"))
    n = names.where("name is not null and k > 0").select("name", "k").repartition(parts, "name", "k").distinct().select("name", "k", F.length("name").alias("own"), F.substring("name", 1, block).alias("head"))
    deepest = reduce(lambda out, k: F.when(F.col("length") <= RESTS[k], k).otherwise(out), [k for k in sorted(RESTS) if k <= most], F.lit(0))
    stored = rests(t.withColumn("k", deepest).where("k > 0"), "text", min(most, max(RESTS))).select("text", "length", "head", "rest", F.col("out").alias("taken")).distinct()
    asked = rests(n.where(F.col("own") <= _limit(F.col("k")) + F.col("k")), "name", min(most, max(RESTS))).select("name", "k", "head", "rest").distinct()
    short = asked.join(stored, ["head", "rest"]).where((F.col("taken") <= F.col("k")) & (F.col("length") <= _limit(F.col("k")))).select("name", "text")
    return short.union(_by_pieces(n, t, most)).distinct()
