"""Dictionary lookups: exact, alias, prefix and fuzzy tiers, searches, pairs within a group.

A tier runs only on the names that no earlier tier has found. Names are made distinct first and joined back, so each is
looked up once. Fuzzy tiers are equi-joins on a blocking key with the distance as a residual condition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.near import near_candidates
from tessera.sources.shared import dealt, spread, written

Tier = Callable[[DataFrame], DataFrame]

#: About how many keys of one name stand in a block of `near_pairs`; the pairs of two blocks (the square of it) are in memory at a time, as generated code hands on the rows made from one row together.
KEYS = 500


def first_per(rows: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def exact(names: DataFrame, entries: DataFrame) -> DataFrame:
    """(name, code) of entries (entry, code, rank) that equal the name, best rank first."""
    j = names.join(entries, F.col("name") == F.col("entry"))
    return first_per(j, ["name"], F.col("rank"), F.col("code")).select("name", "code")


def prefix(names: DataFrame, entries: DataFrame, longer_by: int, block: int = 3) -> DataFrame:
    """The shortest entry that the name begins, at most `longer_by` letters longer; blocked on the first letters."""
    n = names.where(F.length("name") >= block).withColumn("__b", F.substring("name", 1, block))
    e = entries.withColumn("__b", F.substring("entry", 1, block))
    j = n.join(e, "__b").where(F.col("entry").startswith(F.col("name")) & (F.length("entry") <= F.length("name") + longer_by))
    return first_per(j, ["name"], F.length("entry"), F.col("rank"), F.col("code")).select("name", "code")


def fuzzy(names: DataFrame, entries: DataFrame, most: int = 2, block: int = 1) -> DataFrame:
    """The nearest entry within `most` edits that begins alike; ties to the better rank."""
    met = near_candidates(names.select("name", F.lit(most).alias("k")), entries.select(F.col("entry").alias("text")), most, block)
    d = met.withColumn("distance", F.levenshtein("name", "text", most)).where("distance >= 0")
    return first_per(d.join(entries, F.col("text") == F.col("entry")), ["name"], F.col("distance"), F.col("rank"), F.col("code")).select("name", "code", "distance")


def tiered(names: DataFrame, tiers: Sequence[tuple[str, Tier]]) -> DataFrame:
    """(name, code, tier) of the first tier that finds each name. What a tier finds and what it leaves are written, so the plan of a tier does not hold those before it."""
    left, out = written(names.select("name").distinct(), "names"), None
    for label, tier in tiers:
        got = written(tier(left).select("name", "code", F.lit(label).alias("tier")), "found")
        out = got if out is None else out.unionByName(got)
        left = written(left.join(got.select("name"), "name", "left_anti"), "names")
    return out


def search(entries: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Entries that contain the text: equal first, then those it begins, then the rest; shorter first."""
    e, low = F.lower("entry"), text.lower()
    place = F.when(e == low, 0).when(e.startswith(low), 1).otherwise(2)
    return entries.where(e.contains(low)).withColumn("place", place).orderBy("place", F.length("entry"), "code").limit(limit)


def near_pairs(rows: DataFrame, key: str, name: str, most: int = 2, block: int = 1) -> DataFrame:
    """(a, b, distance) of all keys a < b whose names begin alike and are at most `most` edits apart, copies of a name included.

    Distances are taken between distinct names that share a piece (`near_candidates`). The keys of a name are dealt into blocks of about `KEYS`, and the pairs of blocks over all
    tasks: pairs grow with the square of a name's copies, but a task makes them from two blocks at a time and holds none.
    """
    known = rows.select(F.col(key).alias("key"), F.col(name).alias("name")).where("key IS NOT NULL AND name IS NOT NULL")
    sizes = known.groupBy("name").agg(F.ceil(F.count("*") / KEYS).alias("parts"))
    put = known.join(sizes, "name").select("name", F.pmod(F.xxhash64("key"), F.col("parts")).alias("part"), "key")
    blocks = written(dealt(put, "name", "part").groupBy("name", "part").agg(F.sort_array(F.collect_list("key")).alias("keys")), "blocks")
    n = blocks.select("name", F.lit(most).alias("k"))
    d = near_candidates(n, n.select(F.col("name").alias("text")), most, block).select(F.col("name").alias("na"), F.col("text").alias("nb")).where("na <= nb")
    d = d.withColumn("distance", F.levenshtein("na", "nb", most).cast("long")).where("distance >= 0")
    a, b = (blocks.select(F.col("name").alias(f"n{x}"), F.col("part").alias(f"p{x}"), F.col("keys").alias(f"k{x}")) for x in "ab")
    met = d.join(a, "na").join(b, "nb").where("na < nb OR pa <= pb").selectExpr("distance", "na = nb AND pa = pb AS own", "ka", "kb")
    pairs = spread(met).select("distance", "own", "kb", F.explode("ka").alias("x")).select("distance", "own", "x", F.explode("kb").alias("y"))
    return pairs.where("IF(own, x < y, x <> y)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def pairs_within(rows: DataFrame, group: str, item: str, rules: DataFrame) -> DataFrame:
    """Rules (a, b) of which both items stand in a group, each once.

    Rows meet a rule's first item before the second, so only pairs that a rule names are ever formed. `rules` is a small
    fixed table, so it is broadcast.
    """
    d = rows.select(group, item).distinct()
    r = F.broadcast(rules.select(F.col("a").alias(item), F.col("b").alias("__b"), "severity"))
    half = d.join(r, item).select(F.col(group), F.col(item).alias("a"), F.col("__b").alias("b"), "severity")
    return half.join(d.select(group, F.col(item).alias("b")), [group, "b"]).select(group, "a", "b", "severity")


def duplicates(rows: DataFrame, group: str, item: str, order: Sequence[str]) -> DataFrame:
    """Second and later rows of an item in a group, with the group's first row of it."""
    w = Window.partitionBy(group, item).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).withColumn("first_row", F.first(order[0]).over(w)).where("nth > 1")
