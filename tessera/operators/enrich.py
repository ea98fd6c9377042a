"""Scored dictionary lookups and the enrichment of a document's rows with what they find.

A dictionary entry has code, component, shortname, consumer, related (aliases joined by ";"), kind and rank (0: unranked). Names
are looked up once each (distinct, lower case). Every candidate generator is an equi-join on something both sides can be exploded
to - the name itself, an alias, a prefix that ends a word, first letter and length - so no join compares all with all;
the best candidate of a name is an aggregate with map-side combine, not a sort. No candidate list is cut off.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import sound_code
from tessera.operators.near import near_candidates
from tessera.sources.shared import written

UNRANKED = 999_999


def ranked(rank: Column) -> Column:
    return F.when(rank > 0, rank).otherwise(UNRANKED)


def best(found: DataFrame, *order: Column, keep: Sequence[str] = ("code", "match")) -> DataFrame:
    """One row a name: the least in `order`, ties to the smaller code."""
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("code").alias("last"))
    return found.groupBy("name").agg(F.min_by(F.struct(*keep), key).alias("b")).select("name", "b.*")


def after(names: DataFrame, found: DataFrame) -> DataFrame:
    """The names that are not found yet."""
    return names.join(found.select("name"), "name", "left_anti")


def keyed(found: DataFrame, match: Column, *order: Column) -> DataFrame:
    """Keys of a tier: the name an entry is met by, its code, how it was met, and what is least for the best entry of a name."""
    return found.select("name", "code", match.alias("match"), F.array(*[o.cast("long") for o in order]).alias("order"))


def by_name(entries: DataFrame) -> DataFrame:
    """Entries whose component, short name or consumer name is the name; the best rank wins. Names of one sign find nothing."""
    keys = entries.select("code", "rank", F.explode(F.array_distinct(F.array_compact(F.array(*[F.lower(c) for c in ("component", "shortname", "consumer")])))).alias("name"))
    return keyed(keys.where(F.length("name") >= 2), F.lit("exact"), ranked(F.col("rank")))


def word_prefixes(text: Column) -> Column:
    """All beginnings of a text that end before a space."""
    words = F.split(text, " ")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))


def by_alias(entries: DataFrame) -> DataFrame:
    """Entries with the name as an alias or at the beginning of their short name, by score.

    200 for the short name, 100 for an alias and up to 50 for its place, 50 for the component's beginning, and 1000 less the rank.
    """
    e = entries.select("code", ranked(F.col("rank")).alias("rank"), F.lower("component").alias("component"), F.lower("shortname").alias("shortname"), F.transform(F.split(F.lower("related"), ";"), lambda a: F.trim(a)).alias("aliases"))
    starts = F.transform(F.filter(F.array(F.lit(" "), F.lit("-")), lambda s: F.col("shortname").contains(s)), lambda s: F.array_join(F.slice(F.split(F.col("shortname"), s), 1, 1), ""))
    keys = e.select("*", F.explode(F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce(word_prefixes(F.col("shortname")), F.array().cast("array<string>")), F.coalesce(starts, F.array().cast("array<string>"))))).alias("name"))
    name = F.col("name")
    at = F.array_position("aliases", name)
    spaced, dashed = F.col("shortname").startswith(F.concat(name, F.lit(" "))), F.col("shortname").startswith(F.concat(name, F.lit("-")))
    told = F.exists("aliases", lambda a: a.contains(name))
    short = F.coalesce(spaced | (dashed & told), F.lit(False))
    is_alias = F.coalesce(at > 0, F.lit(False))
    shown = F.coalesce(spaced | dashed | (F.col("shortname") == name), F.lit(False))
    score = F.when(shown, 200).otherwise(0) + F.when(is_alias, 100 + F.greatest(50 - (at - 1) * 5, F.lit(0))).otherwise(0)
    score = score + F.when(F.col("component").startswith(name), 50).otherwise(0) + F.when(F.col("rank") < UNRANKED, 1000 - F.least(F.col("rank"), F.lit(1000))).otherwise(0)
    return keyed(keys.where((F.length("name") >= 2) & (is_alias | short)), F.when(shown, "shortname_prefix").otherwise("alias"), -score, F.col("rank"))


def by_prefix(entries: DataFrame, longer_by: int, column: str = "component", shortest: bool = False, match: str = "prefix") -> DataFrame:
    """Entries that a name of three signs begins, at most `longer_by` signs longer; the best rank, or the shortest, wins."""
    text = F.lower(column)
    cuts = F.transform(F.sequence(F.lit(0), F.lit(longer_by)), lambda k: text.substr(F.lit(1), F.length(text) - k))
    keys = entries.select("code", "rank", F.length(text).alias("length"), F.explode(F.array_distinct(F.filter(cuts, lambda c: F.length(c) >= 3))).alias("name"))
    return keyed(keys, F.lit(match), *([F.col("length")] if shortest else []), ranked(F.col("rank")))


def by_first_words(entries: DataFrame, column: str = "component", kinds: Sequence[str] | None = None, shortest: bool = False, match: str = "word_match") -> DataFrame:
    """Entries that begin with a name of four signs and a space; the best rank, or the shortest, wins."""
    e = entries if kinds is None else entries.where(F.col("kind").isin(*kinds))
    text = F.lower(column)
    keys = e.where(text.contains(" ")).select("code", "rank", F.length(text).alias("length"), F.explode(F.array_distinct(word_prefixes(text))).alias("name"))
    return keyed(keys.where(F.length("name") >= 4), F.lit(match), *([F.col("length")] if shortest else []), ranked(F.col("rank")))


def cascade(names: DataFrame, tiers: Sequence[DataFrame]) -> DataFrame:
    """(name, code, match) of the first tier (`keyed`) that has each name, the tier's best entry, ties to the smaller code."""
    keys = reduce(DataFrame.unionByName, [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)])
    met = names.select("name").where("name is not null").distinct().join(keys, "name")
    return met.groupBy("name").agg(F.min_by(F.struct("code", "match"), F.struct("tier", "order", "code")).alias("b")).select("name", "b.*")


def test_lookup(names: DataFrame, entries: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Tests by fixed override, name, scored alias, prefix (up to three signs longer) and first words."""
    known = [] if overrides is None else [keyed(overrides.join(entries.select("code"), "code", "left_semi"), F.lit("override"), F.lit(0))]
    return cascade(names, [*known, by_name(entries), by_alias(entries), by_prefix(entries, 3), by_first_words(entries)])


def drug_lookup(names: DataFrame, entries: DataFrame, kinds: Sequence[str] = ("IN", "BN", "PIN", "MIN")) -> DataFrame:
    """Drugs by name, prefix (one sign longer) and first words (of some kinds); the shortest entry wins. Names of three signs at least."""
    tiers = [by_name(entries), by_prefix(entries, 1, shortest=True), by_first_words(entries, kinds=kinds, shortest=True, match="word_prefix")]
    return cascade(names.where(F.length("name") >= 3), tiers)


def most_edits(name: Column) -> Column:
    return F.when(F.length(name) <= 4, 1).when(F.length(name) <= 6, 2).otherwise(3)


def tolerant(names: DataFrame, entries: DataFrame, unit_class: Sequence[tuple[str, Sequence[str]]] = ()) -> DataFrame:
    """(name, code, match, distance, score) by edit distance: 1, 2 or 3 edits by length.

    Candidates begin with the same letter and are of about the same length; of their codes, only those with a text within the edits are looked at (`near_candidates`). Score: similarity, rank (.2 up to 100, .1 up to 500),
    sound (.1), and .1 where the unit (column `unit` of `names`, may be absent) goes with the entry's kind. A component stands for its
    entry before its short name does.
    """
    n = names.where(F.length("name") >= 3).withColumn("most", most_edits(F.col("name")))
    if "unit" not in names.columns:
        n = n.withColumn("unit", F.lit(None).cast("string"))
    sides = [entries.select("code", "rank", "kind", F.lit(i).alias("side"), F.lower(c).alias("text")) for i, c in enumerate(("component", "shortname"))]
    keys = sides[0].union(sides[1])
    near = near_candidates(n.select("name", F.col("most").alias("k")), keys.select("text"), 3).withColumn("distance", F.levenshtein("name", "text")).join(n.select("name", "most").distinct(), "name")
    near = written(near.where("distance <= most").select("name", "text", "distance", (sound_code(F.col("name")) == sound_code(F.col("text"))).alias("sounds")), "near")
    pairs = near.join(keys.select("text", "code").distinct(), "text").select("name", "code").distinct()
    goes = F.length("text").between(F.greatest(F.lit(2), F.length("name") - F.col("most")), F.length("name") + F.col("most") + 2)
    found = n.select("name", "unit", "most").join(pairs, "name").join(keys, "code").where(goes & (F.substring("name", 1, 1) == F.substring("text", 1, 1)))
    found = found.groupBy("name", "unit", "code").agg(F.min_by(F.struct("text", "rank", "kind"), F.struct("side", "text")).alias("e")).select("name", "unit", "code", "e.*")
    found = found.join(near, ["name", "text"])
    rank = ranked(F.col("rank"))
    score = 1 - F.col("distance") / F.greatest(F.length("name"), F.length("text")) + F.when(rank <= 100, 0.2).when(rank <= 500, 0.1).otherwise(0.0)
    score = score + F.when(F.col("sounds"), 0.1).otherwise(0.0)
    goes = F.lit(False)
    for kind, units in unit_class:
        goes = goes | (F.upper("kind").contains(kind) & F.upper("unit").isin(*units))
    found = found.withColumn("score", F.round(score + F.when(F.coalesce(goes, F.lit(False)), 0.1).otherwise(0.0), 9)).withColumn("match", F.lit("ocr_corrected"))
    return best(found, -F.col("score"), rank, keep=("code", "match", "distance", "score"))


def facade(names: DataFrame, first: DataFrame, second: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(name, code, match) by the first lookup, which is written out, and by the second, which sees only the names left over."""
    known = written(first.select("name", "code", "match").join(names.select("name").distinct(), "name", "left_semi"), "found")
    return known.unionByName(second(after(names, known)).select("name", "code", "match"))


def contained_alias(name: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """What a name stands for: the pair of that very name, else the first that holds it or that it holds; or null."""
    exact, near = F.lit(None).cast("string"), F.lit(None).cast("string")
    for key, code in reversed(pairs):
        exact = F.when(name == key, code).otherwise(exact)
        near = F.when(name.contains(key) | F.lit(key).contains(name), code).otherwise(near)
    return F.coalesce(exact, near)


def enrich_tests(results: DataFrame, codes: DataFrame, ranges: DataFrame, critical: DataFrame) -> DataFrame:
    """`results` (doc, name, value, flag or null, low and high or null) with code, status, range, flag and whether it is critical.

    codes: name, code, match; ranges: code, low, high; critical: code, below, above (each one row a code).
    """
    r = results.join(codes, "name", "left").join(ranges.select("code", F.col("low").alias("r_low"), F.col("high").alias("r_high")), "code", "left").join(critical, "code", "left")
    status = F.when(F.col("match").isNull(), "unverified").when(F.col("match") == "ocr_corrected", "ocr_corrected").otherwise("verified")
    added = F.col("low").isNull() & F.col("high").isNull() & F.col("r_low").isNotNull() & F.col("r_high").isNotNull()
    r = r.withColumn("status", status).withColumn("range_added", F.coalesce(added, F.lit(False)))
    r = r.withColumns({"low": F.when(F.col("range_added"), F.col("r_low")).otherwise(F.col("low")), "high": F.when(F.col("range_added"), F.col("r_high")).otherwise(F.col("high"))})
    told = F.when(F.col("value") < F.col("low"), "L").when(F.col("value") > F.col("high"), "H")
    r = r.withColumn("flag_added", F.col("flag").isNull() & F.col("code").isNotNull() & told.isNotNull()).withColumn("flag", F.coalesce("flag", F.when(F.col("code").isNotNull(), told)))
    return r.withColumn("is_critical", F.coalesce((F.col("value") < F.col("below")) | (F.col("value") > F.col("above")), F.lit(False)))


def enrich_drugs(entries: DataFrame, codes: DataFrame, strengths: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """`entries` (doc, name, strength or null, and `keep`) with code, class, the other drugs of the document, and the status of each.

    codes: name, code, match, class; strengths: code, strength (distinct). A strength that is none of a code's known ones is a mismatch.
    """
    known = strengths.groupBy("code").agg(F.lit(True).alias("listed"))
    fits = strengths.select("code", "strength", F.lit(True).alias("fits"))
    e = entries.join(codes, "name", "left").join(known, "code", "left").join(fits, ["code", "strength"], "left")
    wrong = F.col("strength").isNotNull() & F.coalesce("listed", F.lit(False)) & F.col("fits").isNull()
    status = F.when(F.col("code").isNull(), "unverified").when(wrong, "strength_mismatch").when(F.col("match") == "ocr_corrected", "ocr_corrected").otherwise("verified")
    together = entries.groupBy("doc").agg(F.array_sort(F.collect_set("name")).alias("names"))
    e = e.join(together, "doc").withColumn("others", F.filter("names", lambda x: x != F.col("name")))
    return e.select(*keep, "doc", "name", "strength", "code", "match", "class", "others", status.alias("status"))


def summary(enriched: DataFrame) -> DataFrame:
    """A document's rows by status, and the share of those that are verified or corrected."""
    good = F.count_if(F.col("status").isin("verified", "ocr_corrected"))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("verified", "ocr_corrected", "unverified", "strength_mismatch")]
    return enriched.groupBy("doc").agg(*counts, (good / F.count("*")).alias("confidence"))
