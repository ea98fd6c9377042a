"""Drug names as a scanner or a hand may have spoiled them: candidates from seven generators, scored, the best one kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import sound_code
from tessera.operators.enrich import best
from tessera.operators.tables import inferred_class

# Signs that are taken for each other, name endings in the order they are tried, kinds of entries, one class's common
# members, and classes often prescribed together.
CONFUSIONS = {
    "t": ["l", "i", "f", "k"],
    "l": ["t", "i", "1"],
    "i": ["l", "t", "1", "j"],
    "n": ["u", "r", "h", "m"],
    "u": ["n", "v", "a"],
    "m": ["rn", "nn", "n"],
    "rn": ["m"],
    "a": ["o", "e", "u"],
    "o": ["a", "e", "0", "c", "d"],
    "e": ["o", "a", "c"],
    "c": ["o", "e"],
    "h": ["n", "b", "k"],
    "r": ["n", "v"],
    "v": ["u", "r", "w"],
    "w": ["vv", "uu"],
    "s": ["5", "z"],
    "z": ["2", "s"],
    "g": ["q", "9"],
    "q": ["g", "9"],
    "d": ["cl", "b", "o", "a"],
    "b": ["d", "h", "6"],
    "p": ["b", "q"],
    "f": ["t", "l"],
    "k": ["t", "h", "lc", "x"],
    "dd": ["ol", "al", "cl"],
}
ENDINGS = ["olol", "ol", "in", "ide", "ate", "one", "ine", "pril", "sartan", "statin", "mycin", "cillin", "zole", "pam", "lam"]
KINDS = ["IN", "BN", "PIN", "MIN", "SCD", "SCDF", "SBD", "SBDF"]
BETA_BLOCKERS = ["atenolol", "metoprolol", "propranolol", "carvedilol", "bisoprolol", "labetalol", "nadolol", "nebivolol", "acebutolol", "betaxolol", "esmolol", "sotalol", "timolol", "pindolol"]
TOGETHER = [("beta_blocker", "ace_inhibitor", 0.10), ("statin", "ace_inhibitor", 0.10), ("ppi", "ssri", 0.08)]


def misreadings(word: Column) -> Column:
    """The word with one confusion at one place, every one of them."""
    swaps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, many in CONFUSIONS.items() for b in many])
    at = lambda i, s: F.concat(F.substr(word, F.lit(1), i - 1), s["b"], F.substr(word, i + F.length(s["a"])))
    made = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.transform(F.filter(swaps, lambda s: F.substr(word, i, F.length(s["a"])) == s["a"]), lambda s: at(i, s)))
    return F.when(F.length(word) > 0, F.array_distinct(F.flatten(made))).otherwise(F.array().cast("array<string>"))


def ending(word: Column) -> Column:
    """The first of the known endings that the word has, or null."""
    out = F.lit(None).cast("string")
    for e in reversed(ENDINGS):
        out = F.when(word.endswith(e), e).otherwise(out)
    return out


def edits_allowed(word: Column) -> Column:
    return F.when(F.length(word) <= 4, 3).when(F.length(word) <= 5, 4).when(F.length(word) <= 7, 5).otherwise(6)


def candidates(names: DataFrame, entries: DataFrame) -> DataFrame:
    """(name, code, text, kind): one entry a code, of the first generator that proposes it.

    Same first letter and about the same length; same ending and about the same length; a misreading of the name; common beta blockers
    for names in "ol". Each is an equi-join and none is cut off. Of several entries of a code in one generator the least text stands, so entries that are alike are met once.
    """
    most, size = edits_allowed(F.col("name")), F.length("name")
    n = names.where(size >= 4).select("name", F.explode(F.sequence(F.greatest(F.lit(3), size - most), size + most + 4)).alias("length"), F.substring("name", 1, 1).alias("first"), ending(F.col("name")).alias("end"))
    e = entries.select("code", F.lower("text").alias("text"), "kind").where("text is not null").distinct().withColumn("length", F.length("text"))
    usual = F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    lettered = n.join(e.withColumn("first", F.substring("text", 1, 1)), ["first", "length"]).select("name", F.when(usual | F.coalesce(F.col("kind").isin("GPCK", "BPCK"), F.lit(False)), 1).otherwise(6).alias("step"), "code", "text", "kind")
    ends = F.filter(F.array(*map(F.lit, ENDINGS)), lambda x: F.endswith("text", x))
    ended = n.where("end is not null").join(e.where(usual).withColumn("end", F.explode(ends)), ["end", "length"]).select("name", F.lit(3).alias("step"), "code", "text", "kind")
    once = names.where(size >= 4).select("name")
    read = once.withColumn("text", F.explode(misreadings(F.col("name")))).join(e.where(usual), "text").select("name", F.lit(4).alias("step"), "code", "text", "kind")
    blockers = e.where(F.col("text").isin(*BETA_BLOCKERS))
    blocked = once.where(ending(F.col("name")).isin("ol", "olol")).withColumn("text", F.explode(F.array(*map(F.lit, BETA_BLOCKERS)))).join(blockers, "text").select("name", F.lit(5).alias("step"), "code", "text", "kind")
    found = lettered.union(ended).union(read).union(blocked)
    return found.groupBy("name", "code").agg(F.min_by(F.struct("text", "kind"), F.struct("step", "text", F.coalesce("kind", F.lit("")))).alias("e")).select("name", "code", "e.*")


def tolerant_drugs(names: DataFrame, entries: DataFrame, classes: Sequence[tuple[str, Sequence[str], Sequence[str]]] = (), strengths: DataFrame | None = None) -> DataFrame:
    """(name, code, match, distance, score) for each distinct name of four signs or more that has a candidate near enough.

    `names`: name (lower case), one row each; optional `strength` (a writing) and `context` (array of the classes of the other drugs).
    `entries`: code, text, kind; a code may have several. `strengths`: code, strength. Score: similarity, up to .15 for a code of many
    entries, .15 and up to .1 for the same ending and stem, .1 for the sound, .05 for kind IN, .4 for a known strength and -.15 for an
    unknown one of a code with known ones, up to .15 for a class that goes with the context. Accepted are 3 to 6 edits by length, or a
    similarity of .5. Ties: fewer edits, then the smaller code. Null names and empty tables give no rows.
    """
    for c, kind in (("strength", "string"), ("context", "array<string>")):
        if c not in names.columns:
            names = names.withColumn(c, F.lit(None).cast(kind))
    name, text, end = F.col("name"), F.col("text"), F.col("end")
    names = names.where("name is not null").select("name", "strength", "context", ending(name).alias("end"), sound_code(name).alias("sound"))
    popular = entries.groupBy("code").agg(F.count("*").alias("entries"))
    c = candidates(names.select("name").distinct(), entries)
    c = c.withColumn("distance", F.levenshtein("name", "text")).withColumn("alike", 1 - F.col("distance") / F.greatest(F.length("name"), F.length("text")))
    c = c.where((F.col("distance") <= edits_allowed(name)) | (F.col("alike") >= 0.5)).join(popular, "code").join(names, "name")
    stem = lambda t: F.when(F.length(t) > F.length(end), F.substr(t, F.lit(1), F.length(t) - F.length(end))).otherwise(t)
    stems = 1 - F.levenshtein(stem(name), stem(text)) / F.greatest(F.length(stem(name)), F.length(stem(text)), F.lit(1))
    score = F.col("alike") + F.least(F.col("entries") / 10, F.lit(1.0)) * 0.15 + F.when(text.endswith(end), 0.15 + stems * 0.1).otherwise(0.0)
    score = score + F.when(F.col("sound") == sound_code(text), 0.1).otherwise(0.0) + F.when(F.col("kind") == "IN", 0.05).otherwise(0.0)
    if strengths is not None:
        known = strengths.groupBy("code").agg(F.lit(True).alias("listed"))
        fits = strengths.select("code", "strength").distinct().withColumn("fits", F.lit(True))
        c = c.join(known, "code", "left").join(fits, ["code", "strength"], "left")
        score = score + F.when(F.col("fits"), 0.4).when(F.col("listed") & F.col("strength").isNotNull(), -0.15).otherwise(0.0)
    if classes:
        own, others = inferred_class(text, classes), F.col("context")
        goes = F.when(F.array_contains(others, own), 0.15)
        for a, b, bonus in TOGETHER:
            goes = goes.when(((own == a) & F.array_contains(others, b)) | ((own == b) & F.array_contains(others, a)), bonus)
        score = score + goes.otherwise(0.0)
    c = c.withColumn("score", F.round(score, 6)).withColumn("match", F.lit("ocr_corrected"))
    return best(c, -F.col("score"), F.col("distance"), keep=("code", "match", "distance", "score"))
