"""Whether a text names a drug: vetoes, the dictionary, and the look of the name; a dictionary by region; warnings on prescriptions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.prescriptions import drug_name
from tessera.sources.shared import written

# Words that are never a drug, in the order they are tried (whole names, without punctuation).
NEVER = [
    r"^(patient|doctor|dr\.|physician|prescriber|pharmacy|pharmacist)$",
    r"^(name|address|phone|fax|date|signature|license|npi|dea)$",
    r"^(refill|quantity|qty|directions|sig|instructions)$",
    r"^(street|avenue|ave|road|rd|boulevard|blvd|suite|ste)$",
    r"^(city|state|zip|zipcode)$",
    r"^\d+$",
    r"^\d{3}[-.]?\d{3}[-.]?\d{4}$",
    r"^\d{5}(-\d{4})?$",
    r"^(the|and|for|with|take|use|apply|as|needed|prn)$",
    r"^(none|n/a|na|not applicable|unknown)$",
    r"^(mr|mrs|ms|dr|md|do|rn|np|pa)\.?$",
]
# Endings of drug names.
ENDINGS = [
    "in", "ol", "ide", "ate", "one", "ine", "an", "il", "al",
    "am", "em", "um", "ic", "ax", "ex", "ix", "ox", "ux",
    "zole", "pril", "sartan", "statin", "mycin", "cycline",
    "cillin", "floxacin", "mab", "nib", "tinib", "zumab",
    "prazole", "tidine", "setron", "triptan", "afil", "fen",
    "profen", "caine", "pam", "lam", "pine", "dipine",
    "azine", "asone", "olone", "isone", "derm", "cort",
]
# Well-known drugs, met anywhere in a name.
COMMON = [
    "aspirin", "tylenol", "advil", "motrin", "aleve", "ibuprofen",
    "acetaminophen", "naproxen", "penicillin", "amoxicillin",
    "metformin", "lisinopril", "atorvastatin", "omeprazole",
    "metoprolol", "amlodipine", "losartan", "gabapentin",
    "hydrocodone", "oxycodone", "tramadol", "prednisone",
    "levothyroxine", "pantoprazole", "sertraline", "fluoxetine",
    "escitalopram", "duloxetine", "bupropion", "trazodone",
    "alprazolam", "lorazepam", "clonazepam", "diazepam",
    "insulin", "warfarin", "eliquis", "xarelto", "plavix",
    "lipitor", "crestor", "zoloft", "lexapro", "prozac",
    "xanax", "ativan", "valium", "ambien", "lunesta",
    "viagra", "cialis", "humira", "enbrel", "remicade",
    "synthroid", "nexium", "prilosec", "zantac", "pepcid",
    "zyrtec", "claritin", "allegra", "benadryl", "flonase",
    "advair", "symbicort", "ventolin", "albuterol", "proair",
    "lantus", "humalog", "novolog", "jardiance", "ozempic",
    "trulicity", "victoza", "farxiga", "invokana", "januvia",
]
# Forms of a dosage, met anywhere in a name, and words of which a name may not consist.
FORMS = [
    "tablet", "capsule", "cap", "tab", "pill", "cream", "ointment",
    "gel", "solution", "suspension", "syrup", "injection", "patch",
    "inhaler", "spray", "drops", "suppository", "liquid", "powder",
]
PLAIN = [
    "the", "and", "for", "are", "but", "not", "you", "all",
    "can", "had", "her", "was", "one", "our", "out", "day",
    "get", "has", "him", "his", "how", "its", "may", "new",
    "now", "old", "see", "way", "who", "boy", "did", "own",
    "say", "she", "too", "use", "take", "with", "daily",
]

REGIONS = ("usa", "canada", "india")


def bare(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"(?U)[^\w\s-]", "")


def has_ending(name: Column, endings: Sequence[str]) -> Column:
    """Whether the name ends in any of the endings: its endings of each length are looked up among those of the same length."""
    out = F.lit(False)
    for n in sorted({len(e) for e in endings}):
        out = out | F.right(name, F.lit(n)).isin([e for e in endings if len(e) == n])
    return F.coalesce(out, F.lit(False))


def vetoed(name: Column) -> Column:
    """Whether a text cannot be a drug: under 3 or over 50 signs, or a word that never is one."""
    return F.coalesce((F.length(name) < 3) | (F.length(name) > 50) | bare(name).rlike("(?i)" + "|".join(NEVER)), F.lit(True))


def looks_like_drug(name: Column) -> Column:
    """By its look alone: a drug's ending, a known drug or a form in it; or a brand: letters, digits, spaces and hyphens, one word or with a digit, and not only of plain words."""
    b, words = bare(name), F.filter(F.split(F.lower(F.trim(name)), r"\s+"), lambda w: w != "")
    known = has_ending(b, ENDINGS) | b.rlike("|".join(COMMON)) | b.rlike("|".join(FORMS))
    brand = name.rlike(r"^[a-zA-Z][a-zA-Z0-9\s-]{2,30}$") & ~F.forall(words, lambda w: w.isin(PLAIN)) & ((F.size(words) == 1) | name.rlike(r"\d"))
    return F.coalesce(known | brand, F.lit(False))


def likely_drugs(names: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(name, valid, code, told_by) of each distinct name: vetoed names are not valid; a name whose drug name or, failing that, whose whole text the dictionary has is; so is
    one that looks like a drug. told_by: veto, dictionary, look or nothing. `find` gives (name, code) of the lower-case names that the dictionary has.

    Both spellings go through the dictionary in one pass, each once; the drug's own name wins. The names with what they look like are written out, as they are read twice.
    """
    n = names.select("name").where("name is not null").distinct().select("name", vetoed(F.col("name")).alias("veto"), looks_like_drug(F.col("name")).alias("look"))
    n = written(n, "judged")
    spelt = n.where("not veto").select(F.col("name").alias("said"), F.posexplode(F.array(F.lower(F.trim(drug_name(F.col("name")))), F.lower(F.trim("name")))).alias("rank", "name"))
    got = find(spelt.select("name").distinct()).select("name", "code")
    best = spelt.join(got, "name").groupBy(F.col("said").alias("name")).agg(F.min_by("code", F.struct("rank", "code")).alias("code"))
    told = F.when(F.col("veto"), "veto").when(F.col("code").isNotNull(), "dictionary").when(F.col("look"), "look").otherwise("nothing")
    return n.join(best, "name", "left").select("name", told.isin("dictionary", "look").alias("valid"), "code", told.alias("told_by"))


def region_of(region: Column, default: str = "usa") -> Column:
    """A known region, written any way; the default for an unknown or missing one."""
    r = F.lower(F.trim(region))
    return F.when(r.isin(*REGIONS), r).otherwise(F.lit(default))


def found_in_region(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """`rows` (name, region, ...) with the least code of the name in its region's dictionary (null: none).

    `dictionary` (entry, code, region) lies in folders by region, so with rows of few regions only those folders are read.
    """
    asked = rows.withColumn("region", region_of(F.col("region")))
    keys = asked.select("name", "region").distinct()
    got = dictionary.join(keys, (dictionary["region"] == keys["region"]) & (F.lower("entry") == F.lower("name"))).groupBy(keys["name"], keys["region"]).agg(F.min("code").alias("code"))
    return asked.join(got, ["name", "region"], "left")


# Drugs that are controlled whatever the dictionary says (met anywhere in a name), and the schedules that are.
CONTROLLED = [
    "oxycodone", "hydrocodone", "morphine", "fentanyl",
    "alprazolam", "diazepam", "lorazepam", "clonazepam",
    "adderall", "ritalin", "methylphenidate", "amphetamine",
]
SCHEDULES = ["Schedule II", "Schedule III", "Schedule IV", "Schedule V"]
REQUIRED = {"name": "medication_name", "strength": "strength/dosage", "route": "route", "frequency": "frequency"}


def class_closure(parents: DataFrame, most: int = 20) -> DataFrame:
    """(class, over) of every class and all classes above it, itself included; `parents`: class, parent. Circles are met once.

    Each round joins what is new with the parents, so rounds are as many as the tree is deep (`most` at most, an error beyond).
    """
    up = parents.select("class", "parent").where("class is not null and parent is not null").distinct()
    every = up.select("class").union(up.select("parent")).distinct()
    found = written(every.select("class", F.col("class").alias("over")), "closure")
    new = found
    for _ in range(most):
        step = new.join(up.select(F.col("class").alias("over"), "parent"), "over").select("class", F.col("parent").alias("over")).distinct()
        new = written(step.join(found, ["class", "over"], "left_anti"), "closure")
        if new.isEmpty():
            return found
        found = found.union(new)
    raise ValueError(f"classes lie more than {most} deep")


def prescription_issues(drugs: DataFrame, prescribers: DataFrame, facts: DataFrame, classes: DataFrame, parents: DataFrame, interactions: DataFrame, unsafe: DataFrame, allergies: DataFrame) -> DataFrame:
    """(doc, kind, place, text): errors and warnings of all prescriptions, each rule a join or a column of its own.

    drugs: doc, place (from 1), name, code, strength, route, frequency, quantity, refills; prescribers: doc, licence; facts: code, schedule, class (one a code); classes: name, class (of
    names, lower case); parents: class, parent; interactions: a, b, text (names, lower case, a < b); unsafe: name, strength, reason (verdicts of a model or a table); allergies: doc, allergy.

    Errors: a required field is missing; the patient is allergic to a drug, to its class or to any class above that. Warnings: an unsafe strength; a controlled drug (by its code's schedule,
    or by its name where the code is not known) without a licence, of over 90, of schedule II with refills or III or IV with over 5; two drugs that interact; a name again;
    a class again, with the class's first drug. The drugs are written out once. Names meet without case. Quantities and refills that are no whole numbers are not judged.
    """
    d = drugs.select("doc", "place", F.coalesce("name", F.lit("")).alias("name"), "code", "strength", "route", "frequency", *[F.col(c).cast("string").try_cast("int").alias(c) for c in ("quantity", "refills")])
    d = written(d, "drugs")  # every rule reads it, and its places may come from a window
    low = F.lower("name")
    numbered = lambda text: F.concat(F.lit("Medication "), F.col("place").cast("string"), F.lit(": "), text)
    issue = lambda rows, kind, text: rows.select("doc", F.lit(kind).alias("kind"), "place", text.alias("text"))
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", said) for c, said in REQUIRED.items()]))
    gone = issue(d.select("*", F.explode(missing).alias("m")), "error", numbered(F.concat(F.lit("Missing "), F.col("m"))))
    risky = issue(d.join(unsafe.select(F.lower("name").alias("u"), F.col("strength").alias("s"), "reason"), (low == F.col("u")) & (F.col("strength") == F.col("s"))), "warning", numbered(F.coalesce("reason", F.lit("Dosage concern"))))
    c = d.join(facts.select("code", "schedule", F.lit(True).alias("known")), "code", "left").join(prescribers.select("doc", "licence"), "doc", "left")
    by_name = F.lit(False)
    for w in CONTROLLED:
        by_name = by_name | low.contains(w)
    c = c.where(F.when(F.col("known"), F.coalesce(F.col("schedule").isin(SCHEDULES), F.lit(False))).otherwise(by_name))
    refills = F.when((F.col("schedule") == "Schedule II") & (F.col("refills") > 0), "Schedule II controlled substance cannot have refills").when(
        F.col("schedule").isin("Schedule III", "Schedule IV") & (F.col("refills") > 5), F.concat("schedule", F.lit(" controlled substance cannot exceed 5 refills"))
    )
    said = [
        F.when(F.coalesce("licence", F.lit("")) == "", "Controlled substance prescribed without DEA number"),
        F.when(F.col("quantity") > 90, F.concat(F.lit("Controlled substance quantity ("), F.col("quantity").cast("string"), F.lit(") exceeds typical 90-day supply"))),
        refills,
    ]
    held = issue(c.select("*", F.explode(F.array_compact(F.array(*said))).alias("w")), "warning", numbered(F.col("w")))
    names = d.where("name <> ''").groupBy("doc", low.alias("low")).agg(F.min("place").alias("place"), F.count("*").alias("n"))
    half = names.join(interactions.select(F.col("a").alias("low"), "b", "text"), "low").select("doc", "low", "place", "b", "text")
    both = half.join(names.select("doc", F.col("low").alias("b")), ["doc", "b"])
    meet = issue(both, "warning", F.concat(F.lit("Drug interaction: "), F.col("text")))
    again = issue(names.where("n > 1").select("doc", "place", "low", F.explode(F.sequence(F.lit(2).cast("long"), F.col("n")))), "warning", F.concat(F.lit("Potential duplicate therapy: Duplicate prescription: "), F.col("low")))
    classed = d.join(facts.select("code", "class"), "code").where("class <> ''")
    first = classed.groupBy("doc", "class").agg(F.min_by("name", F.struct("place", "name")).alias("first"), F.min("place").alias("from"))
    same = classed.join(first, ["doc", "class"]).where("place > from")
    twice = issue(same, "warning", F.concat(F.lit("Potential duplicate therapy: Multiple drugs in same class ("), F.col("class"), F.lit("): "), F.col("first"), F.lit(" and "), F.col("name")))
    above = classes.select(F.lower("name").alias("low"), "class").distinct().join(class_closure(parents), "class", "left").select("low", F.lower(F.coalesce("over", "class")).alias("what"))
    named = d.where("name <> ''").select("doc", "place", "name", low.alias("low")).join(allergies.select("doc", F.lower(F.trim("allergy")).alias("allergy")).distinct(), "doc")
    direct = named.where(F.col("low") == F.col("allergy"))
    through = named.join(above.distinct(), "low").where(F.col("what") == F.col("allergy")).select(*named.columns)
    clash = issue(direct.union(through).distinct(), "error", F.concat(F.lit("Allergy conflict: "), F.col("name"), F.lit(" and "), F.col("allergy")))
    return gone.union(risky).union(held).union(meet).union(again).union(twice).union(clash)


def prescriptions_judged(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """(doc, is_valid, n_errors, n_warnings) of every document of `docs` (doc): valid without any error."""
    n = issues.groupBy("doc").agg(F.count_if(F.col("kind") == "error").alias("n_errors"), F.count_if(F.col("kind") == "warning").alias("n_warnings"))
    out = docs.select("doc").distinct().join(n, "doc", "left").fillna(0, ["n_errors", "n_warnings"])
    return out.select("doc", (F.col("n_errors") == 0).alias("is_valid"), "n_errors", "n_warnings")
