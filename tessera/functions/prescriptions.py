"""Prescription text: drug names, lines that order a drug with what the next lines add, the people named, entry confidence.

Expressions throughout: the line scan is a fold over a text's lines, so it stays in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import first_group, let

# What stands around a drug's name, taken off one after the other.
AROUND_NAME = [
    r"^(TAB|CAP|CAPS|INJ|SYR|SUSP|OINT|GEL|DRP|DROPS|CR|LOT|LOTION|INHALER|PATCH|SUPP)\.?\s+",
    r"\s+\d*\s*(morning|evening|night|bedtime|afternoon|before\s+food|after\s+food|empty\s+stomach|sos|stat|prn)$",
    r"\s+\d+(\.\d+)?\s*(mg|mcg|g|ml|units?|%|/\d+).*$",
    r"\s+\d+(\.\d+)?$",
    r"\s+(tablet|capsule|cap|tab|pill|cream|ointment|gel|solution|suspension|syrup|injection|patch|inhaler|spray|drops|suppository|liquid|powder)s?$",
]
# Forms of a dosage.
DOSAGES = [r"\d+\s*(mg|mcg|g|ml|units?|iu)", r"\d+/\d+", r"\d+\.\d+\s*(mg|mcg|g|ml)"]
# Lines that order nothing, and the four forms of a line that does, in the order they are tried.
NO_ORDER = [
    r"(physician|provider|patient|address|date|phone|fax|dea|npi)",
    r"(please|see|refill|staff|clinic|center|building|street)",
    r"\d{1,2}[./]\d{1,2}[./]\d{2,4}$",
    r"\d{3}[-.]?\d{3}[-.]?\d{4}$",
    r"(chief|complaint|diagnosis|advice|follow)",
    r"(weight|height|bp|b\.?m\.?i)",
]
_NAME, _DOSE, _FORM = r"([A-Za-z][A-Za-z-]{1,29}[A-Za-z])\s+", r"([ZzOo\d][\dOoZz.]*\s*(?:mg|my|ml|mcg|g|%))", r"(?:\s*(?:cap|tab|capsule|tablet)s?)?"
DOSED = rf"(?i)^{_NAME}{_DOSE}{_FORM}(?:\s*[x×#÷]?\s*(\d+))?(?:\s*\((\d+)\))?"
PRESCRIBED = rf"(?i)^R[x]?\s*[:\s]*{_NAME}{_DOSE}{_FORM}(?:\s*[x×#]?\s*(\d+))?"
HANDWRITTEN = r"(?i)^([A-Za-z][A-Za-z]{2,29})\s+[A-Za-z0-9\s]*(?:cap|tab|capsule|tablet)s?\s*[#x×]?\s*(\d+)"
FORM_FIRST = r"(?i)^(?:\d+\)?\s*)?(?:TAB\.?|CAP\.?|SYR\.?|INJ\.?|SUSP\.?|DROPS?\.?|CREAM\.?|GEL\.?|OINT\.?)\s+([A-Za-z][A-Za-z0-9-]{1,29})(?:\s+(\d+(?:\.\d+)?\s*(?:mg|ml|mcg|g|%)?)\s*)?(?:\s*/\s*SR)?"
# What the lines after such a line say.
TOTAL = r"(?i)\(Tot[:\s]*(\d+)\s*(?:Tab|Cap|Tabs|Caps)?\)"
DURATION = r"(?i)(\d+)\s*(?:Days?|Weeks?|Months?)"
TIMES = r"(?i)(\d+\s*(?:Morning|Night|Evening|Noon|Afternoon|Bedtime)(?:\s*,\s*\d+\s*(?:Morning|Night|Evening|Noon|Afternoon|Bedtime))?)(?:\s*\(([^)]+)\))?"
MEALS = r"(?i)\(([^)]*(?:Food|Meal|Empty|Stomach)[^)]*)\)"
A_DAY = [r"(?i)(\d+)\s*x\s*a?\s*day", r"(?i)(\d+)\s*times?\s*(?:a\s*)?day", r"(?i)(?:cap|tab)s?\s*(\d+)\s*x"]

ORDER = "struct<kind:string,line:string,name:string,dosage:string,quantity:string,frequency:string,duration:string,instructions:string,rest:string,wait:int>"


def drug_name(text: Column) -> Column:
    """The name in an entry without form, times and strength; the entry itself if nothing is left."""
    out = F.trim(reduce(lambda c, p: F.regexp_replace(c, "(?i)" + p, ""), AROUND_NAME, F.trim(text)))
    return F.coalesce(F.nullif(out, F.lit("")), text)


def is_dosage(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(DOSAGES)), F.lit(False))


def _kind(line: Column) -> Column:
    none = (F.length(line) < 5) | line.rlike("(?i)^(?:" + "|".join(NO_ORDER) + ")")
    out = F.when(line.rlike(DOSED), "dosed").when(line.rlike(PRESCRIBED), "prescribed").when(line.rlike(HANDWRITTEN), "handwritten").when(line.rlike(FORM_FIRST), "form first")
    return F.when(~none, out)


def _group(line: Column, pattern: str, k: int) -> Column:
    return F.trim(F.regexp_extract(line, pattern, k))


def _begun(line: Column, kind: Column) -> Column:
    """The order that a line begins, with what it says itself."""
    pick = lambda **by: reduce(lambda o, k: F.when(kind == k.replace("_", " "), by[k]).otherwise(o), by, F.lit(""))
    paired = F.coalesce(F.nullif(_group(line, DOSED, 3), F.lit("")), _group(line, DOSED, 4))
    first = F.regexp_extract(line, r"(?i)(\d+)\s*(?:mg|my|ml|mcg|g)?", 1)
    guess = F.when((first != "") & (first != _group(line, HANDWRITTEN, 2)), F.concat(first, F.lit("mg"))).otherwise("")
    strength = _group(line, FORM_FIRST, 2)
    strength = F.when((strength != "") & ~strength.rlike("(?i)(mg|ml|mcg|g|%)$"), F.concat(strength, F.lit("mg"))).otherwise(strength)
    return F.struct(
        kind.alias("kind"), line.alias("line"),
        pick(dosed=_group(line, DOSED, 1), prescribed=_group(line, PRESCRIBED, 1), handwritten=_group(line, HANDWRITTEN, 1), form_first=_group(line, FORM_FIRST, 1)).alias("name"),
        pick(dosed=_group(line, DOSED, 2), prescribed=_group(line, PRESCRIBED, 2), handwritten=guess, form_first=strength).alias("dosage"),
        pick(dosed=paired, prescribed=_group(line, PRESCRIBED, 3), handwritten=_group(line, HANDWRITTEN, 2)).alias("quantity"),
        F.lit("").alias("frequency"), F.lit("").alias("duration"), F.lit("").alias("instructions"), line.alias("rest"),
        F.when(kind == "handwritten", 3).otherwise(0).alias("wait"),
    ).cast(ORDER)


def _told(o: Column) -> Column:
    """An order with what its further lines say."""
    rest, sig = o["rest"], o["instructions"]
    a_day = F.coalesce(*[first_group(sig, p) for p in A_DAY])
    meals = F.coalesce(F.nullif(_group(rest, TIMES, 2), F.lit("")), F.trim(first_group(rest, MEALS)), F.lit(""))
    form, hand = o["kind"] == "form first", o["kind"] == "handwritten"
    return F.struct(
        o["kind"].alias("kind"), o["line"].alias("line"), o["name"].alias("name"), o["dosage"].alias("dosage"),
        F.when(form, F.regexp_extract(rest, TOTAL, 1)).otherwise(o["quantity"]).alias("quantity"),
        F.when(form, _group(rest, TIMES, 1)).when(hand & a_day.isNotNull(), F.concat(a_day, F.lit("x daily"))).otherwise("").alias("frequency"),
        F.when(form, F.regexp_extract(rest, DURATION, 0)).otherwise("").alias("duration"),
        F.when(form, meals).otherwise(sig).alias("instructions"),
    )


def orders(text: Column) -> Column:
    """The drugs a text orders, line by line: (kind, line, name, dosage, quantity, frequency, duration, instructions).

    A line that begins with a form takes the next four lines, up to the next such line, as its own; a handwritten one waits three
    lines for a line that begins with "sig". Lines taken begin no order.
    """
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    # Each line is read once: what the fold names, it computes again at every mention.
    lines = F.transform(lines, lambda x: F.struct(x.alias("line"), x.rlike(FORM_FIRST).alias("form"), F.lower(x).startswith("sig").alias("sig"), _kind(x).alias("kind")))
    lines = F.transform(lines, lambda r: F.struct(*[r[c].alias(c) for c in ("line", "form", "sig", "kind")], F.when(r["kind"].isNotNull(), _begun(r["line"], r["kind"])).alias("order")))
    state = f"struct<left:int,out:array<{ORDER}>,open:array<{ORDER}>>"  # open: the last order, and those that wait or come after one that does

    def step(s: Column, read: Column) -> Column:
        line, form, sig = read["line"], read["form"], read["sig"]
        waits = F.exists(s["open"], lambda o: o["wait"] > 0) & sig
        mine = (s["left"] > 0) & ~form
        kind = F.when(mine | waits | (line == ""), F.lit(None).cast("string")).otherwise(read["kind"])
        n = F.size(s["open"])

        def passed(o: Column, i: Column) -> Column:
            gets = (o["wait"] > 0) & sig
            rest = F.when(mine & (i == n - 1) & (line != ""), F.concat(o["rest"], F.lit(" "), line)).otherwise(o["rest"])
            wait = F.when(gets, 0).otherwise(F.greatest(o["wait"] - 1, F.lit(0)))
            kept = [o[c].alias(c) for c in ("kind", "line", "name", "dosage", "quantity", "frequency", "duration")]
            return F.struct(*kept, F.when(gets, line).otherwise(o["instructions"]).alias("instructions"), rest.alias("rest"), wait.alias("wait")).cast(ORDER)

        def closed(x: Column) -> Column:
            """The state with the orders that nothing can change any more moved to the others, in order."""
            held = F.filter(F.sequence(F.lit(1), F.size(x["open"])), lambda i: F.get(x["open"], i - 1)["wait"] > 0)
            done = F.when(F.size(x["open"]) == 0, 0).otherwise(F.least(F.size(x["open"]), F.coalesce(F.get(held, F.lit(0)), F.size(x["open"]))) - 1)
            out = F.when(done > 0, F.concat(s["out"], F.slice(x["open"], F.lit(1), done))).otherwise(s["out"])
            return F.struct(x["left"].alias("left"), out.alias("out"), F.slice(x["open"], done + 1, F.size(x["open"])).alias("open")).cast(state)

        after = F.transform(s["open"], passed)
        after = F.when(kind.isNotNull(), F.concat(after, F.array(read["order"]))).otherwise(after)
        left = F.when(kind == "form first", 4).when(form, 0).otherwise(F.greatest(s["left"] - 1, F.lit(0)))
        return let(F.struct(left.alias("left"), after.alias("open")), closed)

    none = F.array().cast(f"array<{ORDER}>")
    start = F.struct(F.lit(0).alias("left"), none.alias("out"), none.alias("open")).cast(state)
    return F.aggregate(lines, start, step, lambda s: F.transform(F.concat(s["out"], s["open"]), _told))


def prescriber(text: Column) -> Column:
    phone = r"(?i)(?:phone|tel|ph)[:\s]*(\(?[\d]{3}\)?[-.\s]?[\d]{3}[-.\s]?[\d]{4})"
    return F.struct(first_group(text, r"(?i)NPI[:\s]*(\d{10})").alias("npi"), first_group(text, r"(?i)DEA[:\s]*([A-Z]{2}\d{7})").alias("dea"), first_group(text, phone).alias("phone"))


def patient(text: Column) -> Column:
    """Birth date, record number and allergies ("none" and "NKDA": an empty list)."""
    told = first_group(text, r"(?i)(?:Allergies|Allergy)[:\s]*([^\n]+)")
    listed = F.when(told.rlike("(?i)none|nkda") | told.isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.split(told, ","), lambda x: F.trim(x)))
    born = first_group(text, r"(?i)(?:DOB|Date of Birth)[:\s]*([\d]{1,2}[/-][\d]{1,2}[/-][\d]{2,4})")
    return F.struct(born.alias("dob"), first_group(text, r"(?i)(?:MRN|Patient ID|Medical Record)[:\s]*([\w\d-]+)").alias("mrn"), listed.alias("allergies"))


def written_on(text: Column) -> Column:
    date = r"([\d]{1,2}[/-][\d]{1,2}[/-][\d]{2,4})"
    return F.coalesce(first_group(text, r"(?i)(?:Date|Prescribed|Rx Date)[:\s]*" + date), first_group(text, date))


# Words that make a frequency or a route.
FREQUENCY_WORDS = ["daily", "twice", "once", "hour", "bid", "tid", "qid", "prn", "morning", "evening", "night", "bedtime", "meal", "weekly"]
ROUTE_WORDS = ["oral", "topical", "iv", "im", "subcutaneous", "sublingual", "inhaled", "nasal", "ophthalmic", "otic", "rectal", "vaginal", "transdermal", "by mouth", "injection", "applied"]


def entry_confidence(match: Column, similarity: Column, distance: Column, strength_known: Column, class_known: Column, strength: Column, frequency: Column, route: Column, quantity: Column, instructions: Column) -> Column:
    """Confidence in a drug entry: by how its name was found (null: by its look only), and by what else it says."""
    near = 0.40 + 0.25 * similarity - F.when(distance >= 4, 0.10).otherwise(0.0) + F.when(strength_known, 0.10).otherwise(0.0) + F.when(class_known, 0.08).otherwise(0.0)
    base = F.when(match.isNull(), 0.5).when(match == "exact", 0.85).when(match == "prefix", 0.75).when(match == "word_prefix", 0.70).when(match == "ocr_corrected", near).otherwise(0.65)
    has = lambda c, words: F.coalesce(F.lower(c).rlike("|".join(words)), F.lit(False))
    said = [
        (has(strength, ["mg", "mcg", "g", "ml", "unit", "%"]), 0.05, 0.15),
        (has(frequency, FREQUENCY_WORDS), 0.03, 0.15),
        (has(route, ROUTE_WORDS), 0.02, 0.1),
        (F.coalesce(quantity.rlike(r"\d"), F.lit(False)), 0.02, 0.05),
        (F.coalesce(F.length(F.trim(instructions)) > 5, F.lit(False)), 0.03, 0.05),
    ]
    extra = sum((F.when(there, F.when(match.isNull(), alone).otherwise(known)).otherwise(0.0) for there, known, alone in said), F.lit(0.0))
    return F.least(base + extra, F.lit(1.0))
