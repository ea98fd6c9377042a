"""Who a laboratory report is about, when it was made and by whom, by labels; and whatever fields an unknown document shows.

Labels are tried in their order and the first that matches counts. Patterns take letters, digits and white space of all scripts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let

# The ways to write a date, in the order they are tried.
DATES = [
    r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})",
    r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})",
    r"([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})",
]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
# Labels of reports, in the order they are tried.
PATIENT = [r"patient\s*(?:name)?:?\s*", r"name:?\s*", r"pt\s*(?:name)?:?\s*"]
BORN = [r"(?:date\s+of\s+)?birth:?\s*", r"d\.?o\.?b\.?:?\s*", r"dob:?\s*", r"born:?\s*"]
PATIENT_ID = [r"patient\s*id:?\s*", r"mrn:?\s*", r"medical\s*record\s*(?:number|#)?:?\s*", r"account\s*(?:number|#)?:?\s*", r"acct\s*(?:number|#)?:?\s*"]
PHYSICIAN = [r"ordering\s*(?:physician|provider|doctor|md):?\s*", r"physician:?\s*", r"provider:?\s*", r"ordered\s*by:?\s*", r"requesting\s*(?:physician|provider):?\s*"]
DIRECTOR = [r"(?:lab(?:oratory)?|medical)\s*director:?\s*", r"pathologist:?\s*", r"reported\s*by:?\s*"]
COLLECTED = [r"collected:?\s*", r"collection\s*(?:date|time)?:?\s*", r"specimen\s*collected:?\s*", r"draw\s*date:?\s*"]
RECEIVED = [r"received:?\s*", r"received\s*(?:date|time)?:?\s*", r"specimen\s*received:?\s*"]
REPORTED = [r"report(?:ed)?\s*(?:date)?:?\s*", r"resulted?:?\s*", r"final(?:ized)?:?\s*", r"printed:?\s*"]
ACCESSION = [r"accession\s*(?:number|#|no)?:?\s*", r"specimen\s*(?:id|number|#):?\s*", r"lab\s*(?:id|number|#):?\s*", r"order\s*(?:id|number|#):?\s*"]
NAME = r"([A-Z][a-zA-Z'-]+(?:\s+[A-Z][a-zA-Z'-]+)+)"
SIGNED = r"([A-Z][a-zA-Z'-]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-zA-Z'-]+)(?:,?\s*(M\.?D\.?|D\.?O\.?|Ph\.?D\.?))?"
LABORATORIES = [r"(labcorp|laboratory\s+corporation)", r"(quest\s+diagnostics)", r"(bioreference|bio-?reference)", r"(sonic\s+healthcare)"]


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, case-blind; null without one, or where the group took no part."""
    p = "(?iU)" + pattern
    return F.when(text.rlike(p), F.nullif(F.regexp_extract(text, p, group), F.lit("")))


def first_found(text: Column, labels: Sequence[str], value: str) -> Column:
    return F.coalesce(*[found(text, label + value) for label in labels])


def _date(text: Column, pattern: str) -> Column:
    """The date of a label's first match, if there is such a day."""
    p = "(?iU)" + pattern
    names = F.array(*[F.lit(m[:k]) for m in MONTHS for k in (3, len(m))])  # of month i at places 2 i - 1 and 2 i
    number = lambda c: c.try_cast("int")

    def day_of(x: Column) -> Column:
        named, led = x["at"] > 0, F.length(x["a"]) == 4
        year = F.when(led & ~named, number(x["a"])).otherwise(number(x["c"]))
        year = F.when(year >= 100, year).when(year < 50, year + 2000).otherwise(year + 1900)
        month = F.when(named, F.floor((x["at"] + 1) / 2).cast("int")).when(led, number(x["b"])).otherwise(number(x["a"]))
        day = F.when(led & ~named, number(x["c"])).otherwise(number(x["b"]))
        return F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date")

    a, b, c = (F.regexp_extract(text, p, k) for k in (1, 2, 3))
    return F.when(text.rlike(p), let(F.struct(a.alias("a"), b.alias("b"), c.alias("c"), F.array_position(names, F.lower(a)).alias("at")), day_of))


def first_date(text: Column, labels: Sequence[str]) -> Column:
    return F.coalesce(*[_date(text, label + d) for label in labels for d in DATES])


def _sure(*values: Column) -> Column:
    """.5 and .15 for each value found, .95 at most; null without any."""
    n = reduce(lambda a, v: a + v.isNotNull().cast("int"), values, F.lit(0))
    return F.when(n > 0, F.round(F.least(F.lit(0.95), 0.5 + n * 0.15), 2))


def patient(text: Column, today: Column) -> Column:
    """struct(name, first_name, middle_name, last_name, birth_date, age, sex, id, confidence), or null. The age is that of the birth date, else the one that is written."""

    def shaped(x: Column) -> Column:
        parts = F.split(x["name"], r"(?U)\s+")
        n = F.size(parts)
        several = n >= 2
        years = F.year(today) - F.year(x["born"]) - F.when((F.month(today) < F.month(x["born"])) | ((F.month(today) == F.month(x["born"])) & (F.dayofmonth(today) < F.dayofmonth(x["born"]))), 1).otherwise(0)
        sure = _sure(x["name"], x["born"], x["sex"], x["id"])
        out = F.struct(
            x["name"].alias("name"), F.when(several, F.get(parts, F.lit(0))).alias("first_name"), F.when(n > 2, F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), " ")).alias("middle_name"), F.when(several, F.get(parts, n - 1)).alias("last_name"),
            x["born"].alias("birth_date"), F.coalesce(F.nullif(years, F.lit(0)), x["age"]).alias("age"), x["sex"].alias("sex"), x["id"].alias("id"), sure.alias("confidence"),
        )
        return F.when(sure.isNotNull(), out)

    sex = F.upper(F.substring(found(text, r"(?:sex|gender):?\s*([MF](?:ale)?|Female?)"), 1, 1))
    age = found(text, r"age:?\s*(\d{1,3})\s*(?:y(?:ears?)?|yo)?").try_cast("int")
    return let(F.struct(F.trim(first_found(text, PATIENT, NAME)).alias("name"), first_date(text, BORN).alias("born"), age.alias("age"), sex.alias("sex"), first_found(text, PATIENT_ID, "([A-Z0-9]{4,20})").alias("id")), shaped)


def specimen(text: Column) -> Column:
    """struct(accession, kind, collected, fasting, confidence), or null."""

    def shaped(x: Column) -> Column:
        sure = _sure(x["accession"], x["kind"], x["collected"])
        return F.when(sure.isNotNull(), F.struct(*[x[c].alias(c) for c in ("accession", "kind", "collected", "fasting")], sure.alias("confidence")))

    kind = F.initcap(found(text, r"(?:specimen|sample)\s*(?:type)?:?\s*(blood|serum|plasma|urine|whole blood|edta|lavender)"))
    fasting = F.lower(found(text, r"fasting:?\s*(yes|no|y|n)")).isin("yes", "y")
    return let(F.struct(first_found(text, ACCESSION, r"([A-Z0-9\-]{6,20})").alias("accession"), kind.alias("kind"), first_date(text, COLLECTED).alias("collected"), fasting.alias("fasting")), shaped)


def report(text: Column, header: Column) -> Column:
    """struct(collected, received, reported, order_id, status, pages, confidence), or null. Its own date is looked for in the last 2,000 signs, where reports carry it; pages anywhere; the
    rest in the header."""

    def shaped(x: Column) -> Column:
        sure = _sure(x["collected"], x["reported"], x["order_id"])
        return F.when(sure.isNotNull(), F.struct(*[x[c].alias(c) for c in ("collected", "received", "reported", "order_id", "status", "pages")], sure.alias("confidence")))

    end = F.when(F.length(text) > 2000, F.right(text, F.lit(2000))).otherwise(text)
    status = F.when(header.rlike(r"(?iU)\b(?:preliminary|pending)\b"), "preliminary").when(header.rlike(r"(?iU)\b(?:corrected|amended)\b"), "corrected").otherwise("final")
    pages = found(text, r"page\s*\d+\s*of\s*(\d+)").try_cast("int")
    order = found(header, r"order\s*(?:number|#|no)?:?\s*([A-Z0-9\-]{6,20})")
    return let(F.struct(first_date(header, COLLECTED).alias("collected"), first_date(header, RECEIVED).alias("received"), first_date(end, REPORTED).alias("reported"), order.alias("order_id"), status.alias("status"), pages.alias("pages")), shaped)


def practitioner(text: Column, labels: Sequence[str]) -> Column:
    """struct(name, credentials, npi, confidence) of the first label with a name, or null."""
    said = F.coalesce(*[F.when(found(text, p + SIGNED).isNotNull(), F.struct(F.trim(found(text, p + SIGNED)).alias("name"), F.replace(found(text, p + SIGNED, 2), F.lit("."), F.lit("")).alias("credentials"))) for p in labels])
    return let(said, lambda s: F.when(s.isNotNull(), F.struct(s["name"].alias("name"), s["credentials"].alias("credentials"), found(text, r"npi:?\s*(\d{10})").alias("npi"), F.lit(0.85).alias("confidence"))))


def organization(text: Column, template: Column) -> Column:
    """struct(name, display_name, clia, phone, confidence), or null; a vendor's template names it before the text does."""
    t = F.lower(template)
    known = F.when(t.contains("labcorp"), "LabCorp").when(t.contains("quest"), "Quest Diagnostics")
    shown = F.when(t.contains("labcorp"), "Laboratory Corporation of America").when(t.contains("quest"), "Quest Diagnostics Incorporated")
    name = F.coalesce(known, *[F.trim(found(text, p)) for p in LABORATORIES])
    clia = found(text, r"clia(?:\s*#?)?:?\s*(\d{2}D?\d{7})")
    phone = found(text, r"(?:phone|tel|call):?\s*(\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4})")
    return F.when(name.isNotNull() | clia.isNotNull(), F.struct(name.alias("name"), shown.alias("display_name"), clia.alias("clia"), phone.alias("phone"), F.lit(0.9).alias("confidence")))


# What stands for itself in any document, in the order it is listed (field, pattern).
STANDALONE = [
    ("email", r"[\w.-]+@[\w.-]+\.\w+"),
    ("phone", r"\b\d{3}[\s.-]?\d{3}[\s.-]?\d{4}\b"),
    ("amount", r"\$[\d,]+\.?\d*"),
    ("date_iso", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("date_text", r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}"),
    ("reference_number", r"#[A-Za-z0-9-]+"),
    ("transaction_id", r"\b(?:ch|pi|in|cus)_[A-Za-z0-9]{10,}\b"),
    ("uuid", r"(?i)\b[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}\b"),
    ("card_info", r"(?i)(?:VISA|MASTERCARD|AMEX|DISCOVER)\s+ending\s+in\s+\d{4}"),
    ("postal_code", r"(?i)\b[A-Z]\d[A-Z]\s*\d[A-Z]\d\b"),
    ("tax_registration", r"(?i)(?:RT|GST|HST|PST|QST)\d+"),
]
LABELLED = r"([A-Za-zéèêëàâäùûüôöîïç\s]{2,40})(?:\s*/\s*[A-Za-zéèêëàâäùûüôöîïç\s]+)?\s*:\s*([^\n]{2,150})"
ADDRESS = r"(?i)(\d+(?:\s*-?\s*\d*[A-Z]?)?\s+[A-Za-z\s]+(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Crescent|Cres|Boulevard|Blvd|Way|Lane|Ln)[,\s]+[A-Za-z\s]+,\s*[A-Z]{2},?\s*[A-Z]\d[A-Z]\s*\d[A-Z]\d)"
STREET = r"(?i)\b(\d+\s+[A-Za-z\s]+(?:RD|ROAD|ST|STREET|AVE|AVENUE|DR|DRIVE|CRES|CRESCENT))\b"
CITY = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?),\s*([A-Z]{2})\s+([A-Z]\d[A-Z]\s*\d[A-Z]\d)\b"


def _whole_number(pattern: str) -> str:
    """The pattern of ADDRESS so that its number is only tried whole: from its first digit (or where the last match ended) and with all of its digits.

    A match from a later digit or with fewer of them would be one with all of them too, so the matches are the same; tried one by one they take a time that grows with the digits' number cubed.
    """
    return pattern.replace(r"(\d+(?:", r"(?:(?<!\d)|\G)(\d++(?:", 1)


def _all(text: Column, field: Column | str, pattern: str, group: int = 0) -> Column:
    name = F.lit(field) if isinstance(field, str) else field
    return F.transform(F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(group)), lambda v: F.struct(name.alias("name"), v.alias("value")))


def shown_fields(text: Column) -> Column:
    """array<struct(field, value)> of all that a document shows: what stands for itself, label and value pairs, addresses, cities; in this order, each once.

    A field's name is raw_ and its label in small letters, digits and underscores (50 at most, as names are keys); a value's white space is trimmed and one sign is no value. Pairs of one name
    whose values agree in their first 50 signs are one.
    """
    pair = [F.regexp_extract_all(text, F.lit("(?U)" + LABELLED), F.lit(k)) for k in (1, 2)]
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
    labelled = F.zip_with(*pair, lambda label, value: F.struct(label.alias("name"), strip(F.get(F.split(value, r"(?U)\s+[A-Z][a-z]+\s*[/:]"), F.lit(0))).alias("value")))
    places = F.flatten(F.transform(F.arrays_zip(*[F.regexp_extract_all(text, F.lit("(?U)" + CITY), F.lit(k)).alias(c) for k, c in ((1, "city"), (2, "province"), (3, "postal_code_extracted"))]), lambda p: F.array(*[F.struct(F.lit(c).alias("name"), p[c].alias("value")) for c in ("city", "province", "postal_code_extracted")])))
    every = F.concat(*[_all(text, f, p) for f, p in STANDALONE], labelled, _all(text, "address", _whole_number(ADDRESS), 1), _all(text, "street_address", STREET, 1), places)

    def plain(x: Column) -> Column:
        name = F.substring(F.regexp_replace(F.translate(F.lower(strip(x["name"])), " /", "__"), "[^a-z0-9_]", ""), 1, 50)
        return F.struct(F.concat(F.lit("raw_"), name).alias("field"), strip(x["value"]).alias("value"))

    kept = F.filter(F.transform(every, plain), lambda x: (F.length(x["field"]) > 4) & (F.length(x["value"]) >= 2))
    key = lambda x: F.concat(x["field"], F.lit(":"), F.substring(x["value"], 1, 50))
    return let(kept, lambda all_: let(F.transform(all_, key), lambda keys: F.filter(all_, lambda x, i: F.array_position(keys, key(x)) == i + 1)))
