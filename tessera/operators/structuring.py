"""Typed records out of a model's JSON answers, and patches of them by verdicts on single fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.reports import completeness

CORRUPT = "_corrupt_record"


def _texts(*names: str) -> str:
    return ", ".join(f"{n} string" for n in names)


ANSWER = f"""patient struct<{_texts('name', 'dob', 'gender', 'mrn', 'address', 'phone', 'insurance', 'insurance_id').replace(' string', ':string')}>,
    medications array<struct<name:string,strength:string,route:string,frequency:string,quantity:string,refills:string,instructions:string,prescriber:string,status:string,source_text:string>>,
    findings array<struct<finding:string,category:string,severity:string,location:string,source_text:string>>, dates array<struct<date_type:string,date_value:string>>,
    providers array<struct<name:string,role:string,specialty:string,npi:string>>, organizations array<struct<name:string,address:string,phone:string>>,
    additional_fields map<string,string>, invoice map<string,string>, {CORRUPT} string"""


def filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def joined_words(text: Column) -> Column:
    """Words that a scanner split are joined: a letter, a space and a small letter; a lone capital and the word after it."""
    return F.regexp_replace(F.regexp_replace(text, r"([a-zA-Z])\s([a-z])", "$1$2"), r"(^|(?<=[\s,]))([A-Z])\s([a-z]{2,})", "$2$3")


def parsed(rows: DataFrame, key: str, answer: str) -> DataFrame:
    """key, a (the typed answer, null where it is not JSON) and corrupt. Fields of another type than the schema's make the answer corrupt."""
    read = F.from_json(answer, ANSWER, {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"})
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    return rows.select(key, read.alias("r")).select(key, F.when(~bad, F.col("r")).alias("a"), bad.alias("corrupt"))


def patient_of(p: Column) -> Column:
    """Name, birth date, sex, number, address, phone and insurance; confidence .8 by the first four fields, .2 by the others."""
    share = lambda names: sum((filled(p[n]).cast("int") for n in names), F.lit(0)) / len(names)
    confidence = F.round(share(("name", "dob", "gender", "mrn")) * 0.8 + share(("address", "phone", "insurance", "insurance_id")) * 0.2, 2)
    insurance = F.when(filled(p["insurance"]), p["insurance"]).otherwise(p["insurance_id"])
    plain = [p[n].alias(n) for n in ("gender", "mrn", "address", "phone")]
    return F.when(p.isNotNull(), F.struct(joined_words(p["name"]).alias("name"), joined_words(p["dob"]).alias("dob"), *plain, insurance.alias("insurance"), confidence.alias("confidence")))


def kept_first(items: Column, same) -> Column:
    """The items whose key no earlier item of the array has."""
    keys = F.transform(items, same)
    return F.filter(items, lambda x, i: F.array_position(keys, same(x)) == i + 1)


def items_of(items: Column, needs: str, counts: Sequence[str], keep: Sequence[str], words: Sequence[str] = ()) -> Column:
    """Items with a value of `needs`: the fields `keep` (those of `words` joined), and confidence by how many of `counts` are filled."""
    usable = F.filter(items, lambda x: filled(x[needs]))
    shaped = F.transform(usable, lambda x: F.struct(*[(joined_words(x[n]) if n in words else x[n]).alias(n) for n in keep], completeness([x[c] for c in counts]).alias("confidence")))
    return F.coalesce(shaped, F.array())


def structured(answers: DataFrame, key: str) -> DataFrame:
    """`parsed` answers as records: patient, medications (the first of each name), findings, dates, providers, organizations, raw_fields and warnings.

    An answer that is not JSON gives an empty record with a warning. Invoice fields go to raw_fields as invoice_..., unless they are empty.
    """
    a = lambda n: F.col(f"a.{n}")
    drugs = items_of(a("medications"), "name", ("strength", "frequency", "instructions"), ("name", "strength", "route", "frequency", "quantity", "refills", "instructions", "prescriber", "status"))
    dates = F.transform(F.filter(a("dates"), lambda x: filled(x["date_value"])), lambda x: F.struct(F.coalesce(x["date_type"], F.lit("other")).alias("date_type"), joined_words(x["date_value"]).alias("date_value"), F.lit(0.8).alias("confidence")))
    invoice = F.transform_keys(F.map_filter(a("invoice"), lambda k, v: filled(v)), lambda k, v: F.when(k.startswith("invoice"), k).otherwise(F.concat(F.lit("invoice_"), k)))
    none = F.create_map().cast("map<string,string>")
    raw = F.map_concat(F.coalesce(a("additional_fields"), none), F.coalesce(invoice, none))
    warn = F.when(F.col("corrupt"), F.array(F.lit("LLM returned empty response"))).otherwise(F.array().cast("array<string>"))
    return answers.select(
        key,
        patient_of(a("patient")).alias("patient"),
        kept_first(drugs, lambda m: F.lower(F.trim(m["name"]))).alias("medications"),
        items_of(a("findings"), "finding", ("category", "severity", "location"), ("finding", "category", "severity", "location")).alias("findings"),
        F.coalesce(dates, F.array()).alias("dates"),
        items_of(a("providers"), "name", ("role", "specialty", "npi"), ("name", "role", "npi", "specialty"), ("name",)).alias("providers"),
        items_of(a("organizations"), "name", ("address", "phone"), ("name", "address", "phone")).alias("organizations"),
        raw.alias("raw_fields"),
        warn.alias("warnings"),
    )


#: What a failed verdict says of a field in the warnings.
SAID = {"patient_dob": "DOB removed: ", "patient_name": "Patient name uncertain: ", "invoice_number": "Invoice number removed: "}


def reconciled(records: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Records patched by verdicts (key, field, correct, reason) on patient_dob, patient_name and invoice_number.

    A birth date that failed goes; a name that failed stays, its patient's confidence .3 less (.1 at least); an invoice number goes from raw_fields; each leaves a warning. Only
    fields that the record has are judged; verdicts that are right, unknown or on other fields change nothing. If several verdicts on a field fail, the least reason is told.
    """
    failed = verdicts.where(~F.col("correct") & F.col("field").isin(*SAID))
    failed = failed.groupBy(key).agg(*[F.min(F.when(F.col("field") == f, F.coalesce("reason", F.lit("failed verification")))).alias(f"__{f}") for f in SAID])
    r = records.join(failed, key, "left")
    has = {"patient_dob": filled(F.col("patient.dob")), "patient_name": filled(F.col("patient.name")), "invoice_number": filled(F.col("raw_fields")["invoice_number"])}
    hit = {f: F.coalesce(F.col(f"__{f}").isNotNull() & has[f], F.lit(False)) for f in SAID}
    p = F.col("patient")
    p = F.when(hit["patient_dob"], p.withField("dob", F.lit(None).cast("string"))).otherwise(p)
    lower = F.greatest(F.lit(0.1), F.round(F.col("patient.confidence") - 0.3, 2))
    p = F.when(hit["patient_name"], p.withField("confidence", lower)).otherwise(p)
    raw = F.when(hit["invoice_number"], F.map_filter("raw_fields", lambda k, v: k != "invoice_number")).otherwise(F.col("raw_fields"))
    told = F.filter(F.array(*[F.when(hit[f], F.concat(F.lit(t), f"__{f}")) for f, t in SAID.items()]), lambda w: w.isNotNull())
    return r.withColumns({"warnings": F.concat("warnings", told), "raw_fields": raw, "patient": p}).select(*records.columns)
