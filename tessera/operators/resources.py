"""Nested clinical records: observations, requests, reports, bundles, and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the status of an observation and of a report may be.
OBSERVATION_STATUSES = ("registered", "preliminary", "final", "amended", "corrected", "cancelled", "entered-in-error")
REPORT_STATUSES = ("registered", "partial", "preliminary", "final", "amended", "corrected", "appended", "cancelled", "entered-in-error", "unknown")
BUNDLES = ("collection", "document", "message")
INTERPRETATIONS = {"H": "H", "L": "L", "N": "N", "CRITICAL HIGH": "HH", "CRITICAL LOW": "LL"}


def concept(system: Column, code: Column, display: Column) -> Column:
    return F.struct(F.array(F.struct(system.alias("system"), code.alias("code"), display.alias("display"))).alias("coding"), display.alias("text"))


def interpretation(flag: Column, default: str = "N") -> Column:
    """Code of a flag; the two builders differ in what an unknown flag becomes, hence the default."""
    m = F.create_map(*[F.lit(x) for kv in INTERPRETATIONS.items() for x in kv])
    return F.coalesce(F.element_at(m, flag), F.lit(default))


def observation(id_: Column, name: Column, value: Column, unit: Column, low: Column, high: Column, flag: Column, when: Column) -> Column:
    """A value of 0 or null gives no quantity, a range without bounds none."""
    quantity = F.when(value.isNotNull() & (value != 0), F.struct(value.alias("value"), unit.alias("unit")))
    range_ = F.when(low.isNotNull() | high.isNotNull(), F.array(F.struct(low.alias("low"), high.alias("high"))))
    return F.struct(
        F.lit("Observation").alias("resourceType"), id_.cast("string").alias("id"), F.lit("final").alias("status"), concept(F.lit("local"), name, name).alias("code"),
        quantity.alias("valueQuantity"), range_.alias("referenceRange"), interpretation(flag).alias("interpretation"), when.alias("effectiveDateTime"),
    )


def medication_request(id_: Column, name: Column, dose: Column, quantity: Column, refills: Column) -> Column:
    dispense = F.when(quantity.isNotNull() | refills.isNotNull(), F.struct(quantity.alias("quantity"), refills.alias("numberOfRepeatsAllowed")))
    return F.struct(F.lit("MedicationRequest").alias("resourceType"), id_.cast("string").alias("id"), F.lit("active").alias("status"), F.lit("order").alias("intent"), concept(F.lit("local"), name, name).alias("medication"), F.array(F.struct(dose.alias("text"))).alias("dosageInstruction"), dispense.alias("dispenseRequest"))


def diagnostic_report(id_: Column, code: Column, conclusion: Column, results: Column) -> Column:
    return F.struct(F.lit("DiagnosticReport").alias("resourceType"), id_.cast("string").alias("id"), F.lit("final").alias("status"), concept(F.lit("local"), code, code).alias("code"), conclusion.alias("conclusion"), results.alias("result"))


def patient(id_: Column, name: Column, sex: Column) -> Column:
    return F.struct(F.lit("Patient").alias("resourceType"), id_.cast("string").alias("id"), F.array(F.struct(name.alias("text"))).alias("name"), F.when(sex.isin("male", "female"), sex).otherwise("unknown").alias("gender"))


def bundles(rows: DataFrame, key: Sequence[str], resource: str, order: str) -> DataFrame:
    """One collection bundle a key with its resources in order; a bundle is one document, as large as its key."""
    g = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(resource)))).alias("e"))
    entry = F.transform("e", lambda x: F.struct(x[resource].alias("resource")))
    return g.select(*key, F.struct(F.lit("Bundle").alias("resourceType"), F.lit("collection").alias("type"), entry.alias("entry")).alias("bundle"))


def observation_errors(o: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(o["status"].isNull(), "no status").when(~o["status"].isin(*OBSERVATION_STATUSES), "bad status"),
            F.when(F.coalesce(F.size(o["code"]["coding"]), F.lit(0)) <= 0, "no code"),
            F.when(o["valueQuantity"].isNull(), "no value"),
            F.when(F.size(o["referenceRange"]) == 0, "empty range"),
        )
    )


def report_errors(r: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(r["status"].isNull(), "no status").when(~r["status"].isin(*REPORT_STATUSES), "bad status"),
            F.when(F.coalesce(F.size(r["code"]["coding"]), F.lit(0)) <= 0, "no code"),
        )
    )


def bundle_errors(b: Column) -> Column:
    return F.array_compact(F.array(F.when(b["type"].isNull() | ~b["type"].isin(*BUNDLES), "bad type"), F.when(F.coalesce(F.size(b["entry"]), F.lit(0)) <= 0, "no entries")))


def count_of(b: Column, kind: str) -> Column:
    return F.size(F.filter(b["entry"], lambda x: x["resource"]["resourceType"] == kind))


def visible(fields: Column) -> Column:
    """A map without the keys that begin with '_'."""
    return F.map_filter(fields, lambda k, v: ~k.startswith("_"))


def range_text(low: Column, high: Column) -> Column:
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(low.cast("string"), F.lit(" - "), high.cast("string"))).when(low.isNotNull(), F.concat(F.lit(">= "), low.cast("string"))).when(high.isNotNull(), F.concat(F.lit("<= "), high.cast("string"))).otherwise("")
