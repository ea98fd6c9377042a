"""Gates by fixed lists: fields that are no measurements, named thresholds, the processor of a document's type, known code systems."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields of a report's head and frame, and parts of names that only such fields have.
METADATA = [
    "patient_id", "patient_name", "patient", "name", "dob", "date_of_birth",
    "birth_date", "birthdate", "age", "sex", "gender", "sex_female", "sex_male",
    "female", "male", "m", "f", "patient_number", "mrn", "medical_record_number",
    "account", "account_number", "acct", "acct_number", "order_number",
    "order_id", "accession", "accession_number", "requisition", "requisition_number",
    "specimen_id", "specimen_number", "specimen", "sample_id", "sample_number",
    "collection_date", "received_date", "reported_date", "report_date",
    "physician", "doctor", "ordering_physician", "provider", "npi",
    "facility", "lab", "laboratory", "clinic", "hospital", "address",
    "phone", "fax", "client",
    "test", "test_name", "result", "units", "reference", "reference_interval",
    "reference_range", "flag", "status", "current", "previous", "date",
    "in_range", "out_of_range", "normal", "abnormal", "critical",
    "page", "page_number", "total_pages", "fasting", "fasting_status",
    "blood_group", "blood_type", "abo_type", "abo", "rh_type", "rh",
    "rh_d_type", "a", "b", "o", "ab", "positive", "negative",
]
METADATA_PARTS = [
    "patient", "account", "specimen", "accession", "order",
    "requisition", "collection_date", "report_date", "received_date",
    "physician", "provider", "npi", "facility", "address",
    "phone", "fax", "page_", "_page", "client_", "_id",
]
# Thresholds by name, and types of documents with their processors; other types are for the fallback.
THRESHOLDS = {"default": 0.85, "template": 0.85, "human_review": 0.70, "classification": 0.85}
PROCESSORS = {"lab": "lab", "radiology": "radiology", "pathology": "pathology", "prescription": "prescription"}


def is_metadata_field(name: Column) -> Column:
    """Whether a field belongs to the report's head: one of the list, or with one of the parts, written any way. A missing name does not."""
    n = F.replace(F.replace(F.trim(F.lower(name)), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    part = reduce(lambda a, p: a | n.contains(p), METADATA_PARTS, F.lit(False))
    return F.coalesce((name != "") & (n.isin(METADATA) | part), F.lit(False))


def meets_threshold(confidence: Column, name: Column) -> Column:
    """Whether a confidence reaches the threshold of that name; an unknown name has that of "default"."""
    bar = F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv])[name]
    return confidence >= F.coalesce(bar, F.lit(THRESHOLDS["default"]))


def processor_of(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PROCESSORS.items() for x in kv])[kind], F.lit("fallback"))


def known_system(system: Column, expected: Sequence[str]) -> Column:
    """Whether a code's system is one of those expected; a missing one is not."""
    return F.coalesce(system.isin(list(expected)), F.lit(False))
