"""Predicates on what a text or a result holds: likely test names, readable text, medical and oncology content, enough values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let

# Names that are no tests, and words that make one.
NO_TEST = [r"(test|result|value|unit|reference|range|flag|status|date|time)s?", r"(patient|name|dob|id|mrn|specimen|collected|received)", r"(page|of|\d+)", r"\s*", r"-+", r"=+"]
TEST_WORDS = [
    "wbc|rbc|hgb|hct|mcv|mch|mchc|plt|rdw",
    "glucose|sodium|potassium|chloride|creatinine|bun",
    "ast|alt|alp|ggt|bilirubin|albumin",
    "tsh|t3|t4|hba1c|a1c",
    "neutrophil|lymphocyte|monocyte|eosinophil|basophil",
    "cholesterol|triglyceride|hdl|ldl",
    "cd4|cd8|ratio",
    "count|level|panel|screen",
]
# Signals of a medical document, and of another.
MEDICAL = [
    "patient|diagnosis|treatment|medication|prescription",
    "clinical|medical|health|hospital|clinic",
    "test|result|specimen|laboratory|blood|urine",
    "reference|range|normal|abnormal|high|low",
    "mg|mcg|ml|g/dl|mmol|units?",
    "report|findings|impression|conclusion",
    "dosage|dose|tablet|capsule|sig:|rx",
    "heart|lung|liver|kidney|brain|bone|tissue",
    "claim|coverage|benefit|insurance|insur[ée]|assuré",
    "paramedical|psychotherapist|counsell?ing|therapist|physiotherapy",
    "participant|provider|fournisseur|prestations",
    "submission|réclamation|santé|mental",
    "receipt|invoice|payment|amount|subtotal|total",
    "service|session|appointment|visit",
]
OTHER = [r"office\s+photo|workspace|meeting\s+room|conference\s+room", r"welcome\s+to|about\s+us|our\s+products", r"all\s+rights\s+reserved"]
# Words of oncology reports.
ONCOLOGY = ["tumor", "cancer", "carcinoma", "adenocarcinoma", "metastasis", "metastatic", "malignancy", "malignant", "mass", "lesion", "nodule", "staging", "tnm"]


def _words(alternatives: str) -> str:
    return rf"(?iU)\b({alternatives})\b"


def _hits(text: Column, lists: Sequence[str]) -> Column:
    return sum((text.rlike(_words(x)).cast("int") for x in lists), F.lit(0))


def likely_test(name: Column) -> Column:
    """Whether a cell looks like the name of a test: no heading, and a known word or up to 50 signs with a letter."""
    s = F.trim(name)
    no = s.rlike("(?i)^(" + "|".join(f"(?:{p})" for p in NO_TEST) + ")$")
    return F.coalesce((F.length(s) >= 2) & ~no & ((_hits(s, TEST_WORDS) > 0) | ((F.length(s) <= 50) & s.rlike("[a-zA-Z]"))), F.lit(False))


def readable(text: Column) -> Column:
    """Whether a text is more than noise: five signs, not only 0 and 1, few backticks, two words, half of them of 2 to 20 signs."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    fair = F.size(F.filter(words, lambda w: F.length(w).between(2, 20)))
    ticks = F.length(text) - F.length(F.replace(text, F.lit("`"), F.lit("")))
    return F.coalesce((F.length(text) >= 5) & text.rlike(r"[^01\s]") & (ticks <= F.length(text) * 0.3) & (F.size(words) >= 2) & (fair >= F.size(words) * 0.5), F.lit(False))


def medical_signals(text: Column) -> Column:
    """How many of the medical signals a text has; 0 where it is too short to tell (50 signs, 10 words)."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.when((F.length(text) < 50) | (words < 10), 0).otherwise(_hits(text, MEDICAL))


def medical_gate(text: Column) -> Column:
    """struct(signals, medical): `medical_signals`, and whether there are two and no more signals of another kind than that; each list is looked for once, the other kinds only with two signals."""

    def told(n: Column) -> Column:
        return F.struct(n.alias("signals"), F.when(n >= 2, _hits(text, OTHER) <= n).otherwise(F.lit(False)).alias("medical"))

    return let(medical_signals(text), told)


def is_medical(text: Column) -> Column:
    """Two signals, and no more signals of another kind than that."""
    return medical_gate(text)["medical"]


def is_oncology(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(ONCOLOGY)), F.lit(False))


def sufficient(values: Column, confidence: Column, fields: Column, text: Column, panels: Sequence[str], least: int, sure: float, ratio: float, most_panels: int = 2) -> Column:
    """Whether a template's result stands alone: enough values, sure enough, enough of its fields, not a report of several panels."""
    several = sum((F.lower(text).contains(p).cast("int") for p in panels), F.lit(0)) > most_panels
    return (values >= least) & (confidence >= sure) & ((fields <= 0) | (values / F.nullif(fields, F.lit(0)) >= ratio)) & ~F.coalesce(several, F.lit(False))
