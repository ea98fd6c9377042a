"""Names of measurements: scanner repairs, a dictionary of spellings, and what unit and value suggest.

Built-in expressions only; the dictionaries are fixed and small, so they are literals of the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let, strip_footnotes

# Spellings and the name each stands for.
SPELLINGS = {
    "wbc": "WBC", "rbc": "RBC", "hgb": "Hemoglobin", "hb": "Hemoglobin", "hemoglobin": "Hemoglobin", "hct": "Hematocrit", "hematocrit": "Hematocrit",
    "mcv": "MCV", "mch": "MCH", "mchc": "MCHC", "rdw": "RDW", "plt": "Platelets", "platelet": "Platelets", "platelets": "Platelets", "mpv": "MPV",
    "neutrophils": "Neutrophils", "neut": "Neutrophils", "lymphocytes": "Lymphocytes", "lymph": "Lymphocytes", "monocytes": "Monocytes", "mono": "Monocytes",
    "eosinophils": "Eosinophils", "eos": "Eosinophils", "basophils": "Basophils", "baso": "Basophils", "basos": "Basophils",
    "glucose": "Glucose", "bun": "BUN", "creatinine": "Creatinine", "creat": "Creatinine", "sodium": "Sodium", "na": "Sodium", "potassium": "Potassium", "k": "Potassium",
    "chloride": "Chloride", "cl": "Chloride", "co2": "CO2", "carbon dioxide": "CO2", "calcium": "Calcium", "ca": "Calcium",
    "albumin": "Albumin", "alb": "Albumin", "total protein": "Total Protein", "protein": "Total Protein", "bilirubin": "Bilirubin", "bili": "Bilirubin",
    "alkaline phosphatase": "Alkaline Phosphatase", "alk phos": "Alkaline Phosphatase", "alp": "Alkaline Phosphatase", "ast": "AST", "sgot": "AST", "alt": "ALT", "sgpt": "ALT",
    "cholesterol": "Total Cholesterol", "total cholesterol": "Total Cholesterol", "hdl": "HDL", "ldl": "LDL", "triglycerides": "Triglycerides", "trig": "Triglycerides", "vldl": "VLDL",
    "tsh": "TSH", "t3": "T3", "t4": "T4", "free t4": "Free T4", "ft4": "Free T4", "troponin": "Troponin", "bnp": "BNP", "ck": "CK", "ck-mb": "CK-MB",
    "pt": "PT", "inr": "INR", "ptt": "PTT", "aptt": "aPTT", "ph": "pH", "specific gravity": "Specific Gravity", "sp gr": "Specific Gravity",
    "hba1c": "HbA1c", "a1c": "HbA1c", "hemoglobin a1c": "HbA1c", "iron": "Iron", "ferritin": "Ferritin", "tibc": "TIBC", "transferrin": "Transferrin",
    "magnesium": "Magnesium", "mg": "Magnesium", "phosphorus": "Phosphorus", "phos": "Phosphorus",
}
# What scanners make of names.
MISREADINGS = {
    "rnch": "MCH", "rnchc": "MCHC", "rnov": "MCV", "wbo": "WBC", "rbo": "RBC", "hgd": "Hemoglobin", "plts": "Platelets", "neuts": "Neutrophils", "lymphs": "Lymphocytes",
    "monos": "Monocytes", "eosins": "Eosinophils", "glu": "Glucose", "gluc": "Glucose", "creat": "Creatinine", "crea": "Creatinine", "bili": "Bilirubin",
    "tbili": "Total Bilirubin", "dbili": "Direct Bilirubin", "alb": "Albumin", "alkp": "Alkaline Phosphatase", "alkphos": "Alkaline Phosphatase",
    "chol": "Total Cholesterol", "trig": "Triglycerides", "trigs": "Triglycerides",
}
# Unit, least and most value, and the name they suggest, in the order they are tried.
HINTS = [
    ("x10^9/l", 4.0, 11.0, "WBC"), ("x10^12/l", 4.0, 6.0, "RBC"), ("g/dl", 12.0, 18.0, "Hemoglobin"), ("g/l", 120.0, 180.0, "Hemoglobin"), ("%", 36.0, 54.0, "Hematocrit"),
    ("fl", 80.0, 100.0, "MCV"), ("pg", 26.0, 34.0, "MCH"), ("g/dl", 31.0, 37.0, "MCHC"), ("x10^9/l", 150.0, 450.0, "Platelets"),
    ("%", 40.0, 75.0, "Neutrophils"), ("%", 20.0, 45.0, "Lymphocytes"), ("%", 2.0, 10.0, "Monocytes"), ("%", 0.0, 6.0, "Eosinophils"), ("%", 0.0, 2.0, "Basophils"),
    ("mg/dl", 70.0, 140.0, "Glucose"), ("mg/dl", 7.0, 25.0, "BUN"), ("mg/dl", 0.5, 1.5, "Creatinine"), ("meq/l", 136.0, 145.0, "Sodium"), ("mmol/l", 136.0, 145.0, "Sodium"),
    ("meq/l", 3.5, 5.5, "Potassium"), ("mmol/l", 3.5, 5.5, "Potassium"), ("meq/l", 96.0, 106.0, "Chloride"), ("meq/l", 22.0, 32.0, "CO2"),
    ("u/l", 10.0, 50.0, "AST"), ("u/l", 7.0, 56.0, "ALT"), ("u/l", 40.0, 150.0, "Alkaline Phosphatase"), ("mg/dl", 0.1, 1.5, "Bilirubin"), ("g/dl", 3.5, 5.5, "Albumin"),
    ("mg/dl", 100.0, 250.0, "Total Cholesterol"), ("mg/dl", 40.0, 100.0, "HDL"), ("mg/dl", 50.0, 200.0, "LDL"), ("mg/dl", 30.0, 200.0, "Triglycerides"),
    ("miu/l", 0.3, 5.0, "TSH"), ("uiu/ml", 0.3, 5.0, "TSH"), ("seconds", 10.0, 15.0, "PT"), ("", 0.8, 1.3, "INR"), ("%", 4.0, 7.0, "HbA1c"),
]
# Scanner errors in letters, and what they stand for, one after the other.
LETTERS = [(r"\s+", " "), (r"[|l](?=[A-Z])", "I"), (r"(?<=[a-z])0(?=[a-z])", "o"), (r"(?<=[A-Z])0(?=[A-Z])", "O"), (r"rn(?=[a-z])", "m")]


def repair_letters(text: Column) -> Column:
    """White space made single, and letters that scanners mistake put right."""
    return F.trim(reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), LETTERS, text))


def _spelt(key: Column, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[key]


def suggested_name(name: Column, unit: Column, value: Column) -> Column:
    """The first hint whose unit is (part of) this one, whose values hold this one, and whose name begins alike; or null.

    A value of 0 counts as missing, an empty unit as none.
    """
    fields = ("unit", "least", "most", "means", "low")
    hints = F.array(*[F.struct(*[F.lit(x).alias(f) for f, x in zip(fields, (*h, h[3].lower()))]) for h in HINTS])

    def first_hint(x: Column) -> Column:
        def fits(h: Column) -> Column:
            alike = (F.substring(x["n"], 1, 2) == F.substring(h["low"], 1, 2)) | h["low"].contains(x["n"]) | h["low"].startswith(F.substring(x["n"], 1, 3))
            return (x["u"].contains(h["unit"]) | h["unit"].contains(x["u"])) & x["v"].between(h["least"], h["most"]) & alike

        return F.get(F.filter(hints, fits), F.lit(0))["means"]

    said = F.struct(F.lower(F.trim(unit)).alias("u"), F.lower(F.trim(name)).alias("n"), value.alias("v"))
    return F.when((unit != "") & (value != 0), let(said, first_hint))


def titled(text: Column) -> Column:
    """Every run of letters with a capital first, the rest small."""
    apart = F.regexp_replace(text, r"([^\p{L}])(\p{L})", "$1\u0001 $2")
    return F.replace(F.initcap(apart), F.lit("\u0001 "), F.lit(""))


def plain_name(name: Column, unit: Column | None = None, value: Column | None = None) -> Column:
    """A measurement's name without footnotes and scanner errors: the dictionary's, a misreading's, the one that unit and value
    suggest, or its own, with capitals if it was in one case only."""

    def of_repaired(c: Column) -> Column:
        def of_key(key: Column) -> Column:
            one_case = ((c == F.upper(c)) | (c == key)) & (F.upper(c) != key)
            own = F.when(one_case & (F.length(c) <= 4) & c.rlike(r"^\p{L}+$"), F.upper(c)).when(one_case, titled(c)).otherwise(c)
            guess = [] if unit is None or value is None else [suggested_name(c, unit, value)]
            return F.coalesce(_spelt(key, SPELLINGS), _spelt(key, MISREADINGS), *guess, own)

        return let(F.lower(c), of_key)

    return F.when(name == "", name).otherwise(let(repair_letters(strip_footnotes(name)), of_repaired))


def plain_values(values: Column) -> Column:
    """An array of (name, unit, value as text) with plain names and values, and the name it had if that changed."""

    def one(v: Column) -> Column:
        name = plain_name(v["name"], v["unit"], v["value"].try_cast("double"))
        return F.struct(name.alias("name"), v["unit"].alias("unit"), strip_footnotes(v["value"]).alias("value"), F.when(name != v["name"], v["name"]).alias("original_name"))

    return F.transform(values, one)
