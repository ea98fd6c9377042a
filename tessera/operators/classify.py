"""Structure and type of texts: fingerprints, keyword classes, schemas, templates, verdict merging."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def has_table(text: Column, least: float = 0.3) -> Column:
    """Whether over `least` of the lines that hold something look like table rows: a tab, or three parts set apart by gaps."""
    row = lambda x: (F.length(F.trim(x)) >= 10) & (x.contains("\t") | (F.size(F.split(F.trim(x), r"\s{2,}")) >= 3))
    full = F.size(F.filter(lines(text), lambda x: F.trim(x) != ""))
    return F.coalesce(F.try_divide(F.size(F.filter(lines(text), row)), full) > least, F.lit(False))


def section_count(text: Column) -> Column:
    """Heading lines: a word of four or more letters and blanks before a colon, any case."""
    return F.regexp_count(text, F.lit(r"(?m)^[A-Za-z][A-Za-z ]{3,}:"))


def header_count(text: Column) -> Column:
    """Lines of 3 to 50 characters written in capitals."""
    head = lambda x: F.length(F.trim(x)).between(3, 50) & (F.upper(x) == x) & x.rlike(r"[A-Z]")
    return F.size(F.filter(lines(text), head))


def numeric_density(text: Column) -> Column:
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(text, r"[^0-9]", "")), F.length(F.regexp_replace(text, r"\s", ""))), F.lit(0.0))


def layout(table: Column, sections: Column, density: Column) -> Column:
    return F.when(table & ~sections & (density > 0.15), "tabular").when(sections & ~table & (density < 0.1), "narrative").when(table & sections, "mixed").otherwise("unknown")


def contained(text: Column, words: Sequence[str]) -> Column:
    """How many of the words the text contains (as substrings)."""
    low = F.lower(text)
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def type_score(text: Column, keywords: Sequence[str], headers: Sequence[str], layouts: Sequence[str], against: Sequence[str]) -> Column:
    """Keywords .35 (five are enough), a header in the first 500 characters .25, layout .40, less .1 a word against (up to .4)."""
    head = contained(F.substring(text, 1, 500), headers) > 0
    shape = F.lit(False)
    for p in layouts:
        shape = shape | text.rlike(p)
    score = F.least(F.lit(1.0), contained(text, keywords) / 5) * 0.35 + F.when(head, 0.25).otherwise(0.0) + F.when(shape, 0.40).otherwise(0.0)
    return F.greatest(F.lit(0.0), score - F.least(F.lit(0.4), contained(text, against) * 0.1))


def schema_score(text: Column, keywords: Sequence[str], fields: Sequence[str] = (), sections: Sequence[str] = ()) -> Column:
    """Shares of keywords .6, fields .3 and sections .3 found, over the weights of those that the schema has."""
    parts = [(words, w) for words, w in ((keywords, 0.6), (fields, 0.3), (sections, 0.3)) if words]
    return sum((contained(text, words) / len(words) * w for words, w in parts), F.lit(0.0)) / sum(w for _, w in parts)


def best_label(scores: dict[str, Column]) -> Column:
    """struct(score, label) of the greatest score; the first wins a tie."""
    ranked = F.array(*[F.struct(F.round(c, 9).alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("label")) for i, (k, c) in enumerate(scores.items())])
    return F.array_max(ranked)


def merge_verdicts(model: Column, model_score: Column, rule: Column, rule_score: Column) -> tuple[Column, Column, Column]:
    """(label, confidence, review): agreement adds up to .15, a rule surer by .2 overrides, no model leaves the rule."""
    agree = model == rule
    override = ~agree & (rule_score - model_score > 0.2)
    label = F.when(model.isNull() | override, rule).otherwise(model)
    confidence = F.when(model.isNull(), rule_score).when(agree, F.least(F.lit(0.98), model_score + F.least(F.lit(0.15), rule_score * 0.2))).when(override, rule_score).otherwise(model_score)
    return label, confidence, F.coalesce(~agree, F.lit(False))


def _after(text: Column, heads: str, until: str) -> Column:
    """What follows the first of the heads, up to a line that begins the next part; null where none stands."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    pattern = rf"(?isuU)(?:{heads})[:\s]*\n?(.*?)(?=\n(?:{until})|\z)"
    return F.when(t.rlike(pattern), _stripped(F.regexp_extract(t, pattern, 1)))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def fallback_impression(text: Column) -> Column:
    """The first three sentences of a report's impression."""
    found = _after(text, "IMPRESSION|CONCLUSION|SUMMARY", "[A-Z]{3,}|Page")
    first = F.transform(F.slice(F.split(found, r"[.!?]+"), 1, 3), _stripped)
    said = F.concat(F.array_join(F.filter(first, lambda x: x != ""), ". "), F.lit("."))
    return F.coalesce(said, F.lit("Impression not found in document"))


def fallback_findings(text: Column) -> Column:
    found = _after(text, "FINDINGS|OBSERVATIONS", "IMPRESSION|CONCLUSION|RECOMMENDATION|Page")
    return F.coalesce(found, F.lit("Findings not found in document"))


def procedure(text: Column) -> Column:
    """Kind of imaging; 'ct' counts inside words too, as in the reference."""
    t = F.lower(text)
    has = lambda *words: reduce(or_, [t.contains(w) for w in words])
    ct = F.when(has("chest"), "chest_ct").when(has("abdomen"), "abdomen_ct").when(has("head", "brain"), "head_ct").otherwise("ct_unknown")
    mri = F.when(has("brain", "head"), "mri_brain").otherwise("mri_unknown")
    echo = F.when(has("abdomen"), "ultrasound_abdomen").otherwise("ultrasound_unknown")
    xray = F.when(has("chest"), "chest_xray").otherwise("xray_unknown")
    kind = F.when(has("ct", "computed tomography"), ct).when(has("mri", "magnetic resonance"), mri).when(has("ultrasound", "sonogram"), echo)
    return kind.when(has("mammogram", "mammography"), "mammogram").when(has("x-ray", "radiograph"), xray).otherwise("unknown")


class Template(NamedTuple):
    """A vendor's form: a pattern of its heading, names of the vendor, tests that it lists, and whether it shows ranges and flags."""

    name: str
    header: str | None
    vendors: tuple[str, ...]
    fields: tuple[str, ...]
    ranges: bool
    flags: bool


# Other names of tests; what shows ranges, flags and laboratory units.
ALIASES = {
    "hemoglobin": ["hgb", "hb"],
    "hematocrit": ["hct"],
    "platelets": ["plt", "platelet count"],
    "neutrophils": ["neut", "neutro"],
    "lymphocytes": ["lymph", "lymphs"],
    "monocytes": ["mono", "monos"],
    "eosinophils": ["eos", "eosino"],
    "basophils": ["baso", "basos"],
}
RANGE_MARKS = [r"\d+\.?\d*\s*-\s*\d+\.?\d*", r"\d+\.?\d*\s*to\s*\d+\.?\d*", r">\s*\d+\.?\d*", r"<\s*\d+\.?\d*", r"reference\s*(range|interval)"]
FLAG_MARKS = [r"\bHigh\b", r"\bLow\b", r"\bCRITICAL\b", r"\bABNORMAL\b", r"FLAG"]
UNIT_MARKS = [r"RESULT", r"UNITS?", r"x10E\d/uL", r"g/dL", r"mg/dL", r"mmol/L", r"mL/min", r"fL\b", r"pg\b"]
USE_FROM, LOOK_BELOW, SEEN_FROM = 0.85, 0.75, 0.7  # a template is used from; the page is looked at below; what was seen counts from


def template_scores(text: Column, templates: Sequence[Template]) -> list[Column]:
    """struct(score, order, label) of each template: heading .25, vendor .30, tests .30, layout .15.

    A vendor's name counts 1 where it stands, .7 where all its long words do (two at least); a test counts .9 by another name. Without a vendor the score is .5 at most, with under .3 of
    its names .65 at most, as tests and layouts are alike everywhere. A null text is empty.
    """
    text = F.coalesce(text, F.lit(""))
    clean = F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f]", " ")
    low = F.lower(clean)
    one = lambda hit, value=1.0: F.when(hit, value).otherwise(0.0)
    any_of = lambda marks: clean.rlike("(?iU)" + "|".join(f"(?:{m})" for m in marks))
    units = sum((one(clean.rlike("(?iU)" + m)) for m in UNIT_MARKS), F.lit(0.0))
    shown = {"ranges": one(any_of(RANGE_MARKS)), "flags": one(clean.rlike(r"(?<![A-Za-z])[HL](?![A-Za-z])") | any_of(FLAG_MARKS)), "units": F.when(units >= 3, 1.0).when(units >= 1, 0.5).otherwise(0.0)}
    seen = F.struct(low.alias("low"), *[c.alias(k) for k, c in shown.items()])

    def score(x: Column, t: Template) -> Column:
        low = x["low"]

        def vendor(name: str) -> Column:
            name = name.lower()
            words = [w for w in name.split() if len(w) > 3]
            whole = F.when(low.contains(name), 1.0)
            return (whole.when(reduce(and_, [low.contains(w) for w in words]), 0.7) if len(name) > 6 and len(words) >= 2 else whole).otherwise(0.0)

        def test(name: str) -> Column:
            other = reduce(or_, [low.contains(a) for a in ALIASES.get(name.lower(), [])], F.lit(False))
            return F.when(low.contains(name.lower()), 1.0).when(other, 0.9).otherwise(0.0)

        header = one(low.rlike("(?isU)" + t.header)) if t.header else F.lit(0.0)
        vendors = F.least(F.lit(1.0), sum(map(vendor, t.vendors), F.lit(0.0)) / len(t.vendors)) if t.vendors else F.lit(0.0)
        tests = sum(map(test, t.fields), F.lit(0.0)) / len(t.fields) if t.fields else F.lit(0.0)
        checks = [x["units"], *([x["ranges"]] if t.ranges else []), *([x["flags"]] if t.flags else [])]
        raw = header * 0.25 + vendors * 0.3 + tests * 0.3 + sum(checks, F.lit(0.0)) / len(checks) * 0.15
        return F.round(F.when(vendors == 0, F.least(raw, F.lit(0.5))).when(vendors < 0.3, F.least(raw, F.lit(0.65))).otherwise(raw), 9)

    of = lambda t: let(seen, lambda x: score(x, t))
    return [F.struct(of(t).alias("score"), F.lit(-i).alias("order"), F.lit(t.name).alias("label")) for i, t in enumerate(templates)]


def matched_template(text: Column, templates: Sequence[Template], seen: Column | None = None) -> Column:
    """struct(decision, template, confidence): the best template of the text if it reaches .85 (the first wins a tie); under .75, what a look at the page told (`seen`: struct(template,
    vendor, confidence), or null), if it is .7 sure, names a vendor, and its template is known; else extraction without a template, at the seen or the best score."""
    nothing = F.lit(None).cast("struct<template:string,vendor:string,confidence:double>")
    seen = nothing if seen is None else seen.cast("struct<template:string,vendor:string,confidence:double>")

    def decide(x: Column) -> Column:
        best, look = x["best"], x["seen"]
        told = F.coalesce((best["score"] < LOOK_BELOW) & (look["confidence"] >= SEEN_FROM) & (F.coalesce(look["vendor"], F.lit("")) != ""), F.lit(False))
        known = told & look["template"].isin([t.name for t in templates])
        shape = lambda decision, template, conf: F.struct(F.lit(decision).alias("decision"), template.cast("string").alias("template"), conf.alias("confidence"))
        return F.when(best["score"] >= USE_FROM, shape("use_template", best["label"], best["score"])).when(known, shape("use_template", look["template"], look["confidence"])).when(told, shape("use_medgemma", F.lit(None), look["confidence"])).otherwise(shape("use_medgemma", F.lit(None), best["score"]))

    return let(F.struct(F.array_max(F.array(*template_scores(text, templates))).alias("best"), seen.alias("seen")), decide)
