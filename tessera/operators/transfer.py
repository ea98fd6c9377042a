"""Where a text stands on a page of word boxes, fields taken over from a similar document, and what pathology findings say."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import value_after
from tessera.operators.tables import sequence_similarity


RUN = 8  # neighbouring words brought together by one window; longer texts are met word by word


def most_words(wanted: DataFrame, *texts: str) -> int:
    """A bound of the words of the longest text, by its white space; one at least."""
    blanks = [F.length(F.trim(t)) - F.length(F.translate(F.trim(t), " \t\n\x0b\f\r", "")) for t in texts]
    return (wanted.agg(F.max(F.array_max(F.array(*blanks)))).first()[0] or 0) + 1


def boxes_of_text(words: DataFrame, wanted: DataFrame, alike: Callable[[Column, Column], Column] = sequence_similarity, least: float = 0.8) -> DataFrame:
    """(page, want, place, text, box, confidence, match): the boxes of `words` (page, place, text, box) that show each wanted text.

    The first way that finds anything on the page counts: the very word (1); a word alike (.9 of the likeness); as many neighbouring
    words as the wanted text has, two at least (.85 of it; the box around them); a number within .001 (.95). `wanted`: page, want,
    distinct. Places are the words' numbers on their page, without gaps. Null or blank texts are neither found nor looked for.
    """
    asked = wanted.select("page", "want").distinct().withColumn("least", F.lit(least))
    return texts_shown(words, asked, most_words(wanted, "want"), alike).drop("least")


def texts_shown(words: DataFrame, asked: DataFrame, longest: int, alike: Callable[[Column, Column], Column] = sequence_similarity) -> DataFrame:
    """`boxes_of_text` for texts with a least likeness each: the columns of `asked` (page, want, least, and others; distinct by the three), and place, text, box, confidence, match.

    `longest`: no text has more words (`most_words`). Words and texts meet once, by page;
    what is dealt out by page is not shuffled for that, nor are the matches after it (but once if the likeness is a Python function).
    """
    number = lambda c: F.when(c.rlike(r"^[+-]?\d+(\.\d+)?$"), c.cast("double"))
    seen = words.where(F.trim("text") != "").select("page", "place", F.trim("text").alias("text"), "box").withColumn("number", number(F.col("text"))).withColumn("low_text", F.lower("text"))
    want = asked.where(F.trim("want") != "").withColumn("low", F.lower(F.trim("want"))).withColumn("n", F.size(F.split("low", r"\s+"))).withColumn("asked_number", number(F.col("low")))
    kept, near = asked.columns, min(longest, RUN)
    after, run, low_run = F.array(), F.lit(None).cast("string"), F.lit(None).cast("string")
    if near > 1:
        w = Window.partitionBy("page").orderBy("place").rowsBetween(0, near - 1)
        whole = lambda k: F.get("after", F.lit(k - 1))["place"] == F.col("place") + (k - 1)
        joined = [F.when(whole(k), F.array_join(F.transform(F.slice("after", 1, k), lambda x: x["text"]), " ")) for k in range(2, near + 1)]
        seen = seen.withColumn("after", F.collect_list(F.struct("place", "text", "box")).over(w)).withColumn("runs", F.array(*joined))
        seen = seen.withColumn("low_runs", F.transform("runs", F.lower))
        after, run, low_run = F.slice("after", 1, F.col("n")), *[F.when(F.col("n") > 1, F.get(c, F.col("n") - 2)) for c in ("runs", "low_runs")]
    low = F.col("low_text")
    pairs = seen.join(want, "page").withColumn("run", run)
    pairs = pairs.withColumn("like", alike(low, F.col("low"))).withColumn("run_like", F.when(low_run.isNotNull(), alike(low_run, F.col("low"))) if near > 1 else F.lit(None).cast("double"))
    tier = F.when(low == F.col("low"), 1).when(F.col("like") >= F.col("least"), 2).when(F.abs(F.col("number") - F.col("asked_number")) < 0.001, 4)
    pairs = pairs.withColumn("tier", tier).where(F.col("tier").isNotNull() | (F.col("run_like") >= F.col("least")))
    sure = F.when(F.col("tier") == 1, 1.0).when(F.col("tier") == 2, F.col("like") * 0.9).otherwise(0.95)
    ways = [F.when(F.col("tier").isNotNull(), F.struct("place", "text", "box", sure.alias("confidence"), "tier"))]
    if near > 1:
        boxes = F.transform(after, lambda x: x["box"])
        around = F.struct(*[f(boxes[s]).alias(s) for f, s in ((F.array_min, "x0"), (F.array_min, "y0"), (F.array_max, "x1"), (F.array_max, "y1"))])
        many = F.struct("place", F.col("run").alias("text"), around.alias("box"), (F.col("run_like") * 0.85).alias("confidence"), F.lit(3).alias("tier"))
        ways.append(F.when(F.col("run_like") >= F.col("least"), many))
    every = pairs.select(*kept, F.explode(F.array_compact(F.array(*ways))).alias("way")).select(*kept, "way.*")
    if longest > near:
        every = every.unionByName(_long_texts(seen.select("page", "place", "text", "box"), want.where(F.col("n") > near), kept, alike))
    every = every.withColumn("first", F.min("tier").over(Window.partitionBy("page", "want", "least")))
    match = F.when(F.col("tier").isin(1, 4), "exact").when(F.col("tier") == 2, "fuzzy").otherwise("partial")
    return every.where("tier = first").select(*kept, "place", "text", "box", "confidence", match.alias("match"))


def _long_texts(seen: DataFrame, want: DataFrame, kept: Sequence[str], alike: Callable[[Column, Column], Column]) -> DataFrame:
    """The runs of neighbouring words for texts of many words: each word goes to every run that it may belong to."""
    runs = seen.join(want, "page").withColumn("first", F.explode(F.sequence(F.col("place") - F.col("n") + 1, F.col("place"))))
    sides = [f(f"box.{s}").alias(s) for f, s in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda w: w["text"]), " ").alias("text")
    runs = runs.groupBy(*kept, "low", "n", "first").agg(joined, F.count("*").alias("have"), *sides).where("have = n")
    runs = runs.withColumn("like", alike(F.lower("text"), F.col("low"))).where(F.col("like") >= F.col("least"))
    return runs.select(*kept, F.col("first").alias("place"), "text", F.struct("x0", "y0", "x1", "y1").alias("box"), (F.col("like") * 0.85).alias("confidence"), F.lit(3).alias("tier"))


def fields_of_similar(texts: DataFrame, similar: DataFrame, fields: DataFrame, least: float = 0.7) -> DataFrame:
    """(doc, field, value, unit, confidence): fields of each document's most similar one, as its own text gives them.

    `texts`: doc, text; `similar`: doc, other, similarity (the candidates found by a search); `fields`: doc, field. The best candidate
    counts if its similarity is `least` or more, ties to the smaller id; confidence is .95 of it. Fields that the text lacks give no row.
    """
    top = similar.groupBy("doc").agg(F.min_by(F.struct("other", "similarity"), F.struct(-F.col("similarity"), "other")).alias("m")).select("doc", "m.*").where(F.col("similarity") >= least)
    asked = top.join(fields.select(F.col("doc").alias("other"), "field").distinct(), "other")
    got = texts.select("doc", "text").join(asked, "doc").withColumn("v", value_after(F.col("text"), F.col("field"))).where("v is not null")
    return got.select("doc", "field", "v.value", "v.unit", (F.col("similarity") * 0.95).alias("confidence"))


# What pathology texts say of stage, grade, margins, specimen and diagnosis, in the order they are tried.
STAGES = {"T": r"\bT([0-4]|is|x)\b", "N": r"\bN([0-3]|x)\b", "M": r"\bM([0-1]|x)\b"}
GRADES = [(r"grade\s*([1-4IViv]+)", "Tumor grade"), (r"gleason\s*(\d+)", "Gleason score"), (r"differentiat\w*\s*(well|moderate|poor)", "Differentiation")]
MARGINS = [
    (r"margin[s]?\s*(negative|clear|free)", "negative"),
    (r"margin[s]?\s*(positive|involved)", "positive"),
    (r"(negative|clear|free)\s*margin", "negative"),
    (r"(positive|involved)\s*margin", "positive"),
    (r"close\s*margin", "close"),
]
ADEQUACY = [(r"adequate\s*(for|specimen)", "adequate"), (r"inadequate|insufficient", "inadequate"), (r"satisfactory\s*for", "adequate"), (r"unsatisfactory", "inadequate")]
DIAGNOSES = [
    ("adenocarcinoma", "Adenocarcinoma"),
    (r"squamous\s*cell\s*carcinoma", "Squamous cell carcinoma"),
    ("melanoma", "Melanoma"),
    ("lymphoma", "Lymphoma"),
    ("sarcoma", "Sarcoma"),
    (r"carcinoma\s*in\s*situ", "Carcinoma in situ"),
    ("dysplasia", "Dysplasia"),
    ("metastatic", "Metastatic disease"),
    ("benign", "Benign"),
    ("malignant", "Malignant"),
]


def enrich_pathology(findings: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """One row a document of findings: stages, grade, margin, adequacy, diagnoses (by "; "), reasons for review, confidence.

    What stands first wins: by rule, then by `order`. Each finding is read by itself, so a phrase that runs over two findings is not
    seen, and no document's findings are gathered. Null findings say nothing.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    said = lambda p: t.rlike("(?i)" + p)
    taken = lambda p: F.regexp_extract(t, "(?i)" + p, 1)

    def earliest(rules: Sequence[tuple[str, str]], shown: Callable[[str, str], Column], name: str) -> Column:
        rule, value = F.lit(None).cast("int"), F.lit(None).cast("string")
        for i, (p, v) in reversed(list(enumerate(rules))):
            rule, value = F.when(said(p), i).otherwise(rule), F.when(said(p), shown(p, v)).otherwise(value)
        return F.min_by(value, F.when(rule.isNotNull(), F.struct(rule, F.col(order)))).alias(name)

    plain = lambda p, v: F.lit(v)
    stages = [F.min_by(F.upper(taken(p)), F.when(said(p), F.col(order))).alias(f"stage_{k.lower()}") for k, p in STAGES.items()]
    seen = [F.coalesce(F.bool_or(said(p)), F.lit(False)).alias(f"d{i}") for i, (p, _) in enumerate(DIAGNOSES)]
    g = findings.groupBy(key).agg(*stages, earliest(GRADES, lambda p, v: F.concat(F.lit(v + ": "), taken(p)), "grade"), earliest(MARGINS, plain, "margin"), earliest(ADEQUACY, plain, "adequacy"), *seen)
    named = F.array_compact(F.array(*[F.when(F.col(f"d{i}"), d) for i, (_, d) in enumerate(DIAGNOSES)]))
    grave = F.exists(named, lambda d: F.lower(d).rlike("malignant|carcinoma"))
    reasons = [(F.col("stage_m") == "1", "metastatic_disease"), (F.col("margin") == "positive", "positive_margins"), (F.col("adequacy") == "inadequate", "inadequate_specimen"), (grave, "malignancy_detected")]
    why = F.array_join(F.array_compact(F.array(*[F.when(c, r) for c, r in reasons])), ",")
    empty = F.coalesce("stage_t", "stage_n", "stage_m", "grade").isNull() & (F.size(named) == 0)
    return g.select(key, "stage_t", "stage_n", "stage_m", "grade", "margin", "adequacy", F.array_join(named, "; ").alias("diagnoses"), why.alias("reasons"), F.when(empty, 0.5).otherwise(0.8).alias("confidence"))
