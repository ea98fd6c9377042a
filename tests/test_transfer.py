"""Spoiled drug names, word boxes, fields of similar documents and pathology findings on small fixtures."""

import difflib

from pyspark.sql import functions as F

from tessera.operators import drugs as D
from tessera.operators import transfer as T


def test_misreadings_are_every_single_confusion(spark):
    word = "modd"
    want = {word[:i] + b + word[i + len(a) :] for i in range(len(word)) for a, many in D.CONFUSIONS.items() for b in many if word[i : i + len(a)] == a}
    got = spark.sql("SELECT 'modd' AS w UNION ALL SELECT ''").select("w", D.misreadings(F.col("w")).alias("m")).collect()
    assert {r.w: set(r.m) for r in got} == {word: want, "": set()}


def test_spoiled_names_find_their_drug(spark):
    entries = spark.createDataFrame([(1, "Atenolol", "IN"), (2, "albuterol", "IN"), (3, "Metformin", "IN"), (3, "metformin 500", "SCD"), (4, None, "IN"), (5, "atenolol", "IN")], "code long, text string, kind string")
    names = spark.createDataFrame([("aerol", None), ("rnetformin", None), ("ate", None), (None, None), ("wwwwwwwwwwww", None), ("metfornin", "500 mg"), ("metforrnin", "1 g")], "name string, strength string")
    strengths = spark.createDataFrame([(3, "500 mg"), (3, "850 mg")], "code long, strength string")
    got = {r.name: r for r in D.tolerant_drugs(names, entries, strengths=strengths).collect()}
    assert set(got) == {"aerol", "rnetformin", "metfornin", "metforrnin"}
    assert got["rnetformin"].code == 3 and got["metfornin"].code == 3 and got["metfornin"].distance == 1
    assert got["metfornin"].score - got["metforrnin"].score > 0.5
    assert got["aerol"].code in (1, 2)
    tie = D.tolerant_drugs(names.where("name = 'aerol'").withColumn("name", F.lit("atenolo")), entries).collect()
    assert [(r.code, r.distance) for r in tie] == [(1, 1)]
    assert D.tolerant_drugs(names, entries.limit(0)).count() == 0 and D.tolerant_drugs(names.limit(0), entries).count() == 0


def test_boxes_by_the_first_way_that_finds(spark):
    words = [("p", i, w, (float(i), 0.0, i + 0.9, 1.0)) for i, w in enumerate("Hemoglobin 5.20 Sodium serurn high Hemoglobin".split())] + [("p", 6, None, None), ("q", 0, "5.2", (0.0, 0.0, 1.0, 1.0))]
    w = spark.createDataFrame(words, "page string, place int, text string, box struct<x0:double,y0:double,x1:double,y1:double>")
    asked = spark.createDataFrame([("p", x) for x in ("hemoglobin", "sodum", "sodium serum", "5.2", "absent", "  ", None)] + [("r", "5.2")], "page string, want string")
    got = T.boxes_of_text(w, asked).collect()
    ratio = difflib.SequenceMatcher(None, "sodium serurn", "sodium serum").ratio()
    want = {("hemoglobin", 0): ("exact", 1.0, 0.9), ("hemoglobin", 5): ("exact", 1.0, 5.9), ("sodum", 2): ("fuzzy", 0.9 * 10 / 11, 2.9), ("sodium serum", 2): ("partial", 0.85 * ratio, 3.9), ("5.2", 1): ("fuzzy", 0.9 * 6 / 7, 1.9)}
    assert {(r.want, r.place): (r.match, round(r.confidence, 6), r.box.x1) for r in got} == {k: (m, round(c, 6), x) for k, (m, c, x) in want.items()}
    assert T.boxes_of_text(w.limit(0), asked).count() == 0


def test_texts_of_many_words(spark):
    """Texts longer than the window of neighbouring words, and as long as it, are found like short ones."""
    said = [f"w{i}" for i in range(2 * T.RUN)]
    w = spark.createDataFrame([("p", i, x, (float(i), 0.0, i + 0.9, 1.0)) for i, x in enumerate(said)] + [("q", i, x, (0.0, 0.0, 1.0, 1.0)) for i, x in enumerate(said) if i != 3], "page string, place int, text string, box struct<x0:double,y0:double,x1:double,y1:double>")
    texts = {n: " ".join(said[1 : n + 1]) for n in (2, T.RUN, T.RUN + 1, T.RUN + 4)}
    asked = spark.createDataFrame([(p, t) for p in "pq" for t in texts.values()], "page string, want string")
    got = {(r.page, r.want, r.place, r.text, r.box.x0, r.box.x1, r.confidence, r.match) for r in T.boxes_of_text(w, asked, least=0.999).collect()}
    assert got == {("p", t, 1, t, 1.0, n + 0.9, 0.85, "partial") for n, t in texts.items()} | {("q", texts[2], 1, texts[2], 0.0, 1.0, 0.85, "partial")}


def test_boxes_of_text_stay_on_their_page(spark, sf):
    """The query deals its words out once by page; no run of words and no page is shuffled again."""
    from tessera.plans.transfer import boxes_of_text

    plan = boxes_of_text(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_most_words_bounds_every_text(spark):
    texts = ["a", " a ", "a b", "a  b\tc\n", "", " ", None, "x\x0by z"]
    rows = spark.createDataFrame([(t, "one two") for t in texts], "t string, u string")
    assert T.most_words(rows.where("t = 'a'"), "t") == 1 and T.most_words(rows.where("t is null"), "t") == 1 and T.most_words(rows.limit(0), "t") == 1
    assert T.most_words(rows, "t") >= 4 and T.most_words(rows.where("t = 'a'"), "t", "u") == 2 and T.most_words(rows.where("t like 'x%'"), "t") == 3


def test_fields_of_the_most_similar_document(spark):
    texts = spark.createDataFrame([(1, "Blood urea: 12.5 mg here"), (2, "nothing"), (3, None)], "doc long, text string")
    near = spark.createDataFrame([(1, 9, 0.8), (1, 8, 0.8), (1, 7, 0.6), (2, 8, 0.9), (3, 8, 0.9), (4, 8, 0.69)], "doc long, other long, similarity double")
    fields = spark.createDataFrame([(8, "blood_urea"), (8, "blood_urea"), (9, "none"), (8, None)], "doc long, field string")
    assert [tuple(r) for r in T.fields_of_similar(texts, near, fields).collect()] == [(1, "blood_urea", 12.5, "mg", 0.8 * 0.95)]


def test_pathology_reasons(spark):
    f = spark.createDataFrame([(1, 1, "margins positive, T2"), (1, 2, "margin free; t3; M1"), (1, 2, None), (2, 1, None), (3, 1, "unsatisfactory; squamous cell carcinoma")], "doc long, at int, said string")
    got = {r.doc: r for r in T.enrich_pathology(f, "doc", "at", "said").collect()}
    assert (got[1].stage_t, got[1].stage_m, got[1].margin, got[1].reasons) == ("2", "1", "negative", "metastatic_disease")
    assert (got[2].diagnoses, got[2].reasons, got[2].confidence, got[2].margin) == ("", "", 0.5, None)
    assert (got[3].adequacy, got[3].diagnoses, got[3].reasons) == ("inadequate", "Squamous cell carcinoma", "inadequate_specimen,malignancy_detected")


def test_drug_entries_alike_are_met_once(spark):
    """Copies of an entry are taken together before names meet them, and change only how popular a code is."""
    names = spark.createDataFrame([("metforrnin",), ("tenolol",)], "name string")
    entries = spark.createDataFrame([(1, "Metformin", "IN"), (1, "metformin", "SCD"), (2, "atenolol", None), (3, None, "IN")], "code long, text string, kind string")
    many = entries.crossJoin(spark.range(50).select())
    one, copies = (D.candidates(names, e) for e in (entries, many))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, copies.collect())) == [("metforrnin", 1, "metformin", "IN"), ("tenolol", 2, "atenolol", None)]
    plan = copies._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") > 2
