"""Queries that SQL cannot express, over their whole tables, against plain Python."""

import difflib
import re

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.names import plain_name
from tessera.operators import classify as C
from tessera.operators import retrieval, tables
from tessera.plans import QUERIES
from tessera.plans.registry import table


def test_scanner_variants(spark, sf):
    swaps = [("0", "o"), ("o", "0"), ("1", "l"), ("l", "1"), ("5", "s"), ("s", "5"), ("8", "b"), ("b", "8"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv")]
    words = [r.w for r in table(spark, sf, "part").select(F.lower("p_name").alias("w")).distinct().collect()] + ["", "born85", "vvmw"]
    got = {r.w: r.v for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", X.scanner_variants(F.col("w")).alias("v")).collect()}
    assert got == {w: sorted({w.replace(a, b) for a, b in swaps} - {w}) for w in words}


def strip_footnotes(s):
    s = s.strip(" ")
    for p in X.FOOTNOTES:
        s = re.sub(p, "", s)
    return s.strip(" ")


def test_footnotes_and_splits(spark, sf):
    rows = {r.p_partkey: (r.p_name, r.p_type) for r in table(spark, sf, "part").select("p_partkey", "p_name", "p_type").collect()}
    got = {r.p_partkey: (r.plain, r.joined) for r in QUERIES["footnotes_and_splits"](spark, sf).collect()}
    assert got == {k: (strip_footnotes(n), re.sub(r"([A-Za-z]{3,}) ([a-z]{1,3})\b", r"\1\2", t)) for k, (n, t) in rows.items()}
    marks = ["Sodium¹²", "WBC (2)", "Hgb [10]", "K ***", "Na†", "Ca‡", "Mg_12", "B12", "T4 12", " x "]
    assert [r.v for r in spark.createDataFrame([(m,) for m in marks], "m string").select(X.strip_footnotes(F.col("m")).alias("v")).collect()] == [strip_footnotes(m) for m in marks]


def test_stages_and_sizes(spark, sf):
    def stage(t):
        if m := re.search(r"(T[0-4][a-c]?)\s*(N[0-3][a-c]?)\s*(M[0-1][a-c]?)", t, re.I):
            return tuple(g.upper() for g in m.groups())
        one = lambda p: (m := re.search(p, t, re.I)) and m.group().upper()
        return one("T[0-4][a-c]?"), one("N[0-3][a-c]?"), one("M[0-1][a-c]?")

    n = r"\d+\.?\d*"
    sizes = lambda t: [m for p in (rf"{n}\s*x\s*{n}\s*x\s*{n}\s*cm", rf"{n}\s*x\s*{n}\s*cm", rf"{n}\s*cm") for m in re.findall(p, t, re.I)]
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").where("text is not null").select("doc_id", "text").collect()]
    rows += [(-1, "pT2a N1 M0, 2.5 x 3 x 1 cm and 4x5 CM"), (-2, "m1 then t3; 7cm"), (-3, "T1N0M1c")]
    d = spark.createDataFrame(rows, "i long, t string").select("i", X.stage(F.col("t")).alias("s"), X.measurements(F.col("t")).alias("m")).collect()
    texts = dict(rows)
    assert all((tuple(r.s), r.m) == (stage(texts[r.i]), sizes(texts[r.i])) for r in d) and len(d) == len(rows)


def test_fallback_sections(spark, sf):
    def after(t, heads, until):
        m = re.search(rf"(?:{heads})[:\s]*\n?(.*?)(?=\n(?:{until})|\Z)", re.sub(r"\r\n?", "\n", t), re.I | re.S)
        return m and m.group(1).strip()

    def impression(t):
        s = after(t, "IMPRESSION|CONCLUSION|SUMMARY", "[A-Z]{3,}|Page")
        return "Impression not found in document" if s is None else ". ".join(x.strip() for x in re.split(r"[.!?]+", s)[:3] if x.strip()) + "."

    rows = [r.text for r in table(spark, sf, "documents").where("text is not null").select("text").collect()]
    rows += ["FINDINGS: one\ntwo\nIMPRESSION:\nA b. C! D? E.\nPAGE 2", "summary", "Conclusion x\r\nPage 3", "observations\n\n y \nRecommendation z"]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", C.fallback_impression(F.col("t")).alias("a"), C.fallback_findings(F.col("t")).alias("b")).orderBy("i").collect()
    found = lambda t: after(t, "FINDINGS|OBSERVATIONS", "IMPRESSION|CONCLUSION|RECOMMENDATION|Page")
    assert [(r.a, r.b) for r in got] == [(impression(t), "Findings not found in document" if found(t) is None else found(t)) for t in rows]


def test_text_similarity(spark):
    rows = [("abcd", "bcde"), ("", "x"), (None, None), ("a b\nc", "a b c"), ("qabxcd", "abycdf")]
    got = [r.s for r in spark.createDataFrame(rows, "a string, b string").select(tables.sequence_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in rows]


def test_plain_value_lists_are_plain_names(spark, sf):
    from tessera.plans.names import cells

    want = {}
    for r in cells(spark, sf).select("p_partkey", "name", plain_name(F.col("name"), F.col("unit"), F.col("value").cast("string").try_cast("double")).alias("plain")).collect():
        want.setdefault(r.p_partkey, []).append((r.plain, r.name if r.plain != r.name else None))
    got = {}
    for r in QUERIES["plain_value_lists"](spark, sf).collect():
        got.setdefault(r.p_partkey, []).append((r.name, r.original_name))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def test_chunks_of_every_document(spark, sf):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    got = {}
    for r in QUERIES["chunk_documents"](spark, sf).collect():
        got.setdefault(r.doc_id, {})[r["index"]] = r.n_chars
    assert got == {k: dict(enumerate(map(len, retrieval.cut_chunks(t, 2000, 200)))) for k, t in texts.items() if retrieval.cut_chunks(t, 2000, 200)}


def test_gates(spark):
    from tessera.operators import gates as G

    def metadata(name):
        n = (name or "").lower().strip().replace(" ", "_").replace("-", "_")
        return bool(name) and (n in G.METADATA or any(p in n for p in G.METADATA_PARTS))

    names = ["Patient Name", "WBC", "", None, " Rh-D type", "Sodium", "Order no", "grid_id", "AB", "abs", "page 2", "Phone"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(G.is_metadata_field(F.col("n")).alias("m")).collect()
    assert [r.m for r in got] == [metadata(n) for n in names]
    rows = [(0.85, "default"), (0.84, "x"), (0.7, "human_review"), (0.69, "human_review"), (0.9, None), (None, "default")]
    assert [r.m for r in spark.createDataFrame(rows, "c double, n string").select(G.meets_threshold(F.col("c"), F.col("n")).alias("m")).collect()] == [True, False, True, False, True, None]
    assert [r.p for r in spark.createDataFrame([("lab",), ("operative_note",), (None,)], "k string").select(G.processor_of(F.col("k")).alias("p")).collect()] == ["lab", "fallback", "fallback"]


def test_nested_sections_keep_their_type(spark):
    from tessera.operators.records import plain_sections

    kind = "t string, l array<string>, r array<struct<a:string,b:array<string>,c:map<string,array<struct<d:string>>>,n:int>>, e struct<>, m map<string,string>"
    row = ("x (1)", ["K*"], [("Na†", ["Ca‡", None], {"k_1": [("Mg_2",), None]}, 5), None], (), {"y**": "z**"})
    d = spark.createDataFrame([row, (None,) * 5], kind)
    got = plain_sections(d, d.columns, X.strip_footnotes)
    assert [f.dataType.simpleString() for f in got.schema] == [f.dataType.simpleString() for f in d.schema]
    a, b = got.collect()
    assert a.t == "x" and a.l == ["K*"] and a.r[0].a == "Na" and a.r[0].b == ["Ca", None] and a.r[0].c["k_1"][0].d == "Mg" and a.r[0].c["k_1"][1] is None and a.r[1] is None and a.m == {"y**": "z"}
    assert tuple(b) == (None,) * 5


def test_strengths(spark):
    from tessera.operators import strengths as G

    entries = [(1, "Atenolol", "IN"), (1, "atenolol tab", "BN"), (2, "zolpidem", "IN"), (3, "atenolol 50 MG Oral Tablet", "SCD"), (4, "ATENOLOL 25.5 mcg tablet", "SBD"), (5, "atenolol 50mg extra", "SCD"), (6, "atenololx 7 MG", "SCD"), (7, "lone 5", "IN")]
    dosages = [(2, "10 MG"), (2, "5 MG"), (2, "10 MG"), (2, None), (2, "5 MCG")]
    known = G.known_strengths(spark.createDataFrame(dosages, "code int, strength string"), spark.createDataFrame(entries, "code int, text string, kind string"))
    lists = {}
    for r in known.orderBy("code", "place").collect():
        lists.setdefault(r.code, []).append(r.strength)
    assert lists[1] == ["25.5 MCG", "50 MG"] and lists[2] == ["5 MCG", "5 MG", "10 MG"] and 7 not in lists and lists[6] == ["7 MG"]

    def plain(code, said):
        if not said or code not in lists:
            return False, 0.0
        up = said.upper().strip()
        if m := re.match(r"^([A-Z\d.]+)\s*(MG|MY|MCG|G|ML|%|UNIT|UNITS)?(.*)$", up, re.I):
            n, unit, rest = m.group(1), m.group(2) or "", m.group(3) or ""
            for a, b in G.DIGITS:
                n = n.replace(a, b)
            up = n + " " + ("MG" if unit == "MY" else unit) + rest
        else:
            for a, b in G.DIGITS + G.MORE_SIGNS:
                up = up.replace(a, b)
        s = re.sub(r"(\d+)(MG|MCG|G|ML|%)", r"\1 \2", re.sub(r"\s+", " ", up.strip()))
        for k in lists[code]:
            if s == k:
                return True, 0.20
            x, y = re.search(r"([\d.]+)", s), re.search(r"([\d.]+)", k)
            if x and y and float(x.group(1)) == float(y.group(1)):
                return True, 0.18 if ("MG" in s and "MG" in k) or ("MCG" in s and "MCG" in k) else 0.10
        return False, 0.0

    said = ["50 MG", "50mg", "5O mg", "Z5.5 mcg", "50", "50 ml", "5 MG", "1O MY", "(5 my)", "", None, "abc", "10 mg x"]
    asked = [(c, s) for c in (1, 2, 6, 9) for s in said]
    got = {(r.code, r.strength): (r.valid, r.boost) for r in G.validated_strengths(spark.createDataFrame(asked, "code int, strength string"), known).collect()}
    assert got == {(c, s): plain(c, s) for c, s in asked}
