"""Column functions against expected values; sources, sinks and streams against small files."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import content as C
from tessera.functions import prescriptions as P
from tessera.functions import text as X
from tessera.operators import reports as R
from tessera.operators import retrieval, seams
from tessera.sources import files, sinks
from tessera.streaming import events as streams


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, want", [("7.2", 7.2), ("<5", 5.0), (" > 60 mL", 60.0), ("10E3/uL", None), ("mg/dL", None), ("", None), (None, None), ("abc", None), ("a-3", -3.0), ("x12345678901", None)])
def test_parse_numeric(spark, raw, want):
    assert one(spark, X.parse_numeric, raw) == want


@pytest.mark.parametrize("raw, want", [("4.5-11.0", (4.5, 11.0)), ("0.5 – 1.2", (0.5, 1.2)), (">60", (60.0, float("inf"))), ("<= 5", (0.0, 5.0)), ("negative", None), ("see note 1-2", None), (None, None), ("", None)])
def test_parse_range(spark, raw, want):
    got = one(spark, X.parse_range, raw)
    assert (got and tuple(got)) == want


@pytest.mark.parametrize("raw, want", [("1O2", "102"), ("1O2O3", "102O3"), ("1OO2", "1OO2"), ("S5.5", "55.5"), ("1B5", "185"), ("l5", "15"), ("3E5", "35"), ("10E3/uL", "10E3/uL"), ("1O0-2O0", "100-200"), ("none", "none")])
def test_repair_value(spark, raw, want):
    assert one(spark, X.repair_value, raw) == want


@pytest.mark.parametrize("raw, want", [("Ashcraft", "A226"), ("Robert", "R163"), ("Lee", "L000")])
def test_sound_code(spark, raw, want):
    assert one(spark, X.sound_code, raw) == want


def test_flags_units_and_values(spark):
    assert one(spark, X.value_flag, "14.2 High") == "H" and one(spark, X.flagged_value, "14.2 High") == 14.2 and one(spark, X.value_unit, "14.2 g/dL H") == "g/dL"


def test_dosage_stage_sizes(spark):
    assert tuple(one(spark, X.dosage, "take 2.5 MG po")) == (2.5, "mg") and tuple(one(spark, X.dosage, "5 % cream")) == (5.0, "%")
    assert tuple(one(spark, X.stage, "pT2N1M0")) == ("T2", "N1", "M0") and tuple(one(spark, X.stage, "stage t3b")) == ("T3B", None, None)
    assert one(spark, X.measurements, "2 x 3 cm") == ["2 x 3 cm", "3 cm"]
    assert one(spark, X.quantity, "Qty: 30") == 30 and one(spark, X.refills, "2 refills") == 2


@pytest.mark.parametrize("raw, want", [("2024-01-05 10:00", "2024-01-05"), ("01/05/2024", "2024-01-05"), ("25/12/2024", "2024-12-25"), ("January 5, 2024", "2024-01-05"), ("21 Jan 2025", "2025-01-21"), ("21-Jan-2025", "2025-01-21"), ("20250121", "2025-01-21"), ("01-21-2025", "2025-01-21"), ("1/4/2016", "2016-01-04"), ("2016/01/04", None), ("soon", None)])
def test_iso_date(spark, raw, want):
    assert one(spark, X.iso_date, raw) == want


@pytest.mark.parametrize("raw, want", [("mchc02", "mchc"), ("Glucose¹", "Glucose"), ("WBC (1)", "WBC"), ("basos_02", "basos"), ("x [2]", "x"), ("neut **", "neut"), ("a†", "a"), ("¹mid", "¹mid")])
def test_strip_footnotes(spark, raw, want):
    assert one(spark, X.strip_footnotes, raw) == want


@pytest.mark.parametrize("raw, want", [("inhaled twice", "inhaled"), ("give it", "intravenous"), ("by mouth", "oral"), ("Sublingual tab", "sublingual"), ("", "oral")])
def test_routes(spark, raw, want):
    assert one(spark, lambda c: X.first_contained(c, X.ROUTES, "oral"), raw) == want


@pytest.mark.parametrize("raw, want", [("qd then bid", ("qd", "once daily", None, None)), ("q8h tab", ("q8h", "every 8 hours", None, None)), ("3 times daily", (None, None, "times_per_day", 3)), ("every 6 hours", (None, None, "every_n_hours", 6)), ("stat", (None, None, None, None))])
def test_frequencies(spark, raw, want):
    assert tuple(one(spark, X.frequency, raw)) == want


@pytest.mark.parametrize("raw, want", [("10 mg", True), ("5/325", True), ("0.5 G", True), ("ten", False), (None, False)])
def test_dosage_format(spark, raw, want):
    assert one(spark, P.is_dosage, raw) == want


@pytest.mark.parametrize("raw, want", [("TAB. ABCIXIMAB 1 Morning", "ABCIXIMAB"), ("CAP. OMEPRAZOLE 20mg", "OMEPRAZOLE"), ("INJ. INSULIN 10 units", "INSULIN"), ("Metformin 500mg", "Metformin"), ("Lisinopril 10 mg tablets", "Lisinopril"), ("Advair Diskus 250/50", "Advair Diskus"), ("tab", "tab")])
def test_drug_name(spark, raw, want):
    assert one(spark, P.drug_name, raw) == want


def scanned(text):
    """Orders of a text, a line at a time, with sets of lines taken."""
    lines, taken, out = [x.strip(" ") for x in text.split("\n")], set(), []
    for i, line in enumerate(lines):
        if i in taken or len(line) < 5 or any(re.match(p, line, re.I) for p in P.NO_ORDER):
            continue
        if m := re.match(P.DOSED, line):
            out.append(("dosed", line, m[1], m[2].strip(), m[3] or m[4] or "", "", "", ""))
        elif m := re.match(P.PRESCRIBED, line):
            out.append(("prescribed", line, m[1], m[2].strip(), m[3] or "", "", "", ""))
        elif m := re.match(P.HANDWRITTEN, line):
            n = re.search(r"(\d+)\s*(?:mg|my|ml|mcg|g)?", line, re.I)
            sig = next((k for k in range(i + 1, min(i + 4, len(lines))) if lines[k].lower().startswith("sig")), None)
            said = lines[sig] if sig is not None else ""
            taken |= {sig}
            often = next((f"{a[1]}x daily" for p in P.A_DAY if (a := re.search(p, said))), "")
            out.append(("handwritten", line, m[1], n[1] + "mg" if n and n[1] != m[2] else "", m[2], often, "", said))
        elif m := re.match(P.FORM_FIRST, line):
            more = line
            for k in range(i + 1, min(i + 5, len(lines))):
                if lines[k]:
                    if re.match(P.FORM_FIRST, lines[k]):
                        break
                    more += " " + lines[k]
                    taken.add(k)
            strength = (m[2] or "").strip()
            if strength and not re.search("(mg|ml|mcg|g|%)$", strength, re.I):
                strength += "mg"
            total, days, times, meal = (re.search(p, more) for p in (P.TOTAL, P.DURATION, P.TIMES, P.MEALS))
            told = (times[2] or "").strip() if times else ""
            out.append(("form first", line, m[1], strength, total[1] if total else "", times[1].strip() if times else "", days[0] if days else "", told or (meal[1].strip() if meal else "")))
    return out


def test_orders_equal_a_scan_of_lines(spark):
    pieces = ["TAB. ABCIXIMAB", "1) CAP. ZOCLAR 500", "1 Morning, 1 Night", "(Before Food)", "8 Days (Tot:16 Tab)", "amoxirillin Joong Cap#21", "Sig: 1 cap 3x a day", "sig 2 times a day", "Lisinopril 10mg x30", "Akendd Z5my 30", "Rx: Metformin 500 mg tab 60", "Patient: someone", "1/2/2024", "", "note", "word word word", "SYR. AMOXYCILLIN 250 MG / SR", "Vitamin-D 5 mcg (30)"]
    rnd = random.Random(3)
    texts = ["\n".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 14))) for _ in range(250)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", P.orders(F.col("t")).alias("o")).collect()
    for r in rows:
        assert [tuple(x) for x in r["o"]] == scanned(texts[r["i"]]), texts[r["i"]]


def test_orders_read_each_line_once(spark):
    """The form of a prescribed line stands in the plan where it is tried and where its three groups are taken, not at every mention of a line's kind."""
    plan = spark.createDataFrame([("Rx a",)], "t string").select(P.orders(F.col("t")).alias("o"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(P.PRESCRIBED) == 4


def test_plain_value_lists_equal_plain_names(spark, sf):
    lists, names = entry.queries()["plain_value_lists"](spark, sf), entry.queries()["plain_names"](spark, sf)
    assert lists.count() == names.count() and lists.join(names, ["p_partkey", "name"]).count() == names.count()


def test_chunks_overlap_and_end():
    assert retrieval.cut_chunks("a" * 10, 10, 2) == ["a" * 10]
    assert [len(c) for c in retrieval.cut_chunks("x" * 3700, 2000, 200)] == [2000, 1900, 100]
    assert retrieval.cut_chunks("one. " + "b" * 6 + ". " + "c" * 9, 14, 2)[0] == "one. bbbbbb."
    with pytest.raises(ValueError):
        retrieval.cut_chunks("x" * 30, 10, 6)


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("LOINC_NUM,COMPONENT,SHORTNAME,STATUS,RANK\n1,Glucose,Gluc,ACTIVE,5\n2,Old,O,DEPRECATED,1\n3,Sodium,Na,ACTIVE,x\n")
    got = {r["loinc_num"]: (r["rank"], r["component_lower"]) for r in files.ranked_terms(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {"1": (5, "glucose"), "3": (files.UNRANKED, "sodium")}
    (tmp_path / "n.rrf").write_text("1|ENG|IN|Aspirin|N\n2|SPA|IN|Aspirina|N\n3|ENG|XX|Thing|N\n4|ENG|BN|Bayer|Y\n")
    assert [r["name_lower"] for r in files.piped_names(spark, str(tmp_path / "n.rrf"), ["rxcui", "lat", "tty", "name", "suppress"]).collect()] == ["aspirin"]


def test_binary_kinds(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n")
    got = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in files.binary_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "pdf", "b.png": "png"}


def test_sinks(spark, tmp_path):
    d, path = spark.range(3), str(tmp_path / "t")
    sinks.append(d, path)
    sinks.append(d, path)
    assert spark.read.parquet(path).count() == 6
    sinks.truncate(d, path)
    assert spark.read.parquet(path).count() == 0


def test_upsert_stream(spark, tmp_path):
    write = streams.upsert_batches(str(tmp_path / "s"), ["k"], ["t"])
    write(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, t int, v string"), 0)
    write(spark.createDataFrame([(1, 2, "c"), (3, 1, "d"), (3, 0, "e")], "k int, t int, v string"), 1)
    assert {(r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "s" / "v1")).collect()} == {(1, "c"), (2, "b"), (3, "d")}


def test_embedding_seam(spark):
    d = spark.createDataFrame([(1, "abc"), (2, None)], "id long, t string")
    got = {r["id"]: sum(x * x for x in r["embedding"]) for r in seams.embed(d, "id", "t").collect()}
    assert abs(got[1] - 1) < 1e-9 and got[2] == 0


def test_narrow_ranges(spark):
    cells = ["1-2", " 1-2", "1 – 2", "<5", "> 5.5", "5.-6.", "", None, "x1-2", "≤3"]
    low, high = X.leading_range(F.col("r"))
    a, b = X.range_texts(F.col("r"))
    got = [tuple(r) for r in spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, r string").orderBy("i").select(low, high, a, b).collect()]
    none = (None,) * 4
    assert got == [(1, 2, "1", "2"), none, (None, None, "1", "2"), (0, 5, None, None), (5.5, float("inf"), None, None), (5, 6, "5.", "6."), none, none, none, none]


def test_reported_values_and_findings(spark):
    values = ["5", "DNR", "LDNR", "xldnr", " see note ", "None", "", None, "pending"]
    rows = spark.createDataFrame([(i, "n", v, None, "") for i, v in enumerate(values)], "i int, name string, value string, unit string, range string")
    assert [r["i"] for r in rows.where(R.reported(F.col("value"))).orderBy("i").collect()] == [0, 3]
    assert [(r["value"], r["confidence"]) for r in R.structured_tests(rows.withColumn("d", F.lit(1)), "d", "i").orderBy("i").collect()] == [("5", 0.67), ("xldnr", 0.67)]
    notes = spark.createDataFrame([(1, "mass left"), (1, None), (2, None)], "d int, t string")
    got = R.enrich_findings(notes, "d", "t", [("mass", "mass")], [("left", "left")], [("again", "repeat")])
    assert [tuple(r) for r in got.orderBy("d").collect()] == [(1, 1, 1, 0, "mass", 0.8, True), (2, 0, 0, 0, "", 0.5, False)]
    assert R.table_results(rows.where("false").withColumn("d", F.lit(1)), "d", "i", F.col("name"), F.col("value"), F.lit(True)).count() == 0


def test_finding_words_end_at_ascii_edges(spark):
    """A letter beyond ASCII is no part of a word, as in the SQL, whatever the Java version."""
    notes = spark.createDataFrame([(1, "ñque"), (2, "que\u00e9 x"), (3, "aque"), (4, "la QUE, no"), (5, r"\bque")], "d int, t string")
    got = R.enrich_findings(notes, "d", "t", [("watch", r"\bque\b")], [("slash", r"\\bq")], [("again", "x")])
    assert [(r["d"], r["critical"], r["n_places"]) for r in got.orderBy("d").collect()] == [(1, "watch", 0), (2, "watch", 0), (3, "", 0), (4, "watch", 0), (5, "", 1)]


@pytest.mark.parametrize("block", [8192, 7])
def test_similar_by_blocks(spark, block):
    """The same as by comparing all, with copies, zero and short vectors, nulls and numbers that are none; blocks meet by key and nothing is joined without one."""
    rng = random.Random(5)
    vectors = [[float(rng.randint(-3, 3)) for _ in range(4)] for _ in range(40)] * 2 + [[0.0] * 4, [1.0, 2.0], [2.0, 4.0], None, [1.0, None, 2.0, 0.0], [float("nan"), 1.0, 1.0, 1.0], []]
    rows = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<float>")
    got = retrieval.similar(rows, rows.where("id % 3 = 0 or id > 79"), "id", "v", 3, 0.2, block)

    def cosine(a, b):
        lengths = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return 0.0 if lengths == 0 else sum(x * y for x, y in zip(a, b)) / lengths

    known = {i: v for i, v in enumerate(vectors) if v is not None and None not in v}
    want = []
    for q in (i for i in known if i % 3 == 0 or i > 79):
        near = [(s, i) for i, v in known.items() if i != q and len(v) == len(known[q]) and not (s := cosine(known[q], v)) < 0.2]
        near.sort(key=lambda x: (-math.inf if math.isnan(x[0]) else -x[0], x[1]))
        want += [(q, i, repr(s), n) for n, (s, i) in enumerate(near[:3], 1)]
    assert sorted((r["query"], r["id"], repr(r["similarity"]), r["rank"]) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_medical_gate_looks_for_each_list_once(spark):
    long = "about us, our products, welcome to the meeting room; all rights reserved since then, "
    texts = [long + "the clinic", long + "patient at the clinic", long + "patient, clinic, blood test", "patient clinic blood", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", C.medical_gate(F.col("t")).alias("g"))
    assert [tuple(r.g) for r in d.orderBy("i").collect()] == [(1, False), (2, False), (3, True), (0, False), (None, False)]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count(x) == 1 for x in C.MEDICAL + C.OTHER)
