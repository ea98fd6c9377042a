"""Queries over whole tables against brute force on small fixtures."""

import re
from itertools import combinations

import pytest

import __spark_entry__ as entry


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_pairs(spark, tmp_path):
    """Typos in the second and third letter, other lengths and keys beyond 500 count."""
    names = ["aspirin", "asprin", "axpirin", "asqirin", "spirin", "aspirins", "aspirin", "bspirin", "a", "ab", "", None, "aspirinsxx"]
    part = list(enumerate(names, 495))
    sf = save(spark, tmp_path, "part", part, "p_partkey long, p_name string")
    got = [tuple(r) for r in entry.queries()["edit_distance_pairs"](spark, sf).collect()]
    known = [x for x in part if x[1] is not None]
    classes = {k: [k, *(b for a, b, d in got if a == k and d == 0)] for k in {k for k, _ in known} - {b for _, b, d in got if d == 0}}
    pairs = [(a, b, 0) for m in classes.values() for a, b in combinations(sorted(m), 2)]
    pairs += [(min(x, y), max(x, y), d) for a, b, d in got if d for x in classes[a] for y in classes[b]]
    assert sorted(pairs) == sorted((a, b, d) for (a, x), (b, y) in combinations(known, 2) if x[:1] == y[:1] and (d := edits(x, y)) <= 2)
    assert any(b > 500 for _, b, _ in got)


@pytest.mark.parametrize("name", ["edit_distance_join", "edit_distance_pairs"])
def test_edit_distance_copies(spark, tmp_path, name):
    """Copies give a row each, not a row each two of them; links between different names stay."""
    part = [(i, ["steel bolt", "steel bold", "brass nut", None][i % 4]) for i in range(400)]
    sf = save(spark, tmp_path, "part", part, "p_partkey long, p_name string")
    got = sorted(tuple(r) for r in entry.queries()[name](spark, sf).collect())
    assert got == sorted([(0, 1, 1), *((i % 4, i, 0) for i, n in part if i > 3 and n)])


def test_value_box_match(spark, tmp_path):
    """The best of all other boxes wins, whatever its id."""
    corner = {0: (0.1, 0.1), 1: (0.5, 0.5), 2: (0.5, 0.1), 3: (0.02, 0.1), 20: (0.1, 0.5), 41: (0.9, 0.9)}
    rows = [(i, "p", [x, y, x + 0.05, y + 0.05]) for i, (x, y) in corner.items()]
    sf = save(spark, tmp_path, "embeddings", rows, "vec_id long, label string, embedding array<double>")

    def score(f, v):
        (fx, fy), (vx, vy) = corner[f], corner[v]
        return (1 - abs(fy - vy)) * (1.1 if vx >= fx + 0.05 else 1) * (0.7 if abs(fy - vy) > 0.02 else 1)

    got = {r["field"]: r["value"] for r in entry.queries()["value_box_match"](spark, sf).collect()}
    assert got == {f: min((v for v in corner if v != f), key=lambda v: (-score(f, v), v)) for f in (0, 20)} == {0: 2, 20: 1}


def test_rows_beyond_the_subsets(spark, tmp_path):
    """Every key, supplier and language has its row."""
    save(spark, tmp_path, "part", [(1, "a"), (301, "a"), (302, ""), (303, None), (9999, "b")], "p_partkey long, p_type string")
    save(spark, tmp_path, "lineitem", [(5, "N", "O"), (21, "A", "F"), (21, "R", "O")], "l_suppkey long, l_returnflag string, l_linestatus string")
    sf = save(spark, tmp_path, "documents", [(1, "en", "HEAD ONE\nno head"), (2, "de", "ÜBER ALLES\nNicht"), (3, None, "")], "doc_id long, lang string, text string")
    rows = {n: sorted(tuple(r) for r in entry.queries()[n](spark, sf).collect()) for n in ("samples_by_category", "attribute_product", "header_counts")}
    assert rows["samples_by_category"] == [("a", 2, "1,301"), ("b", 1, "9999"), ("other", 2, "302,303")]
    assert rows["attribute_product"] == [(5, "N", "O")] + [(21, s, f) for s in "AR" for f in "FO"]
    assert rows["header_counts"] == [(1, 1), (2, 1), (3, 0)]


def sections(text):
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    impression, findings = "Impression not found in document", "Findings not found in document"
    if m := re.search(r"(?:IMPRESSION|CONCLUSION|SUMMARY)[:\s]*\n?(.*?)(?=\n[A-Z]{3,}|\nPage|\Z)", text, re.I | re.S):
        impression = ". ".join(s.strip() for s in re.split(r"[.!?]+", m[1].strip())[:3] if s.strip()) + "."
    if m := re.search(r"(?:FINDINGS|OBSERVATIONS)[:\s]*\n?(.*?)(?=\n(?:IMPRESSION|CONCLUSION|RECOMMENDATION|Page)|\Z)", text, re.I | re.S):
        findings = m[1].strip()
    return impression, findings


def test_report_queries(spark, tmp_path):
    texts = [
        "CT of the chest\r\nFINDINGS: clear lungs.\r\n No more.\r\nImpression:\n Normal! Two? Three. Four.\n\nPage 2", "impression\n", "SUMMARY: a. b\nc d\nEND", "Observations:\u00a0x\u00a0\n", "",
        "Mammography", "chest X-Ray", "a fracture of the head", "MRI brain", "sonogram, abdomen", "x-ray of a hand", "CONCLUSION .. !", "FINDINGS a\n\n",
    ]
    sf = save(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["impression"], r["findings"]) for r in entry.queries()["fallback_sections"](spark, sf).collect()}
    assert got == {k: sections(t) for k, t in enumerate(texts)}
    kinds = [tuple(r)[1:] for r in entry.queries()["procedure_type"](spark, sf).orderBy("doc_id").collect()]
    assert kinds[0] == ("chest_ct", "71250") and kinds[4] == ("unknown", None)
    assert kinds[5:11] == [("mammogram", "77067"), ("chest_xray", "71046"), ("head_ct", "70450"), ("mri_brain", "70551"), ("ultrasound_abdomen", "76700"), ("xray_unknown", None)]


def test_cache_expire_rounds_now(spark, tmp_path):
    """The last time goes to the nearest second, a half to the even one; times of rows are cut to theirs."""
    import duckdb

    for last in ("00:00:09.4", "00:00:09.6", "00:00:09.5", "00:00:10.5", "00:00:10.500001"):
        rows = [(0, f"2024-01-04 {last}")] + [(i, f"2024-01-01 00:00:{i:02}.9") for i in range(7, 13)]
        folder = tmp_path / last.replace(":", "")
        sf = save(spark, folder, "events", rows, "event_id long, at string")
        spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "cast(at as timestamp_ntz) AS ts").write.parquet(f"{sf}/x/events.parquet")
        c = duckdb.connect()
        c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/x/events.parquet/*.parquet')")
        want = sorted(c.execute(entry.oracle_sql()["cache_expire"]).fetchall())
        assert sorted(tuple(r) for r in entry.queries()["cache_expire"](spark, f"{sf}/x").collect()) == want and 0 < len(want) < len(rows)


def test_same_fields_are_spread(spark, sf):
    """A small file of many rows is not left to one task."""
    assert entry.queries()["same_fields"](spark, sf).rdd.getNumPartitions() >= 4


def test_prescriptions_number_their_drugs_once(spark, sf):
    """The window over each prescription's drugs is not in the plan of every rule."""
    assert "Window" not in entry.queries()["prescription_issues"](spark, sf)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["parse_range", "parse_numeric", "value_flag"])
def test_cells_of_broken_quantities(spark, tmp_path, name):
    """Quantities that are no whole numbers go to the nearest, halves to the even one, as the SQL's cast has them."""
    import duckdb

    quantities = [None, 0.0, 0.4, 0.5, 1.5, 2.5, 2.500001, 3.7, 49.99, 7.0, -0.5, -1.5, -12.0]
    rows = [(i, part, line, q) for i, (part, line, q) in enumerate((p, n, q) for p in range(27) for n in (1, 7, None) for q in quantities)]
    save(spark, tmp_path / "x", "lineitem", rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/x/lineitem.parquet/*.parquet')")
    want = c.execute(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path / "x")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 500


@pytest.mark.parametrize("keys", [3, 500])
@pytest.mark.parametrize("name, head", [("edit_distance_join", 3), ("edit_distance_pairs", 1)])
def test_edit_distance_whole_pairs(spark, tmp_path, monkeypatch, name, head, keys):
    """Every pair of parts has its row, copies of a name too, whether a name's keys are one block or many."""
    monkeypatch.setattr("tessera.operators.lookup.KEYS", keys)
    names = ["steel bolt", "steel bold", "steal bolt", "brass nut", "steel bolt", None, "", "a", "ab", "steel bolts", "brass nut, of a kind with a long name", "brass nut, of a kynd with a long name"]
    part = [((i * 37) % 101, names[i % len(names)]) for i in range(100)] + [(None, "brass nut")]
    sf = save(spark, tmp_path, "part", part, "p_partkey long, p_name string")
    got = [tuple(r) for r in entry.queries()[name](spark, sf).collect()]
    known = [x for x in sorted(part[:-1]) if x[1] is not None]
    assert sorted(got) == sorted((a, b, d) for (a, x), (b, y) in combinations(known, 2) if x[:head] == y[:head] and (d := edits(x, y)) <= 2)
