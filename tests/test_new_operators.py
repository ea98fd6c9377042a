"""Boxes, streams of jobs, retries, records, drugs, readings, columns, snapshots and near names: edge cases and brute force."""

import difflib
import itertools
import math
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.names import HINTS, plain_name, suggested_name
from tessera.operators import boxes as B
from tessera.operators import lookup as L
from tessera.operators import medications as M
from tessera.operators import readings as R
from tessera.operators import seams
from tessera.operators import structuring as S
from tessera.operators import tables as T
from tessera.operators import validation as V
from tessera.operators.enrich import most_edits, tolerant
from tessera.operators.near import near_candidates
from tessera.operators.transfer import boxes_of_text
from tessera.sources import snapshots
from tessera.sources.shared import new_path, written
from tessera.streaming import events as E
from tessera.streaming import jobs as J

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_nearest_values_equal_brute_force(spark):
    r = random.Random(4)
    rows = [("p" if k % 3 else "q", k, (x := r.random(), y := r.choice([r.random(), 0.5]), x + r.random() * 0.3, y + 0.01)) for k in range(300)]
    rows += [("lone", 400, (0.1, 0.1, 0.2, 0.2)), ("far", 500, (0.0, 0.0, 0.1, 0.1)), ("far", 501, (0.0, 90.0, 0.1, 91.0)), ("p", 600, (None, None, None, None))]
    fields = spark.createDataFrame(rows, f"page string, field int, box {BOX}").where("field % 5 = 0")
    values = spark.createDataFrame(rows, f"page string, value int, box {BOX}")
    got = {x.field: (x.value, round(x.score, 9)) for x in B.nearest_values(fields, values).collect()}
    want = {}
    for page, f, fb in rows:
        if f % 5 == 0 and fb[0] is not None:
            scored = []
            for p, v, vb in rows:
                if p == page and v != f and vb[0] is not None:
                    gap = abs(fb[1] - vb[1])
                    scored.append(((1 - gap) * (1.1 if vb[0] >= fb[2] else 1) * (0.7 if gap > 0.02 else 1), -v))
            if scored:
                s, v = max(scored)
                want[f] = (-v, round(s, 9))
    assert got == want and len(got) == 61
    assert B.nearest_values(fields.limit(0), values).count() == 0 and B.nearest_values(fields, values.limit(0)).count() == 0


def test_rows_joined_grow_with_the_fields(spark):
    """Ten times as many boxes on one page: about ten times as many pairs met, not a hundred."""

    def pairs(n):
        r = random.Random(n)
        rows = [("p", k, (x := r.random(), y := r.random(), x + 0.1, y + 0.01)) for k in range(n)]
        values = spark.createDataFrame(rows, f"page string, value int, box {BOX}")
        fields = spark.createDataFrame(rows, f"page string, field int, box {BOX}")
        ys, height = sorted(b[1] for _, _, b in rows), 0.02
        fullest = max(sum(1 for y in ys if math.floor(y / 0.02) == c) for c in range(50))
        while height > 0.02 * 16 / fullest:
            height /= 4
        near = sum(1 for a in rows[:: n // 100] for b in rows if abs(math.floor(a[2][1] / height) - math.floor(b[2][1] / height)) <= 1)
        assert B.nearest_values(fields.limit(5), values).count() == 5
        return near / 100

    assert pairs(4000) < 4 * pairs(400) + 50


def find_in_words(want, words, least):
    """The reference's ways of finding a text among words, by plain Python."""
    low, out = want.strip().lower(), []
    like = lambda a, b: difflib.SequenceMatcher(None, a.strip().lower(), b.strip().lower()).ratio() if a.strip().lower() != b.strip().lower() else 1.0
    out = [(1.0, -k, w, b) for k, w, b in words if w.strip().lower() == low]
    if not out:
        out = [(like(w, want) * 0.9, -k, w, b) for k, w, b in words if like(w, want) >= least]
    n = len(low.split())
    if not out and n > 1:
        for s in range(len(words) - n + 1):
            part = words[s : s + n]
            text = " ".join(w.strip() for _, w, _ in part)
            if like(text, want) >= least:
                bs = [b for _, _, b in part]
                out.append((like(text, want) * 0.85, -part[0][0], text, (min(b[0] for b in bs), min(b[1] for b in bs), max(b[2] for b in bs), max(b[3] for b in bs))))
    return sorted(out, key=lambda x: (-x[0], -x[1]))


def test_values_of_fields_equal_brute_force(spark):
    r, words, pages = random.Random(9), [], {}
    for p in range(25):
        pages[p] = [(k, r.choice(["Sodium", "Sodlum", "Potassium", "140", "4.2", "mmol/L", "high", "Total", "Protein"]), (x := r.choice([0.0, 0.3, 0.6]), y := r.randint(0, 25) * 0.013, x + 0.2, y + 0.01)) for k in range(14)]
        words += [(p, k, w, b) for k, w, b in pages[p]]
    asked = [("sodium", "140"), ("Potassium", "4.2"), ("total protein", "high"), ("missing", "140"), ("Sodium", "total protein")]
    w = spark.createDataFrame(words, f"page int, place int, text string, box {BOX}")
    wanted = spark.createDataFrame([(p, f, v) for p in range(26) for f, v in asked] + [(0, None, "140"), (0, "sodium", " ")], "page int, field string, value string")
    got = {(x.page, x.field, x.value): (x.place, x.text, round(x.confidence, 6)) for x in B.values_of_fields(w, wanted).collect()}
    want = {}
    for p in pages:
        for f, v in asked:
            fields, values = find_in_words(f, pages[p], 0.7), find_in_words(v, pages[p], 0.8)
            if not values:
                continue
            if not fields:
                c, k, t, _ = values[0]
                want[p, f, v] = (-k, t, round(c, 6))
                continue
            fb, scored = fields[0][3], []
            for c, k, t, b in values:
                gap = abs((b[1] + b[3]) / 2 - (fb[1] + fb[3]) / 2)
                row = gap <= 0.02 + 1e-12
                scored.append((round(min(1.0, c * (1 - min(gap * 5, 0.5)) * (1.1 if row and b[0] > fb[2] else 1.0 if row else 0.7)), 9), c, k, t))
            best = max(scored)
            want[p, f, v] = (-best[2], best[3], round(best[0], 6))
    assert got == want and len(got) > 60


def test_placed_values_over_pages_and_tables(spark):
    words = [("d", 1, 0, "Sodium", (10.0, 10.0, 50.0, 20.0), 100.0, 200.0), ("d", 1, 1, "140", (60.0, 10.0, 90.0, 20.0), 100.0, 200.0), ("d", 2, 0, "140", (0.1, 0.1, 0.2, 0.2), 1.0, 1.0), ("e", 1, 0, "9", (0.1, 0.1, 0.3, 0.3), 1.0, 1.0)]
    cells = [("d", 2, "7.5", (0.5, 0.5, 0.6, 0.6)), ("d", 2, "bad", (0.9, 0.9, 0.1, 0.1)), ("e", 1, " 9 ", (0.4, 0.4, 0.6, 0.6))]
    wanted = [("d", 1, "sodium", "140", None, None), ("d", 2, None, "140", 2, None), ("d", 3, "x", "7.5", None, None), ("d", 4, "x", "bad", None, None), ("d", 5, "x", "140", 1, (0.0, 0.0, 1.0, 1.0)), ("e", 6, None, "9", None, (2.0, 0.0, 1.0, 1.0)), ("e", 7, None, None, None, None)]
    got = {x.id: x for x in B.placed_values(spark.createDataFrame(words, f"doc string, page int, place int, text string, box {BOX}, width double, height double"), spark.createDataFrame(cells, f"doc string, page int, text string, box {BOX}"), spark.createDataFrame(wanted, f"doc string, id int, field string, value string, page int, box {BOX}")).collect()}
    assert set(got) == {1, 2, 3, 5, 6}
    assert got[1].page == 1 and got[1].box.x0 == 0.6 and got[1].box.y1 == 0.1 and got[1].source == "ocr"
    assert got[2].page == 2 and got[3].source == "table" and got[5].source == "given" and got[6].source == "table"


def test_job_states_over_several_batches(spark, tmp_path):
    """Files read one by one: writes, hits, misses and expiries as a plain loop has them."""
    r, t0, rows = random.Random(2), datetime(2024, 1, 1), []
    for i in range(400):
        rows.append((i, t0 + timedelta(minutes=30 * i), r.randint(0, 9), r.random() < 0.5, r.choice(["queued", "done"])))
    rows.append((900, t0 + timedelta(days=40), 99, False, "queued"))
    for k in range(4):
        part = rows[k * 100 : (k + 1) * 100 + (k == 3)]
        df = pd.DataFrame([(e, ts, j, p, None if p else s) for e, ts, j, p, s in part], columns=["event_id", "ts", "job", "is_poll", "status"])
        spark.createDataFrame(df, "event_id long, ts timestamp, job long, is_poll boolean, status string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    ttl = timedelta(hours=5)
    stream = spark.readStream.schema("event_id long, ts timestamp, job long, is_poll boolean, status string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    updates = J.drain_jobs(J.job_updates(stream, ttl), new_path(spark, "jobs"))
    got = {x.job: (x.status, x.writes, x.hits, x.misses) for x in J.last_states(updates).collect()}
    state = {}
    for _, ts, j, poll, s in rows:
        status, at, w, h, m = state.get(j, (None, None, 0, 0, 0))
        if not poll:
            state[j] = (s, ts, w + 1, h, m)
        elif at is not None and ts - at <= ttl:
            state[j] = (status, at, w, h + 1, m)
        else:
            state[j] = (status, at, w, h, m + 1)
    last = max(x[1] for x in rows) - timedelta(hours=2)
    want = {j: ("expired" if at is not None and at + ttl < last else s, w, h, m) for j, (s, at, w, h, m) in state.items()}
    assert got == want and want[99][0] == "queued" and any(v[0] == "expired" for v in want.values())


def test_drained_windows_have_every_event(spark, sf):
    rows = E.drain(E.tumbling(E.read_stream(spark, sf, "events")), new_path(spark, "windows"))
    assert rows.groupBy("start", "event_type").agg(F.max_by("n", "epoch").alias("n")).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_retries_ask_failed_rows_only(spark):
    def model(b, attempt):
        if "boom" in set(b["prompt"]) and attempt == 0:
            raise RuntimeError("down")
        bad = b["prompt"].str.startswith("never") | (b["prompt"].str.startswith("late") & (attempt < 2))
        return pd.DataFrame({"answer": [f"{p}@{attempt}" for p in b["prompt"]], "error": ["no" if x else None for x in bad]}).assign(answer=lambda d: d["answer"].where(d["error"].isna()))

    rows = spark.createDataFrame([(1, "a"), (2, "late"), (3, "never"), (3, "a"), (None, "a")], "k long, prompt string").coalesce(1)
    answers, dead = seams.infer_with_retries(rows, "k", model, "answer string", retries=2)
    assert sorted((x.k or 0, x.answer, x.attempts) for x in answers.collect()) == [(0, "a@0", 1), (1, "a@0", 1), (2, "late@2", 3), (3, "a@0", 1)]
    assert [(x.k, x.attempts, x.error) for x in dead.collect()] == [(3, 3, "Failed after 2 retries: no")]
    answers, dead = seams.infer_with_retries(spark.createDataFrame([(1, "boom")], "k long, prompt string"), "k", model, "answer string", retries=1)
    assert answers.first().attempts == 2 and dead.count() == 0
    none = seams.infer_with_retries(rows.limit(0), "k", model, "answer string")
    assert none[0].count() == 0 and none[1].count() == 0


def test_records_and_patches(spark):
    said = [(1, '{"patient":{"name":"J ohn","dob":"x","gender":"","insurance_id":"I"},"medications":[{"name":"A "},{"name":"a"},{"name":null}],"invoice":{"invoice_number":"7","total":""}}'), (2, "not json"), (3, None), (4, "{}"), (5, '{"patient":"text"}')]
    r = S.structured(S.parsed(spark.createDataFrame(said, "k int, answer string"), "k", "answer"), "k")
    got = {x.k: x for x in r.collect()}
    assert (got[1].patient.name, got[1].patient.insurance, got[1].patient.confidence) == ("John", "I", 0.45)
    assert [m.name for m in got[1].medications] == ["A "] and got[1].raw_fields == {"invoice_number": "7"} and got[1].warnings == []
    assert got[2].warnings == got[3].warnings == got[5].warnings == ["LLM returned empty response"] and got[2].patient is None and got[4].medications == []
    verdicts = spark.createDataFrame([(1, "patient_dob", False, None), (1, "patient_name", False, "b"), (1, "patient_name", False, "a"), (1, "invoice_number", True, "c"), (1, "total", False, "d"), (2, "patient_dob", False, "e"), (4, "invoice_number", False, "f")], "k int, field string, correct boolean, reason string")
    p = {x.k: x for x in S.reconciled(r, verdicts, "k").collect()}
    assert p[1].patient.dob is None and p[1].patient.confidence == 0.15 and p[1].raw_fields == {"invoice_number": "7"}
    assert p[1].warnings == ["DOB removed: failed verification", "Patient name uncertain: a"] and p[4].warnings == [] and len(p) == 5


@pytest.mark.parametrize(("name", "told"), [("Ibuprofen", "look"), ("refill", "veto"), ("Dr.", "veto"), ("555-123-4567", "veto"), ("xy", "veto"), ("the day", "nothing"), ("Brand 7", "look"), ("two words", "nothing"), ("TAB. Known 10 mg", "dictionary"), ("x" * 51, "veto"), ("Zolpam", "look")])
def test_likely_drugs(spark, name, told):
    entries = spark.createDataFrame([("known", 5, 0), ("known", 4, 1)], "entry string, code int, rank int")
    got = M.likely_drugs(spark.createDataFrame([(name,), (None,)], "name string"), lambda n: L.exact(n, entries)).collect()
    assert [(x.name, x.told_by, x.valid) for x in got] == [(name, told, told in ("look", "dictionary"))]


def test_only_the_regions_asked_for_are_read(spark):
    d = written(spark.createDataFrame([("Drug", i, r) for i, r in enumerate(["usa", "canada", "india"])], "entry string, code int, region string"), "regions", "region")
    rows = spark.createDataFrame([("drug", " Canada"), ("other", "canada")], "name string, region string")
    got = M.found_in_region(rows, d)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "region#" in plan and "PartitionFilters" in plan
    assert {(x.name, x.region, x.code) for x in got.collect()} == {("drug", "canada", 1), ("other", "canada", None)}
    assert [x.r for x in spark.createDataFrame([(" USA",), ("mars",), (None,)], "r string").select(M.region_of(F.col("r")).alias("r")).collect()] == ["usa"] * 3


def test_class_closure_with_circles(spark):
    up = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", None)], "class string, parent string")
    assert {(x[0], x[1]) for x in M.class_closure(up).collect()} == {("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "c"), ("c", "b")}
    chain = spark.createDataFrame([(f"k{i}", f"k{i + 1}") for i in range(6)], "class string, parent string")
    with pytest.raises(ValueError):
        M.class_closure(chain, most=3).count()


def test_heaviest_rise_equals_all_subsets():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(0, 9)
        places, weights = r.sample(range(50), n), [r.randint(1, 9) for _ in range(n)]
        best = max((sum(weights[i] for i in c) for k in range(n + 1) for c in itertools.combinations(range(n), k) if all(places[a] < places[b] for a, b in itertools.pairwise(c))), default=0)
        assert R.heaviest_rise(places, weights) == best


def test_likeness_of_texts(spark):
    rows = [(1, "a b\nccc\nd", "A  B\nccc\nx"), (2, None, "x"), (3, "", ""), (4, "same\nsame", "SAME\n same"), (5, "one\ntwo\nthree", "three\none\ntwo"), (6, None, None)]
    got = {x.k: round(x.likeness, 6) for x in R.likeness(spark.createDataFrame(rows, "k int, l string, r string"), "k", "l", "r").collect()}
    assert got[4] in (0.0, 1.0)  # a text of one line twice has no anchor
    assert got == {1: round(2 * 6 / 14, 6), 2: 0.0, 3: 0.0, 4: got[4], 5: round(2 * 6 / 22, 6), 6: 0.0}
    m = spark.createDataFrame(rows, "k int, l string, r string").select("k", R.merged_reading(F.col("l"), F.col("r"), F.create_map().cast("map<string,string>"), F.create_map().cast("map<string,string>"), F.lit(0.9), F.lit(0.3), F.lit(0.2)).alias("m")).collect()
    assert {x.k: x.m.source for x in m} == {1: "ocr", 2: "vlm", 3: "ocr", 4: "ocr", 5: "ocr", 6: "none"}


def test_column_places(spark):
    rows = [
        (1, ["Test", "Result"], [["a", "1"]]),
        (2, None, [["1", "x", "5"], ["2", "y", "6.5", "mg/dL"], ["3", "", "<7", "mg/dL", "1-2"], ["4"]]),
        (3, ["Test", "Method", "Value here"], None),
        (4, ["Test", "Method", "c", "d"], [["a", "m", "5", "H"], ["b", "m", "6", ""]]),
        (5, None, None),
        (6, [], [["only"]]),
        (7, ["x"], [[None, "3"], [None, "4"]]),
    ]
    got = {x.k: tuple(x)[1:] for x in T.column_places(spark.createDataFrame(rows, "k int, headers array<string>, rows array<array<string>>"), "k").collect()}
    assert got == {1: (0, 1, None, None, None), 2: (0, 2, None, 3, None), 3: (0, 2, None, None, None), 4: (0, 2, 3, None, None), 5: (0, 1, None, None, None), 6: (0, None, None, None, None), 7: (0, 1, None, None, None)}


def test_dual_validation_lattice(spark):
    verdicts = [True, False, None]
    cases = list(itertools.product(verdicts, verdicts))
    rules = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)] + [(20, False)], "k int, ok boolean")
    model = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(cases)] + [(21, False)], "k int, ok boolean")
    got = {x.k: (x.conflict, x.rejected) for x in V.dual_validation(rules, model, ["k"]).collect()}
    want = {i: (a is not None and b is not None and a != b, not a and not b and (a is not None or b is not None)) for i, (a, b) in enumerate(cases)}
    assert got == want | {20: (False, True), 21: (False, True)}
    assert {x.k: (x.conflict, x.rejected) for x in V.dual_validation(rules, model, ["k"], dual=False).collect()}[3] == (False, True)


def test_snapshots_are_seen_whole(spark, tmp_path):
    path, a = str(tmp_path / "s"), spark.createDataFrame([(1, "x", [1.5])], "k int, v string, l array<double>")
    with pytest.raises(ValueError):
        snapshots.load(spark, path)
    assert snapshots.save(a, path) == 1
    fails = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).alias("k"))
    with pytest.raises(Exception, match="killed"):
        snapshots.save(fails, path)
    spark.range(3).write.parquet(f"{path}/version-2-dead")  # rows without an entry
    assert snapshots.load(spark, path).collect() == a.collect() and snapshots.manifest(spark, path).count() == 1
    assert snapshots.save(a.union(a), path, "again", "json") == 2
    assert snapshots.load(spark, path, kind="json").count() == 2 and snapshots.load(spark, path, version=1).count() == 1
    assert snapshots.save(a.limit(0), path) == 3 and snapshots.load(spark, path).count() == 0
    old = spark.createDataFrame([(1, datetime(2024, 1, 1), 10), (2, datetime(2024, 1, 1), None)], "k int, created timestamp, ttl_seconds int")
    assert [x.k for x in snapshots.fresh(old, F.lit(datetime(2024, 1, 2))).collect()] == [2]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_near_candidates_hold_all_pairs_within_the_edits(spark, most):
    r = random.Random(most)
    words = list({"".join(r.choice("abc") for _ in range(r.randint(0, 11))) for _ in range(160)})
    for base in ("".join(r.choice("abcd") for _ in range(n)) for n in (12, 14, 16, 20, 21, 23, 39, 42)):  # about the lengths from which pieces are taken
        for _ in range(12):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                at = r.randrange(1, len(w))
                w[at : at + r.randint(0, 1)] = [r.choice("abcd")] * r.randint(0, 1)
            words.append("".join(w))
    n = spark.createDataFrame([(w, most) for w in words] + [(None, most)], "name string, k int")
    met = {(x.name, x.text) for x in near_candidates(n, n.select(F.col("name").alias("text")), 3).collect()}
    near = {(a, b) for a in words for b in words if a[:1] == b[:1] and edits(a, b) <= most}
    assert near <= met


def test_ten_times_fewer_candidates(spark, sf):
    """Words of the texts: pairs that share a piece against pairs of like first letter and about the same length."""
    words = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("name")).where("length(name) > 6").distinct().limit(4000)
    n = words.select("name", F.lit(2).alias("k"))
    met = near_candidates(n, words.select(F.col("name").alias("text")), 2)
    blocked = n.groupBy(F.substring("name", 1, 1).alias("f"), F.length("name").alias("l")).count()
    around = blocked.alias("a").join(blocked.alias("b"), F.expr("a.f = b.f and abs(a.l - b.l) <= 2")).agg(F.sum(F.col("a.count") * F.col("b.count"))).first()[0]
    assert met.count() * 10 <= around


def test_tolerant_finds_what_all_pairs_find(spark):
    r = random.Random(5)
    stock = ["".join(r.choice("abcde") for _ in range(r.randint(2, 10))) for _ in range(120)]
    entries = [(k, stock[k], stock[-k - 1] if k % 3 else None, k % 700, "CHEM" if k % 2 else None) for k in range(110)] + [(7, "abcab", None, 3, None)]
    names = list({w[: r.randint(2, 9)] + r.choice(["", "a", "bc"]) for w in stock})
    e = spark.createDataFrame(entries, "code int, component string, shortname string, rank int, kind string")
    got = {x.name: (x.code, x.distance) for x in tolerant(spark.createDataFrame([(n,) for n in names], "name string"), e).collect()}
    by_name = {}
    for n in names:
        most = 1 if len(n) <= 4 else 2 if len(n) <= 6 else 3
        chosen = {}
        for code, comp, short, rank, kind in entries:
            for side, text in enumerate((comp, short)):
                if text and len(n) >= 3 and text[0] == n[0] and max(2, len(n) - most) <= len(text) <= len(n) + most + 2:
                    chosen[code] = min(chosen.get(code, (9, "")), (side, text))
        by_name[n] = {c: edits(n, t) for c, (_, t) in chosen.items() if edits(n, t) <= most}
    assert set(got) == {n for n, c in by_name.items() if c} and all(by_name[n][c] == d for n, (c, d) in got.items())
    assert spark.range(1).select(most_edits(F.lit("abcd")).alias("m")).first().m == 1


def test_value_after_names_with_signs(spark):
    rows = [("hdl (calc): 5.5 mg", "hdl (calc"), ("hdl (calc): 5.5 mg", "hdl (calc)"), ("a+b 7", "a+b"), ("alpha count: 3 kg", "alpha_count"), ("x", "["), (None, "x"), ("x: 1", None)]
    got = [x.v and (x.v.value, x.v.unit) for x in spark.createDataFrame(rows, "t string, f string").select(X.value_after(F.col("t"), F.col("f")).alias("v")).collect()]
    assert [g and g[0] for g in got] == [None, 5.5, 7.0, 3.0, None, None, None] and got[1][1] == "mg" and got[3][1] == "kg"


def test_plain_names_compile(spark):
    """The stage of a plain name stays small, and each hint is found as a loop finds it."""
    rows = [(n, u, v) for n in ("Hemoglobin", "glu", "creat", "X", "neutro", "") for u in ("g/dL", "%", "mg/dl", "", None) for v in (0.0, 1.0, 5.0, 14.0, 90.0, None)]
    d = spark.createDataFrame(rows, "n string, u string, v double")
    code = d.select(plain_name(F.col("n"), F.col("u"), F.col("v")).alias("p"))._jdf.queryExecution().debug().codegenToSeq()
    assert all("maxMethodCodeSize" in str(c._3()) or c._3().maxMethodCodeSize() < 64_000 for c in [code.apply(i) for i in range(code.length())])

    def hint(n, u, v):
        if not u or not v:
            return None
        n, u = n.strip().lower(), u.strip().lower()
        for unit, least, most, means in HINTS:
            low = means.lower()
            if (unit in u or u in unit) and least <= v <= most and (n[:2] == low[:2] or n in low or low.startswith(n[:3])):
                return means
        return None

    got = [x.g for x in d.select(suggested_name(F.col("n"), F.col("u"), F.col("v")).alias("g")).collect()]
    assert got == [hint(n, u, v) for n, u, v in rows]


def test_percentiles_with_outliers_and_ties(spark):
    from tessera.operators.stores import histogram_stats

    r = random.Random(8)
    groups = {"outlier": [r.random() for _ in range(999)] + [1e12], "tied": [5.0] * 900 + [1.0, 9.0], "signs": [-1e-300, 0.0, -3.5, 2.25, 1e300, -7.0], "one": [4.0], "same": [0.0, -0.0], "close": [1 + k * 1e-12 for k in range(500)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None)]
    got = {x.k: x for x in histogram_stats(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k, vs in groups.items():
        vs, n = sorted(vs), len(vs)
        assert (got[k].n, got[k].p95, got[k].p99) == (n, vs[int(n * 0.95)], vs[int(n * 0.99)])
        assert got[k].median == pytest.approx((vs[(n - 1) // 2] + vs[n // 2]) / 2, abs=1e-6)


def test_boxes_of_text_on_an_empty_page(spark):
    w = spark.createDataFrame([], f"page int, place int, text string, box {BOX}")
    asked = spark.createDataFrame([(1, "x")], "page int, want string")
    assert boxes_of_text(w, asked).count() == 0 and B.values_of_fields(w, asked.select("page", F.lit("f").alias("field"), F.col("want").alias("value"))).count() == 0


def test_values_of_fields_stay_on_their_page(spark):
    """Words and wanted texts that are dealt out by page are shuffled no more, and nothing is written out on the way."""
    words = spark.createDataFrame([(1, 0, "Glucose", (0.0, 0.1, 0.1, 0.2)), (1, 1, "5.5", (0.2, 0.1, 0.3, 0.2)), (1, 2, "5.5", (0.2, 0.5, 0.3, 0.6))], f"page int, place int, text string, box {BOX}")
    asked = spark.createDataFrame([(1, "glucose", "5.5"), (1, "sodium", "5.5"), (1, "glucose", "5.5"), (1, None, "5.5"), (1, "glucose", None)], "page int, field string, value string")
    got = B.values_of_fields(words.repartition("page"), asked.repartition("page"), lambda a, b: 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "parquet" not in plan.lower()
    assert sorted(tuple(r)[:4] + (r.confidence,) for r in got.collect()) == [(1, "glucose", "5.5", 1, 1.0), (1, "sodium", "5.5", 1, 1.0)]


def test_values_without_a_height(spark):
    """A field whose box has no height still has its values, at the confidence of far ones."""
    words = spark.createDataFrame([(1, 0, "Glucose", None), (1, 1, "5.5", (0.2, 0.1, 0.3, 0.2)), (2, 0, "Glucose", (0.0, 0.1, 0.1, 0.2)), (2, 1, "5.5", (0.2, None, 0.3, 0.2))], f"page int, place int, text string, box {BOX}")
    asked = spark.createDataFrame([(1, "glucose", "5.5"), (2, "glucose", "5.5")], "page int, field string, value string")
    assert sorted((r.page, r.place, r.confidence) for r in B.values_of_fields(words, asked).collect()) == [(1, 1, 0.35), (2, 1, 0.35)]


def test_column_places_judge_each_table_once(spark):
    """A table is read once and never shuffled; padded cells, empty rows and null rows count as `column_profile` counts them."""
    rows = [
        (1, None, [["a", " 5 ", " low "], ["b", "6", ""], None, []]),
        (2, None, [[], None]),
        (3, ["Flag", None, "Item"], [["1", "2", "3"], ["1", "2", "H"]]),
        (4, None, [["x", "y"]] * 10 + [["x", "5"]] * 5),
        (5, ["Result", "Flag"], [["H", "5", "mg/dL"], ["L", "6", "%"]]),
        (6, None, [["1", "2", "2"], ["1", "2", "2"]]),
    ]
    got = T.column_places(spark.createDataFrame(rows, "k int, headers array<string>, rows array<array<string>>"), "k")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {x.k: tuple(x)[1:] for x in got.collect()} == {1: (0, 1, 2, None, None), 2: (0, None, None, None, None), 3: (0, 1, 0, None, None), 4: (0, None, None, None, None), 5: (0, 0, 1, None, None), 6: (0, 1, None, None, None)}
