"""Queries of report metadata, of the fields that unknown documents show, and of vendor templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import metadata as D
from tessera.operators import classify as C
from tessera.plans.registry import query, table
from tessera.sources.shared import spread

quote = lambda s: "'" + s.replace("'", "''") + "'"
found = lambda p, g=1, t="t": f"nullif(regexp_extract({t}, {quote('(?i)' + p)}, {g}), '')"
first = lambda labels, value, t="t": "coalesce(" + ", ".join(found(p + value, 1, t) for p in labels) + ")"

# The head of a report about each customer: labels, dates written three ways (some of days that are not) and signatures differ.
REPORT = """concat(CASE c_custkey % 4 WHEN 0 THEN 'Patient Name: ' WHEN 1 THEN 'PT: ' WHEN 2 THEN 'name ' ELSE 'Who: ' END, 'Ann ', CASE WHEN c_custkey % 3 = 0 THEN 'Bea ' ELSE '' END, 'Lee', '; ',
    CASE c_custkey % 5 WHEN 0 THEN 'DOB: 3/7/81' WHEN 1 THEN 'birth 1975-12-09' WHEN 2 THEN 'Born: Dec 24, 1990' WHEN 3 THEN 'D.O.B. 13/45/2020' ELSE '' END, '; sex: ', CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'f' END, '; age: ', CAST(c_custkey % 90 AS {text}), ' years; ',
    CASE c_custkey % 3 WHEN 0 THEN 'MRN: A' WHEN 1 THEN 'acct # A' ELSE 'id A' END, CAST(c_custkey + 1000 AS {text}), '; ', CASE c_custkey % 4 WHEN 1 THEN 'Accession No: S-' WHEN 2 THEN 'Lab ID: S-' ELSE 'none ' END, CAST(c_custkey + 100000 AS {text}),
    '; collected: 2024-0', CAST(c_custkey % 9 + 1 AS {text}), '-10; sample type serum; ', CASE c_custkey % 6 WHEN 0 THEN 'preliminary' WHEN 1 THEN 'Amended' ELSE 'done' END, '; Ordered by: Sam Q. Roe, M.D.; NPI 12345', CAST(10000 + c_custkey AS {text}), '; page 1 of ', CAST(c_custkey % 7 + 1 AS {text}),
    '; ', CASE c_custkey % 3 WHEN 0 THEN 'reported 1/2/24' WHEN 1 THEN 'printed: April 31, 2024' ELSE 'final 12-31-2023' END)"""
_MONTH = "CASE lower(a)" + "".join(f" WHEN '{m}' THEN {i + 1} WHEN '{m[:3]}' THEN {i + 1}" for i, m in enumerate(D.MONTHS) if m != "may") + " WHEN 'may' THEN 5 END"


def date_sql(labels):
    """The first date that a label's first match gives, over labels and ways to write it."""
    one = lambda p: (
        f"(SELECT TRY(make_date(CASE WHEN y >= 100 THEN y WHEN y < 50 THEN y + 2000 ELSE y + 1900 END, m, d)) FROM (SELECT coalesce(m0, CASE WHEN length(a) = 4 THEN b ELSE TRY_CAST(a AS BIGINT) END) AS m, CASE WHEN m0 IS NOT NULL OR length(a) <> 4 THEN b ELSE c END AS d,"
        f" CASE WHEN m0 IS NULL AND length(a) = 4 THEN TRY_CAST(a AS BIGINT) ELSE c END AS y FROM (SELECT a, TRY_CAST(b AS BIGINT) AS b, TRY_CAST(c AS BIGINT) AS c, {_MONTH} AS m0 FROM (SELECT x.a, x.b, x.c FROM (SELECT regexp_extract(t, {quote('(?i)' + p)}, ['a', 'b', 'c']) AS x)) WHERE a <> '')))"
    )
    return "coalesce(" + ", ".join(one(p + d) for p in labels for d in D.DATES) + ")"


_SIGNED = "coalesce(" + ", ".join(f"CASE WHEN {found(p + D.SIGNED)} IS NOT NULL THEN {found(p + D.SIGNED)} || '/' || coalesce(replace({found(p + D.SIGNED, 2)}, '.', ''), '') END" for p in D.PHYSICIAN) + ")"


@query("report_metadata", f"""WITH r AS (SELECT c_custkey, {REPORT.replace('{text}', 'VARCHAR')} AS t FROM customer), p AS (SELECT c_custkey, {first(D.PATIENT, D.NAME)} AS name, {date_sql(D.BORN)} AS born, upper(substr({found('(?:sex|gender):?' + chr(92) + 's*([MF](?:ale)?|Female?)')}, 1, 1)) AS sex,
    TRY_CAST({found('age:?' + chr(92) + 's*(' + chr(92) + 'd{1,3})')} AS INTEGER) AS said, {first(D.PATIENT_ID, '([A-Z0-9]{4,20})')} AS id, {first(D.ACCESSION, '([A-Z0-9-]{6,20})')} AS accession, {date_sql(D.COLLECTED)} AS collected, {date_sql(D.REPORTED)} AS reported,
    CASE WHEN regexp_matches(t, '(?i)preliminary') THEN 'preliminary' WHEN regexp_matches(t, '(?i)amended') THEN 'corrected' ELSE 'final' END AS status, c_custkey % 7 + 1 AS pages, {_SIGNED} AS signed FROM r)
    SELECT c_custkey, name, born AS birth_date, coalesce(nullif(2025 - year(born) - (strftime(born, '%m-%d') > '06-15')::INT, 0), said)::INTEGER AS age, sex, id, round(least(0.95, 0.5 + 0.15 * ((name IS NOT NULL)::INT + (born IS NOT NULL)::INT + (sex IS NOT NULL)::INT + (id IS NOT NULL)::INT)), 2)::DOUBLE AS confidence,
    accession, collected, reported, status, pages::INTEGER AS pages, signed FROM p""")
def report_metadata(spark, sf):
    """Patient, specimen, report and signature of a report about every customer."""
    t = F.col("t")
    r = spread(table(spark, sf, "customer")).select("c_custkey", F.expr(REPORT.replace("{text}", "STRING")).alias("t"))
    m = r.select("c_custkey", D.patient(t, F.lit("2025-06-15").cast("date")).alias("p"), D.specimen(t).alias("s"), D.report(t, t).alias("r"), D.practitioner(t, D.PHYSICIAN).alias("d"))
    signed = F.concat("d.name", F.lit("/"), F.coalesce("d.credentials", F.lit("")))
    return m.select("c_custkey", "p.name", "p.birth_date", "p.age", "p.sex", "p.id", "p.confidence", "s.accession", "s.collected", "r.reported", "r.status", "r.pages", signed.alias("signed"))


# A letter to each customer with one of each kind of field, some of them twice.
LETTER = """concat('Mail ', lower(replace(c_name, '#', '.')), '@mail.example.com, call ', concat('555-123-', CAST(c_custkey % 9000 + 1000 AS {text})), '. Total: $', CAST(c_custkey % 900 AS {text}), ',100.50 on 2025-02-', CAST(c_custkey % 19 + 10 AS {text}), ' and May ', CAST(c_custkey % 28 + 1 AS {text}), ', 2024', chr(10),
    'Invoice No: #C', CAST(c_custkey AS {text}), '-P1 #C', CAST(c_custkey AS {text}), '-P1', chr(10), 'Segment / Segment : ', c_mktsegment, ' Nation: ', CAST(c_nationkey AS {text}), chr(10), 'x: y', chr(10), 'Note: visa ending in ', CAST(c_custkey % 9000 + 1000 AS {text}), ' GST', CAST(c_custkey AS {text}), chr(10),
    'Ship To: ', CAST(c_custkey AS {text}), ' Long Way Street, Comox, BC V', CAST(c_custkey % 10 AS {text}), 'N 8R9', chr(10), 'Victoria, BC V8V 1A1')"""
_lists = ", ".join(f"list_transform(regexp_extract_all(t, {quote(p)}), lambda v: {{'f': '{f}', 'v': v}})" for f, p in D.STANDALONE)
_kv = f"list_transform(list_zip(regexp_extract_all(t, {quote(D.LABELLED)}, 1), regexp_extract_all(t, {quote(D.LABELLED)}, 2)), lambda z: {{'f': z[1], 'v': regexp_replace(z[2], '\\s+[A-Z][a-z]+\\s*[/:].*$', '', 's')}})"
_places = f"flatten(list_transform(list_zip(regexp_extract_all(t, {quote(D.CITY)}, 1), regexp_extract_all(t, {quote(D.CITY)}, 2), regexp_extract_all(t, {quote(D.CITY)}, 3)), lambda z: [{{'f': 'city', 'v': z[1]}}, {{'f': 'province', 'v': z[2]}}, {{'f': 'postal_code_extracted', 'v': z[3]}}]))"
_streets = ", ".join(f"list_transform(regexp_extract_all(t, {quote(p)}, 1), lambda v: {{'f': '{f}', 'v': v}})" for f, p in (("address", D.ADDRESS), ("street_address", D.STREET)))


@query("shown_fields", f"""WITH l AS (SELECT c_custkey, {LETTER.replace('{text}', 'VARCHAR')} AS t FROM customer), a AS (SELECT c_custkey, flatten([{_lists}, {_kv}, {_streets}, {_places}]) AS l FROM l),
    e AS (SELECT c_custkey, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM a), p AS (SELECT c_custkey, i, 'raw_' || substr(regexp_replace(translate(lower(trim(regexp_replace(x.f, '^\\s+|\\s+$', '', 'g'))), ' /', '__'), '[^a-z0-9_]', '', 'g'), 1, 50) AS field, regexp_replace(x.v, '^\\s+|\\s+$', '', 'g') AS value FROM e)
    SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY i) - 1 AS INTEGER) AS pos, field, value FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey, field, substr(value, 1, 50) ORDER BY i) AS k FROM p WHERE length(field) > 4 AND length(value) >= 2) WHERE k = 1""")
def shown_fields(spark, sf):
    """All fields that a letter to every customer shows."""
    letters = spread(table(spark, sf, "customer")).select("c_custkey", F.expr(LETTER.replace("{text}", "STRING")).alias("t"))
    return letters.select("c_custkey", F.posexplode(D.shown_fields(F.col("t")))).select("c_custkey", "pos", "col.field", "col.value")


TEMPLATES = [
    C.Template("promo", r"promo\s+burnished", ("Copper Works", "Brand#1 Steel Corporation"), ("Hemoglobin", "small", "drill"), True, True),
    C.Template("plated", r"plated", ("widget",), ("steel", "brass"), True, False),
    C.Template("any", None, (), ("bolt",), False, True),
]
FORM = """concat(p_type, ' ', p_name, CASE p_partkey % 7 WHEN 0 THEN ' Copper Works' WHEN 1 THEN ' brand#1 corporation' WHEN 2 THEN ' hgb' ELSE '' END, chr(9), CASE WHEN p_size > 25 THEN concat(CAST(p_size AS {text}), ' - 90') ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN ' H' ELSE '' END, CASE p_partkey % 4 WHEN 0 THEN ' RESULT UNIT g/dL' WHEN 1 THEN ' mmol/L' ELSE '' END)"""


def _score_sql(t):
    one = lambda c, v="1.0": f"CASE WHEN {c} THEN {v} ELSE 0 END"

    def vendor(v):
        v, words = v.lower(), [w for w in v.lower().split() if len(w) > 3]
        part = f" WHEN {' AND '.join(f'contains(low, {quote(w)})' for w in words)} THEN 0.7" if len(v) > 6 and len(words) >= 2 else ""
        return f"CASE WHEN contains(low, {quote(v)}) THEN 1.0{part} ELSE 0 END"

    def test(v):
        others = "".join(f" OR contains(low, {quote(a)})" for a in C.ALIASES.get(v.lower(), []))
        return f"CASE WHEN contains(low, {quote(v.lower())}) THEN 1.0 WHEN false{others} THEN 0.9 ELSE 0 END"

    vendors = f"least(1.0, ({' + '.join(map(vendor, t.vendors))}) / {len(t.vendors)})" if t.vendors else "0.0"
    checks = ["units", *(["ranges"] if t.ranges else []), *(["flags"] if t.flags else [])]
    header = one(f"regexp_matches(low, {quote('(?is)' + t.header)})") if t.header else "0"
    raw = f"({header} * 0.25 + {vendors} * 0.3 + {'(' + ' + '.join(map(test, t.fields)) + ')' if t.fields else '0'} / {len(t.fields) or 1} * 0.3 + ({' + '.join(checks)}) / {len(checks)} * 0.15)"
    return f"round(CASE WHEN {vendors} = 0 THEN least({raw}, 0.5) WHEN {vendors} < 0.3 THEN least({raw}, 0.65) ELSE {raw} END, 9)::DOUBLE"


_marks = lambda marks: " OR ".join(f"regexp_matches(clean, {quote('(?i)' + m)})" for m in marks)
_seen = lambda t, v, c: f"named_struct('template', '{t}', 'vendor', '{v}', 'confidence', {c}D)"
SEEN = f"CASE p_partkey % 5 WHEN 0 THEN {_seen('plated', 'W', 0.8)} WHEN 1 THEN {_seen('other', 'W', 0.9)} WHEN 2 THEN {_seen('plated', '', 0.9)} WHEN 3 THEN {_seen('plated', 'W', 0.6)} END"


@query("vendor_template", f"""WITH d AS (SELECT p_partkey, regexp_replace({FORM.replace('{text}', 'VARCHAR')}, '[\\x00-\\x1f\\x7f-\\x9f]', ' ', 'g') AS clean FROM part), s AS (SELECT *, lower(clean) AS low, CASE WHEN {_marks(C.RANGE_MARKS)} THEN 1.0 ELSE 0 END AS ranges,
        CASE WHEN regexp_matches(clean, '(^|[^A-Za-z])[HL]([^A-Za-z]|$)') OR {_marks(C.FLAG_MARKS)} THEN 1.0 ELSE 0 END AS flags, {' + '.join(f"regexp_matches(clean, {quote('(?i)' + m)})::INT" for m in C.UNIT_MARKS)} AS n FROM d),
    u AS (SELECT *, CASE WHEN n >= 3 THEN 1.0 WHEN n >= 1 THEN 0.5 ELSE 0 END AS units FROM s), b AS (SELECT p_partkey, list_max([{', '.join(f"{{'score': {_score_sql(t)}, 'o': {-i}, 'label': '{t.name}'}}" for i, t in enumerate(TEMPLATES))}]) AS b, p_partkey % 5 AS k FROM u)
    SELECT p_partkey, CASE WHEN b.score >= 0.85 OR (b.score < 0.75 AND k = 0) THEN 'use_template' ELSE 'use_medgemma' END AS decision, CASE WHEN b.score >= 0.85 THEN b.label WHEN b.score < 0.75 AND k = 0 THEN 'plated' END AS template,
    round(CASE WHEN b.score < 0.75 AND k = 0 THEN 0.8 WHEN b.score < 0.75 AND k = 1 THEN 0.9 ELSE b.score END, 6)::DOUBLE AS confidence FROM b""")
def vendor_template(spark, sf):
    """The template of a form about every part, by its text or, where that tells too little, by a look at it."""
    forms = table(spark, sf, "part").select("p_partkey", F.expr(FORM.replace("{text}", "STRING")).alias("t"), F.expr(SEEN).alias("seen"))
    m = forms.select("p_partkey", C.matched_template(F.col("t"), TEMPLATES, F.col("seen")).alias("m"))
    return m.select("p_partkey", "m.decision", "m.template", F.round("m.confidence", 6).alias("confidence"))
