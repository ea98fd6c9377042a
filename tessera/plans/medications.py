"""Queries of likely drugs, of a dictionary by region and of warnings on prescriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import lookup as L
from tessera.operators import medications as M
from tessera.operators import strengths as G
from tessera.plans.registry import query, table
from tessera.sources.shared import written

quoted = lambda words: ", ".join(f"'{w}'" for w in words)
_any = lambda c, words: " OR ".join(f"contains({c}, '{w}')" for w in words)
# Names in part's own words, spoiled and dressed as prescriptions write them, and the words of all texts.
NAMED = """SELECT DISTINCT concat(element_at(array('TAB. ', '', 'inj '), CAST(p_partkey % 3 + 1 AS INT)), p_name, element_at(array(' 10 mg tablets', ' 250mg', '', ' 1 morning', 'in', ' for patients who take it'), CAST(p_size % 6 + 1 AS INT))) AS name FROM {part}
    UNION SELECT DISTINCT element_at(array('Patient', '12345', 'Dr.', 'Advair Diskus', 'the day', 'ABC 12', 'xy', 'Zzz', 'two words', 'Ibuprofen'), CAST(p_partkey % 10 + 1 AS INT)) FROM {part} UNION SELECT DISTINCT word FROM {words} WHERE word <> ''"""
_duck_named = NAMED.replace("array(", "list_value(").replace("element_at(", "list_extract(").format(part="part", words="(SELECT unnest(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+')) AS word FROM documents)")
_bare = r"regexp_replace(lower(trim(name)), '[^\pL\pN\p{Mn}_\s-]', '', 'g')"
_strip = "name"
for _p in [r"^(TAB|CAP|CAPS|INJ|SYR|SUSP|OINT|GEL|DRP|DROPS|CR|LOT|LOTION|INHALER|PATCH|SUPP)\.?\s+", r"\s+\d*\s*(morning|evening|night|bedtime|afternoon|before\s+food|after\s+food|empty\s+stomach|sos|stat|prn)$",
           r"\s+\d+(\.\d+)?\s*(mg|mcg|g|ml|units?|%|/\d+).*$", r"\s+\d+(\.\d+)?$", r"\s+(tablet|capsule|cap|tab|pill|cream|ointment|gel|solution|suspension|syrup|injection|patch|inhaler|spray|drops|suppository|liquid|powder)s?$"]:
    _strip = f"regexp_replace({_strip}, '(?i){_p}', '')"


@query("likely_drugs", rf"""WITH n AS ({_duck_named}), b AS (SELECT name, {_bare} AS bare, list_filter(regexp_split_to_array(lower(trim(name)), '\s+'), lambda w: w <> '') AS words FROM n),
    d AS (SELECT lower(p_name) AS entry, min(p_partkey) AS code FROM part WHERE p_size % 3 > 0 GROUP BY 1), c AS (SELECT *, length(name) < 3 OR length(name) > 50 OR regexp_matches(bare, '(?i){"|".join(M.NEVER)}') AS veto,
        regexp_matches(bare, '({"|".join(M.ENDINGS)})$') OR {_any('bare', M.COMMON)} OR {_any('bare', M.FORMS)} OR (regexp_matches(name, '^[a-zA-Z][a-zA-Z0-9\s-]{{2,30}}$') AND len(list_filter(words, lambda w: w NOT IN ({quoted(M.PLAIN)}))) > 0 AND (len(words) = 1 OR regexp_matches(name, '[0-9]'))) AS look FROM b),
    r AS (SELECT c.*, coalesce(x.code, y.code) AS code FROM c LEFT JOIN d x ON NOT veto AND x.entry = lower(trim(coalesce(nullif(trim({_strip}), ''), name))) LEFT JOIN d y ON NOT veto AND y.entry = lower(trim(name)))
    SELECT name, NOT veto AND (code IS NOT NULL OR look) AS valid, code, CASE WHEN veto THEN 'veto' WHEN code IS NOT NULL THEN 'dictionary' WHEN look THEN 'look' ELSE 'nothing' END AS told_by FROM r""")
def likely_drugs(spark, sf):
    """Part names as prescriptions write them, and every word of the texts, against two thirds of the part names."""
    p = table(spark, sf, "part")
    words = table(spark, sf, "documents").select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word"))
    entries = p.where("p_size % 3 > 0").select(F.lower("p_name").alias("entry"), F.col("p_partkey").alias("code"), F.lit(0).alias("rank"))
    return M.likely_drugs(spark.sql(NAMED, part=p, words=words), lambda n: L.exact(n, entries))


REGION = "CASE p_size % 5 WHEN 0 THEN ' USA' WHEN 1 THEN 'canada' WHEN 2 THEN 'India ' WHEN 3 THEN 'mars' END"


@query("drugs_by_region", f"""WITH d AS (SELECT lower(p_name) AS entry, CASE p_partkey % 3 WHEN 0 THEN 'usa' WHEN 1 THEN 'canada' ELSE 'india' END AS region, min(p_partkey) AS code FROM part GROUP BY 1, 2),
    a AS (SELECT DISTINCT p_name AS name, CASE WHEN lower(trim(r)) IN ('usa', 'canada', 'india') THEN lower(trim(r)) ELSE 'usa' END AS region FROM (SELECT p_name, {REGION} AS r FROM part)) SELECT name, a.region, code FROM a LEFT JOIN d ON entry = lower(name) AND d.region = a.region""")
def drugs_by_region(spark, sf):
    """Every part name in the dictionary of its region; the dictionary lies in folders by region."""
    p = table(spark, sf, "part")
    dictionary = written(p.select(F.col("p_name").alias("entry"), F.col("p_partkey").alias("code"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'usa' WHEN 1 THEN 'canada' ELSE 'india' END AS region")), "dictionary", "region")
    rows = p.select(F.col("p_name").alias("name"), M.region_of(F.expr(REGION)).alias("region")).distinct()
    return M.found_in_region(rows, dictionary).select("name", "region", "code")


# Every order is a prescription: its lines are drugs, named by their part, with fields left out, schedules, classes in a tree and allergies by the customer.
DRUGS = """l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS place, CASE l_partkey % 12 WHEN 0 THEN 'Oxycodone' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE concat('drug', CAST(l_partkey % 12 AS {text})) END AS name,
    CASE WHEN l_suppkey % 4 > 0 THEN l_partkey % 12 END AS code, CASE WHEN l_suppkey % 7 > 0 THEN concat(CAST(l_suppkey % 3 AS {text}), ' mg') END AS strength, 'oral' AS route, CASE WHEN l_tax > 0.01 THEN 'daily' ELSE '' END AS frequency,
    CASE WHEN l_quantity > 45 THEN 'many' ELSE CAST(CAST(l_quantity * 3 AS INT) AS {text}) END AS quantity, CAST(l_linenumber + 1 AS {text}) AS refills"""
ALLERGY = "CASE o_custkey % 6 WHEN 0 THEN ' Opioid' WHEN 1 THEN 'drug5' WHEN 2 THEN 'Root' WHEN 3 THEN 'leaf2' WHEN 4 THEN 'nothing' END"
SCHEDULE = "CASE code WHEN 3 THEN 'Schedule II' WHEN 4 THEN 'Schedule III' WHEN 5 THEN 'Schedule IV' WHEN 6 THEN 'Schedule VI' END"
CLASS_OF = "CASE WHEN code IN (3, 4) THEN 'leaf1' WHEN code IN (5, 6, 7) THEN 'leaf2' WHEN code = 0 THEN 'opioid' ELSE '' END"
PARENTS = [("leaf1", "branch"), ("leaf2", "branch"), ("branch", "root"), ("root", "top"), ("top", "branch"), ("opioid", "analgesic")]
INTERACT = [("drug3", "oxycodone"), ("drug4", "drug9"), ("drug10", "drug3")]
_sched = SCHEDULE.replace("code", "d.code")
_controlled = f"CASE WHEN code IS NOT NULL AND code < 11 THEN coalesce({SCHEDULE} IN ({quoted(M.SCHEDULES)}), false) ELSE {_any('low', M.CONTROLLED)} END"
_ISSUES = f"""d AS (SELECT doc, place, coalesce(name, '') AS name, lower(coalesce(name, '')) AS low, code, strength, route, frequency, TRY_CAST(quantity AS INTEGER) AS quantity, TRY_CAST(refills AS INTEGER) AS refills FROM (SELECT {DRUGS.format(text='VARCHAR')} FROM lineitem)),
    u AS (SELECT doc, o_orderkey % 3 > 0 AS licence, lower(trim({ALLERGY})) AS allergy FROM (SELECT o_orderkey AS doc, * FROM orders)),
    up AS (SELECT unnest([{quoted(a for a, _ in PARENTS)}]) AS class, unnest([{quoted(b for _, b in PARENTS)}]) AS parent), ia AS (SELECT unnest([{quoted(a for a, _ in INTERACT)}]) AS a, unnest([{quoted(b for _, b in INTERACT)}]) AS b),
    n AS (SELECT doc, low, min(place) AS place, count(*) AS n FROM d WHERE low <> '' GROUP BY 1, 2), k AS (SELECT *, CASE WHEN code < 11 THEN {CLASS_OF} ELSE '' END AS class FROM d),
    f AS (SELECT doc, class, arg_min(name, (place, name)) AS first, min(place) AS fp FROM k WHERE class <> '' GROUP BY 1, 2), v AS (SELECT d.*, coalesce(u.licence, false) AS licence, coalesce({_sched.replace('d.code', 'CASE WHEN d.code < 11 THEN d.code END')}, '') AS schedule FROM d LEFT JOIN u USING (doc) WHERE {_controlled}),
    i AS (SELECT doc, 'error' AS kind, place, 'Medication ' || place || ': Missing ' || m AS text FROM (SELECT doc, place, unnest([CASE WHEN name = '' THEN 'medication_name' END, CASE WHEN coalesce(strength, '') = '' THEN 'strength/dosage' END, CASE WHEN coalesce(frequency, '') = '' THEN 'frequency' END]) AS m FROM d) WHERE m IS NOT NULL
        UNION ALL SELECT doc, 'warning', place, 'Medication ' || place || ': ' || CASE WHEN low = 'drug8' THEN 'too much' ELSE 'Dosage concern' END FROM d WHERE low IN ('drug8', 'drug9') AND strength = '2 mg'
        UNION ALL SELECT doc, 'warning', place, 'Medication ' || place || ': Controlled substance prescribed without DEA number' FROM v WHERE NOT licence
        UNION ALL SELECT doc, 'warning', place, 'Medication ' || place || ': Controlled substance quantity (' || quantity || ') exceeds typical 90-day supply' FROM v WHERE quantity > 90
        UNION ALL SELECT doc, 'warning', place, 'Medication ' || place || ': ' || CASE WHEN schedule = 'Schedule II' THEN 'Schedule II controlled substance cannot have refills' ELSE schedule || ' controlled substance cannot exceed 5 refills' END FROM v WHERE (schedule = 'Schedule II' AND refills > 0) OR (schedule IN ('Schedule III', 'Schedule IV') AND refills > 5)
        UNION ALL SELECT x.doc, 'warning', x.place, 'Drug interaction: ' || a || ' with ' || b FROM n x JOIN ia ON x.low = a JOIN n y ON y.doc = x.doc AND y.low = b
        UNION ALL SELECT doc, 'warning', place, 'Potential duplicate therapy: Duplicate prescription: ' || low FROM (SELECT doc, place, low, unnest(range(1, n)) FROM n WHERE n > 1)
        UNION ALL SELECT k.doc, 'warning', k.place, 'Potential duplicate therapy: Multiple drugs in same class (' || k.class || '): ' || first || ' and ' || name FROM k JOIN f ON k.doc = f.doc AND k.class = f.class WHERE k.place > fp
        UNION ALL SELECT DISTINCT d.doc, 'error', place, 'Allergy conflict: ' || name || ' and ' || allergy FROM d JOIN u USING (doc) WHERE low <> '' AND (low = allergy OR (allergy = 'opioid' AND low = 'oxycodone') OR (allergy = 'leaf2' AND low IN ('drug5', 'drug6', 'drug7')) OR (allergy = 'root' AND low IN ('drug3', 'drug4', 'drug5', 'drug6', 'drug7'))))"""


def issues(spark, sf):
    o, text = table(spark, sf, "orders"), lambda rows, schema: spark.createDataFrame(rows, schema)
    drugs = spark.sql(f"SELECT {DRUGS.format(text='STRING')} FROM {{lines}}", lines=table(spark, sf, "lineitem"))
    codes = table(spark, sf, "part").selectExpr("p_partkey % 11 AS code").distinct()
    facts = codes.selectExpr("code", f"{SCHEDULE} AS schedule", f"{CLASS_OF} AS class")
    classes = facts.where("class <> ''").selectExpr("CASE code WHEN 0 THEN 'Oxycodone' ELSE concat('drug', CAST(code AS STRING)) END AS name", "class")
    meets = text([(a, b, f"{a} with {b}") for a, b in INTERACT], "a string, b string, text string")
    unsafe = text([("Drug8", "2 mg", "too much"), ("drug9", "2 mg", None)], "name string, strength string, reason string")
    who = o.selectExpr("o_orderkey AS doc", "CASE WHEN o_orderkey % 3 > 0 THEN 'AB1' END AS licence")
    return M.prescription_issues(drugs, who, facts, classes, text(PARENTS, "class string, parent string"), meets, unsafe, o.selectExpr("o_orderkey AS doc", f"{ALLERGY} AS allergy").where("allergy is not null"))


@query("prescription_issues", f"WITH {_ISSUES} SELECT * FROM i")
def prescription_issues(spark, sf):
    """Errors and warnings of every order read as a prescription."""
    return issues(spark, sf)


@query("prescriptions_judged", f"WITH {_ISSUES} SELECT o_orderkey AS doc, coalesce(e, 0) = 0 AS is_valid, coalesce(e, 0) AS n_errors, coalesce(w, 0) AS n_warnings FROM orders LEFT JOIN (SELECT doc, count_if(kind = 'error') AS e, count_if(kind = 'warning') AS w FROM i GROUP BY 1) ON doc = o_orderkey")
def prescriptions_judged(spark, sf):
    return M.prescriptions_judged(table(spark, sf, "orders").selectExpr("o_orderkey AS doc"), issues(spark, sf))


# What is asked of each part: its own size as a strength, spoiled in some ways; the names of the dictionary carry strengths, some codes have a list.
_SAID = "concat(CASE p_partkey % 5 WHEN 0 THEN 'Z' ELSE '' END, CAST(p_size % 30 AS {text}), CASE p_partkey % 6 WHEN 0 THEN ' MG' WHEN 1 THEN 'mg' WHEN 2 THEN ' my' WHEN 3 THEN ' mcg' WHEN 4 THEN '' ELSE ' MG x' END)"
_TEXT = "concat(p_name, ' ', CAST(p_size % 12 AS {text}), CASE WHEN p_partkey % 2 = 0 THEN ' MG' ELSE ' mcg' END, ' tablet')"
_KIND = "CASE p_size % 3 WHEN 0 THEN 'SCD' WHEN 1 THEN 'SBD' ELSE 'IN' END"
_read = r"""regexp_replace(regexp_replace(trim(CASE WHEN g.n <> '' THEN replace(replace(replace(replace(replace(g.n, 'Z', '2'), 'O', '0'), 'L', '1'), 'I', '1'), 'S', '5') || ' ' || CASE WHEN g.u = 'MY' THEN 'MG' ELSE g.u END || g.r ELSE up END), '\s+', ' ', 'g'), '(\d+)(MG|MCG|G|ML|%)', '\1 \2', 'g')"""


@query("strengths_validated", rf"""WITH e AS (SELECT p_partkey % 400 AS code, {_TEXT.format(text='VARCHAR')} AS text, {_KIND} AS kind FROM part), o AS (SELECT DISTINCT p_partkey % 400 AS code, (p_size % 20) || ' MG' AS strength, p_size % 20 AS number FROM part WHERE p_partkey % 400 < 150),
    b AS (SELECT code, split_part(min(lower(text)), ' ', 1) AS word FROM e WHERE code NOT IN (SELECT code FROM o) GROUP BY 1), n AS (SELECT DISTINCT split_part(lower(text), ' ', 1) AS word, regexp_extract(text, '(?i)(\d+(?:\.\d+)?)\s*(MG|MCG|G|ML|%)', 1) AS n, upper(regexp_extract(text, '(?i)(\d+(?:\.\d+)?)\s*(MG|MCG|G|ML|%)', 2)) AS unit FROM e WHERE kind IN ('SCD', 'SBD')),
    k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY number, strength) AS place FROM (SELECT code, strength, number::DOUBLE AS number FROM o UNION ALL SELECT DISTINCT code, n || ' ' || unit, n::DOUBLE FROM b JOIN n USING (word))),
    a AS (SELECT DISTINCT p_partkey % 400 AS code, {_SAID.format(text='VARCHAR')} AS strength FROM part), s AS (SELECT *, {_read} AS said FROM (SELECT *, upper(trim(strength)) AS up, regexp_extract(upper(trim(strength)), '^([A-Z\d.]+)\s*(MG|MY|MCG|G|ML|%|UNIT|UNITS)?(.*)$', ['n', 'u', 'r']) AS g FROM a)),
    m AS (SELECT s.code, s.strength, place, CASE WHEN said = k.strength THEN 0.2 WHEN TRY_CAST(regexp_extract(said, '([\d.]+)', 1) AS DOUBLE) = TRY_CAST(regexp_extract(k.strength, '([\d.]+)', 1) AS DOUBLE) THEN CASE WHEN (contains(said, 'MG') AND contains(k.strength, 'MG')) OR (contains(said, 'MCG') AND contains(k.strength, 'MCG')) THEN 0.18 ELSE 0.1 END END::DOUBLE AS boost FROM s JOIN k ON s.code = k.code),
    h AS (SELECT code, strength, arg_min(boost, place) AS boost FROM m WHERE boost IS NOT NULL GROUP BY 1, 2) SELECT code, strength, boost IS NOT NULL AS valid, coalesce(boost, 0)::DOUBLE AS boost FROM a LEFT JOIN h USING (code, strength)""")
def strengths_validated(spark, sf):
    """Whether the strengths asked for are ones that their codes are made in."""
    p = table(spark, sf, "part")
    entries = p.selectExpr("p_partkey % 400 AS code", f"{_TEXT.format(text='STRING')} AS text", f"{_KIND} AS kind")
    dosages = p.where("p_partkey % 400 < 150").selectExpr("p_partkey % 400 AS code", "concat(CAST(p_size % 20 AS STRING), ' MG') AS strength")
    return G.validated_strengths(p.selectExpr("p_partkey % 400 AS code", f"{_SAID.format(text='STRING')} AS strength"), G.known_strengths(dosages, entries))
