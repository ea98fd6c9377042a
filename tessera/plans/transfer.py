"""Queries of spoiled drug names, texts on pages of word boxes, fields of similar documents and pathology findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import drugs as D
from tessera.operators import transfer as T
from tessera.operators.enrich import drug_lookup, facade
from tessera.plans.enrich import sound
from tessera.plans.geometry import edit_likeness
from tessera.plans.registry import query, table

KNOWN = ["atenolol", "metoprolol", "metformin", "lisinopril", "simvastatin", "sertraline", "omeprazole", "amlodipine"]
SPOILED = ["aerol", "metforrnin", "atenolo", "1isinopril", "simvaslatin", "sertrallne", "omeprazole", "qq", "xyzzyol", "arnlodipine", "tenolol"]
CLASSES = [("beta_blocker", ["olol"], []), ("ace_inhibitor", ["pril"], []), ("statin", ["statin"], []), ("ssri", [], ["sertra"]), ("ppi", ["prazole"], [])]
quoted = lambda words: ", ".join(f"'{w}'" for w in words)

ENTRIES = f"""SELECT p_partkey % 500 AS code, lower(p_name) AS text, CASE p_size % 5 WHEN 0 THEN 'IN' WHEN 1 THEN 'BN' WHEN 2 THEN 'SCD' WHEN 3 THEN 'GPCK' ELSE 'TMSY' END AS kind FROM part
    UNION ALL SELECT 1000L + length(w) * 10 + ascii(w), w, 'IN' FROM (SELECT explode(array({quoted(KNOWN)})) AS w)"""
ASKED = f"""SELECT DISTINCT w AS name, CASE length(w) % 3 WHEN 0 THEN '25 mg' WHEN 1 THEN '75 mg' END AS strength, CASE length(w) % 2 WHEN 0 THEN array('ace_inhibitor', 'ssri') END AS context
    FROM (SELECT explode(array(concat(substr(lower(p_name), 1, 2), substr(lower(p_name), 4)), replace(lower(p_name), 'o', '0'), concat('q', substr(lower(p_name), 2)), concat(substr(lower(p_name), 1, 7), 'in'))) AS w FROM part
    UNION ALL SELECT explode(array({quoted(SPOILED)})))"""
STRENGTHS = "SELECT DISTINCT p_partkey % 500 AS code, concat(CAST(p_size % 4 * 25 AS STRING), ' mg') AS strength FROM part"
duck = lambda s: s.replace("explode(", "unnest(").replace("array(", "list_value(").replace("1000L", "1000").replace("STRING", "VARCHAR")
SWAPS = ", ".join(f"('{a}', '{b}')" for a, many in D.CONFUSIONS.items() for b in many)
END = "CASE " + " ".join(f"WHEN ends_with(name, '{e}') THEN '{e}'" for e in D.ENDINGS) + " END"
CLASS = "CASE WHEN ends_with(text, 'olol') THEN 'beta_blocker' WHEN ends_with(text, 'pril') THEN 'ace_inhibitor' WHEN ends_with(text, 'statin') THEN 'statin' WHEN contains(text, 'sertra') THEN 'ssri' WHEN ends_with(text, 'prazole') THEN 'ppi' END"
STEM = lambda c: f"CASE WHEN length({c}) > length(e) THEN substr({c}, 1, length({c}) - length(e)) ELSE {c} END"
TOLERANT = f"""d AS ({duck(ENTRIES)}), n AS ({duck(ASKED)}), st AS ({duck(STRENGTHS)}),
    c AS (SELECT name, CASE WHEN length(name) <= 4 THEN 3 WHEN length(name) <= 5 THEN 4 WHEN length(name) <= 7 THEN 5 ELSE 6 END AS most, {END} AS e FROM n WHERE length(name) >= 4),
    sw AS (SELECT * FROM (VALUES {SWAPS}) AS t(a, b)), u AS (SELECT * FROM d WHERE kind IN ({quoted(D.KINDS)})),
    v AS (SELECT DISTINCT name, substr(name, 1, i - 1) || b || substr(name, i + length(a)) AS text FROM (SELECT name, unnest(range(1, length(name) + 1))::INT AS i FROM c) JOIN sw ON substr(name, i, length(a)) = a),
    g AS (SELECT name, CASE WHEN kind IN ({quoted(D.KINDS)}, 'GPCK', 'BPCK') THEN 1 ELSE 6 END AS step, code, text, kind FROM c JOIN d ON substr(text, 1, 1) = substr(name, 1, 1) AND length(text) BETWEEN greatest(3, length(name) - most) AND length(name) + most + 4
        UNION ALL SELECT name, 3, code, text, kind FROM c JOIN u ON ends_with(text, e) AND length(text) BETWEEN greatest(3, length(name) - most) AND length(name) + most + 4
        UNION ALL SELECT name, 4, code, text, kind FROM v JOIN u USING (text)
        UNION ALL SELECT name, 5, code, text, kind FROM c JOIN d ON e IN ('ol', 'olol') AND text IN ({quoted(D.BETA_BLOCKERS)})),
    o AS (SELECT name, code, arg_min({{'text': text, 'kind': kind}}, (step, text, kind)) AS x FROM g GROUP BY 1, 2),
    p AS (SELECT code, count(*) AS entries FROM d GROUP BY 1), k AS (SELECT DISTINCT code FROM st),
    s AS (SELECT o.name, o.code, x.text AS text, x.kind AS kind, most, e, levenshtein(o.name, x.text) AS distance, 1 - levenshtein(o.name, x.text) / greatest(length(o.name), length(x.text))::DOUBLE AS alike FROM o JOIN c ON o.name = c.name),
    r AS (SELECT s.name, s.code, distance, round(alike + least(entries / 10.0, 1.0)::DOUBLE * 0.15
        + CASE WHEN ends_with(text, e) THEN 0.15 + (1 - levenshtein({STEM('s.name')}, {STEM('text')}) / greatest(length({STEM('s.name')}), length({STEM('text')}), 1)::DOUBLE) * 0.1 ELSE 0 END
        + CASE WHEN {sound('s.name')} = {sound('text')} THEN 0.1 ELSE 0 END + CASE WHEN kind = 'IN' THEN 0.05 ELSE 0 END
        + CASE WHEN st.code IS NOT NULL THEN 0.4 WHEN k.code IS NOT NULL AND n.strength IS NOT NULL THEN -0.15 ELSE 0 END
        + CASE WHEN context IS NULL THEN 0 WHEN {CLASS} IN ('ace_inhibitor', 'ssri') THEN 0.15 WHEN {CLASS} IN ('beta_blocker', 'statin') THEN 0.1 WHEN {CLASS} = 'ppi' THEN 0.08 ELSE 0 END, 6)::DOUBLE AS score
        FROM s JOIN p ON s.code = p.code JOIN n ON s.name = n.name LEFT JOIN k ON s.code = k.code LEFT JOIN st ON s.code = st.code AND n.strength = st.strength WHERE distance <= most OR alike >= 0.5),
    t AS (SELECT name, code, 'ocr_corrected' AS match, distance::INTEGER AS distance, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, distance, code) AS i FROM r) WHERE i = 1)"""


def spoiled(spark, sf):
    part = table(spark, sf, "part")
    return tuple(spark.sql(q.replace("FROM part", "FROM {part}"), part=part) for q in (ASKED, ENTRIES, STRENGTHS))


@query("drug_tolerant_lookup", f"WITH {TOLERANT} SELECT * FROM t")
def drug_tolerant_lookup(spark, sf):
    names, entries, strengths = spoiled(spark, sf)
    return D.tolerant_drugs(names, entries, CLASSES, strengths)


@query("drug_lookup_facade", f"""WITH {TOLERANT}, x AS (SELECT name, min(code) AS code FROM n JOIN d ON name = text GROUP BY 1),
    q AS (SELECT name, arg_min(code, (length(text), code)) AS code FROM n JOIN d ON length(name) >= 3 AND starts_with(text, name) AND length(text) <= length(name) + 1 WHERE name NOT IN (SELECT name FROM x) GROUP BY 1),
    w AS (SELECT name, arg_min(code, (length(text), code)) AS code FROM n JOIN d ON length(name) >= 4 AND starts_with(text, name || ' ') AND kind IN ('IN', 'BN') WHERE name NOT IN (SELECT name FROM x UNION ALL SELECT name FROM q) GROUP BY 1),
    f AS (SELECT name, code, 'exact' AS match FROM x UNION ALL SELECT name, code, 'prefix' FROM q UNION ALL SELECT name, code, 'word_prefix' FROM w)
    SELECT * FROM f UNION ALL SELECT name, code, match FROM t WHERE name NOT IN (SELECT name FROM f)""")
def drug_lookup_facade(spark, sf):
    """By name, prefix and first words; what is left by the tolerant lookup."""
    names, entries, strengths = spoiled(spark, sf)
    none = F.lit(None).cast("string")
    plain = entries.select("code", F.col("text").alias("component"), none.alias("shortname"), none.alias("consumer"), none.alias("related"), "kind", F.lit(0).alias("rank"))
    return facade(names, drug_lookup(names, plain), lambda left: D.tolerant_drugs(left, entries, CLASSES, strengths))


WORDS = "SELECT l_orderkey AS page, l_linenumber AS place, CASE l_partkey % 5 WHEN 0 THEN 'Steel' WHEN 1 THEN 'bolt ' WHEN 2 THEN 'stele' WHEN 3 THEN CAST(l_linenumber AS STRING) || '.0' ELSE 'widget' END AS text FROM lineitem"
WANTED = ["STEEL", "widgets", "bolt widget", "2", "steel bolt", " "]


@query("boxes_of_text", f"""WITH w AS (SELECT page, place, trim(text) AS text FROM (SELECT *, row_number() OVER (PARTITION BY page, place ORDER BY text) AS i FROM ({duck(WORDS)})) WHERE i = 1), a AS (SELECT unnest([{quoted(WANTED[:-1])}]) AS want),
    s AS (SELECT page, want, place, text, place AS upto, 1 - levenshtein(lower(text), lower(want)) / greatest(length(text), length(want))::DOUBLE AS alike, abs(TRY_CAST(text AS DOUBLE) - TRY_CAST(want AS DOUBLE)) < 0.001 AS num FROM w, a),
    o AS (SELECT page, want, place, upto, text, CASE WHEN lower(text) = lower(want) THEN 1 WHEN alike >= 0.8 THEN 2 WHEN num THEN 4 END AS tier, CASE WHEN lower(text) = lower(want) THEN 1.0 WHEN alike >= 0.8 THEN alike * 0.9 ELSE 0.95 END AS confidence FROM s
        UNION ALL SELECT page, want, place, place + 1, text, 3, alike * 0.85 FROM (SELECT page, want, x.place, x.text || ' ' || y.text AS text, 1 - levenshtein(lower(x.text || ' ' || y.text), lower(want)) / greatest(length(x.text) + length(y.text) + 1, length(want))::DOUBLE AS alike
            FROM w x JOIN w y USING (page), a WHERE y.place = x.place + 1 AND contains(want, ' ')) WHERE alike >= 0.8)
    SELECT page, want, place, text, place::DOUBLE AS x0, upto + 0.5 AS x1, round(confidence, 6)::DOUBLE AS confidence, CASE tier WHEN 2 THEN 'fuzzy' WHEN 3 THEN 'partial' ELSE 'exact' END AS match
    FROM (SELECT *, min(tier) OVER (PARTITION BY page, want) AS least FROM o WHERE tier IS NOT NULL) WHERE tier = least""")
def boxes_of_text(spark, sf):
    """The places of six texts on every order's page of words, by edit distance."""
    at, lines = F.col("place").cast("double"), table(spark, sf, "lineitem")
    w = spark.sql(WORDS.replace("FROM lineitem", "FROM {lines}"), lines=lines).repartition("page").groupBy("page", "place").agg(F.min("text").alias("text")).withColumn("box", F.struct(at.alias("x0"), F.lit(0.0).alias("y0"), (at + 0.5).alias("x1"), F.lit(1.0).alias("y1")))
    wanted = lines.select(F.col("l_orderkey").alias("page")).distinct().withColumn("want", F.explode(F.array(*map(F.lit, WANTED))))
    got = T.boxes_of_text(w, wanted, edit_likeness)
    return got.select("page", "want", "place", "text", "box.x0", "box.x1", F.round("confidence", 6).alias("confidence"), "match")


TEXT = "CASE p_partkey % 2 WHEN 0 THEN 'Alpha count: ' || CAST(p_size AS STRING) || '.5 mg per day' ELSE 'none' END || ' Beta ' || CAST(p_partkey AS STRING) || ' kg'"


@query("fields_of_similar", """WITH m AS (SELECT p_partkey AS doc, arg_min(other, (-sim, other)) AS other, max(sim) AS sim FROM (SELECT p_partkey, p_partkey % 50 AS other, p_size % 10 / 10.0 AS sim FROM part UNION ALL SELECT p_partkey, p_partkey % 7, p_size % 4 / 4.0 FROM part) GROUP BY 1),
    f AS (SELECT doc, unnest(CASE other % 3 WHEN 0 THEN ['alpha_count', 'beta'] WHEN 1 THEN ['beta'] ELSE ['alpha_count', 'gamma'] END) AS field, sim FROM m WHERE sim >= 0.7)
    SELECT doc, field, CASE field WHEN 'beta' THEN p_partkey::DOUBLE ELSE p_size + 0.5 END::DOUBLE AS value, CASE field WHEN 'beta' THEN 'kg' ELSE 'mg' END AS unit, round(sim * 0.95, 6)::DOUBLE AS confidence FROM f JOIN part ON doc = p_partkey
    WHERE field = 'beta' OR (field = 'alpha_count' AND p_partkey % 2 = 0)""")
def fields_of_similar(spark, sf):
    p = table(spark, sf, "part")
    texts = p.select(F.col("p_partkey").alias("doc"), F.expr(TEXT).alias("text"))
    near = p.selectExpr("p_partkey AS doc", "p_partkey % 50 AS other", "p_size % 10 / 10D AS similarity").union(p.selectExpr("p_partkey AS doc", "p_partkey % 7 AS other", "p_size % 4 / 4D AS similarity"))
    fields = near.select(F.col("other").alias("doc"), F.explode(F.expr("CASE other % 3 WHEN 0 THEN array('alpha_count', 'beta') WHEN 1 THEN array('beta') ELSE array('alpha_count', 'gamma') END")).alias("field")).distinct()
    return T.fields_of_similar(texts, near, fields).withColumn("confidence", F.round("confidence", 6))


SAID = ["Stage T2 N0 M1, grade III", "Margins clear. Gleason 7", "close margin; carcinoma in  situ", "insufficient material", "Adequate for diagnosis, benign", "differentiation poor, pTis", "positive margin Nx", "nothing to say", "METASTATIC melanoma t1"]
FINDING = "CASE p_partkey % 13 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SAID)) + " END"


def _first(rules, value):
    """SQL: the value of the first rule that any finding matches, of the first such finding."""
    return "coalesce(" + ", ".join(f"arg_min({value(p, v)}, id) FILTER (regexp_matches(t, '(?i){p}'))" for p, v in rules) + ")"


@query("pathology_enriched", f"""WITH f AS (SELECT p_size % 40 + p_partkey // 300 * 100 AS doc, p_partkey AS id, coalesce({FINDING}, '') AS t FROM part), g AS (SELECT doc,
    {", ".join(f"arg_min(upper(regexp_extract(t, '(?i){p}', 1)), id) FILTER (regexp_matches(t, '(?i){p}')) AS stage_{k.lower()}" for k, p in T.STAGES.items())},
    {_first(T.GRADES, lambda p, v: f"'{v}: ' || regexp_extract(t, '(?i){p}', 1)")} AS grade, {_first(T.MARGINS, lambda p, v: f"'{v}'")} AS margin, {_first(T.ADEQUACY, lambda p, v: f"'{v}'")} AS adequacy,
    concat_ws('; ', {", ".join(f"CASE WHEN bool_or(regexp_matches(t, '(?i){p}')) THEN '{d}' END" for p, d in T.DIAGNOSES)}) AS diagnoses FROM f GROUP BY 1)
    SELECT *, concat_ws(',', CASE WHEN stage_m = '1' THEN 'metastatic_disease' END, CASE WHEN margin = 'positive' THEN 'positive_margins' END, CASE WHEN adequacy = 'inadequate' THEN 'inadequate_specimen' END,
    CASE WHEN regexp_matches(lower(diagnoses), 'malignant|carcinoma') THEN 'malignancy_detected' END) AS reasons, CASE WHEN coalesce(stage_t, stage_n, stage_m, grade) IS NULL AND diagnoses = '' THEN 0.5 ELSE 0.8 END::DOUBLE AS confidence FROM g""")
def pathology_enriched(spark, sf):
    f = table(spark, sf, "part").selectExpr("p_size % 40 + p_partkey div 300 * 100 AS doc", "p_partkey AS id", f"{FINDING} AS t")
    return T.enrich_pathology(f, "doc", "id", "t")
