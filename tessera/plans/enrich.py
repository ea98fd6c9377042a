"""Scored lookups and enrichment: parts as the dictionary, their names as they may be asked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import sound_code
from tessera.operators import enrich as E
from tessera.plans.registry import query, table

ENTRIES = """e AS (SELECT p_partkey AS code, lower(p_name) AS component, split_part(p_name, ' ', 1) || ' ' || p_brand AS shortname, CASE WHEN p_partkey % 3 = 0 THEN lower(p_name) || ' ' || lower(p_type) END AS consumer,
    lower(concat_ws('; ', p_type, split_part(p_name, ' ', 2), p_brand)) AS related, ['IN', 'BN', 'SCD', 'CHEM', 'HEM'][p_partkey % 5 + 1] AS kind, (p_size % 40)::BIGINT AS rank FROM part), k AS (SELECT *, lower(shortname) AS short, CASE WHEN rank > 0 THEN rank ELSE 999999 END AS r FROM e)"""
ASKED = """n AS (SELECT DISTINCT name FROM (SELECT unnest([n, substr(n, 1, length(n) - 1), substr(n, 1, length(n) - 2), replace(n, 'o', '0'), substr(n, 1, 2) || 'q' || substr(n, 4), split_part(n, ' ', 1), split_part(n, ' ', 2), lower(p_brand), lower(p_type), n || ' ' || lower(p_type), 'x', 'unknown thing']) AS name FROM (SELECT lower(p_name) AS n, p_brand, p_type FROM part)))"""


def entries(spark, sf):
    w = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    kinds = F.array(*map(F.lit, ["IN", "BN", "SCD", "CHEM", "HEM"]))
    consumer = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lower("p_name"), F.lit(" "), F.lower("p_type")))
    cols = [F.col("p_partkey").alias("code"), F.lower("p_name").alias("component"), F.concat(w(1), F.lit(" "), F.col("p_brand")).alias("shortname"), consumer.alias("consumer")]
    return table(spark, sf, "part").select(*cols, F.lower(F.concat_ws("; ", "p_type", w(2), "p_brand")).alias("related"), F.get(kinds, (F.col("p_partkey") % 5).cast("int")).alias("kind"), (F.col("p_size") % 40).cast("long").alias("rank"))


def asked(spark, sf):
    n = F.lower("p_name")
    part = lambda a, b: n.substr(a if isinstance(a, F.Column) else F.lit(a), b)
    forms = [n, n.substr(F.lit(1), F.length(n) - 1), n.substr(F.lit(1), F.length(n) - 2), F.replace(n, F.lit("o"), F.lit("0")), F.concat(F.substring(n, 1, 2), F.lit("q"), n.substr(F.lit(4), F.length(n))), F.split_part(n, F.lit(" "), F.lit(1)), F.split_part(n, F.lit(" "), F.lit(2)),
             F.lower("p_brand"), F.lower("p_type"), F.concat(n, F.lit(" "), F.lower("p_type")), F.lit("x"), F.lit("unknown thing")]
    return table(spark, sf, "part").select(F.explode(F.array(*forms)).alias("name")).distinct()


def top(found: str, order: str, match: str) -> str:
    return f"(SELECT name, code, {match} AS match FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY {order}, code) AS i FROM {found}) WHERE i = 1)"


EXACT = top("(SELECT name, code, r FROM n JOIN k ON (name = component OR name = short OR name = lower(consumer)) WHERE length(name) >= 2)", "r", "'exact'")
ALIAS = f"""(SELECT name, code, match FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, r, code) AS i FROM (SELECT name, code, r, CASE WHEN s THEN 'shortname_prefix' ELSE 'alias' END AS match,
    CASE WHEN s THEN 200 ELSE 0 END + CASE WHEN a > 0 THEN 100 + greatest(0, 50 - (a - 1) * 5) ELSE 0 END + CASE WHEN starts_with(component, name) THEN 50 ELSE 0 END + CASE WHEN r < 999999 THEN 1000 - least(r, 1000) ELSE 0 END AS score
    FROM (SELECT name, k.*, coalesce(list_position(string_split(related, '; '), name), 0) AS a, short = name OR starts_with(short, name || ' ') OR starts_with(short, name || '-') AS s, starts_with(short, name || ' ') OR (starts_with(short, name || '-') AND contains(related, name)) AS c FROM n, k WHERE length(name) >= 2) WHERE a > 0 OR c)) WHERE i = 1)"""
PREFIX = lambda more, order, text="component": top(f"(SELECT name, code, r, length({text}) AS len FROM n JOIN k ON starts_with({text}, name) AND length({text}) <= length(name) + {more} WHERE length(name) >= 3)", order, "'prefix'")
FIRST = lambda order, match, where="true": top(f"(SELECT name, code, r, length(component) AS len FROM n JOIN k ON starts_with(component, name || ' ') WHERE length(name) >= 4 AND {where})", order, match)


def steps(*found: str) -> str:
    """The first of several results that has a name."""
    every = " UNION ALL ".join(f"SELECT {i} AS step, * FROM {f}" for i, f in enumerate(found))
    return f"SELECT name, arg_min(code, step) AS code, arg_min(match, step) AS match FROM ({every}) GROUP BY 1"


@query("test_lookup", f"WITH {ENTRIES}, {ASKED}, o AS (SELECT name, 3::BIGINT AS code, 'override' AS match FROM n WHERE name = 'unknown thing') {steps('o', EXACT, ALIAS, PREFIX(3, 'r'), FIRST('r', chr(39) + 'word_match' + chr(39)))}")
def test_lookup(spark, sf):
    """Override, name, scored alias, prefix, first words."""
    overrides = spark.sql("SELECT 'unknown thing' AS name, 3L AS code")
    return E.test_lookup(asked(spark, sf), entries(spark, sf), overrides)


@query("drug_lookup", f"WITH {ENTRIES}, {ASKED.replace('SELECT DISTINCT name FROM', 'SELECT DISTINCT name FROM')}, m AS (SELECT * FROM n WHERE length(name) >= 3) {steps(EXACT.replace('FROM n JOIN', 'FROM m AS n JOIN'), PREFIX(1, 'len, r'), FIRST('len, r', chr(39) + 'word_prefix' + chr(39), 'kind IN (' + chr(39) + 'IN' + chr(39) + ', ' + chr(39) + 'BN' + chr(39) + ')'))}")
def drug_lookup(spark, sf):
    return E.drug_lookup(asked(spark, sf), entries(spark, sf))


def _sound(s: str) -> str:
    s = f"regexp_replace(translate(upper({s}), 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '11112222222233455600000000'), '[^0-9]', '0', 'g')"
    for d in range(7):
        s = f"regexp_replace({s}, '{d}+', '{d}', 'g')"
    return s


def sound(s: str) -> str:
    return f"rpad(upper(substr({s}, 1, 1)) || replace(substr({_sound(s)}, 2), '0', ''), 4, '0')"


NEAR = f"""(WITH c AS (SELECT name, CASE WHEN length(name) <= 4 THEN 1 WHEN length(name) <= 6 THEN 2 ELSE 3 END AS most FROM n WHERE length(name) >= 3), t AS (SELECT code, r, kind, 0 AS side, component AS text FROM k UNION ALL SELECT code, r, kind, 1, short FROM k),
    j AS (SELECT name, most, code, r, kind, side, text FROM c JOIN t ON substr(name, 1, 1) = substr(text, 1, 1) AND length(text) BETWEEN greatest(2, length(name) - most) AND length(name) + most + 2), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, code ORDER BY side) AS i FROM j) WHERE i = 1),
    s AS (SELECT name, code, r, levenshtein(name, text) AS distance, round(1 - levenshtein(name, text) / greatest(length(name), length(text))::DOUBLE + CASE WHEN r <= 100 THEN 0.2 WHEN r <= 500 THEN 0.1 ELSE 0 END + CASE WHEN {sound('name')} = {sound('text')} THEN 0.1 ELSE 0 END + CASE WHEN contains(kind, 'CHEM') THEN 0.1 ELSE 0 END, 9) AS score FROM f WHERE levenshtein(name, text) <= most)
    SELECT name, code, 'ocr_corrected' AS match, distance, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, r, code) AS i FROM s) WHERE i = 1)"""
UNIT_CLASS = [("CHEM", ["MG/DL", "MMOL/L", "MEQ/L"]), ("HEM", ["G/DL", "K/UL", "M/UL", "%"])]


@query("ocr_tolerant_lookup", f"WITH {ENTRIES}, {ASKED} SELECT name, code, distance::INTEGER AS distance, score FROM {NEAR}")
def ocr_tolerant_lookup(spark, sf):
    n = asked(spark, sf).withColumn("unit", F.lit("mg/dL"))
    return E.tolerant(n, entries(spark, sf), UNIT_CLASS).select("name", "code", "distance", "score")


def found_tests(spark, sf, names):
    e = entries(spark, sf)
    return E.facade(names, E.test_lookup(names, e), lambda left: E.tolerant(left.withColumn("unit", F.lit("mg/dL")), e, UNIT_CLASS))


FACADE = steps(EXACT, ALIAS, PREFIX(3, "r"), FIRST("r", "'word_match'"), f"(SELECT name, code, match FROM {NEAR})")


@query("lookup_facade", f"WITH {ENTRIES}, {ASKED} {FACADE}")
def lookup_facade(spark, sf):
    """The exact to word tiers, then the tolerant one."""
    return found_tests(spark, sf, asked(spark, sf))


ALIASES = [("cold", "C1"), ("widget", "C2"), ("small bolt", "C3"), ("bolt", "C4"), ("steel", "C5"), ("re", "C6"), ("cold widget", "C7")]


@query("alias_contains", "SELECT p_partkey, CASE lower(p_name) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES) + " ELSE CASE " + " ".join(f"WHEN contains(lower(p_name), '{k}') OR contains('{k}', lower(p_name)) THEN '{v}'" for k, v in ALIASES) + " END END AS code FROM part")
def alias_contains(spark, sf):
    return table(spark, sf, "part").select("p_partkey", E.contained_alias(F.lower("p_name"), ALIASES).alias("code"))


RESULTS = """q AS (SELECT l_orderkey AS doc, l_linenumber, CASE WHEN l_linenumber % 4 = 3 THEN replace(lower(p_name), 'o', '0') WHEN l_linenumber % 7 = 6 THEN 'nothing of the kind' ELSE lower(p_name) END AS name, l_quantity AS value,
    CASE WHEN l_returnflag = 'A' THEN 'H' END AS flag, CASE WHEN l_linenumber % 5 = 0 THEN 10.0 END AS low, CASE WHEN l_linenumber % 5 = 0 THEN 40.0 END AS high FROM lineitem JOIN part ON p_partkey = l_partkey), n AS (SELECT DISTINCT name FROM q)"""


def results(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    n, k = F.lower("p_name"), F.col("l_linenumber")
    name = F.when(k % 4 == 3, F.replace(n, F.lit("o"), F.lit("0"))).when(k % 7 == 6, "nothing of the kind").otherwise(n)
    told = k % 5 == 0
    return j.select(F.col("l_orderkey").alias("doc"), "l_linenumber", name.alias("name"), F.col("l_quantity").alias("value"), F.when(F.col("l_returnflag") == "A", "H").alias("flag"), F.when(told, 10.0).alias("low"), F.when(told, 40.0).alias("high"))


def enriched(spark, sf):
    r, p = results(spark, sf), table(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.col("p_size").cast("double").alias("size"))
    codes = found_tests(spark, sf, r.select("name").distinct())
    ranges = p.where("code % 4 <> 0").select("code", F.col("size").alias("low"), (F.col("size") + 20).alias("high"))
    critical = p.where("code % 2 = 0").select("code", F.lit(3.0).alias("below"), F.lit(48.0).alias("above"))
    return E.enrich_tests(r, codes, ranges, critical)


ENRICHED = f"""{ENTRIES}, {RESULTS}, found AS ({FACADE}), x AS (SELECT q.*, found.code, match, CASE WHEN match IS NULL THEN 'unverified' WHEN match = 'ocr_corrected' THEN 'ocr_corrected' ELSE 'verified' END AS status, low IS NULL AND p_partkey IS NOT NULL AND found.code % 4 <> 0 AS added, p_size FROM q LEFT JOIN found USING (name) LEFT JOIN part ON p_partkey = found.code),
    y AS (SELECT * REPLACE (CASE WHEN added THEN p_size ELSE low END AS low, CASE WHEN added THEN p_size + 20 ELSE high END AS high) FROM x), z AS (SELECT *, CASE WHEN value < low THEN 'L' WHEN value > high THEN 'H' END AS told FROM y)"""


@query("lab_enrichment", f"""WITH {ENRICHED} SELECT doc, l_linenumber, code, status, added AS range_added, coalesce(flag, CASE WHEN code IS NOT NULL THEN told END) AS flag, flag IS NULL AND code IS NOT NULL AND told IS NOT NULL AS flag_added, coalesce(code % 2 = 0 AND (value < 3 OR value > 48), false) AS is_critical FROM z""")
def lab_enrichment(spark, sf):
    return enriched(spark, sf).select("doc", "l_linenumber", "code", "status", F.coalesce("range_added", F.lit(False)).alias("range_added"), "flag", "flag_added", "is_critical")


@query("enrichment_summary", f"""WITH {ENRICHED} SELECT doc, count_if(status = 'verified') AS verified, count_if(status = 'ocr_corrected') AS ocr_corrected, count_if(status = 'unverified') AS unverified, 0::BIGINT AS strength_mismatch, count_if(status <> 'unverified') / count(*)::DOUBLE AS confidence FROM z GROUP BY 1""")
def enrichment_summary(spark, sf):
    return E.summary(enriched(spark, sf))


@query("prescription_enrichment", """WITH d AS (SELECT l_orderkey AS doc, l_linenumber, CASE WHEN l_linenumber % 7 = 6 THEN 'nothing' ELSE lower(p_name) END AS name, CASE l_linenumber % 3 WHEN 0 THEN p_size WHEN 1 THEN 999 END AS strength FROM lineitem JOIN part ON p_partkey = l_partkey),
    c AS (SELECT lower(p_name) AS name, min(p_partkey) AS code FROM part GROUP BY 1), s AS (SELECT DISTINCT c.code, p_size AS strength FROM part JOIN c ON c.name = lower(p_name) WHERE c.code % 2 = 0), t AS (SELECT doc, list_sort(list_distinct(list(name))) AS names FROM d GROUP BY 1)
    SELECT d.doc, d.l_linenumber, c.code, CASE WHEN c.code IS NULL THEN 'unverified' WHEN d.strength IS NOT NULL AND c.code IN (SELECT code FROM s) AND s.code IS NULL THEN 'strength_mismatch' ELSE 'verified' END AS status, array_to_string(list_filter(names, lambda x: x <> d.name), ',') AS others
    FROM d JOIN t USING (doc) LEFT JOIN c ON c.name = d.name LEFT JOIN s ON s.code = c.code AND s.strength = d.strength""")
def prescription_enrichment(spark, sf):
    part = table(spark, sf, "part")
    j = table(spark, sf, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    k = F.col("l_linenumber")
    d = j.select(F.struct("l_orderkey", "l_linenumber").alias("line"), F.col("l_orderkey").alias("doc"), F.when(k % 7 == 6, "nothing").otherwise(F.lower("p_name")).alias("name"), F.when(k % 3 == 0, F.col("p_size")).when(k % 3 == 1, 999).alias("strength"))
    c = part.groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("code")).select("name", "code", F.lit("exact").alias("match"), F.lit(None).cast("string").alias("class"))
    s = part.select(F.lower("p_name").alias("name"), F.col("p_size").alias("strength")).join(c, "name").where("code % 2 = 0").select("code", "strength").distinct()
    e = E.enrich_drugs(d, c, s, keep=("line",))
    return e.select("doc", "line.l_linenumber", "code", "status", F.array_join("others", ",").alias("others"))


@query("sound_codes", f"SELECT p_partkey, {sound('split_part(p_name, chr(32), 1)')} AS code FROM part")
def sound_codes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", sound_code(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("code"))
