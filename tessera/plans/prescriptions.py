"""Queries of prescriptions: each order's lines as a text, each line's part as a drug entry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import prescriptions as P
from tessera.functions import text as X
from tessera.plans.registry import query, table

LINES = """l AS (SELECT l_orderkey, l_linenumber, l_partkey, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, p_size AS size, l_quantity::INT AS qty FROM lineitem JOIN part ON p_partkey = l_partkey)"""
#: An entry as it may be written; both engines read the expression.
ENTRY = """CASE l_linenumber % 7 WHEN 0 THEN concat('TAB. ', upper(w2), ' ', size, 'mg Morning') WHEN 1 THEN concat(w2, ' ', size, ' mg tablets') WHEN 2 THEN concat('Cap ', w1, ' ', w2, ' ', size) WHEN 3 THEN concat(w2, ' cream') WHEN 4 THEN concat(w1, ' ', size, '/50 units')
    WHEN 5 THEN concat('INJ. ', w2, ' 10 units') ELSE concat(w2, ' after food') END"""
STRENGTH = "CASE l_linenumber % 4 WHEN 0 THEN concat(size, 'mg') WHEN 1 THEN concat(size, '/', qty) WHEN 2 THEN concat(size, ' drops') ELSE '' END"


def lines(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w1"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("w2"), F.col("p_size").alias("size"))
    return table(spark, sf, "lineitem").join(p, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "w1", "w2", "size", F.col("l_quantity").cast("int").alias("qty"))


def stripped(s: str) -> str:
    s = f"trim({s})"
    for p in P.AROUND_NAME:
        s = f"regexp_replace({s}, '(?i){p}', '')"
    return f"coalesce(nullif(trim({s}), ''), entry)"


@query("drug_names", f"WITH {LINES}, e AS (SELECT *, {ENTRY} AS entry FROM l) SELECT l_orderkey, l_linenumber, entry, {stripped('entry')} AS drug FROM e")
def drug_names(spark, sf):
    e = lines(spark, sf).withColumn("entry", F.expr(ENTRY))
    return e.select("l_orderkey", "l_linenumber", "entry", P.drug_name(F.col("entry")).alias("drug"))


@query("dosage_format", f"WITH {LINES}, e AS (SELECT *, {STRENGTH} AS s FROM l) SELECT l_orderkey, l_linenumber, regexp_matches(s, '\\d+\\s*(mg|mcg|g|ml|units?|iu)') OR regexp_matches(s, '\\d+/\\d+') OR regexp_matches(s, '\\d+\\.\\d+\\s*(mg|mcg|g|ml)') AS valid FROM e")
def dosage_format(spark, sf):
    return lines(spark, sf).select("l_orderkey", "l_linenumber", P.is_dosage(F.expr(STRENGTH)).alias("valid"))


def texts(spark, sf):
    """One text an order, a few lines an item, in the order of the items."""
    line = """CASE l_linenumber % 6 WHEN 0 THEN concat('TAB. ', upper(w2), ' ', size, '\\n1 Morning, 1 Night (After Food)\\n8 Days (Tot:', qty, ' Tab)') WHEN 1 THEN concat(w2, ' ', size, 'mg x', qty) WHEN 2 THEN concat('Rx ', w2, ' ', size, ' mg tab ', qty)
        WHEN 3 THEN concat(w2, ' Joong Cap#', qty, '\\nnote\\nSig: 1 cap 3x a day') WHEN 4 THEN 'Patient: nobody' ELSE concat(w1, ' ', w2) END"""
    g = lines(spark, sf).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.expr(line).alias("line")))).alias("l"))
    return g.select("l_orderkey", F.array_join(F.col("l.line"), "\n").alias("text"))


@query("medication_lines")
def medication_lines(spark, sf):
    """A fold over lines that look ahead has no SQL; tests compare with brute force."""
    return texts(spark, sf).select("l_orderkey", F.posexplode(P.orders(F.col("text")))).select("l_orderkey", "pos", "col.*")


HEADER = "concat('Dr. X NPI: ', lpad(cast(o_orderkey AS STRING), 10, '0'), ' DEA AB', lpad(cast(o_custkey AS STRING), 7, '0'), ' Tel (555) 123-4567\\nDOB: 1/', o_orderkey % 28 + 1, '/1980 MRN: A-', o_custkey, '\\nAllergies: ', CASE o_orderkey % 3 WHEN 0 THEN 'NKDA' WHEN 1 THEN 'nuts, dust ' ELSE 'cats' END, '\\nDate: 02/03/2024')"
HEADER_SQL = HEADER.replace("\\n", "' || chr(10) || '").replace("AS STRING", "AS VARCHAR")


@query("prescription_header", f"""WITH h AS (SELECT o_orderkey, {HEADER_SQL} AS t FROM orders) SELECT o_orderkey, regexp_extract(t, 'NPI[:\\s]*(\\d{{10}})', 1) AS npi, regexp_extract(t, 'DEA[:\\s]*([A-Z]{{2}}\\d{{7}})', 1) AS dea, '(555) 123-4567' AS phone,
    regexp_extract(t, 'DOB[:\\s]*([\\d/]+)', 1) AS dob, regexp_extract(t, 'MRN[:\\s]*([\\w-]+)', 1) AS mrn, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'nuts|dust' ELSE 'cats' END AS allergies, '02/03/2024' AS written FROM h""")
def prescription_header(spark, sf):
    h = table(spark, sf, "orders").select("o_orderkey", F.expr(HEADER).alias("t"))
    p = h.select("o_orderkey", P.prescriber(F.col("t")).alias("d"), P.patient(F.col("t")).alias("p"), P.written_on(F.col("t")).alias("written"))
    return p.select("o_orderkey", "d.*", "p.dob", "p.mrn", F.array_join("p.allergies", "|").alias("allergies"), "written")


SIGS = ["take orally bid", "inhaled twice", "apply topical q8h", "qd then bid", "give iv 3 times daily", "every 6 hours", "2 times a week", "sublingual prn", "otic drops", "one at night"]
SIG = "array(" + ", ".join(f"'{s}'" for s in SIGS) + f")[l_orderkey % {len(SIGS)}]"
SIG_SQL = "[" + ", ".join(f"'{s}'" for s in SIGS) + f"][l_orderkey % {len(SIGS)} + 1]"
ROUTES_SQL = "CASE " + " ".join(f"WHEN contains(s, '{w}') THEN '{v}'" for w, v in X.ROUTES) + " ELSE 'oral' END"
CODES_SQL = "CASE " + " ".join(f"WHEN contains(s, '{w}') THEN '{w}'" for w, _ in X.FREQUENCIES) + " END"


@query("sig_parse", f"""WITH t AS (SELECT l_orderkey, l_linenumber, {SIG_SQL} AS s FROM lineitem), f AS (SELECT *, {ROUTES_SQL} AS route, {CODES_SQL} AS code FROM t)
    SELECT l_orderkey, l_linenumber, route, code, CASE WHEN code IS NOT NULL THEN NULL WHEN regexp_matches(s, '(\\d+)\\s*times?\\s*(?:per|a|daily)') THEN 'times_per_day' WHEN regexp_matches(s, 'every\\s*(\\d+)\\s*hours?') THEN 'every_n_hours' WHEN regexp_matches(s, '(\\d+)\\s*times?\\s*(?:per|a)\\s*week') THEN 'times_per_week' END AS kind,
    CASE WHEN code IS NULL THEN TRY_CAST(nullif(regexp_extract(s, '(\\d+)\\s*(?:times|hour)', 1), '') AS INTEGER) END AS every FROM f""")
def sig_parse(spark, sf):
    s = F.expr(SIG)
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.first_contained(s, X.ROUTES, "oral").alias("route"), X.frequency(s).alias("f"))
    return t.select("l_orderkey", "l_linenumber", "route", F.col("f.code").alias("code"), F.col("f.kind").alias("kind"), F.col("f.every").alias("every"))


@query("entry_confidence", f"""WITH {LINES}, e AS (SELECT *, {STRENGTH} AS s, CASE l_partkey % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix' WHEN 2 THEN 'word_prefix' WHEN 3 THEN 'ocr_corrected' WHEN 4 THEN 'alias' END AS m, l_partkey % 5 + 1 AS d FROM l),
    b AS (SELECT *, CASE m WHEN 'exact' THEN 0.85 WHEN 'prefix' THEN 0.75 WHEN 'word_prefix' THEN 0.70 WHEN 'ocr_corrected' THEN 0.40 + 0.25 * (1 - d / 10.0) - CASE WHEN d >= 4 THEN 0.1 ELSE 0 END + CASE WHEN qty > 25 THEN 0.1 ELSE 0 END WHEN 'alias' THEN 0.65 ELSE 0.5 END AS base FROM e)
    SELECT l_orderkey, l_linenumber, round(least(1, base + CASE WHEN regexp_matches(s, 'mg|g|ml|unit|%') THEN CASE WHEN m IS NULL THEN 0.15 ELSE 0.05 END ELSE 0 END + CASE WHEN qty % 2 = 0 THEN CASE WHEN m IS NULL THEN 0.15 ELSE 0.03 END ELSE 0 END
        + CASE WHEN m IS NULL THEN 0.1 ELSE 0.02 END + CASE WHEN m IS NULL THEN 0.05 ELSE 0.02 END)::DOUBLE, 6) AS confidence FROM b""")
def entry_confidence(spark, sf):
    e = lines(spark, sf)
    m = F.element_at(F.create_map(*[F.lit(x) for pair in enumerate(["exact", "prefix", "word_prefix", "ocr_corrected", "alias"]) for x in pair]), (F.col("l_partkey") % 6).cast("int"))
    d = F.col("l_partkey") % 5 + 1
    c = P.entry_confidence(m, 1 - d / 10.0, d, F.col("qty") > 25, F.lit(False), F.expr(STRENGTH), F.when(F.col("qty") % 2 == 0, "twice daily").otherwise(""), F.lit("oral"), F.col("qty").cast("string"), F.lit("now"))
    return e.select("l_orderkey", "l_linenumber", F.round(c, 6).alias("confidence"))


@query("prescription_confidence", """SELECT o_orderkey, round(CASE WHEN n = 0 THEN 0.3 WHEN n >= 3 THEN least(1, c + 0.05) WHEN n >= 2 THEN least(1, c + 0.03) ELSE c END::DOUBLE, 2) AS confidence
    FROM (SELECT o_orderkey, count(l_orderkey) AS n, avg(CASE WHEN l_linenumber = 1 THEN 0.5 ELSE l_partkey % 64 / 64.0 END) AS c FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""")
def prescription_confidence(spark, sf):
    """Mean of an order's entries (.5 where one has none), a little more for two and three; .3 without entries."""
    line = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.avg(F.coalesce(F.when(F.col("l_linenumber") != 1, (F.col("l_partkey") % 64) / 64.0), F.lit(0.5))).alias("c"))
    o = table(spark, sf, "orders").select("o_orderkey").join(line, "o_orderkey", "left")
    c, n = F.col("c"), F.col("n")
    return o.select("o_orderkey", F.round(F.when(n >= 3, F.least(c + 0.05, F.lit(1.0))).when(n >= 2, F.least(c + 0.03, F.lit(1.0))).otherwise(F.coalesce(c, F.lit(0.3))), 2).alias("confidence"))
