"""Text queries: parsing of cells made from lines, features over documents, conversations and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.plans.registry import query, table

CELLS = ["7.2", "<5", "> 60 mL", "14.2 H", "150 High", "3.1 L", "10E3/uL", "mg/dL", "/hpf", "abc", "1O2", "12 *", "CRITICAL 9", "4.5-11.0", "0.5 – 1.2", ">=60", "< 5.0", "negative", "see note", "", "1O0-2OO", "S5.5", "12.B4", "1B5", "12345678901", "7 HH", "1.2.3"]
# A cell of a results table for every line: a form by its part, with the line's own quantity and number in it. Quantities go to the nearest whole number, halves to the even one, as SQL's cast has it; Spark's cuts them off.
CELL = f"replace(replace(CASE l_partkey % {len(CELLS)} {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CELLS))} END, '5', CAST(CAST({{quantity}} AS INT) AS {{text}})), '7', CAST(l_linenumber AS {{text}}))"
_CELLS = f"(SELECT l_orderkey * 10 + l_linenumber AS id, {CELL.format(text='VARCHAR', quantity='l_quantity')} AS cell FROM lineitem) t"


def cells(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.expr(CELL.format(text="STRING", quantity="rint(l_quantity)")).alias("cell"))


SQL_NUMBER = """CASE WHEN s = '' OR regexp_matches(s, '(?i)^x?10E\\d') OR regexp_matches(s, '^[a-zA-Z]+/[a-zA-Z]+') OR regexp_matches(s, '^/[a-zA-Z]+') OR regexp_matches(s, '(?i)^\\d*E\\d+/') THEN NULL
    ELSE coalesce(TRY_CAST(nullif(regexp_extract(s, '^[<>]?\\s*([\\d.]+)', 1), '') AS DOUBLE), CASE WHEN regexp_matches(s, '(?i)E\\d+/') OR length(regexp_replace(s, '[^\\d.\\-+]', '', 'g')) > 10 THEN NULL ELSE TRY_CAST(regexp_replace(s, '[^\\d.\\-+]', '', 'g') AS DOUBLE) END) END"""


@query("parse_numeric", f"SELECT id, {SQL_NUMBER} AS v FROM (SELECT id, trim(cell) AS s FROM {_CELLS})")
def parse_numeric(spark, sf):
    return cells(spark, sf).select("id", X.parse_numeric(F.col("cell")).alias("v"))


@query("parse_range", f"""WITH t AS (SELECT id, trim(cell) AS s FROM {_CELLS})
    SELECT id, CASE WHEN regexp_matches(s, '(\\d+\\.?\\d*)\\s*[-–—]\\s*(\\d+\\.?\\d*)') THEN regexp_extract(s, '(\\d+\\.?\\d*)\\s*[-–—]\\s*(\\d+\\.?\\d*)', 1)::DOUBLE WHEN regexp_matches(s, '^[>≥]\\s*=?\\s*\\d') THEN regexp_extract(s, '^[>≥]\\s*=?\\s*(\\d+\\.?\\d*)', 1)::DOUBLE WHEN regexp_matches(s, '^[<≤]\\s*=?\\s*\\d') THEN 0 END AS low,
           CASE WHEN regexp_matches(s, '(\\d+\\.?\\d*)\\s*[-–—]\\s*(\\d+\\.?\\d*)') THEN regexp_extract(s, '(\\d+\\.?\\d*)\\s*[-–—]\\s*(\\d+\\.?\\d*)', 2)::DOUBLE WHEN regexp_matches(s, '^[>≥]\\s*=?\\s*\\d') THEN 'inf'::DOUBLE WHEN regexp_matches(s, '^[<≤]\\s*=?\\s*\\d') THEN regexp_extract(s, '^[<≤]\\s*=?\\s*(\\d+\\.?\\d*)', 1)::DOUBLE END AS high
    FROM t WHERE NOT regexp_matches(s, '(?i)^(negative|see .*)$')""")
def parse_range(spark, sf):
    r = cells(spark, sf).where("NOT cell rlike '(?i)^(negative|see .*)$'").select("id", X.parse_range(F.col("cell")).alias("r"))
    return r.select("id", F.col("r.low").alias("low"), F.col("r.high").alias("high"))


@query("value_flag", f"""WITH t AS (SELECT id, trim(cell) AS s FROM {_CELLS}) SELECT id, CASE WHEN regexp_matches(s, '(?i)\\bHigh\\b') THEN 'H' WHEN regexp_matches(s, '(?i)\\bLow\\b') THEN 'L' WHEN regexp_matches(s, '(?i)\\bHH\\b') THEN 'HH'
    WHEN regexp_matches(s, '(?i)\\bLL\\b') THEN 'LL' WHEN regexp_matches(s, '(?i)\\bH\\b') THEN 'H' WHEN regexp_matches(s, '(?i)\\bL\\b') THEN 'L' WHEN regexp_matches(s, '(?i)\\bCRITICAL\\b') THEN 'CRITICAL' WHEN regexp_matches(s, '\\*+$') THEN '*' END AS flag FROM t""")
def value_flag(spark, sf):
    return cells(spark, sf).select("id", X.value_flag(F.col("cell")).alias("flag"))


@query("lab_value")
def lab_value(spark, sf):
    """Value, unit and flag of a cell; rows only (tests compare with expected values)."""
    return cells(spark, sf).select("id", X.flagged_value(F.col("cell")).alias("value"), X.value_unit(F.col("cell")).alias("unit"), X.value_flag(F.col("cell")).alias("flag"), X.repair_value(F.col("cell")).alias("repaired"), X.is_numeric(F.col("cell")).alias("numeric"))


@query("normalise_names", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type), '[/:,\\-\\(\\)]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM part")
def normalise_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.normalise_name(F.col("p_type")).alias("name"))


@query("ref_soundex")
def ref_soundex(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.sound_code(F.regexp_extract("p_name", "^[A-Za-z]+", 0)).alias("code"))


@query("scanner_variants")
def scanner_variants(spark, sf):
    v = X.scanner_variants(F.lower("p_name"))
    return table(spark, sf, "part").select("p_partkey", F.explode(v).alias("variant"))


ORDERED = "l_quantity::INT || ' mg ' || CASE l_linenumber % 4 WHEN 0 THEN 'po bid' WHEN 1 THEN 'iv tid' WHEN 2 THEN 'topical prn' ELSE 'qid' END || ' qty: ' || (l_linenumber * 10) || ' refills 2'"


@query("dosage_parse", f"""SELECT l_orderkey, l_linenumber, l_quantity::INT::DOUBLE AS dose, 'mg' AS unit, CASE WHEN l_linenumber % 4 IN (0, 3) THEN 'oral' WHEN l_linenumber % 4 = 1 THEN 'intravenous' ELSE 'topical' END AS route,
    CASE l_linenumber % 4 WHEN 0 THEN 'twice daily' WHEN 1 THEN 'three times daily' WHEN 2 THEN 'as needed' ELSE 'four times daily' END AS frequency, (l_linenumber * 10)::INT AS quantity, 2 AS refills FROM lineitem""")
def dosage_parse(spark, sf):
    line = F.expr("concat(cast(cast(l_quantity as int) as string), ' mg ', case l_linenumber % 4 when 0 then 'po bid' when 1 then 'iv tid' when 2 then 'topical prn' else 'qid' end, ' qty: ', cast(l_linenumber * 10 as string), ' refills 2')")
    t = table(spark, sf, "lineitem").withColumn("t", line).withColumn("d", X.dosage(F.col("t")))
    return t.select("l_orderkey", "l_linenumber", F.col("d.value").alias("dose"), F.col("d.unit").alias("unit"), X.first_contained(F.col("t"), X.ROUTES, "oral").alias("route"), X.first_contained(F.col("t"), X.FREQUENCIES, None).alias("frequency"), X.quantity(F.col("t")).alias("quantity"), X.refills(F.col("t")).alias("refills"))


@query("numeric_density", "SELECT doc_id, round(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(regexp_replace(text, '[ \\t\\n\\r]', '', 'g')), 1), 6) AS density FROM documents")
def numeric_density(spark, sf):
    digits, signs = F.length(F.regexp_replace("text", "[^0-9]", "")), F.length(F.regexp_replace("text", "[ \\t\\n\\r]", ""))
    return table(spark, sf, "documents").select("doc_id", F.round(digits / F.greatest(signs, F.lit(1)), 6).alias("density"))


@query("universal_patterns", "SELECT doc_id, nullif(regexp_extract(text, '([0-9A-Za-z_.-]+@[0-9A-Za-z_.-]+\\.[0-9A-Za-z_]+)', 1), '') AS email, nullif(regexp_extract(text, '\\b(\\d{3}[\\s.-]?\\d{3}[\\s.-]?\\d{4})\\b', 1), '') AS phone FROM documents")
def universal_patterns(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.universal_patterns(F.col("text")).alias("u"))
    return d.select("doc_id", F.col("u.email").alias("email"), F.col("u.phone").alias("phone"))


@query("raw_kv_fields", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    k AS (SELECT doc_id, n, trim(regexp_extract(trim(line), '^([^:]+?)\\s*:\\s*(.+)$', 1)) AS label, trim(regexp_extract(trim(line), '^([^:]+?)\\s*:\\s*(.+)$', 2)) AS value FROM l WHERE length(trim(line)) >= 5 AND regexp_matches(trim(line), '^([^:]+?)\\s*:\\s*(.+)$')),
    f AS (SELECT *, trim(regexp_replace(regexp_replace(replace(replace(lower(label), ' ', '_'), '-', '_'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_') AS field FROM k WHERE length(label) <= 50 AND length(value) >= 2)
    SELECT doc_id, field, arg_min(value, n) AS value FROM f WHERE length(field) >= 2 AND lower(value) NOT IN ('n/a', 'na') GROUP BY 1, 2""")
def raw_kv_fields(spark, sf):
    """label: value lines; the first of a label wins."""
    p = r"^([^:]+?)\s*:\s*(.+)$"
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    k = lines.where((F.length("line") >= 5) & F.col("line").rlike(p)).select("doc_id", "n", F.trim(F.regexp_extract("line", p, 1)).alias("label"), F.trim(F.regexp_extract("line", p, 2)).alias("value"))
    f = k.where((F.length("label") <= 50) & (F.length("value") >= 2)).withColumn("field", X.field_key(F.col("label")))
    return f.where((F.length("field") >= 2) & ~F.lower("value").isin("n/a", "na")).groupBy("doc_id", "field").agg(F.min_by("value", "n").alias("value"))


@query("stage_and_sizes")
def stage_and_sizes(spark, sf):
    """Stages and sizes in texts; rows only (tests compare with expected values)."""
    d = table(spark, sf, "documents").select("doc_id", X.stage(F.col("text")).alias("s"), X.measurements(F.col("text")).alias("m"))
    return d.select("doc_id", "s.t", "s.n", "s.m", F.size("m").alias("n_sizes"))


@query("date_to_iso", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def date_to_iso(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "MM/dd/yyyy")).otherwise(F.date_format("ts", "MMMM d, yyyy"))
    return table(spark, sf, "events").select("event_id", X.iso_date(raw).alias("day"))


@query("age_and_timeout", "SELECT o_orderkey, date_diff('year', o_orderdate::DATE, DATE '2024-06-30') - CASE WHEN strftime(o_orderdate, '%m%d') > '0630' THEN 1 ELSE 0 END AS age, 600 + greatest(o_orderkey % 10 - 3, 0) * 60 AS timeout, CASE WHEN o_orderkey % 100 < 50 THEN 2000 ELSE 1900 END + o_orderkey % 100 AS year FROM orders")
def age_and_timeout(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", X.age(F.to_date("o_orderdate"), F.lit("2024-06-30").cast("date")).cast("long").alias("age"), X.timeout_seconds(F.col("o_orderkey") % 10).alias("timeout"), X.full_year(F.col("o_orderkey") % 100).alias("year"))


@query("json_fields", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE props LIKE '%{%'")
def json_fields(spark, sf):
    """The JSON in a reply that has words around it."""
    reply = F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" -- done"))
    e = table(spark, sf, "events").select("event_id", F.from_json(X.json_block(reply), "k long").alias("j"))
    return e.where("j is not null").select("event_id", F.col("j.k").alias("k"))


@query("page_markers", "SELECT conv_id, string_agg('=== ' || turn || ' ===' || chr(10) || text, chr(10) ORDER BY turn) AS full_text FROM conversations GROUP BY 1")
def page_markers(spark, sf):
    """Pages of a document in order, each under a marker."""
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return g.select("conv_id", F.array_join(F.transform("p", lambda x: F.concat(F.lit("=== "), x["turn"].cast("string"), F.lit(" ===\n"), x["text"])), "\n").alias("full_text"))


REPORT = "CASE turn % 4 WHEN 0 THEN 'FINDINGS: ' WHEN 1 THEN 'TECHNIQUE USED: ' WHEN 2 THEN 'Note: ' ELSE 'FINDINGS: again ' END"


@query("section_split", f"""WITH t AS (SELECT conv_id, turn, {REPORT} || replace(text, chr(10), ' ') AS line FROM conversations), h AS (SELECT *, nullif(regexp_extract(line, '^([A-Z][A-Z ]{{3,}}):', 1), '') AS head FROM t), g AS (SELECT *, count(head) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM h),
    s AS (SELECT conv_id, n, max(head) AS section, sum(length(line)) + count(*) - 1 - length(max(head)) - 1 AS n_chars FROM g WHERE n > 0 GROUP BY 1, 2) SELECT conv_id, section, arg_min(n_chars, n)::INTEGER AS n_chars FROM s GROUP BY 1, 2""")
def section_split(spark, sf):
    """Text under each heading line (capitals and a colon) of a conversation as a report; the first of a heading wins."""
    line = F.concat(F.expr(REPORT), F.replace("text", F.lit("\n"), F.lit(" ")))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    parts = F.split(F.concat(F.lit("\n"), F.array_join("l.line", "\n")), r"\n(?=[A-Z][A-Z ]{3,}:)")
    d = c.select("conv_id", F.posexplode(parts).alias("n", "part")).where("n > 0")
    head = r"^([A-Z][A-Z ]{3,}):"
    return d.groupBy("conv_id", F.regexp_extract("part", head, 1).alias("section")).agg(F.min_by(F.length(F.regexp_replace("part", head, "")), "n").alias("n_chars"))
