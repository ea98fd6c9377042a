"""Queries of findings, table results, structured records, progress, look-back and two narrow range parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import reports as R
from tessera.plans.registry import query, table

CRITICAL, PLACES, ADVICE = [("urgent", "tion"), ("watch", r"\bque\b")], [("left", r"\bder\b"), ("right", r"\bthe\b")], [("again", "ing")]


@query("findings_enriched", r"""WITH f AS (SELECT conv_id, text IS NOT NULL AS known, CASE WHEN regexp_matches(text, '(?i)tion') THEN 'urgent' WHEN regexp_matches(text, '(?i)\bque\b') THEN 'watch' END AS critical,
    CASE WHEN regexp_matches(text, '(?i)\bder\b') THEN 1 WHEN regexp_matches(text, '(?i)\bthe\b') THEN 1 END AS place, CASE WHEN regexp_matches(text, '(?i)ing') THEN 1 END AS advice FROM conversations)
    SELECT conv_id, count_if(known) AS n_findings, count(place) AS n_places, count(advice) AS n_advice, coalesce(string_agg(DISTINCT critical, ',' ORDER BY critical), '') AS critical,
    CASE WHEN count_if(known) > 0 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence, count(critical) > 0 AS review FROM f GROUP BY 1""")
def findings_enriched(spark, sf):
    return R.enrich_findings(table(spark, sf, "conversations"), "conv_id", "text", CRITICAL, PLACES, ADVICE)


@query("table_results", """WITH k AS (SELECT user_id, event_type AS name, arg_max(value, event_id) AS value FROM events WHERE value > 20 GROUP BY 1, 2)
    SELECT user_id, name, value, round(least(0.95, 0.80 + count(*) OVER (PARTITION BY user_id) * 0.01)::DOUBLE, 6) AS confidence FROM k""")
def table_results(spark, sf):
    got = R.table_results(table(spark, sf, "events"), "user_id", "event_id", F.col("event_type"), F.col("value"), F.col("value") > 20)
    return got.withColumn("confidence", F.round("confidence", 6))


CELLS = "CASE l_linenumber WHEN 1 THEN ' LDNR' WHEN 2 THEN 'Pending ' WHEN 3 THEN '' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END"


@query("structured_tests", f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag AS name, {CELLS} AS value, CASE WHEN l_linestatus = 'O' THEN 'mg' END AS unit, CASE WHEN l_tax > 0.04 THEN '1-2' ELSE '' END AS range FROM lineitem),
    d AS (SELECT *, round(0.5 + 0.5 * (1 + (unit IS NOT NULL)::INT + (range <> '')::INT) / 3, 2)::DOUBLE AS confidence FROM r
        WHERE trim(value) <> '' AND regexp_replace(lower(trim(value)), '^[a-z]dnr$', 'dnr') NOT IN ('dnr', 'pending'))
    SELECT l_orderkey, l_linenumber, name, value, unit, range, confidence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, lower(name), lower(trim(value)) ORDER BY confidence DESC, l_linenumber, coalesce(unit, '') DESC, coalesce(range, '') DESC) AS k FROM d) WHERE k = 1""")
def structured_tests(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("name"), F.expr(CELLS.replace("VARCHAR", "STRING")).alias("value"), F.expr("CASE WHEN l_linestatus = 'O' THEN 'mg' END AS unit"), F.expr("CASE WHEN l_tax > 0.04 THEN '1-2' ELSE '' END AS range"))
    return R.structured_tests(rows, "l_orderkey", "l_linenumber")


@query("job_progress", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS stage, count(*) AS steps FROM events GROUP BY 1")
def job_progress(spark, sf):
    return R.progress(table(spark, sf, "events"), "user_id", F.col("event_type"), ["ts", "event_id"])


@query("looked_back", "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' AND o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 365 DAY")
def looked_back(spark, sf):
    return R.looked_back(table(spark, sf, "orders"), "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz")).select("o_orderkey")


RANGE = "CASE p_partkey % 6 WHEN 0 THEN p_size || ' - ' || (p_size + 5) WHEN 1 THEN '<' || p_size WHEN 2 THEN '> ' || p_retailprice WHEN 3 THEN p_size || '–' || (p_size + 7) WHEN 4 THEN p_name ELSE ' ' || p_size || '-9' END"


@query("narrow_ranges", f"""WITH r AS (SELECT p_partkey, {RANGE} AS r FROM part), m AS (SELECT *, regexp_extract(r, '^([0-9]+\\.?[0-9]*)\\s*-\\s*([0-9]+\\.?[0-9]*)', ['a', 'b']) AS two, regexp_extract(r, '^([0-9]+\\.?[0-9]*)\\s*[-–]\\s*([0-9]+\\.?[0-9]*)', ['a', 'b']) AS api,
    regexp_extract(r, '^<\\s*([0-9]+\\.?[0-9]*)', 1) AS under, regexp_extract(r, '^>\\s*([0-9]+\\.?[0-9]*)', 1) AS over FROM r)
    SELECT p_partkey, CASE WHEN two.a <> '' THEN TRY_CAST(two.a AS DOUBLE) WHEN under <> '' THEN 0 WHEN over <> '' THEN TRY_CAST(over AS DOUBLE) END AS low, CASE WHEN two.a <> '' THEN TRY_CAST(two.b AS DOUBLE) WHEN under <> '' THEN TRY_CAST(under AS DOUBLE) WHEN over <> '' THEN 'Infinity'::DOUBLE END AS high,
    nullif(api.a, '') AS low_text, nullif(api.b, '') AS high_text FROM m""")
def narrow_ranges(spark, sf):
    r = table(spark, sf, "part").select("p_partkey", F.expr(RANGE).alias("r"))
    low, high = X.leading_range(F.col("r"))
    low_text, high_text = X.range_texts(F.col("r"))
    return r.select("p_partkey", low.alias("low"), high.alias("high"), low_text.alias("low_text"), high_text.alias("high_text"))
