"""Queries of names and contents: measurement names as scanners leave them, and what documents hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import content as C
from tessera.functions import names as N
from tessera.knowledge import values_sql
from tessera.plans.registry import query, table

#: What a report's name, unit and value cells may hold; a part takes one of each by its key.
NAMES = ["mchc02", "hgb¹", "Glucose (1)", "WBC **", "rnch", "basos_02", "plts", "s0dium", "K", "creat 12", "total  protein", "alk phos", "XYZ", "foo bar", "lipase", "neut†", "T0TAL", "bilirubin, total", "lFE", "modern [2]", "Eo count", "ck-mb", "AST", "date", "---", "page", "12", "", "a", "Panel of the very long name that goes on and on for more than fifty signs"]
UNITS = ["", "%", "mg/dL", "g/dl", "pg", "x10^9/L", "u/l"]


def pick(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + f"][p_partkey % {len(values)} + 1]"


CELLS = f"c AS (SELECT p_partkey, {pick(NAMES)} AS name, {pick(UNITS)} AS unit, p_size::DOUBLE AS value FROM part)"
FOOTNOTES = ["[¹²³⁴⁵⁶⁷⁸⁹⁰]+$", "\\s*[\\(\\[]\\d+[\\)\\]]$", "\\s*\\*+$", "\\s*†+$", "\\s*‡+$", "_\\d{1,2}$"]


def without_footnotes(s: str) -> str:
    s = f"trim({s})"
    for p in FOOTNOTES:
        s = f"regexp_replace({s}, '{p}', '')"
    return f"trim(regexp_replace(regexp_replace({s}, '([a-zA-Z])\\d{{1,2}}$', '\\1'), '\\s*\\d{{1,2}}$', ''))"


PLAIN = f"""{CELLS}, f AS (SELECT *, {without_footnotes('name')} AS f FROM c),
    r AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(f, '\\s+', ' ', 'g'), '[|l]([A-Z])', 'I\\1', 'g'), '([a-z])0([a-z])', '\\1o\\2', 'g'), '([A-Z])0([A-Z])', '\\1O\\2', 'g'), 'rn([a-z])', 'm\\1', 'g')) AS s FROM f),
    spelt(k, v) AS (VALUES {values_sql(list(N.SPELLINGS.items()))}), misread(k, v) AS (VALUES {values_sql(list(N.MISREADINGS.items()))}), hint(o, u, lo, hi, v) AS (VALUES {values_sql([(i, *h) for i, h in enumerate(N.HINTS)])}),
    g AS (SELECT p_partkey, arg_min(v, o) AS guess FROM r, hint WHERE unit <> '' AND value <> 0 AND value BETWEEN lo AND hi AND (contains(lower(unit), u) OR contains(u, lower(unit)))
        AND (substr(lower(s), 1, 2) = substr(lower(v), 1, 2) OR contains(lower(v), lower(s)) OR starts_with(lower(v), substr(lower(s), 1, 3))) GROUP BY 1)"""


def cells(spark, sf):
    p = table(spark, sf, "part")
    of = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values)).cast("int"))
    return p.select("p_partkey", of(NAMES).alias("name"), of(UNITS).alias("unit"), F.col("p_size").cast("double").alias("value"))


@query("footnote_names", f"WITH {CELLS} SELECT p_partkey, {without_footnotes('name')} AS plain FROM c")
def footnote_names(spark, sf):
    return cells(spark, sf).select("p_partkey", N.strip_footnotes(F.col("name")).alias("plain"))


@query("artefact_names", f"WITH {PLAIN} SELECT p_partkey, s AS repaired FROM r")
def artefact_names(spark, sf):
    return cells(spark, sf).select("p_partkey", N.repair_letters(N.strip_footnotes(F.col("name"))).alias("repaired"))


@query("suggested_names", f"WITH {PLAIN} SELECT r.p_partkey, guess FROM r LEFT JOIN g USING (p_partkey)")
def suggested_names(spark, sf):
    c = N.repair_letters(N.strip_footnotes(F.col("name")))
    return cells(spark, sf).select("p_partkey", N.suggested_name(c, F.col("unit"), F.col("value")).alias("guess"))


@query("plain_names", f"""WITH {PLAIN}, t AS (SELECT *, (s = upper(s) OR s = lower(s)) AND upper(s) <> lower(s) AS one_case FROM r)
    SELECT t.p_partkey, CASE WHEN name = '' THEN name ELSE coalesce(spelt.v, misread.v, guess, CASE WHEN one_case AND length(s) <= 4 AND regexp_matches(s, '^[A-Za-z]+$') THEN upper(s)
        WHEN one_case THEN array_to_string(list_transform(string_split(lower(s), ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE s END) END AS name
    FROM t LEFT JOIN spelt ON spelt.k = lower(s) LEFT JOIN misread ON misread.k = lower(s) LEFT JOIN g ON g.p_partkey = t.p_partkey""")
def plain_names(spark, sf):
    return cells(spark, sf).select("p_partkey", N.plain_name(F.col("name"), F.col("unit"), F.col("value")).alias("name"))


@query("plain_value_lists")
def plain_value_lists(spark, sf):
    """Whole lists of values by brand, with the names they had; rows only (tests compare with plain_names)."""
    v = F.struct("name", "unit", F.col("value").cast("string").alias("value"))
    lists = cells(spark, sf).groupBy("p_partkey").agg(F.collect_list(v).alias("v"))
    return lists.select("p_partkey", F.inline(N.plain_values(F.col("v"))))


TEST_SQL = " OR ".join(f"regexp_matches(lower(s), '\\b({w})\\b')" for w in C.TEST_WORDS)


@query("likely_tests", f"""WITH {CELLS}, t AS (SELECT p_partkey, trim(name) AS s FROM c) SELECT p_partkey, length(s) >= 2 AND NOT (regexp_matches(lower(s), '^(test|result|value|unit|reference|range|flag|status|date|time)s?$')
    OR regexp_matches(lower(s), '^(patient|name|dob|id|mrn|specimen|collected|received)$') OR regexp_matches(lower(s), '^(page|of|\\d+)$') OR regexp_matches(s, '^-+$') OR regexp_matches(s, '^=+$'))
    AND ({TEST_SQL} OR (length(s) <= 50 AND regexp_matches(s, '[a-zA-Z]'))) AS likely FROM t""")
def likely_tests(spark, sf):
    return cells(spark, sf).select("p_partkey", C.likely_test(F.col("name")).alias("likely"))


WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"


@query("readable_text", f"""SELECT doc_id, length(text) >= 5 AND regexp_matches(text, '[^01\\s]') AND length(text) - length(replace(text, '`', '')) <= length(text) * 0.3 AND len({WORDS}) >= 2
    AND len(list_filter({WORDS}, lambda w: length(w) BETWEEN 2 AND 20)) >= len({WORDS}) * 0.5 AS readable FROM documents""")
def readable_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.readable(F.col("text")).alias("readable"))


def word_sql(alternatives: str) -> str:
    """Whole words by Unicode letters, which RE2's own word boundary does not know; "sig:" ends before a word."""
    letter, rest = "\\p{L}\\p{N}_", alternatives.replace("|sig:", "")
    whole = f"regexp_matches(text, '(?i)(?:^|[^{letter}])(?:{rest})(?:$|[^{letter}])')"
    return whole if rest == alternatives else f"({whole} OR regexp_matches(text, '(?i)(?:^|[^{letter}])sig:[{letter}]'))"


SIGNALS = " + ".join(f"{word_sql(w)}::INT" for w in C.MEDICAL)
OTHERS = " + ".join(f"{word_sql(w)}::INT" for w in C.OTHER)


@query("medical_gate", f"""WITH s AS (SELECT doc_id, CASE WHEN length(text) < 50 OR len({WORDS}) < 10 THEN 0 ELSE {SIGNALS} END AS n, {OTHERS} AS other FROM documents) SELECT doc_id, n::INTEGER AS signals, n >= 2 AND other <= n AS medical FROM s""")
def medical_gate(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", C.medical_gate(F.col("text")).alias("g"))
    return d.select("doc_id", F.col("g.signals").cast("int").alias("signals"), F.col("g.medical").alias("medical"))


@query("oncology_gate", "SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{w}')" for w in C.ONCOLOGY) + " AS oncology FROM documents")
def oncology_gate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.is_oncology(F.col("text")).alias("oncology"))


@query("sufficiency_gate", """WITH u AS (SELECT user_id, count(*) AS n, sum(event_id % 100) / (100.0 * count(*)) AS c, user_id % 30 AS fields, string_agg(DISTINCT event_type, ' ') AS t FROM events GROUP BY 1)
    SELECT user_id, n >= 5 AND c >= 0.45 AND (fields <= 0 OR n / fields >= 0.5) AND contains(t, 'click')::INT + contains(t, 'signup')::INT + contains(t, 'error')::INT <= 2 AS sufficient FROM u""")
def sufficiency_gate(spark, sf):
    u = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.sum(F.col("event_id") % 100) / (100.0 * F.count("*"))).alias("c"), F.array_join(F.collect_set("event_type"), " ").alias("t"))
    return u.select("user_id", C.sufficient(F.col("n"), F.col("c"), F.col("user_id") % 30, F.col("t"), ["click", "signup", "error"], 5, 0.45, 0.5).alias("sufficient"))
