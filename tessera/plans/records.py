"""Queries of field names that mean one test, and of names as weighted letter groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import records as R
from tessera.plans.registry import query, table
from tessera.sources.shared import spread

FIELDS = ["WBC", "white blood cell count", "Leukocytes", "HGB", "hemoglobin", "MCV", "mean-cell-volume", "Neutrophils abs", "neutrophils", "glucose level", "Glucose", "Creatinine", "sodium", "K", "potassium", "ast", "unlike", "platelet count"]
LIST = "[" + ", ".join(f"'{f}'" for f in FIELDS) + "]"
GROUPS = "[" + ", ".join("[" + ", ".join(f"'{x}'" for x in g) + "]" for g in R.ALIASES) + "]"
BARE = lambda c: f"regexp_replace({c}, '({'|'.join(R.ENDINGS)})$', '')"
LIKE = lambda c: f"len(list_filter(g, lambda x: contains({c}, x) OR contains(x, {c}))) > 0"


@query("same_fields", f"""WITH n AS (SELECT p_partkey, {LIST}[p_partkey % {len(FIELDS)} + 1] AS a, {LIST}[p_size % {len(FIELDS)} + 1] AS b FROM part), f AS (SELECT *, translate(lower(a), ' -', '__') AS x1, translate(lower(b), ' -', '__') AS x2 FROM n)
    SELECT p_partkey, a, b, x1 = x2 OR {BARE('x1')} = {BARE('x2')} OR len(list_filter({GROUPS}, lambda g: {LIKE('x1')} AND {LIKE('x2')})) > 0 AS same FROM f""")
def same_fields(spark, sf):
    names = F.array(*map(F.lit, FIELDS))
    n = spread(table(spark, sf, "part").select("p_partkey", "p_size")).select("p_partkey", F.get(names, (F.col("p_partkey") % len(FIELDS)).cast("int")).alias("a"), F.get(names, (F.col("p_size") % len(FIELDS)).cast("int")).alias("b"))
    return n.select("p_partkey", "a", "b", R.same_field(F.col("a"), F.col("b")).alias("same"))


@query("letter_group_weights", """WITH d AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT name, gram, count(*) AS n FROM (SELECT name, unnest(flatten(list_transform([2, 3, 4], lambda k: list_transform(range(1, greatest(length(name) - k + 2, 1)), lambda i: substr(lower(name), i, k))))) AS gram FROM d) GROUP BY 1, 2),
    f AS (SELECT gram, count(*) AS df FROM g GROUP BY 1), w AS (SELECT name, gram, n * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)::DOUBLE) + 1) AS w FROM g JOIN f USING (gram)), s AS (SELECT name, sqrt(sum(w * w)) AS size FROM w GROUP BY 1)
    SELECT name, gram, round(w / size, 6) AS weight FROM w JOIN s USING (name)""")
def letter_group_weights(spark, sf):
    w = R.weighted_groups(table(spark, sf, "part").select(F.col("p_name").alias("name")), "name")
    return w.select("name", "gram", F.round("weight", 6).alias("weight"))


# Sections of every order: a text, a list of texts, a list of records with lists of their own, and a record with a map.
SECTIONS = """struct(concat(o_orderpriority, ' (2)') AS note, array(concat(o_orderstatus, '**')) AS tags, array(named_struct('name', concat('WBC', CAST(o_orderkey % 30 AS STRING)), 'codes', array('B12', ' K* '), 'n', o_custkey)) AS tests,
    named_struct('by', concat(o_orderstatus, '_7'), 'more', map('k(1)', 'Hgb [3]', 'z', NULL)) AS head) AS s"""
_strip = lambda c: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({c}), '\\s*[\\(\\[]\\d+[\\)\\]]$', ''), '\\s*\\*+$', ''), '_\\d{{1,2}}$', ''), '([a-zA-Z])\\d{{1,2}}$', '\\1'), '\\s*\\d{{1,2}}$', ''), '\\s+$', '')"


@query("sections_cleaned", f"""SELECT o_orderkey, {_strip("o_orderpriority || ' (2)'")} AS note, o_orderstatus || '**' AS tag, {_strip("'WBC' || (o_orderkey % 30)")} AS test, 'B,K' AS codes, o_custkey AS n, {_strip("o_orderstatus || '_7'")} AS by_whom, 'Hgb' AS more FROM orders""")
def sections_cleaned(spark, sf):
    """Footnote marks taken off all texts inside every order's sections, however deep; a section that is a list of texts stays."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr(SECTIONS)).select("o_orderkey", "s.*")
    d = R.plain_sections(rows, ["note", "tags", "tests", "head"], X.strip_footnotes)
    test = F.get("tests", F.lit(0))
    return d.select("o_orderkey", "note", F.get("tags", F.lit(0)).alias("tag"), test["name"].alias("test"), F.array_join(test["codes"], ",").alias("codes"), test["n"].alias("n"), F.col("head.by").alias("by_whom"), F.col("head.more")["k(1)"].alias("more"))
