"""Queries of confidences, routing and dates: events as a document's values, orders as documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import confidence as K
from tessera.plans.registry import query, table

USERS = """u AS (SELECT user_id, avg(CASE WHEN event_id % 100 > 0 THEN event_id % 100 END) / 100.0 AS extraction, count_if(event_id % 97 = 0) AS conflicts, count_if(event_type = 'error') AS flags, count_if(value > 300) AS critical, count(*) AS n,
    CASE WHEN user_id % 3 > 0 THEN (user_id % 100) / 100.0 END AS classification, CASE WHEN user_id % 4 = 0 THEN (user_id % 50) / 50.0 END AS validation FROM events GROUP BY 1)"""


def users(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    g = table(spark, sf, "events").groupBy("user_id").agg((F.avg(F.when(e % 100 > 0, e % 100)) / 100.0).alias("extraction"), F.count_if(e % 97 == 0).alias("conflicts"), F.count_if(F.col("event_type") == "error").alias("flags"), F.count_if(F.col("value") > 300).alias("critical"), F.count("*").alias("n"))
    return g.select("*", F.when(u % 3 > 0, (u % 100) / 100.0).alias("classification"), F.when(u % 4 == 0, (u % 50) / 50.0).alias("validation"))


CONTEXT = f"""{USERS}, w AS (SELECT *, coalesce(validation, extraction) AS v FROM u), c AS (SELECT *, (coalesce(classification * 0.25, 0) + coalesce(extraction * 0.5, 0) + coalesce(v * 0.25, 0)) / nullif(CASE WHEN classification IS NULL THEN 0 ELSE 0.25 END + CASE WHEN extraction IS NULL THEN 0 ELSE 0.5 END + CASE WHEN v IS NULL THEN 0 ELSE 0.25 END, 0) AS c FROM w)"""


@query("context_confidence", f"WITH {CONTEXT} SELECT user_id, round(coalesce(c, 0)::DOUBLE, 9) AS confidence, CASE WHEN conflicts > 0 THEN 'conflict' WHEN c >= 0.85 THEN 'high' WHEN c >= 0.7 THEN 'medium' ELSE 'low' END AS level FROM c")
def context_confidence(spark, sf):
    c = K.context(F.col("classification"), F.col("extraction"), F.col("validation"))
    return users(spark, sf).select("user_id", F.round(c, 9).alias("confidence"), K.context_level(c, F.col("conflicts") > 0).alias("level"))


@query("pipeline_confidence", f"""WITH {USERS}, p AS (SELECT user_id, coalesce(extraction, 0) AS a, coalesce(classification, 0) AS b, (n % 10) / 10.0 AS t, coalesce(validation, 0) AS e FROM u)
    SELECT user_id, round(CASE WHEN greatest(a, b, t, e) <= 0 THEN 0.5 ELSE (greatest(a, 0) * 5 + greatest(b, 0) * 2 + greatest(t, 0) + greatest(e, 0) * 2) / (CASE WHEN a > 0 THEN 5 ELSE 0 END + CASE WHEN b > 0 THEN 2 ELSE 0 END + CASE WHEN t > 0 THEN 1 ELSE 0 END + CASE WHEN e > 0 THEN 2 ELSE 0 END) END::DOUBLE, 3) AS confidence FROM p""")
def pipeline_confidence(spark, sf):
    return users(spark, sf).select("user_id", K.pipeline(F.col("extraction"), F.col("classification"), (F.col("n") % 10) / 10.0, F.col("validation")).alias("confidence"))


@query("validation_confidence", f"WITH {USERS} SELECT user_id, round(greatest(0, least(1, 1 - 0.1 * conflicts - 0.2 * critical))::DOUBLE, 6) AS confidence FROM u")
def validation_confidence(spark, sf):
    return users(spark, sf).select("user_id", F.round(K.validation(F.col("conflicts"), F.col("critical")), 6).alias("confidence"))


@query("text_confidence", "SELECT conv_id, round(greatest(0.1, least(1, CASE conv_id % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.85 ELSE 0.6 END - 0.3 * count_if(length(text) < 50) / count(*)))::DOUBLE, 6) AS confidence FROM conversations GROUP BY conv_id")
def text_confidence(spark, sf):
    """A conversation as a document, its turns as pages; the base stands for how the text was read."""
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(F.length("text") < 50).alias("short"), F.count("*").alias("pages"))
    base = F.when(F.col("conv_id") % 3 == 0, 0.95).when(F.col("conv_id") % 3 == 1, 0.85).otherwise(0.6)
    return g.select("conv_id", F.round(K.reading(base, F.col("short"), F.col("pages")), 6).alias("confidence"))


@query("review_routing", f"""WITH {CONTEXT}, b AS (SELECT *, n % 13 = 0 AS already, n % 11 = 0 AS rejected FROM c)
    SELECT user_id, already OR coalesce(c, 0) < 0.7 OR conflicts > 0 OR rejected OR critical > 0 OR flags > 0 AS review, CASE WHEN already THEN 'low' WHEN rejected OR critical > 0 THEN 'critical' WHEN conflicts > 0 OR coalesce(c, 0) < 0.7 THEN 'high' WHEN flags > 0 THEN 'medium' ELSE 'low' END AS priority,
    CASE WHEN already THEN '' ELSE concat_ws(';', CASE WHEN coalesce(c, 0) < 0.7 THEN 'low confidence' END, CASE WHEN conflicts > 0 THEN 'conflicts' END, CASE WHEN rejected THEN 'rejected' END, CASE WHEN critical > 0 THEN 'critical findings' END, CASE WHEN flags > 0 THEN flags || ' quality flags' END) END AS reasons FROM b""")
def review_routing(spark, sf):
    c = K.context(F.col("classification"), F.col("extraction"), F.col("validation"))
    r = K.routing(F.col("n") % 13 == 0, c, F.col("conflicts") > 0, F.col("n") % 11 == 0, F.col("critical") > 0, F.col("flags"))
    return users(spark, sf).select("user_id", r.alias("r")).select("user_id", "r.review", "r.priority", F.array_join("r.reasons", ";").alias("reasons"))


@query("final_review", f"""WITH {CONTEXT}, b AS (SELECT *, n % 11 = 0 AS rejected FROM c) SELECT user_id, CASE WHEN rejected OR critical > 0 THEN 'critical' WHEN coalesce(c, 0) < 0.7 OR conflicts > 0 THEN 'high' WHEN flags > 0 THEN 'medium' ELSE 'low' END AS priority,
    CASE WHEN rejected THEN 'rejected' WHEN critical > 0 THEN critical || ' critical findings' WHEN coalesce(c, 0) < 0.7 THEN 'low confidence' WHEN conflicts > 0 THEN 'conflicts' WHEN flags > 0 THEN 'quality flags' END AS reason FROM b""")
def final_review(spark, sf):
    c = K.context(F.col("classification"), F.col("extraction"), F.col("validation"))
    r = K.final(F.col("n") % 11 == 0, F.col("critical"), c, F.col("conflicts") > 0, F.col("flags"))
    return users(spark, sf).select("user_id", r.alias("r")).select("user_id", "r.priority", "r.reason")


@query("merge_classification", """SELECT event_id, CASE WHEN event_type = 'view' THEN coalesce(nullif(CASE WHEN event_id % 2 = 0 THEN 'own' ELSE '' END, ''), 'impression') WHEN event_type = 'click' THEN coalesce(nullif(CASE WHEN event_id % 2 = 0 THEN 'own' ELSE '' END, ''), 'lab') ELSE CASE WHEN event_id % 2 = 0 THEN 'own' ELSE '' END END AS category,
    round(CASE WHEN event_type = 'purchase' AND (event_id % 100) / 100.0 < 0.9 THEN least((event_id % 100) / 100.0 + 0.1, 0.95) ELSE (event_id % 100) / 100.0 END::DOUBLE, 6) AS confidence FROM events""")
def merge_classification(spark, sf):
    """Items of three kinds of document; the kind fills an empty category or lifts a drug's confidence."""
    kind = F.element_at(F.create_map(*map(F.lit, ["click", "lab", "view", "radiology", "purchase", "prescription"])), F.col("event_type"))
    e = table(spark, sf, "events")
    own = F.when(F.col("event_id") % 2 == 0, "own").otherwise("")
    category, confidence = K.merged_classification(kind, own, (F.col("event_id") % 100) / 100.0)
    return e.select("event_id", category.alias("category"), F.round(confidence, 6).alias("confidence"))


@query("document_summary", f"""WITH {CONTEXT} SELECT user_id, n AS values, flags, critical, conflicts, CASE WHEN conflicts > 0 THEN 'conflict' WHEN c >= 0.85 THEN 'high' WHEN c >= 0.7 THEN 'medium' ELSE 'low' END AS level, conflicts > 0 OR coalesce(c, 0) < 0.7 OR critical > 0 OR flags > 0 AS escalate FROM c""")
def document_summary(spark, sf):
    c = K.context(F.col("classification"), F.col("extraction"), F.col("validation"))
    level = K.context_level(c, F.col("conflicts") > 0)
    return users(spark, sf).select("user_id", F.col("n").alias("values"), "flags", "critical", "conflicts", level.alias("level"), (level.isin("low", "conflict") | (F.col("critical") > 0) | (F.col("flags") > 0)).alias("escalate"))


@query("best_table_method", """WITH o AS (SELECT l_orderkey, max(CASE WHEN l_linestatus = 'O' THEN l_discount END) AS lattice, max(CASE WHEN l_linestatus = 'F' THEN l_discount END) AS stream FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CASE WHEN lattice > 0.05 THEN 'lattice' WHEN stream IS NOT NULL THEN 'stream' ELSE 'none' END AS method, CASE WHEN lattice > 0.05 THEN lattice ELSE coalesce(stream, 0) END AS confidence FROM o""")
def best_table_method(spark, sf):
    """Ruled tables if any is sure enough, else spaced ones, else none; the surest table tells."""
    of = lambda s: F.max(F.when(F.col("l_linestatus") == s, F.col("l_discount")))
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(of("O").alias("lattice"), of("F").alias("stream"))
    m = K.best_method([("lattice", F.col("lattice"), 0.05), ("stream", F.col("stream"), None)])
    return o.select("l_orderkey", m.alias("m")).select("l_orderkey", "m.method", "m.confidence")


@query("final_pdf_confidence", f"""WITH {USERS}, m AS (SELECT user_id, list_filter([extraction, CASE WHEN classification > 0 THEN classification END, validation], lambda x: x IS NOT NULL) AS l FROM u) SELECT user_id, round(coalesce(list_avg(l), 0)::DOUBLE, 9) AS confidence FROM m""")
def final_pdf_confidence(spark, sf):
    """Mean of the text's, the scanner's (if above 0) and the best table's confidence, of those there are."""
    return users(spark, sf).select("user_id", F.round(K.mean_of(F.col("extraction"), F.when(F.col("classification") > 0, F.col("classification")), F.col("validation")), 9).alias("confidence"))


#: Ways to write a date; an order takes one by its key.
WRITTEN = ["%m/%d/%Y", "%m-%d-%Y", "%d/%m/%Y", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y", "%d-%b-%Y", "%Y%m%d", "%Y-%m-%d", "%Y/%m/%d", "soon"]
LAYOUTS = ["MM/dd/yyyy", "MM-dd-yyyy", "dd/MM/yyyy", "MMMM dd, yyyy", "MMM dd, yyyy", "dd MMMM yyyy", "dd MMM yyyy", "dd-MMM-yyyy", "yyyyMMdd", "yyyy-MM-dd", "yyyy/MM/dd", "'soon'"]
WRITTEN_SQL = "CASE o_orderkey % 12 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(WRITTEN)) + " END"
TRIED = ", ".join(f"'{f}'" for f in WRITTEN[:9])


def written(spark, sf):
    s = F.lit(None).cast("string")
    for i, f in enumerate(LAYOUTS):
        s = F.when(F.col("o_orderkey") % 12 == i, F.date_format("o_orderdate", f)).otherwise(s)
    return table(spark, sf, "orders").select("o_orderkey", s.alias("s"))


@query("written_dates", f"WITH d AS (SELECT o_orderkey, {WRITTEN_SQL} AS s FROM orders) SELECT o_orderkey, s, CASE WHEN regexp_matches(s, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN substr(s, 1, 10) ELSE strftime(try_strptime(s, [{TRIED}]), '%Y-%m-%d') END AS iso FROM d")
def written_dates(spark, sf):
    return written(spark, sf).select("o_orderkey", "s", X.iso_date(F.col("s")).alias("iso"))


@query("resolved_dates", f"""WITH d AS (SELECT o_orderkey, o_custkey, {WRITTEN_SQL} AS s FROM orders), i AS (SELECT o_orderkey % 50 AS doc, CASE o_custkey % 4 WHEN 0 THEN 'collection_date' WHEN 1 THEN 'study_date' WHEN 2 THEN 'report_date' ELSE 'other' END AS k, s, o_orderkey AS n FROM d),
    l AS (SELECT doc, k, arg_max(s, n) AS s FROM i WHERE s <> '' GROUP BY 1, 2), p AS (SELECT doc, CASE k WHEN 'collection_date' THEN 1 WHEN 'study_date' THEN 2 WHEN 'report_date' THEN 3 END AS o, CASE WHEN regexp_matches(s, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN substr(s, 1, 10) ELSE strftime(try_strptime(s, [{TRIED}]), '%Y-%m-%d') END AS iso FROM l)
    SELECT DISTINCT l.doc, e.iso AS effective FROM l LEFT JOIN (SELECT doc, arg_min(iso, o) AS iso FROM p WHERE o IS NOT NULL AND iso IS NOT NULL GROUP BY 1) e ON e.doc = l.doc""")
def resolved_dates(spark, sf):
    """Documents of many dates: the last of each kind counts, and the first kind in order that can be read."""
    kind = F.element_at(F.create_map(*[F.lit(x) for x in (0, "Collection Date", 1, "Study Date", 2, "Report Date")]), (F.col("o_custkey") % 4).cast("int"))
    d = written(spark, sf).join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    d = d.select((F.col("o_orderkey") % 50).alias("doc"), F.coalesce(kind, F.lit("Other")).alias("kind"), "s", F.col("o_orderkey").alias("n"))
    return K.resolved_dates(d, "doc", "kind", "s", "n", ["collection_date", "study_date", "report_date", "test_date", "date"]).withColumnRenamed("date", "effective")


MONTHS = ["Jan", "march", "JUNE", "sep", "nope"]
PARTS = "CASE o_orderkey % 3 WHEN 0 THEN [['Jan', 'march', 'JUNE', 'sep', 'nope'][o_custkey % 5 + 1], (o_orderkey % 31 + 1)::VARCHAR, (o_orderkey % 100)::VARCHAR] WHEN 1 THEN [strftime(o_orderdate, '%Y'), (o_custkey % 13 + 1)::VARCHAR, (o_orderkey % 31 + 1)::VARCHAR] ELSE [(o_custkey % 13 + 1)::VARCHAR, (o_orderkey % 31 + 1)::VARCHAR, (1940 + o_orderkey % 90)::VARCHAR] END"


@query("date_parts", f"""WITH p AS (SELECT o_orderkey, {PARTS} AS g FROM orders), m AS (SELECT *, CASE lower(g[1]) WHEN 'jan' THEN 1 WHEN 'march' THEN 3 WHEN 'june' THEN 6 WHEN 'sep' THEN 9 END AS word FROM p),
    q AS (SELECT o_orderkey, CASE WHEN word IS NOT NULL THEN [g[3]::INT, word, g[2]::INT] WHEN length(g[1]) = 4 THEN [TRY_CAST(g[1] AS INT), g[2]::INT, g[3]::INT] ELSE [g[3]::INT, TRY_CAST(g[1] AS INT), g[2]::INT] END AS d FROM m), y AS (SELECT o_orderkey, CASE WHEN d[1] < 50 THEN d[1] + 2000 WHEN d[1] < 100 THEN d[1] + 1900 ELSE d[1] END AS year, d FROM q)
    SELECT o_orderkey, TRY_CAST(lpad(year::VARCHAR, 4, '0') || '-' || lpad(d[2]::VARCHAR, 2, '0') || '-' || lpad(d[3]::VARCHAR, 2, '0') AS DATE) AS date FROM y""")
def date_parts(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    day, month = (o % 31 + 1).cast("string"), (c % 13 + 1).cast("string")
    first = F.when(o % 3 == 0, F.get(F.array(*map(F.lit, MONTHS)), (c % 5).cast("int"))).when(o % 3 == 1, F.date_format("o_orderdate", "yyyy")).otherwise(month)
    second = F.when(o % 3 == 1, month).otherwise(day)
    third = F.when(o % 3 == 0, (o % 100).cast("string")).when(o % 3 == 1, day).otherwise((1940 + o % 90).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", X.date_of_parts(first, second, third).alias("date"))


FOUND = """f AS (SELECT user_id, count_if(event_type = 'click') AS tests, count_if(event_type = 'view') AS drugs, (user_id % 4)::BIGINT AS dates, avg(CASE WHEN event_type = 'click' THEN (event_id % 64) / 64.0 END) AS ct, avg(CASE WHEN event_type = 'view' THEN (event_id % 32) / 32.0 END) AS cd, (user_id % 40)::BIGINT AS et, (user_id % 9)::BIGINT AS ed FROM events GROUP BY 1),
    w AS (SELECT *, CASE WHEN tests > 0 THEN least(tests, 10) ELSE 0 END AS wt, CASE WHEN drugs > 0 THEN least(drugs, 5) ELSE 0 END AS wd, CASE WHEN dates > 0 THEN 1 ELSE 0 END AS wx, et > 5 AND tests > 0 AS st, ed > 2 AND drugs > 0 AS sd FROM f),
    q AS (SELECT user_id, CASE WHEN wt + wd + wx = 0 THEN NULL ELSE least(1, (coalesce(ct, 0) * wt + coalesce(cd, 0) * wd + 0.8 * wx) / (wt + wd + wx) + 0.03 * ((wt > 0)::INT + (wd > 0)::INT + wx)) END AS q, CASE WHEN st AND (NOT sd OR et >= ed) THEN least(1, tests / et) WHEN sd THEN least(1, drugs / ed) ELSE 1 END AS c FROM w)"""


@query("content_confidence", f"WITH {FOUND} SELECT user_id, CASE WHEN q IS NULL THEN 0.2 ELSE round((q * c)::DOUBLE, 3) END AS confidence FROM q")
def content_confidence(spark, sf):
    e, kind = F.col("event_id"), F.col("event_type")
    f = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(kind == "click").alias("tests"), F.count_if(kind == "view").alias("drugs"), F.avg(F.when(kind == "click", (e % 64) / 64.0)).alias("ct"), F.avg(F.when(kind == "view", (e % 32) / 32.0)).alias("cd"))
    u = F.col("user_id")
    covered = K.coverage([(F.col("tests"), u % 40, 5), (F.col("drugs"), u % 9, 2)])
    return f.select("user_id", K.content([(F.col("ct"), F.col("tests"), 10), (F.col("cd"), F.col("drugs"), 5), (F.lit(0.8), u % 4, 1)], covered).alias("confidence"))


@query("value_in_text", """WITH t AS (SELECT p_partkey, replace(p_name, ' ', '_') AS field, 'Seen: ' || CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '-') ELSE upper(p_name) END || CASE p_partkey % 2 WHEN 0 THEN ': ' ELSE ' ' END || p_size || '.5 mg/l' AS text FROM part)
    SELECT p_partkey, TRY_CAST(regexp_extract(text, '([\\d.,]+)\\s*(\\w+)?/l$', 1) AS DOUBLE) AS value, 'mg' AS unit FROM t""")
def value_in_text(spark, sf):
    """Each field's own pattern over its own text: the number after the field's name, and the unit after that."""
    name = F.col("p_name")
    shown = F.when(F.col("p_partkey") % 3 == 0, F.replace(name, F.lit(" "), F.lit("-"))).otherwise(F.upper(name))
    text = F.concat(F.lit("Seen: "), shown, F.when(F.col("p_partkey") % 2 == 0, ": ").otherwise(" "), F.col("p_size").cast("string"), F.lit(".5 mg/l"))
    p = table(spark, sf, "part").select("p_partkey", F.replace(name, F.lit(" "), F.lit("_")).alias("field"), text.alias("text"))
    v = X.value_after(F.col("text"), F.col("field")).alias("v")
    return p.select("p_partkey", v).select("p_partkey", "v.value", "v.unit")
