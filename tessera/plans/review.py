"""Confidence and review queries over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import review as R
from tessera.plans.registry import query, table

SCORES = "[(event_id % 100) / 100.0::DOUBLE, (event_id % 37) / 30.0::DOUBLE, least(value / 100, 1.5)]"
C = "(event_id % 100) / 100.0"


def scored(spark, sf):
    return table(spark, sf, "events").withColumn("scores", F.array((F.col("event_id") % 100) / 100.0, (F.col("event_id") % 37) / 30.0, F.least(F.col("value") / 100, F.lit(1.5))))


@query("confidence_aggregate", f"""WITH s AS (SELECT event_id, list_filter({SCORES}, lambda x: x >= 0 AND x <= 1) AS v FROM events)
    SELECT event_id, round(coalesce(list_min(v), 0), 9) AS minimum, round(coalesce(list_avg(v), 0), 9) AS average,
           round(CASE WHEN len(v) = 3 THEN (v[1] + 2 * v[2] + 3 * v[3]) / 6 ELSE coalesce(list_avg(v), 0) END, 9) AS weighted,
           round(CASE WHEN len(v) = 0 OR list_min(v) = 0 THEN 0 ELSE len(v) / list_sum(list_transform(v, lambda x: 1 / x)) END, 9) AS harmonic,
           round(coalesce(list_product(v), 0), 9) AS product FROM s""")
def confidence_aggregate(spark, sf):
    w = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    return scored(spark, sf).select("event_id", *[F.round(R.combine(F.col("scores"), m, w), 9).alias(m) for m in ("minimum", "average", "weighted", "harmonic", "product")])


@query("confidence_level", f"SELECT CASE WHEN {C} >= 0.85 THEN 'high' WHEN {C} >= 0.7 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM events GROUP BY 1")
def confidence_level(spark, sf):
    return table(spark, sf, "events").groupBy(R.level((F.col("event_id") % 100) / 100.0).alias("level")).agg(F.count("*").alias("n"))


@query("component_confidence", f"""SELECT event_id, round(({C} * 1 + CASE WHEN event_id % 5 = 0 THEN 0 ELSE least(value / 100, 1) * 1.5 END + 2 * (event_id % 7) / 7.0 + 1) / (4 + CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1.5 END), 6) AS confidence FROM events""")
def component_confidence(spark, sf):
    """Document confidence: classification 1, template 1.5 (may be missing), extraction 2, quality 1."""
    e = F.col("event_id")
    parts = [((e % 100) / 100.0, 1.0), (F.when(e % 5 != 0, F.least(F.col("value") / 100, F.lit(1.0))), 1.5), ((e % 7) / 7.0, 2.0), (F.lit(1.0), 1.0)]
    return table(spark, sf, "events").select("event_id", F.round(R.weighted(parts), 6).alias("confidence"))


@query("extraction_confidence", f"""WITH s AS (SELECT event_id, {C} AS t, least(value / 100, 1) AS q, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 END AS ok, event_id % 11 = 0 AS conflict FROM events),
    b AS (SELECT *, CASE WHEN least(t, q) = 0 THEN 0 ELSE 2 / (1 / t + 1 / q) END AS base FROM s)
    SELECT event_id, round(CASE WHEN conflict THEN least(base, 0.5) WHEN ok IS NULL THEN base WHEN ok THEN least(base * 1.1, 1) ELSE base * 0.6 END, 6) AS confidence FROM b""")
def extraction_confidence(spark, sf):
    e = F.col("event_id")
    ok = F.when(e % 3 != 0, e % 3 == 1)
    return table(spark, sf, "events").select("event_id", F.round(R.extraction((e % 100) / 100.0, F.least(F.col("value") / 100, F.lit(1.0)), ok, e % 11 == 0), 6).alias("confidence"))


REVIEW = f"r AS (SELECT event_id, {C} AS c, event_id % 9 = 0 AS conflicts, value > 95 AS critical, event_id % 5 AS flags FROM events)"


@query("review_decision", f"""WITH {REVIEW}, p AS (SELECT *, CASE WHEN critical THEN 'critical' WHEN conflicts THEN 'high' WHEN c < 0.7 THEN 'medium' ELSE 'low' END AS p FROM r)
    SELECT event_id, CASE WHEN flags >= 3 THEN 'high' WHEN flags > 0 AND p = 'low' THEN 'medium' ELSE p END AS priority,
    concat_ws(';', CASE WHEN c < 0.7 THEN 'low_confidence' END, CASE WHEN conflicts THEN 'validation_conflict' END, CASE WHEN critical THEN 'critical_findings' END, CASE WHEN flags > 0 THEN 'quality_flags (' || flags || ')' END) AS reasons FROM p""")
def review_decision(spark, sf):
    e = F.col("event_id")
    args = ((e % 100) / 100.0, e % 9 == 0, F.col("value") > 95, e % 5)
    return table(spark, sf, "events").select("event_id", R.review_priority(*args).alias("priority"), F.array_join(R.review_reasons(*args), ";").alias("reasons"))


@query("stage_confidence", f"""WITH s AS (SELECT user_id, min({C}) AS least, count_if(event_id % 97 = 0) AS conflicts, count_if(event_type = 'error') AS flags, max(value) > 300 AS rejected FROM events GROUP BY 1),
    c AS (SELECT *, least + 1 - 0.1 * conflicts - 0.005 * flags AS c FROM s) SELECT user_id, round(greatest(0, least(1, CASE WHEN rejected THEN least(c, 0.3) ELSE c END)), 6) AS confidence FROM c""")
def stage_confidence(spark, sf):
    e = F.col("event_id")
    s = table(spark, sf, "events").groupBy("user_id").agg(F.min((e % 100) / 100.0).alias("least"), F.count_if(e % 97 == 0).alias("conflicts"), F.count_if(F.col("event_type") == "error").alias("flags"), (F.max("value") > 300).alias("rejected"))
    return s.select("user_id", F.round(R.stage_confidence(F.col("least") + 1, F.col("conflicts"), F.col("flags") * 0.1, F.lit(0), F.col("rejected")), 6).alias("confidence"))


@query("signal_score", f"SELECT event_id, round(least(1, greatest(0, ({C} * 0.5 + least(value / 100, 1) * 0.3) / 1.0)), 6) AS score FROM events")
def signal_score(spark, sf):
    """Weights of signals that are absent stay in the denominator."""
    signals = {"a": (F.col("event_id") % 100) / 100.0, "b": F.least(F.col("value") / 100, F.lit(1.0)), "unweighted": F.lit(9.0)}
    return table(spark, sf, "events").select("event_id", F.round(R.signal_score(signals, {"a": 0.5, "b": 0.3, "absent": 0.2}), 6).alias("score"))


@query("review_priority", f"""WITH s AS (SELECT event_id, user_id, (CASE WHEN value > 95 THEN 100 ELSE 0 END + CASE WHEN event_id % 9 = 0 THEN 50 ELSE 0 END + CASE WHEN {C} < 0.7 THEN 30 ELSE 0 END + 20 * (event_id % 3)
    + CASE WHEN value < 10 OR value > 80 THEN 10 ELSE 0 END)::BIGINT AS score FROM events) SELECT event_id, score, rank() OVER (PARTITION BY user_id ORDER BY score DESC)::INTEGER AS place FROM s""")
def review_priority(spark, sf):
    from pyspark.sql import Window

    e, v = F.col("event_id"), F.col("value")
    flag = F.when(v < 10, "L").when(v > 80, "H").otherwise("N")
    s = table(spark, sf, "events").withColumn("score", R.item_priority(v > 95, e % 9 == 0, (e % 100) / 100.0, e % 3, flag).cast("long"))
    return s.select("event_id", "score", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("score"))).alias("place"))


QUEUE = """q AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'done' END AS status, (o_orderkey % 100) / 100.0 AS c, o_totalprice > 300000 AS critical FROM orders),
    p AS (SELECT *, CASE WHEN status = 'failed' OR c < 0.5 THEN 'CRITICAL' WHEN c < 0.7 THEN 'HIGH' WHEN critical THEN 'CRITICAL' ELSE 'MEDIUM' END AS priority FROM q WHERE status = 'failed' OR c < 0.6)"""


def queue(spark, sf):
    q = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status"), ((F.col("o_orderkey") % 100) / 100.0).alias("c"), (F.col("o_totalprice") > 300000).alias("critical"))
    return q.where("status = 'failed' OR c < 0.6").withColumn("priority", R.queue_priority(F.col("status"), F.col("c"), F.col("critical")))


@query("review_queue", f"WITH {QUEUE} SELECT job_id, priority, concat_ws(';', CASE WHEN status = 'failed' THEN 'processing failed' END, CASE WHEN c < 0.7 THEN 'low confidence' END, CASE WHEN critical THEN 'critical findings' END) AS reasons FROM p ORDER BY CASE priority WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END, job_id LIMIT 500")
def review_queue(spark, sf):
    q = queue(spark, sf)
    reasons = F.array_compact(F.array(F.when(F.col("status") == "failed", "processing failed"), F.when(F.col("c") < 0.7, "low confidence"), F.when(F.col("critical"), "critical findings")))
    return q.orderBy(R.in_order(F.col("priority"), ["CRITICAL", "HIGH", "MEDIUM", "LOW"]), "job_id").limit(500).select("job_id", "priority", F.array_join(reasons, ";").alias("reasons"))


@query("review_queue_counts", f"WITH {QUEUE} SELECT priority, count(*) AS n FROM p GROUP BY 1")
def review_queue_counts(spark, sf):
    return queue(spark, sf).groupBy("priority").agg(F.count("*").alias("n"))


@query("document_search", "SELECT p_partkey FROM part WHERE (p_name ILIKE '%re%' OR p_type ILIKE '%re%') AND p_brand = 'Brand#12'")
def document_search(spark, sf):
    """Case-blind substring of either column, and equality filters that may be absent."""
    return table(spark, sf, "part").where((F.col("p_name").ilike("%re%") | F.col("p_type").ilike("%re%")) & (F.col("p_brand") == "Brand#12")).select("p_partkey")


@query("template_stats", "SELECT count(*) AS total, count_if(p_size > 25) AS active, count_if(p_size <= 25) AS draft, round(coalesce(avg(p_retailprice), 0), 2) AS mean_price FROM part")
def template_stats(spark, sf):
    return table(spark, sf, "part").agg(F.count("*").alias("total"), F.count_if(F.col("p_size") > 25).alias("active"), F.count_if(F.col("p_size") <= 25).alias("draft"), F.round(F.coalesce(F.avg("p_retailprice"), F.lit(0.0)), 2).alias("mean_price"))


@query("samples_by_category", "SELECT coalesce(nullif(p_type, ''), 'other') AS category, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS members FROM part GROUP BY 1")
def samples_by_category(spark, sf):
    return members_by_category(table(spark, sf, "part"))


def members_by_category(part):
    g = part.groupBy(F.coalesce(F.nullif("p_type", F.lit("")), F.lit("other")).alias("category"))
    return g.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("p_partkey")).cast("array<string>"), ",").alias("members"))


@query("step_durations", "SELECT user_id, round(sum(coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END, 0)), 4) AS total, count_if(event_type = 'purchase') AS completed FROM events GROUP BY 1")
def step_durations(spark, sf):
    v = F.when(F.col("event_id") % 4 != 0, F.col("value"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.sum(F.coalesce(v, F.lit(0.0))), 4).alias("total"), F.count_if(F.col("event_type") == "purchase").alias("completed"))


@query("priority_key_order", "SELECT n_nationkey, row_number() OVER (ORDER BY CASE n_name WHEN 'FRANCE' THEN 1 WHEN 'BRAZIL' THEN 2 WHEN 'CHINA' THEN 3 ELSE 4 END, n_nationkey)::INTEGER AS place FROM nation")
def priority_key_order(spark, sf):
    from pyspark.sql import Window

    w = Window.orderBy(R.in_order(F.col("n_name"), ["FRANCE", "BRAZIL", "CHINA"]), "n_nationkey")  # 25 rows
    return table(spark, sf, "nation").select("n_nationkey", F.row_number().over(w).alias("place"))


@query("newest_first", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_first(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey")


@query("boxes_on_page", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE nullif(l_linenumber, 7) IS NULL OR l_linenumber = 2")
def boxes_on_page(spark, sf):
    """Boxes of page 2; those without a page belong to every page."""
    page = F.nullif("l_linenumber", F.lit(7))
    return table(spark, sf, "lineitem").where(page.isNull() | (page == 2)).select("l_orderkey", "l_linenumber")
