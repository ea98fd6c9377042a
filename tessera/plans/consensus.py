"""Consensus queries: each event type is a method that reads a field (user, day)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import consensus as C
from tessera.plans.registry import query, table

READ = "m AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type AS method, CAST(floor(value / 60) AS INTEGER) AS v, event_id FROM events)"
PRI = "CASE method WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
VOTE = f"""{READ}, c AS (SELECT user_id, day, v, count(DISTINCT method) AS votes, min({PRI}) AS p FROM m GROUP BY 1, 2, 3),
    b AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY votes DESC, p) AS k, count(*) OVER (PARTITION BY user_id, day) AS nv, sum(votes) OVER (PARTITION BY user_id, day) AS nt FROM c),
    a AS (SELECT user_id, day, v, votes, CASE WHEN nv = 1 AND nt > 1 THEN 'unanimous' WHEN votes * 2 > nt THEN 'majority' WHEN votes > 1 THEN 'minority' ELSE 'conflict' END AS agreement FROM b WHERE k = 1)"""


def voted(spark, sf):
    m = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("method"), F.floor(F.col("value") / 60).cast("int").alias("v"))
    order = F.when(F.col("method") == "click", 0).when(F.col("method") == "view", 1).when(F.col("method") == "purchase", 2).when(F.col("method") == "signup", 3).otherwise(4)
    return C.vote(m, ["user_id", "day"], "method", "v", order)


@query("consensus_vote", f"""WITH {VOTE} SELECT user_id, day, agreement, votes, CASE agreement WHEN 'unanimous' THEN 0.98 WHEN 'majority' THEN 0.92 WHEN 'minority' THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence, agreement IN ('minority', 'conflict') AS needs_review FROM a""")
def consensus_vote(spark, sf):
    return voted(spark, sf).select("user_id", "day", "agreement", "votes", "confidence", "needs_review")


@query("consensus_rollup", f"WITH {VOTE} SELECT agreement, count(*) AS n, count_if(agreement IN ('unanimous', 'majority')) AS n_high, count_if(agreement IN ('minority', 'conflict')) AS n_review FROM a GROUP BY 1")
def consensus_rollup(spark, sf):
    return voted(spark, sf).groupBy("agreement").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.9).alias("n_high"), F.count_if("needs_review").alias("n_review"))


@query("value_boost", """SELECT event_id, CASE WHEN value BETWEEN 20 AND 80 THEN 0.1 WHEN value BETWEEN 10 AND 120 THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN value BETWEEN 10 AND 120 AND event_type IN ('click', 'view') THEN 0.05 ELSE 0 END AS boost FROM events""")
def value_boost(spark, sf):
    v = F.col("value")
    near = F.when(v.between(20, 80), 0.1).when(v.between(10, 120), 0.05).otherwise(0.0)
    return table(spark, sf, "events").select("event_id", (near + F.when(v.between(10, 120) & F.col("event_type").isin("click", "view"), 0.05).otherwise(0.0)).alias("boost"))


@query("merge_field_maps", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'left' END AS a, 'left' AS b FROM events")
def merge_field_maps(spark, sf):
    left = F.create_map(F.lit("a"), F.lit("left"), F.lit("b"), F.lit("left"), F.lit("_hidden"), F.lit("x"))
    right = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("a"), F.col("event_type"))).otherwise(F.create_map(F.lit("_raw"), F.col("event_type")))
    return table(spark, sf, "events").select("event_id", C.merged_maps(left, right).alias("m")).select("event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("most_complete", """SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END DESC, event_id) AS k FROM events WHERE value IS NOT NULL) WHERE k = 1""")
def most_complete(spark, sf):
    e = table(spark, sf, "events")
    for c, k in (("unit", 2), ("range", 3), ("flag", 5)):
        e = e.withColumn(c, F.when(F.col("event_id") % k == 0, c))
    return C.most_complete(e, ["user_id", "event_type"], "event_id").select("event_id")


@query("multipage_combine", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, round(avg((turn % 5) / 5.0), 6) AS confidence, count(*) AS pages FROM conversations GROUP BY 1")
def multipage_combine(spark, sf):
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"), F.round(F.avg((F.col("turn") % 5) / 5.0), 6).alias("confidence"), F.count("*").alias("pages"))
    return g.select("conv_id", F.array_join("p.text", "\n").alias("text"), "confidence", "pages")


@query("page_text_override", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'scan: ' || text ELSE text END AS text FROM conversations")
def page_text_override(spark, sf):
    """A rescanned page replaces the text of the same page."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    scan = c.where("turn % 3 = 0").select("conv_id", "turn", F.concat(F.lit("scan: "), F.col("text")).alias("scan")).dropDuplicates(["conv_id", "turn"])
    return c.join(scan, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("scan", "text").alias("text"))
