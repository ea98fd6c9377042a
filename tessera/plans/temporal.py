"""Series queries over events: key (user_id, event_type)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import temporal as T
from tessera.plans.registry import query, table

KEY = ["user_id", "event_type"]
TREND = """
    WITH p AS (SELECT *, date_sub('day', min(ts) OVER (PARTITION BY user_id, event_type), ts)::DOUBLE AS d FROM events WHERE value IS NOT NULL),
    g AS (SELECT user_id, event_type, count(*) AS n, coalesce(regr_slope(value, d), 0) AS slope, avg(value) AS my, avg(d) AS md,
                 CASE WHEN var_pop(value) = 0 THEN 0 ELSE coalesce(regr_r2(value, d), 0) END AS r2,
                 arg_min(value, {'a': ts, 'b': event_id}) AS v0, arg_max(value, {'a': ts, 'b': event_id}) AS v1, max(d)::BIGINT AS days
          FROM p GROUP BY 1, 2 HAVING count(*) >= 3),
    t AS (SELECT user_id, event_type, n, round(slope, 6) AS slope, round(my - slope * md, 6) AS intercept, round(r2, 6) AS r2,
                 CASE WHEN slope > 0.01 THEN 'rising' WHEN slope < -0.01 THEN 'falling' ELSE 'stable' END AS direction,
                 round(CASE WHEN days > 0 THEN (v1 - v0) / days ELSE 0 END, 6) AS rate,
                 round(CASE WHEN v0 = 0 THEN 0 ELSE (v1 - v0) / v0 * 100 END, 4) AS pct, days FROM g)
"""


def _rounded(df):
    return df.select(*KEY, "n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")], "direction", F.round("rate", 6).alias("rate"), F.round("pct", 4).alias("pct"), "days")


@query("trend_fit", TREND + "SELECT * FROM t")
def trend_fit(spark, sf):
    return _rounded(T.trends(table(spark, sf, "events"), KEY, seq="event_id"))


@query("trend_detect", TREND + "SELECT * FROM t WHERE r2 >= 0.5 AND abs(pct) >= 5")
def trend_detect(spark, sf):
    return _rounded(T.detected(T.trends(table(spark, sf, "events"), KEY, seq="event_id")))


W = "OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)"


@query("acute_drop", f"""WITH p AS (SELECT *, lag(value) {W} AS prev, date_sub('day', lag(ts) {W}, ts) AS gap_days FROM events)
    SELECT event_id, user_id, event_type, round(value, 6) AS value, round(prev, 6) AS prev, gap_days FROM p WHERE value - prev < -2 AND gap_days <= 30""")
def acute_drop(spark, sf):
    return T.acute_drop(table(spark, sf, "events"), KEY).select("event_id", *KEY, F.round("value", 6).alias("value"), F.round("prev", 6).alias("prev"), "gap_days")


RISE = f"WITH p AS (SELECT *, lag(value) {W} AS a, lag(value, 2) {W} AS b, lag(value, 3) {W} AS c FROM events) SELECT event_id, user_id, event_type FROM p WHERE "


@query("monotone_rise", RISE + "c < b AND b < a AND a < value")
def monotone_rise(spark, sf):
    return T.monotone_rise(table(spark, sf, "events"), KEY).select("event_id", *KEY)


@query("rise_newest_first", RISE + "a < b AND b < c AND c < value")
def rise_newest_first(spark, sf):
    return T.monotone_rise(table(spark, sf, "events"), KEY, chronological=False).select("event_id", *KEY)


@query("sudden_normalisation", f"""WITH p AS (SELECT *, lag(value) {W} AS prev FROM events)
    SELECT event_id, user_id, event_type, round((value - prev) / prev * 100, 4) AS pct FROM p
    WHERE prev <> 0 AND abs((value - prev) / prev * 100) > 50 AND value BETWEEN 40 AND 60 AND (prev < 40 OR prev > 60)""")
def sudden_normalisation(spark, sf):
    return T.sudden_normalisation(table(spark, sf, "events"), KEY, F.lit(40.0), F.lit(60.0)).select("event_id", *KEY, F.round("pct", 4).alias("pct"))


@query("temporal_dispatch", f"""WITH p AS (SELECT *, lag(value) {W} AS a, lag(value, 2) {W} AS b, lag(value, 3) {W} AS c, date_sub('day', lag(ts) {W}, ts) AS gap, row_number() {W} AS n FROM events),
    q AS (SELECT event_id, CASE WHEN value - a < -2 AND gap <= 30 THEN 'acute_drop' WHEN c < b AND b < a AND a < value THEN 'chronic_rise'
          WHEN a <> 0 AND abs((value - a) / a * 100) > 50 AND value BETWEEN 40 AND 60 AND (a < 40 OR a > 60) THEN 'sudden_normalisation' END AS rule, n FROM p)
    SELECT event_id, rule FROM q WHERE rule IS NOT NULL AND n > 2""")
def temporal_dispatch(spark, sf):
    return T.dispatch(table(spark, sf, "events"), KEY, F.lit(40.0), F.lit(60.0)).select("event_id", "rule")


@query("delta_prev", f"""WITH p AS (SELECT *, lag(value) {W} AS prev FROM events)
    SELECT event_id, round(value - prev, 6) AS delta, round(CASE WHEN prev = 0 THEN 0 ELSE (value - prev) / prev * 100 END, 4) AS delta_pct FROM p""")
def delta_prev(spark, sf):
    return T.deltas(table(spark, sf, "events"), KEY).select("event_id", F.round("delta", 6).alias("delta"), F.round("delta_pct", 4).alias("delta_pct"))


@query("last_n_per_key", """SELECT event_id, user_id, event_type, recency FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)::INTEGER AS recency FROM events) WHERE recency <= 10""")
def last_n_per_key(spark, sf):
    return T.last_n(table(spark, sf, "events"), KEY).select("event_id", *KEY, "recency")


@query("latest_status", """SELECT user_id, event_type, round(arg_max(value, {'a': ts, 'b': event_id}), 6) AS latest,
    CASE WHEN arg_max(value, {'a': ts, 'b': event_id}) < 0.7 * 20 OR arg_max(value, {'a': ts, 'b': event_id}) > 1.3 * 70 THEN 'critical'
         WHEN arg_max(value, {'a': ts, 'b': event_id}) < 20 THEN 'low' WHEN arg_max(value, {'a': ts, 'b': event_id}) > 70 THEN 'high' ELSE 'normal' END AS status
    FROM events GROUP BY 1, 2""")
def latest_status(spark, sf):
    g = table(spark, sf, "events").groupBy(*KEY).agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    v = F.col("v")
    status = F.when((v < 0.7 * 20) | (v > 1.3 * 70), "critical").when(v < 20, "low").when(v > 70, "high").otherwise("normal")
    return g.select(*KEY, F.round(v, 6).alias("latest"), status.alias("status"))


RULES = [("click", "drop", 30.0, "critical"), ("click", "drop", 20.0, "high"), ("click", "drop", None, "low"), ("view", "drop", 25.0, "high"), ("purchase", "drop", None, "medium")]
RULE_VALUES = ", ".join(f"('{a}', '{b}', {'NULL' if c is None else c}, '{d}')" for a, b, c, d in RULES)


@query("significance_join", f"""WITH p AS (SELECT event_id, event_type, value - lag(value) {W} AS change FROM events), d AS (SELECT *, 'drop' AS kind FROM p WHERE change < 0),
    r(test, kind, threshold, severity) AS (VALUES {RULE_VALUES}),
    j AS (SELECT event_id, severity, row_number() OVER (PARTITION BY event_id ORDER BY coalesce(threshold, -1) DESC) AS n FROM d
          LEFT JOIN r ON d.event_type = r.test AND d.kind = r.kind AND (threshold IS NULL OR abs(change) > threshold))
    SELECT event_id, coalesce(severity, 'medium') AS severity,
           CASE coalesce(severity, 'medium') WHEN 'critical' THEN 'immediate' WHEN 'high' THEN 'urgent' ELSE 'routine' END AS urgency FROM j WHERE n = 1""")
def significance_join(spark, sf):
    rules = spark.sql(f"SELECT test, kind, CAST(threshold AS DOUBLE) threshold, severity FROM VALUES {RULE_VALUES} AS r(test, kind, threshold, severity)")
    d = T.deltas(table(spark, sf, "events"), KEY).where("delta < 0").select("event_id", F.col("event_type").alias("test"), F.lit("drop").alias("kind"), F.col("delta").alias("change"))
    return T.significance(d, rules).select("event_id", "severity", "urgency")


@query("quality_dedup", """SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)
    ORDER BY (CASE WHEN value > 50 THEN 0.15 ELSE 0 END) + (CASE WHEN event_type IN ('click', 'view') THEN 0.1 ELSE 0.05 END) DESC, event_id) AS n FROM events) WHERE n = 1""")
def quality_dedup(spark, sf):
    score = F.when(F.col("value") > 50, 0.15).otherwise(0.0) + F.when(F.col("event_type").isin("click", "view"), 0.1).otherwise(0.05)
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return T.best_per_field(e, [*KEY, "day"], score, "event_id").select("event_id")


@query("document_order", """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY 0, turn::DOUBLE, role)::INTEGER AS position FROM conversations""")
def document_order(spark, sf):
    c = table(spark, sf, "conversations").withColumn("page", F.lit(None).cast("int")).withColumn("top", F.lit(None).cast("double"))
    return T.document_order(c, ["conv_id"], "page", "turn", "top", "role").select("conv_id", "turn", "position")


@query("point_merge", """SELECT user_id, event_type, count(*) AS n, max(ts) AS last_ts FROM
    (SELECT user_id, event_type, ts FROM events UNION ALL SELECT user_id, event_type, max(ts) + INTERVAL 1 DAY AS ts FROM events GROUP BY 1, 2) GROUP BY 1, 2""")
def point_merge(spark, sf):
    """History and a current reading of each series, appended."""
    e = table(spark, sf, "events").select(*KEY, "ts")
    current = e.groupBy(*KEY).agg((F.max("ts") + F.expr("interval 1 day")).alias("ts"))
    return e.unionByName(current).groupBy(*KEY).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
