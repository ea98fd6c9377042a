"""Windowed counts as a batch, and as a stream drained once."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tessera.plans.registry import query, table
from tessera.sources.shared import new_path
from tessera.streaming import events as S
from tessera.streaming import jobs as J

SQL = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@query("events_tumbling", SQL)
def events_tumbling(spark, sf):
    return S.tumbling(table(spark, sf, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("events_tumbling_stream", SQL)
def events_tumbling_stream(spark, sf):
    rows = S.drain(S.tumbling(S.read_stream(spark, sf, "events")), new_path(spark, "tumbling"))
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "epoch").alias("m"))
    return last.select("start", "event_type", "m.n", F.round("m.total", 4).alias("total"))


# Jobs of users: a view is a poll, every other event a write of a status; states live for a day.
STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status"


@query("job_states_stream", f"""WITH e AS (SELECT user_id AS job, event_id, ts, event_type = 'view' AS is_poll, {STATUS} FROM events), w AS (SELECT * FROM e WHERE NOT is_poll),
    p AS (SELECT job, count(*) FILTER (b.ts IS NOT NULL) AS hits, count(*) FILTER (b.ts IS NULL) AS misses FROM
        (SELECT a.job, a.event_id, max(w.ts) AS ts FROM (SELECT * FROM e WHERE is_poll) a LEFT JOIN w ON w.job = a.job AND w.ts <= a.ts AND a.ts - w.ts <= INTERVAL 24 HOUR GROUP BY 1, 2) b GROUP BY 1),
    l AS (SELECT job, arg_max(status, (ts, event_id)) AS status, max(ts) AS written, count(*) AS writes FROM w GROUP BY 1), m AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM events)
    SELECT job, CASE WHEN written + INTERVAL 24 HOUR < mark THEN 'expired' ELSE status END AS status, written, coalesce(writes, 0)::INTEGER AS writes, coalesce(hits, 0)::INTEGER AS hits, coalesce(misses, 0)::INTEGER AS misses
    FROM l FULL JOIN p USING (job), m""")
def job_states_stream(spark, sf):
    """The last states of all jobs after the stream of events is drained."""
    e = S.read_stream(spark, sf, "events").withColumn("is_poll", F.col("event_type") == "view").selectExpr("user_id AS job", "event_id", "ts", "is_poll", STATUS)
    last = J.last_states(J.drain_jobs(J.job_updates(e, timedelta(hours=24)), new_path(spark, "jobs")))
    return last.select("job", "status", F.col("written").cast("timestamp_ntz").alias("written"), "writes", "hits", "misses")
