"""Store queries: orders as jobs, documents as a content store, events as the audit log and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import stores as S
from tessera.plans.registry import query, table
from tessera.sources import snapshots
from tessera.sources.shared import new_path


def jobs(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey AS job_id", "o_orderstatus AS status", "o_orderpriority AS kind", "o_orderdate AS created_at", "o_totalprice AS price")


J = "jobs AS (SELECT o_orderkey AS job_id, o_orderstatus AS status, o_orderpriority AS kind, o_orderdate AS created_at, o_totalprice AS price FROM orders)"


@query("job_list_page", f"WITH {J} SELECT job_id, status, created_at FROM jobs WHERE status = 'O' ORDER BY created_at DESC, job_id LIMIT 200 OFFSET 100")
def job_list_page(spark, sf):
    return S.page(S.filtered(jobs(spark, sf), status="O", kind=None), [F.desc("created_at"), F.col("job_id")], 200, 100).select("job_id", "status", "created_at")


@query("job_get", f"WITH {J} SELECT job_id, status, price FROM jobs WHERE job_id = 7")
def job_get(spark, sf):
    return S.get(jobs(spark, sf), "job_id", 7).select("job_id", "status", "price")


@query("hot_cold_merge", f"WITH {J} SELECT job_id, CASE WHEN job_id % 10 = 0 THEN 'active' ELSE status END AS status FROM jobs")
def hot_cold_merge(spark, sf):
    j = jobs(spark, sf).select("job_id", "status")
    return S.hot_cold(j, j.where("job_id % 10 = 0").withColumn("status", F.lit("active")), "job_id")


@query("upsert_latest", """SELECT user_id, event_type, arg_max(event_id, {'a': ts, 'b': event_id}) AS event_id, max(ts) AS ts FROM events GROUP BY 1, 2""")
def upsert_latest(spark, sf):
    return S.latest(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])


@query("upsert_replace", f"WITH {J} SELECT job_id, CASE WHEN job_id % 4 = 0 THEN price + 1 ELSE price END AS price FROM jobs")
def upsert_replace(spark, sf):
    j = jobs(spark, sf).select("job_id", "price")
    return S.upsert(j, j.where("job_id % 4 = 0").withColumn("price", F.col("price") + 1), ["job_id"])


@query("antijoin_delete", f"WITH {J} SELECT job_id FROM jobs WHERE status <> 'F'")
def antijoin_delete(spark, sf):
    j = jobs(spark, sf)
    return S.delete(j, j.where("status = 'F'").select("job_id"), ["job_id"]).select("job_id")


@query("delete_count", f"WITH {J} SELECT count(DISTINCT job_id) AS deleted FROM jobs WHERE status = 'F' OR job_id % 10 = 0")
def delete_count(spark, sf):
    """Jobs gone by a batch deletion, each counted once even if both stores hold it."""
    j = jobs(spark, sf)
    return j.where("status = 'F'").select("job_id").union(j.where("job_id % 10 = 0").select("job_id")).agg(F.countDistinct("job_id").alias("deleted"))


H = "d AS (SELECT doc_id, substr(sha256(text), 1, 32) AS h FROM documents)"


@query("insert_if_absent", f"WITH {H}, s AS (SELECT h, min(doc_id) AS doc_id FROM d WHERE doc_id % 2 = 0 GROUP BY 1) SELECT h, doc_id FROM s UNION ALL SELECT h, min(doc_id) FROM d WHERE doc_id % 2 = 1 AND h NOT IN (SELECT h FROM s) GROUP BY 1")
def insert_if_absent(spark, sf):
    d = table(spark, sf, "documents").select(S.text_hash(F.col("text")).alias("h"), "doc_id")
    stored = d.where("doc_id % 2 = 0").groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    return S.insert_if_absent(stored, d.where("doc_id % 2 = 1"), "h", "doc_id")


@query("doc_hash_dedup", f"WITH {H} SELECT h, count(*) AS copies, min(doc_id) AS first_doc FROM d GROUP BY 1 HAVING count(*) > 1")
def doc_hash_dedup(spark, sf):
    d = table(spark, sf, "documents").groupBy(S.text_hash(F.col("text")).alias("h")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return d.where("copies > 1")


@query("gated_write", "SELECT doc_id, length(substr(text, 1, 2000)) AS n_embedded FROM documents WHERE (doc_id % 100) / 100.0 >= 0.7")
def gated_write(spark, sf):
    d = table(spark, sf, "documents").withColumn("confidence", (F.col("doc_id") % 100) / 100.0)
    return S.gated(d, "confidence", 0.7, "text").select("doc_id", F.length("embedded").cast("long").alias("n_embedded"))


@query("recent_events", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 100")
def recent_events(spark, sf):
    return S.page(table(spark, sf, "events"), [F.desc("ts"), F.col("event_id")], 100).select("event_id", "ts", "event_type")


@query("event_props", """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def event_props(spark, sf):
    """Best-effort decoding of a JSON column."""
    return table(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query("audit_trail", "SELECT event_id, ts FROM events WHERE user_id = 7 ORDER BY ts, event_id")
def audit_trail(spark, sf):
    return table(spark, sf, "events").where("user_id = 7").orderBy("ts", "event_id").select("event_id", "ts")


@query("event_multiselect", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND ((value > 80) OR (event_id % 3 = 0))")
def event_multiselect(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").isin("click", "view") & ((F.col("value") > 80) | (F.col("event_id") % 3 == 0))).select("event_id")


@query("job_counts", f"WITH {J} SELECT status, count(*) AS n FROM jobs GROUP BY 1")
def job_counts(spark, sf):
    return jobs(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("group_count", "SELECT nullif(source, 'src0') AS template, count(*) AS n, round(coalesce(avg(n_chars), 0), 6) AS avg_chars FROM documents GROUP BY 1")
def group_count(spark, sf):
    """Counts and averages by template; null is a group."""
    return table(spark, sf, "documents").groupBy(F.nullif("source", F.lit("src0")).alias("template")).agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("n_chars"), F.lit(0.0)), 6).alias("avg_chars"))


@query("processing_stats", """SELECT count(*) AS total, count_if(event_type <> 'error') AS successes, count_if(event_type = 'error') AS failures, round(avg(value), 6) AS avg_duration,
    round(avg(value / 500), 6) AS avg_confidence, count_if(value > 90) AS reviews, round(count_if(event_type <> 'error') / count(*), 6) AS success_rate FROM events""")
def processing_stats(spark, sf):
    e = table(spark, sf, "events").withColumn("confidence", F.col("value") / 500)
    return S.success_stats(e, F.col("event_type") != "error", "value", "confidence", F.col("value") > 90)


@query("status_histogram", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def status_histogram(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("batch_success", "SELECT count_if(event_type = 'purchase') AS successes, count_if(event_type = 'error') AS failures, count_if(event_id % 7 = 0) AS cache_hits FROM events")
def batch_success(spark, sf):
    e = F.col("event_type")
    return table(spark, sf, "events").agg(F.count_if(e == "purchase").alias("successes"), F.count_if(e == "error").alias("failures"), F.count_if(F.col("event_id") % 7 == 0).alias("cache_hits"))


@query("metrics_percentiles", """SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
    list_sort(list(value))[CAST(floor(count(*) * 0.95::DOUBLE) AS INT) + 1] AS p95, list_sort(list(value))[CAST(floor(count(*) * 0.99::DOUBLE) AS INT) + 1] AS p99 FROM events WHERE value IS NOT NULL GROUP BY 1""")
def metrics_percentiles(spark, sf):
    return S.histogram_stats(table(spark, sf, "events"), ["event_type"], "value")


@query("metrics_rollup", """SELECT 'counter' AS kind, event_type AS name, round(sum(value), 4) AS v FROM events GROUP BY 2 UNION ALL SELECT 'gauge', event_type, round(arg_max(value, {'a': ts, 'b': event_id}), 4) FROM events GROUP BY 2""")
def metrics_rollup(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.sum("value").alias("counter"), F.max_by("value", F.struct("ts", "event_id")).alias("gauge"))
    return g.select(F.col("event_type").alias("name"), F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.round(k, 4).alias("v")) for k in ("counter", "gauge")])))


@query("perf_summary", """SELECT count(*) AS docs, count_if(event_type LIKE 'error%') AS errors, round((count(*) - count_if(event_type LIKE 'error%')) / count(*) * 100, 6) AS success_rate FROM events""")
def perf_summary(spark, sf):
    bad = F.count_if(F.col("event_type").like("error%"))
    return table(spark, sf, "events").agg(F.count("*").alias("docs"), bad.alias("errors"), F.round(F.coalesce(F.try_divide(F.count("*") - bad, F.count("*")) * 100, F.lit(0.0)), 6).alias("success_rate"))


@query("agent_metrics", "SELECT event_type AS agent, count(*) AS runs, round(sum(value), 4) AS total, round(avg(value), 6) AS average FROM events GROUP BY 1")
def agent_metrics(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("agent")).agg(F.count("*").alias("runs"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("average"))


@query("cache_stats", "SELECT user_id, count_if(event_id % 3 = 0) AS hits, count_if(event_id % 3 <> 0) AS misses, round(count_if(event_id % 3 = 0) / count(*), 6) AS hit_rate FROM events GROUP BY 1")
def cache_stats(spark, sf):
    h, m = F.count_if(F.col("event_id") % 3 == 0), F.count_if(F.col("event_id") % 3 != 0)
    return table(spark, sf, "events").groupBy("user_id").agg(h.alias("hits"), m.alias("misses"), F.round(F.coalesce(F.try_divide(h, h + m), F.lit(0.0)), 6).alias("hit_rate"))


@query("cache_expire", "SELECT event_id FROM events WHERE epoch((SELECT max(ts) FROM events))::BIGINT - epoch(date_trunc('second', ts))::BIGINT <= 86400 * 3")
def cache_expire(spark, sf):
    e = table(spark, sf, "events")
    return S.expire(e, "ts", e.agg(F.max("ts")).scalar(), 86400 * 3).select("event_id")


@query("cache_evict", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def cache_evict(spark, sf):
    return S.keep_recent(table(spark, sf, "events"), [F.desc("ts"), F.desc("event_id")], 500).select("event_id")


@query("most_accessed", "SELECT user_id, count(*) AS accesses FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def most_accessed(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("accesses")).orderBy(F.desc("accesses"), "user_id").limit(10)


@query("popularity", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def popularity(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(100)


@query("template_recent", "SELECT doc_id FROM documents WHERE source = 'src3' ORDER BY n_chars DESC, doc_id LIMIT 10")
def template_recent(spark, sf):
    return table(spark, sf, "documents").where("source = 'src3'").orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id")


@query("concat_logs", "SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT role FROM conversations) GROUP BY 1")
def concat_logs(spark, sf):
    """Two logs appended, columns matched by name."""
    e = table(spark, sf, "events").select("event_type", "value")
    c = table(spark, sf, "conversations").select(F.col("role").alias("event_type"))
    return e.unionByName(c, allowMissingColumns=True).groupBy("event_type").agg(F.count("*").alias("n"))


@query("distinct_triples", "SELECT DISTINCT p_brand, p_type, p_size FROM part")
def distinct_triples(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type", "p_size").distinct()


@query("method_fields", "SELECT event_type AS field FROM events UNION SELECT role FROM conversations")
def method_fields(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("field")).union(table(spark, sf, "conversations").select("role")).distinct()


@query("token_counts", "SELECT conv_id, count(*) AS turns, sum(length(text) - length(replace(text, ' ', '')) + 1) AS words, count_if(role = 'user') AS prompts FROM conversations GROUP BY 1")
def token_counts(spark, sf):
    c = table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).cast("long").alias("words"), F.count_if(F.col("role") == "user").alias("prompts"))


@query("cache_reloaded", """WITH c AS (SELECT user_id, event_type, count(*) AS writes, max(ts) AS created, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_id % 7 > 0 GROUP BY 1, 2), m AS (SELECT max(ts) AS now FROM events)
    SELECT user_id, event_type, writes, value FROM c, m WHERE event_type = 'view' OR now - created <= INTERVAL 10 DAY""")
def cache_reloaded(spark, sf):
    """A cache of the last value of users and types, saved, saved anew, and loaded without what has outlived its time."""
    e = table(spark, sf, "events")
    path = new_path(spark, "cache")

    def cache(rows):
        last = rows.groupBy("user_id", "event_type").agg(F.count("*").alias("writes"), F.max("ts").alias("created"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))
        return last.withColumn("ttl_seconds", F.when(F.col("event_type") != "view", 10 * 86_400))

    snapshots.save(cache(e.where("event_id % 2 = 0")), path, "first")
    snapshots.save(cache(e.where("event_id % 7 > 0")), path, "second")
    now = e.agg(F.max("ts").alias("now"))
    kept = snapshots.fresh(snapshots.load(spark, path).join(F.broadcast(now)), F.col("now"))
    return kept.select("user_id", "event_type", "writes", "value")
