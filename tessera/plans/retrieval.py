"""Retrieval queries over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.plans.registry import query, table

SIM = "SELECT q.vec_id AS query, c.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0"


@query("cosine_topk", f"SELECT query, vec_id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id)::INTEGER AS rank FROM ({SIM}) WHERE s >= 0.2) WHERE rank <= 3")
def cosine_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return R.similar(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 3, 0.2).select("query", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("hint_boost", f"SELECT query, count(*) AS n, round(least(avg(s) * 0.1, 0.1), 6) AS boost FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS k FROM ({SIM}) WHERE s >= 0.2) WHERE k <= 3 GROUP BY 1")
def hint_boost(spark, sf):
    e = table(spark, sf, "embeddings")
    s = R.similar(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 3, 0.2)
    return s.groupBy("query").agg(F.count("*").alias("n"), F.round(F.least(F.avg("similarity") * 0.1, F.lit(0.1)), 6).alias("boost"))


@query("chunk_documents")
def chunk_documents(spark, sf):
    c = R.chunks(table(spark, sf, "documents"), "doc_id", "text")
    return c.select("doc_id", "index", F.length("chunk").alias("n_chars"))


KEYS = ["the", "and", "value", "result"]


@query("chunk_rank", """WITH c AS (SELECT conv_id, turn, lower(text) AS l, text FROM conversations), s AS (SELECT conv_id, turn, length(text) AS n, CASE WHEN contains(l, 'the') THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN contains(l, 'and') THEN 0.1 ELSE 0 END + CASE WHEN contains(l, 'value') THEN 0.1 ELSE 0 END
    + CASE WHEN contains(l, 'result') THEN 0.1 ELSE 0 END + CASE WHEN contains(l, 'tion') THEN 0.2 ELSE 0 END + least(len(regexp_extract_all(text, '\\d+\\.?\\d*')) * 0.05, 0.5) + CASE WHEN regexp_matches(text, '\\d+\\s*-\\s*\\d+') THEN 0.3 ELSE 0 END AS s FROM c)
    SELECT conv_id, turn, round(least(CASE WHEN n < 100 THEN s * 0.5 ELSE s END, 1), 6) AS score FROM s""")
def chunk_rank(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(R.chunk_score(F.col("text"), KEYS, ["tion", "of"]), 6).alias("score"))


@query("chunk_budget", """WITH c AS (SELECT conv_id, turn, length(text)::BIGINT AS n, sum(length(text)) OVER w AS run, row_number() OVER w AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn % 3 DESC, turn))
    SELECT conv_id, turn, least(n, 1500) AS taken FROM c WHERE run <= 1500 OR k = 1""")
def chunk_budget(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") % 3).alias("score"), F.length("text").cast("long").alias("n"))
    return R.within_budget(c, "conv_id", "score", "turn", "n", 1500).select("conv_id", "turn", "taken")


@query("simple_retrieval", "SELECT doc_id, CASE WHEN length(text) > 8000 THEN 8000 + 3 ELSE length(text) END::BIGINT AS n FROM documents")
def simple_retrieval(spark, sf):
    t = F.when(F.length("text") > 8000, F.concat(F.substring("text", 1, 8000), F.lit("..."))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(t).cast("long").alias("n"))


@query("retrieval_route", """SELECT doc_id, CASE WHEN length(text) <= 8000 THEN 'simple' WHEN contains(text, '|') AND length(text) > 10000 THEN 'fusion' ELSE 'chunked' END AS strategy FROM documents""")
def retrieval_route(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.when(F.length(t) <= 8000, "simple").when(t.contains("|") & (F.length(t) > 10000), "fusion").otherwise("chunked").alias("strategy"))


@query("hint_text", "SELECT label, string_agg(vec_id::VARCHAR, ', ' ORDER BY vec_id) AS hint FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) WHERE k <= 5 GROUP BY 1")
def hint_text(spark, sf):
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, sf, "embeddings").withColumn("k", F.row_number().over(w)).where("k <= 5")
    return e.groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("vec_id")).cast("array<string>"), ", ").alias("hint"))
