"""Queries through the model seams, with the stand-in models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import seams
from tessera.plans.registry import query, table


@query("prompt_cache", """WITH p AS (SELECT DISTINCT text AS prompt, md5(text) AS hash FROM conversations WHERE role = 'user'), c AS (SELECT DISTINCT md5(text) AS hash FROM conversations WHERE role = 'user' AND conv_id % 2 = 0)
    SELECT hash, hash IN (SELECT hash FROM c) AS cached FROM p""")
def prompt_cache(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'user'").withColumnRenamed("text", "prompt")
    cache = c.where("conv_id % 2 = 0").select(F.md5("prompt").alias("hash"), F.lit("kept").alias("answer")).distinct()
    return seams.cached(c, cache, seams.echo_model, "hash string, answer string").select("hash", "cached")


@query("text_embedding")
def text_embedding(spark, sf):
    """Hashed-gram embeddings of texts; rows only."""
    e = seams.embed(table(spark, sf, "conversations"), "conv_id", "text")
    return e.select("conv_id", F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


_TRY = ", ".join(f"('0x' || substr(md5(prompt || ':{k}'), 1, 4))::INTEGER % 5" for k in range(4))


@query("seam_retries", f"""WITH p AS (SELECT DISTINCT text AS prompt FROM conversations WHERE role = 'user' AND text IS NOT NULL), d AS (SELECT md5(prompt) AS hash, 'Re: ' || prompt AS answer, [{_TRY}] AS d FROM p),
    k AS (SELECT *, list_position(list_transform(d, lambda x: x > 2), true) AS found FROM d)
    SELECT hash, CASE WHEN found IS NOT NULL THEN md5(answer) END AS answer, coalesce(found, 4)::INTEGER AS attempts, CASE WHEN found IS NULL THEN 'Failed after 3 retries: ' || CASE d[4] WHEN 2 THEN 'too long' ELSE 'busy' END END AS error FROM k""")
def seam_retries(spark, sf):
    """Answers and dead letters of every distinct user prompt, from a stand-in model that fails by hash."""
    p = table(spark, sf, "conversations").where("role = 'user' and text is not null").select(F.md5("text").alias("hash"), F.col("text").alias("prompt")).distinct()
    answers, dead = seams.infer_with_retries(p, "hash", seams.unsteady_model, "answer string")
    none = F.lit(None).cast("string")
    return answers.select("hash", F.md5("answer").alias("answer"), "attempts", none.alias("error")).union(dead.select("hash", none, "attempts", "error"))
