"""Evaluation queries: labels as truth, a rule's verdict as what was found."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import consensus as C
from tessera.plans.registry import query, table

G = """t AS (SELECT doc_id, quality::DOUBLE AS truth FROM labels WHERE doc_id % 4 <> 0), f AS (SELECT doc_id, CASE WHEN n_chars > 800 THEN 1.0 ELSE 0.0 END::DOUBLE AS found, source FROM documents WHERE doc_id % 5 <> 0 AND doc_id IN (SELECT doc_id FROM labels)),
    g AS (SELECT coalesce(t.doc_id, f.doc_id) AS doc_id, source, CASE WHEN found IS NULL THEN 'missing' WHEN truth IS NULL THEN 'extra' WHEN CASE WHEN truth = 0 THEN abs(found) <= 0.01 ELSE abs(found - truth) <= abs(truth) * 0.01 END THEN 'correct' ELSE 'incorrect' END AS outcome FROM t FULL JOIN f ON t.doc_id = f.doc_id)"""
N = "count_if(outcome = 'correct') AS correct, count_if(outcome = 'incorrect') AS incorrect, count_if(outcome = 'missing') AS missing, count_if(outcome = 'extra') AS extra"
P = "s AS (SELECT *, coalesce(correct / nullif(correct + incorrect + extra, 0), 0) AS p, coalesce(correct / nullif(correct + incorrect + missing, 0), 0) AS r FROM n)"


def graded(spark, sf):
    lab = table(spark, sf, "labels")
    t = lab.where("doc_id % 4 <> 0").select("doc_id", F.col("quality").cast("double").alias("truth"))
    f = table(spark, sf, "documents").where("doc_id % 5 <> 0").join(lab.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.when(F.col("n_chars") > 800, 1.0).otherwise(0.0).alias("found"), "source")
    return C.grade(t, f, ["doc_id"])


@query("precision_recall_f1", f"WITH {G}, n AS (SELECT {N} FROM g), {P} SELECT correct, incorrect, missing, extra, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM s")
def precision_recall_f1(spark, sf):
    s = C.scores(graded(spark, sf))
    return s.select("correct", "incorrect", "missing", "extra", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("prompt_comparison", f"WITH {G}, n AS (SELECT source, {N} FROM g GROUP BY 1), {P} SELECT source, round(p, 6) AS precision, round(r, 6) AS recall FROM s WHERE source IS NOT NULL")
def prompt_comparison(spark, sf):
    return C.scores(graded(spark, sf), ["source"]).where("source is not null").select("source", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("error_topk", f"WITH {G} SELECT source, outcome, count(*) AS n, min(doc_id) AS sample FROM g WHERE outcome <> 'correct' AND source IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, source, outcome LIMIT 10")
def error_topk(spark, sf):
    e = graded(spark, sf).where("outcome <> 'correct' and source is not null").groupBy("source", "outcome").agg(F.count("*").alias("n"), F.min("doc_id").alias("sample"))
    return e.orderBy(F.desc("n"), "source", "outcome").limit(10)


@query("set_compare", f"WITH {G} SELECT outcome, count(*) AS n FROM g GROUP BY 1")
def set_compare(spark, sf):
    return graded(spark, sf).groupBy("outcome").agg(F.count("*").alias("n"))


@query("improvement_suggestions", f"WITH {G}, n AS (SELECT source, {N} FROM g GROUP BY 1), {P} SELECT source, concat_ws(';', CASE WHEN p < 0.9 THEN 'be stricter' END, CASE WHEN r < 0.7 THEN 'look further' END) AS advice FROM s WHERE source IS NOT NULL")
def improvement_suggestions(spark, sf):
    s = C.scores(graded(spark, sf), ["source"]).where("source is not null")
    advice = F.array_compact(F.array(F.when(F.col("precision") < 0.9, "be stricter"), F.when(F.col("recall") < 0.7, "look further")))
    return s.select("source", F.array_join(advice, ";").alias("advice"))
