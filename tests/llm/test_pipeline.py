"""The pipeline's stages on whole small tables: schemas, decisions, and the last stage's rows."""

import corpus_pipeline as c
from pyspark.sql import functions as F

from tessera.llm import jaccard_join
from tessera.llm.common import materialize, table


def test_stages(spark, sf):
    docs, names = table(spark, sf, "documents"), table(spark, sf, "documents").columns
    rows = {}
    for k, (name, stage) in enumerate(c.STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf))
        rows[k] = docs
        assert k == 4 or docs.columns == names
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert rows[0].where("lang is null or not text rlike '[A-Za-z]'").count() == 0
    kept = jaccard_join.jaccard_components(rows[0]).where("doc_id = component_id")
    assert rows[1].count() == kept.count()
    assert rows[2].where(F.col("text").rlike("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][a-z]")).count() == 0
    clean = table(spark, sf, "labels").where("quality = 1 and toxic = 0")
    assert rows[3].dropDuplicates(["doc_id"]).join(clean, "doc_id", "left_semi").count() >= 0.95 * rows[2].join(clean, "doc_id", "left_semi").count()
    assert rows[4].where("not exact or n_tokens <> size(ids)").count() == 0 and rows[4].count() == rows[3].count()


def test_null_texts_and_ids(spark, sf):
    d = spark.createDataFrame([(1, None, "en", "s", 0), (None, "the cat and the dog", "en", "s", 19), (2, "le chat et le chien", "fr", "s", 19)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in c.STAGES:
        d = materialize(stage(spark, d, sf))
    assert d.count() <= 2


def test_mixing_draws_the_shares_it_fits(spark, sf):
    """Labelled tokens drawn, by domain, against the targets."""
    big = sf.replace("0.001", "0.1")
    docs, labels = table(spark, big, "documents").where("text is not null"), table(spark, big, "labels")
    drawn = c.mix_domains(spark, docs, big)
    tokens = {}
    for k, d in (("before", docs), ("after", drawn)):
        n = d.join(labels, "doc_id").groupBy(F.expr(c.DOMAIN).alias("d")).agg(F.sum(F.size(F.split("text", "\\s+"))).alias("n")).collect()
        tokens[k] = {r["d"]: r["n"] for r in n}
    after = {k: v / sum(tokens["after"].values()) for k, v in tokens["after"].items()}
    assert abs(after["q1t0"] - c.DOMAIN_WEIGHTS["q1t0"]) < 0.03
    assert tokens["after"]["q1t0"] >= 0.95 * tokens["before"]["q1t0"]


def test_empty_tables(spark, sf):
    d = table(spark, sf, "documents").where("false")
    for name, stage in c.STAGES:
        d = materialize(stage(spark, d, sf))
        assert d.count() == 0
