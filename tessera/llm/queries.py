"""The queries of this package, one an operator, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, conversation_repair, filter_audit, html_text, jaccard_join, language_id, mixing, personal_data, quality_model, quality_rules, url_rules, vector_dedup, vector_search
from tessera.llm.common import materialize, table

#: The folds that labels may be learned from leave out these remainders of the id's checksum.
LANGUAGE_HELD_OUT = "crc32(cast(doc_id as string)) % 3 = 1"
QUALITY_HELD_OUT = "crc32(cast(doc_id as string)) % 4 = 2"
#: Domains of the mixture (quality and toxicity of the labelled documents) and their shares of its tokens.
DOMAIN = "concat('q', quality, 't', toxic)"
DOMAIN_WEIGHTS = {"q1t0": 0.97, "q0t0": 0.02, "q1t1": 0.007, "q0t1": 0.003}
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op2_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit_ratio(docs, table(spark, sf_dir, "labels")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.detect(table(spark, sf_dir, "documents")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(quality_model.with_statistics(table(spark, sf_dir, "documents")), "statistics")
    labels = table(spark, sf_dir, "labels").where(~F.expr(QUALITY_HELD_OUT)).select("doc_id", "quality")
    scored = quality_model.predict(rows, quality_model.fit(rows.join(labels, "doc_id")))
    return scored.select("doc_id", F.expr(QUALITY_HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs, ~F.expr(LANGUAGE_HELD_OUT)))
    return found.select("doc_id", F.expr(LANGUAGE_HELD_OUT).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_to_targets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.expr(DOMAIN), DOMAIN_WEIGHTS, full="q1t0")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with rows dropped, emptied, cut off, repeated or given to the user by a checksum of conversation and turn."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(name) % 20).alias("d")).where("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("d") == 3, 2).otherwise(1)
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    summary, repaired = conversation_repair.repair(damaged(conversations))
    every = conversations.select("conv_id").distinct()
    found = every.join(summary.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    found = found.join(conversation_repair.sha256_of(repaired).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    return found.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_top_k_search": op2_top_k_search,
    "op3_quality_rules": op3_quality_rules,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_html_text": op5_html_text,
    "op6_personal_data": op6_personal_data,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_language_id": op8_language_id,
    "op9_url_filters": op9_url_filters,
    "op10_mixing": op10_mixing,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_dedup": op12_vector_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op2_top_k_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_url_filters": """
        WITH rules(rhost, rpath, verdict) AS (
            VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                   ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
        ), p AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
            FROM pages
        ), hit AS (
            SELECT page_id, rhost || rpath AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
            FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        )
        SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM p LEFT JOIN hit ON hit.page_id = p.page_id AND n = 1""",
    "op11_filter_audit": """
        WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
        first AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
        w AS (
            SELECT t.*, regexp_extract_all(t.text, '[^\\x20\\x09-\\x0D]+') AS words, coalesce(doc_id > least, false) AS copy
            FROM t JOIN first ON t.text = first.text
        ), m AS (
            SELECT doc_id, part,
                   CAST(len(words) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INTEGER)
                   + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS INTEGER)
                   + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(copy AS INTEGER) AS mask
            FROM w
        ), l AS (
            SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
        ), c AS (
            SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY ALL
        ), f AS (SELECT unnest([{'l': 'A', 'b': 1}, {'l': 'B', 'b': 2}, {'l': 'C', 'b': 4}, {'l': 'D', 'b': 8}, {'l': 'E', 'b': 16}], recursive := true)),
        o AS (
            SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
            FROM f a JOIN f b ON b.b <> a.b JOIN f c ON c.b NOT IN (a.b, b.b) JOIN f d ON d.b NOT IN (a.b, b.b, c.b) JOIN f e ON e.b NOT IN (a.b, b.b, c.b, d.b)
        ), s AS (
            SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
            FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)
        )
        SELECT part, filter_order, step,
               CAST(sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
               CAST(sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
               CAST(sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
               CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
               CAST(sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
               CAST(sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
               CAST(sum(CASE WHEN mask & own > 0 THEN n * 120 // bit_count(mask) ELSE 0 END) AS BIGINT) AS shapley
        FROM c, s GROUP BY part, filter_order, step""",
    "op12_vector_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS w FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), e AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.w) = len(b.w) WHERE list_cosine_similarity(a.w, b.w) >= 0.95
        ), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a), c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, least(vec_id, coalesce(c.least, vec_id)) = vec_id AS kept
        FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
}
