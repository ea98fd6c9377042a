"""Raw documents to token ids, in stages; each stage's rows are written as Parquet and read again by the next.

1. language ID: documents whose language is not found or not clear go; a null lang is filled in.
2. n-gram Jaccard join: of each group of near copies the document of least id stays.
3. PII: spans are replaced by their kind; n_chars follows the text.
4. mixing: quality and toxicity domains are brought to their target shares, the clean domain in full; a document of a rate
   over 1 may stand there twice.
5. byte-level BPE: ids of each text, and whether they decode to the very bytes.

All but the last return the columns of documents. Rows with a null id pass the stages that compare ids; null texts
go in the first. An empty table gives no rows. Repeated rows pass the first and third stage each; of rows of one text the second keeps
those of the least id. Very long texts are read whole in every stage. Columns beyond those of documents pass through until the last.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, jaccard_join, language_id, mixing, personal_data
from tessera.llm.common import BATCH_ROWS, materialize, table
from tessera.llm.queries import DOMAIN, DOMAIN_WEIGHTS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(spark: SparkSession) -> None:
    """Whole texts pass through every stage: batches of ten thousand rows would take too much of an executor's memory."""
    spark.conf.set(BATCH_ROWS, 1000)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language_id.accept(docs, language_id.fit(docs, F.lit(True)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    copies = jaccard_join.jaccard_components(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return personal_data.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.draw(docs, table(spark, sf_dir, "labels"), F.expr(DOMAIN), DOMAIN_WEIGHTS, full="q1t0")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    coded = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), offsets=None, exact="exact")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_domains),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

#: SQL can't express the stages; tests/llm/test_twins.py compares each with a brute-force version of its decisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
