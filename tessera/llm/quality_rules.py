"""Quality rules: base counts of every text, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed word n-grams (n = 1, 2; 2^16 buckets): one counted over a
trusted target (documents whose label is `good`), one over the whole raw corpus. A document's score is the mean over its
n-grams of log p_target - log p_raw, so length does not matter. The verdict is a fixed threshold, the same for
every document: no sampling. The target's counts are smoothed towards the raw corpus with the weight of `prior`
n-grams, so a bucket the target never shows counts against a text only as far as it should have shown it.

Counts over the raw corpus cover every document, those over the target every trusted one. The labels may be as many as the
documents, so they are joined by a shuffle; a bitmap of 2^26 hashed ids (8 MB at most, whatever the size of the table) is broadcast
first, so that the texts of few other documents are shuffled, and the join then decides. Of the counts, one row a bucket comes to the
driver and one array of 2^16 weights goes to the executors, whatever the size of the corpus.

Null and empty texts have zero counts and fail the base rule. Repeated rows are each judged; labels that repeat
a document count once if any says `good`. With no trusted document the ratio is 0 and only the base rule decides. Extra
columns are not read, whatever their names; very long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_words, mix, per_doc, slices, text_bytes, window_hashes

BITS = 16
SPACE = bytes([9, 10, 11, 12, 13, 32])
NOT_COUNTED = SPACE + bytes(range(0x80, 0xC0))  # white space and UTF-8 continuation bytes
SYMBOLS = b"#*$%&|<>"


def grams(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and word pairs; where each document's pairs begin and end."""
    shift = np.uint64(64 - BITS)
    one = (mix(np.zeros(len(h), np.uint64), h) >> shift).astype(np.int64)
    g, at = window_hashes(h, ends, 2)
    two = (g >> shift).astype(np.int64)
    return one, two, np.searchsorted(at, ends[:-1]), np.searchsorted(at, ends[1:])


def repeated_words(h: np.ndarray, ends: np.ndarray, n: int = 5) -> np.ndarray:
    """For each document, its words inside an n-word window that occurs twice or more in it."""
    g, at = window_hashes(h, ends, n)
    doc = np.searchsorted(ends, at, side="right") - 1
    g = mix(g, doc.astype(np.uint64))
    order = np.argsort(g, kind="stable")
    same = g[order][1:] == g[order][:-1]
    twice = np.zeros(len(g), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + n, -1)
    return per_doc((np.cumsum(cover)[:-1] > 0).astype(np.int64), ends[:-1], ends[1:])


SLOT_BITS = 26


def likely(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of `docs` whose hashed id one of `trusted` has too; all that join are among them."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << SLOT_BITS)) + 1
    bits = trusted.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = docs.join(F.broadcast(bits), F.bitmap_bucket_number(slot) == F.col("bucket"))
    return found.where(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).select(*docs.columns)


def fit_ratio(docs: DataFrame, labels: DataFrame, good: str = "quality = 1", prior: float = 20_000.0) -> np.ndarray:
    """log p_target - log p_raw of each bucket."""
    trusted = labels.where(F.expr(good) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    texts = docs.select("doc_id", text_bytes().alias("text"))

    def count(side: str, rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(1 << BITS, np.int64)
            for b in batches:
                texts = [t or b"" for t in b.column(0).to_pylist()]
                for lo, hi in slices(texts, len, 4_000_000):
                    one, two, *_ = grams(*hash_words([t.split() for t in texts[lo:hi]]))
                    n += np.bincount(one, minlength=1 << BITS) + np.bincount(two, minlength=1 << BITS)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (at, n[at])], ["bucket", "n"])

        return rows.select("text").mapInArrow(run, "bucket long, n long").select("bucket", F.col("n").alias(side))

    # An inner join (trusted ids are distinct): a semi join would be pushed below the bitmap.
    mine = likely(texts, trusted).join(trusted.hint("merge"), "doc_id")
    counted = count("raw", texts).unionByName(count("target", mine), allowMissingColumns=True)
    raw, target = np.full(1 << BITS, 0.5), np.zeros(1 << BITS)
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r["bucket"]] += r["raw"] or 0
        target[r["bucket"]] = r["target"] or 0
    p = raw / raw.sum()
    if not target.sum():
        return np.zeros(1 << BITS)
    return np.log((target + prior * p) / (target.sum() + prior)) - np.log(p)


def judge(docs: DataFrame, weights: np.ndarray, threshold: float = -0.15) -> DataFrame:
    """doc_id, the base counts, llr (mean log-likelihood ratio), base_failed and kept of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            for lo, hi in slices(texts, len, 4_000_000):
                part = texts[lo:hi]
                h, ends = hash_words([t.split() for t in part])
                n = np.diff(ends)
                one, two, a, z = grams(h, ends)
                total = per_doc(w[one], ends[:-1], ends[1:]) + per_doc(w[two], a, z)
                llr = total / np.maximum(n + (z - a), 1)
                lines = [[x for x in t.split(b"\n") if x.strip(SPACE)] for t in part]
                cols = [
                    b.column(0).slice(lo, hi - lo),
                    pa.array(n, pa.int64()),
                    pa.array([len(t.translate(None, NOT_COUNTED)) for t in part], pa.int64()),
                    pa.array([len(t) - len(t.translate(None, SYMBOLS)) for t in part], pa.int64()),
                    pa.array([len(x) - len(set(x)) for x in lines], pa.int64()),
                    pa.array(repeated_words(h, ends), pa.int64()),
                    pa.array(llr, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(score, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("*", failed.alias("base_failed")).select("*", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"))
