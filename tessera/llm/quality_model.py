"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each text becomes a short vector of statistics (lengths, shares of character kinds, repetition), log-scaled. A
class's density is Gaussian with its mean and a covariance shrunk towards the pooled diagonal; the score is the
logistic of the difference of log densities, read off Mahalanobis distances through Cholesky factors that are
inverted once and sent to the executors.

Sums and sums of products of all learning rows give the fit: one pass, and (d + 1)^2 numbers a class reach the
driver. The statistics are computed once over whole texts and written to the shared folder, so fitting and
scoring both read the small table. Only the text enters a score.

Null texts count as empty; empty texts have the statistics of an empty text and are scored as such. Labels that
repeat a document count each; labels other than 0 and 1 and labels of unknown documents are left out. With
fewer than two rows of a class the score is the share of label 1 (0.5 without labels). Repeated rows are each scored, alike. Very
long texts are read whole. Only id and text are read, whatever the other columns' names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_words, slices, text_bytes
from tessera.llm.quality_rules import NOT_COUNTED, SPACE, repeated_words

UPPERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
ENDINGS = b".,;:!?"
MARKS = b"#*$%&|<>{}[]()=+@\\/^~_\"'-"
STATISTICS = ("words", "word_length", "longest", "upper", "digits", "endings", "shouts", "marks", "distinct", "repeated", "dup_lines", "short_words", "long_words", "line_words")


def statistics(texts: list[bytes]) -> np.ndarray:
    """(texts x statistics), transformed."""
    words = [t.split() for t in texts]
    h, ends = hash_words(words)
    n = np.maximum(np.diff(ends), 1).astype(float)
    chars = np.array([len(t.translate(None, NOT_COUNTED)) for t in texts], float)
    size = np.maximum(chars, 1)
    share = lambda kinds: np.array([len(t) - len(t.translate(None, kinds)) for t in texts], float) / size
    lines = [[x for x in t.split(b"\n") if x.strip(SPACE)] for t in texts]
    rare = lambda x: np.log(x + 0.002)
    lengths = [np.fromiter(map(len, w), np.int64, len(w)) for w in words]
    return np.column_stack([
        np.log1p(np.diff(ends)),
        np.log(size / n),
        np.log1p([x.max(initial=0) for x in lengths]),
        rare(share(UPPERS)),
        rare(share(DIGITS)),
        rare(share(ENDINGS)),
        rare(share(b"!")),
        rare(share(MARKS)),
        np.array([len(set(w)) for w in words]) / n,
        rare(repeated_words(h, ends) / n),
        rare(np.array([(len(x) - len(set(x))) / max(len(x), 1) for x in lines])),
        np.array([(x <= 3).sum() for x in lengths]) / n,
        np.array([(x >= 12).sum() for x in lengths]) / n,
        np.log1p(n / np.maximum([len(x) for x in lines], 1)),
    ])


def with_statistics(docs: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """row_id and the array of statistics of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            for lo, hi in slices(texts, len, 4_000_000):
                x = statistics(texts[lo:hi])
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), flat], [row_id, "x"])

    return docs.select(F.col(row_id).cast("long").alias(row_id), text_bytes()).mapInArrow(run, f"{row_id} long, x array<double>")


@dataclass
class Discriminant:
    means: list[np.ndarray]
    whiten: list[np.ndarray]  # inverses of the Cholesky factors
    offsets: list[float]  # log prior less half the log determinant
    flat: float | None = None  # the score of every row, where there is nothing to tell apart

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        d = [o - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for m, w, o in zip(self.means, self.whiten, self.offsets)]
        return 1 / (1 + np.exp(-np.clip(d[1] - d[0], -500, 500)))


def fit(labelled: DataFrame, label: str = "quality", shrink: float = 0.1) -> Discriminant:
    """Fit to rows with an array `x` and a 0/1 label."""
    d = len(STATISTICS) + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d, d))
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float).reshape(-1, d - 1)
            y = b.column(1).to_numpy()
            x = np.column_stack([np.ones(len(x)), x])
            for k in (0, 1):
                total[k] += x[y == k].T @ x[y == k]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "v"])

    rows = labelled.where(F.col(label).isin(0, 1)).select("x", F.col(label).cast("long").alias("y")).mapInArrow(sums, "cell long, v double")
    total = np.zeros(2 * d * d)
    for r in rows.groupBy("cell").agg(F.sum("v").alias("v")).collect():
        total[r["cell"]] = r["v"]
    total = total.reshape(2, d, d)
    n = total[:, 0, 0]
    if n.min() < 2:
        return Discriminant([], [], [], float(n[1] / n.sum()) if n.sum() else 0.5)
    means = [t[0, 1:] / t[0, 0] for t in total]
    covs = [t[1:, 1:] / t[0, 0] - np.outer(m, m) for t, m in zip(total, means)]
    pooled = np.diag(np.diag((n[0] * covs[0] + n[1] * covs[1]) / n.sum())) + 1e-4 * np.eye(d - 1)
    whiten, offsets = [], []
    for k in (0, 1):
        low = np.linalg.cholesky((1 - shrink) * (covs[k] + covs[k].T) / 2 + shrink * pooled)
        whiten.append(np.linalg.inv(low))
        offsets.append(float(np.log(n[k] / n.sum()) - np.log(np.diag(low)).sum()))
    return Discriminant(means, whiten, offsets)


def predict(rows: DataFrame, model: Discriminant, row_id: str = "doc_id") -> DataFrame:
    """row_id and score of each row of `with_statistics`."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.scores(x), pa.float64())], [row_id, "score"])

    return rows.select(row_id, "x").mapInArrow(run, f"{row_id} long, score double")
