"""Similarity search and retrieval of text chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, z: s + z)


def cosine(a: Column, b: Column) -> Column:
    """0 for a vector without length; null for vectors of different sizes."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms))


def _nearest(asked: pa.Table, rows: pa.Table, k: int, least: float, chunk: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of rows, and similarities, of each query's k best of these rows.

    Products of matrices tell which rows can be among them; of those the similarity is added up component by component, in their order, so that it does not depend on
    what a row is compared beside and copies tie. Ties go to the smaller key; a similarity that is no number is over all others.
    """
    _, ids = np.unique(np.concatenate([t["key"].to_numpy() for t in (asked, rows)]), return_inverse=True)
    q_ids, v_ids = ids[: len(asked)], ids[len(asked) :]
    sizes = [pc.list_value_length(t["vector"]).to_numpy() for t in (asked, rows)]
    out = []
    for size in np.intersect1d(*sizes):
        at = [np.flatnonzero(s == size) for s in sizes]
        q, v = (pc.list_flatten(t["vector"].take(pa.array(i))).to_numpy().astype("float64").reshape(len(i), size).T.copy() for t, i in zip((asked, rows), at))
        qn, vn = (np.sqrt(sum((x * x for x in m), np.zeros(m.shape[1]))) for m in (q, v))
        for start in range(0, q.shape[1], chunk):
            part = slice(start, start + chunk)
            lengths = qn[part, None] * vn
            about = np.where(lengths == 0, 0.0, (q[:, part].T @ v) / np.where(lengths == 0, 1.0, lengths))
            about[np.isnan(about)] = np.inf
            about[q_ids[at[0][part], None] == v_ids[at[1]]] = -np.inf
            bar = np.partition(about, -k, axis=1)[:, -k] if about.shape[1] > k else np.full(len(about), -np.inf)
            i, j = np.nonzero(about >= np.maximum(bar, least)[:, None] - 1e-9)
            i += start
            dot = sum((x[i] * y[j] for x, y in zip(q, v)), np.zeros(len(i)))
            length = qn[i] * vn[j]
            alike = np.where(length == 0, 0.0, dot / np.where(length == 0, 1.0, length))
            fits = ~(alike < least)
            out.append((at[0][i[fits]], at[1][j[fits]], alike[fits]))
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    i, j, alike = map(np.concatenate, zip(*out))
    order = np.lexsort((v_ids[j], np.where(np.isnan(alike), -np.inf, -alike), i))
    i, j, alike = i[order], j[order], alike[order]
    best = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[best], j[best], alike[best]


def similar(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 3, least: float = 0.6, block: int = 8192) -> DataFrame:
    """Each query's k most similar other rows with similarity of at least `least`: query, key, similarity, rank.

    `queries` is a stated set of rows. Every block of about `block` rows meets every block of as many queries, so the work is queries x rows, by products of matrices, and a
    task holds one block of either, however many there are; a block's winners are cut to k before the shuffle. Vectors that are null or hold nulls are like nothing.
    """
    kind = rows.schema[key].dataType.simpleString()
    usable = lambda d: d.where(F.col(key).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    every, asked = usable(rows), usable(queries)
    n, m = (max(-(-d.count() // block), 1) for d in (every, asked))
    into = lambda parts: F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = asked.select("key", "vector", into(m).alias("asked_in"), all_of(n).alias("held_in"))
    right = every.select("key", "vector", all_of(m).alias("asked_in"), into(n).alias("held_in"))

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        with np.errstate(all="ignore"):
            i, j, alike = _nearest(q, v, k, least)
        return pa.table({"query": q["key"].take(pa.array(i)), key: v["key"].take(pa.array(j)), "similarity": pa.array(alike, pa.float64(), from_pandas=False)})

    cells = left.groupBy("asked_in", "held_in").cogroup(right.groupBy("asked_in", "held_in"))
    s = cells.applyInArrow(run, f"query {kind}, {key} {kind}, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cut_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most `size` characters that overlap, cut after a blank line or a sentence if one ends past the middle."""
    if overlap * 2 > size:
        raise ValueError("the overlap may not be over half of the size")
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            for mark in ("\n\n", ". "):
                at = text.rfind(mark, start, end)
                if at > start + size // 2:
                    end = at + 2
                    break
        piece = text[start:end].strip()
        if piece:
            out.append(piece)
        start = end - overlap  # past the text's end this may leave a last piece inside the one before
    return out


def chunks(docs: DataFrame, key: str, text: str, size: int = 2000, overlap: int = 200) -> DataFrame:
    """(key, index, chunk) of every text; row batches go through one Arrow pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, c) for k, t in zip(b.iloc[:, 0], b.iloc[:, 1]) for i, c in enumerate(cut_chunks(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "index", "chunk"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInPandas(run, f"{key} long, index int, chunk string")


def chunk_score(chunk: Column, keywords: list[str], asked: list[str] = ()) -> Column:
    """.1 a keyword, .2 a word of the request over three letters, .05 a number (up to .5), .3 for a range; half if short; at most 1."""
    low = F.lower(chunk)
    score = sum((F.when(low.contains(k), 0.1).otherwise(0.0) for k in keywords), F.lit(0.0))
    score = score + sum((F.when(low.contains(w), 0.2).otherwise(0.0) for w in asked if len(w) > 3), F.lit(0.0))
    score = score + F.least(F.regexp_count(chunk, F.lit(r"\d+\.?\d*")) * 0.05, F.lit(0.5)) + F.when(chunk.rlike(r"\d+\s*-\s*\d+"), 0.3).otherwise(0.0)
    return F.least(F.when(F.length(chunk) < 100, score * 0.5).otherwise(score), F.lit(1.0))


def within_budget(scored: DataFrame, key: str, score: str, order: str, length: str, budget: int) -> DataFrame:
    """Best chunks of each key until the first that would exceed the budget; the best alone is cut to it if it is longer."""
    w = Window.partitionBy(key).orderBy(F.desc(score), order)
    run = scored.withColumn("__sum", F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(w))
    kept = run.where((F.col("__sum") <= budget) | (F.col("__n") == 1))
    return kept.withColumn("taken", F.least(F.col(length), F.lit(budget))).drop("__sum", "__n")
