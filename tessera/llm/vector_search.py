"""Exact top-k search by inner product, exhaustive and term at a time.

Vectors become integer term weights (term = component index, weight = floor(scale * component)). The rows are dealt to
shards of about `shard` rows by a hash of id and vector, and every query row is sent to every shard: a shard's task holds its
rows and lets the queries pass in blocks, so nothing goes through the driver and no task holds all queries. In a task,
each term's postings (the rows of the shard with a weight for
it) are scattered, weighted, into a dense array of scores (queries x rows of a chunk); a partition selection
keeps each query's k best of the shard, ties to the smaller id, and the shards' winners are merged with a
window over (shards x k) rows a query.

Rows whose vector is null, empty of finite meaning (a null, NaN or infinite component) or whose id is null take no
part. Vectors may differ in length: a missing component weighs nothing. Rows that repeat an id are candidates
each by itself, but never for a query with the same id; a repeated query row counts once (the least vector).
Scores are 64-bit integers. Only id and vector are read, whatever the other columns' names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 8192


def _matrix(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x terms) int64 weights of the usable vectors, and which rows those are."""
    sizes = np.diff(column.offsets.to_numpy())
    ok = np.asarray(column.is_valid())
    flat = column.values.slice(column.offsets[0].as_py(), int(sizes.sum()))
    holes = np.asarray(flat.is_null())
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    x[holes] = np.nan
    row = np.repeat(np.arange(len(sizes)), sizes)
    bad = np.bincount(row[~np.isfinite(x)], minlength=len(sizes)) > 0
    ok &= ~bad
    place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    m = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    good = ok[row]
    m[row[good], place[good]] = np.floor(x[good] * scale).astype(np.int64)
    return m[ok], np.flatnonzero(ok)


def _select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of one row of scores, ties to the smaller id."""
    if len(scores) > k:
        least = scores[np.argpartition(-scores, k - 1)[:k]].min()
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _best(q: np.ndarray, qid: np.ndarray, m: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, id and score of the k best rows of a shard for each query of a block."""
    out = [(np.zeros(0, np.int64),) * 3]
    for a in range(0, len(qid), 512):
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in qid[a : a + 512]]
        for lo in range(0, len(ids), CHUNK):  # scores of 512 queries and one chunk at a time
            part, own = m[lo : lo + CHUNK], ids[lo : lo + CHUNK]
            score = np.zeros((len(found), len(own)), np.int64)
            for t in range(min(q.shape[1], m.shape[1])):
                who, has = np.flatnonzero(q[a : a + 512, t]), np.flatnonzero(part[:, t])
                if not len(who) or not len(has):
                    continue
                w = q[a : a + 512, t][who][:, None] * part[has, t]
                if len(has) == len(own) and len(who) == len(score):
                    score += w
                else:
                    score[np.ix_(who, has)] += w
            for i, s in enumerate(score):
                mine = np.flatnonzero(own == qid[a + i])
                rest = np.delete(np.arange(len(own)), mine) if len(mine) else slice(None)
                best = _select(s[rest], own[rest], k)
                found[i].append((own[rest][best], s[rest][best]))
        for i, parts in enumerate(found):
            near, s = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
            best = _select(s, near, k)
            out.append((np.full(len(best), qid[a + i]), near[best], s[best]))
    return tuple(np.concatenate([o[j] for o in out]) for j in range(3))


def top_k(rows: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, row_id: str = "vec_id", vector: str = "embedding", shard: int = 100_000) -> DataFrame:
    """query_id, rank (from 1), row_id, score: each query row's k best other rows."""
    spark = rows.sparkSession
    usable = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    every = rows.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks")).where(F.col("id").isNotNull() & usable)
    queries = every.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    shards = max(-(-rows.where(F.col(row_id).isNotNull()).count() // shard), int(spark.conf.get("spark.sql.shuffle.partitions")))
    data = every.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), "id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("kind"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, own = None, [], None  # the shard, its rows so far, and all of them as one matrix
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy() * 2 + b.column(1).to_numpy()
            edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(key)]):
                now, is_asked = divmod(int(key[lo]), 2)
                if now != at:
                    at, held, own = now, [], None
                (m, _), ids = _matrix(b.column(3).slice(lo, hi - lo), scale), b.column(2).slice(lo, hi - lo).to_numpy()
                if not is_asked:
                    held.append((m, ids))
                    continue
                if own is None:
                    width = max((x.shape[1] for x, _ in held), default=0)
                    own = np.concatenate([np.zeros((0, width), np.int64), *[np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x, _ in held]]), np.concatenate([np.zeros(0, np.int64), *[i for _, i in held]])
                if len(own[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _best(m, ids, *own, k)], ["query_id", row_id, "score"])

    work = data.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "id")
    found = work.mapInArrow(run, f"query_id long, {row_id} long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), row_id)
    return found.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k).select("query_id", "rank", row_id, "score")
