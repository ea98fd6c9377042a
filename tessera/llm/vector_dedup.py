"""Near duplicates among vectors by counting collisions of one-dimensional projections.

Two vectors of cosine c differ, once scaled to length 1, by d = sqrt(2 - 2c), and their projections on a random direction (normal
components) by a normal variable of deviation d. So vectors are sorted by each of `projections` directions; a window of half
width `window` x d around each vector's own value collides with whatever lies inside it, and a pair's collisions are counted over the
directions. A pair at the threshold collides in one direction with the chance p = P(|N(0, 1)| <= window), so the count that a pair must
reach is the largest that a Binomial(projections, p) meets with the chance `recall`; closer pairs meet it the more surely, and unlike ones
rarely. Pairs that reach it are verified by their cosine in double precision, so no link is below the threshold; of those at or above it,
the calibration bounds the share that is missed, whatever the data.

Equal vectors are one class from the start, so thousands of copies cost one comparison. Two more directions lay the classes out in a
grid of cells; a cell of more than `block` rows is cut by a hash of the class. Only cells that are near enough in both directions (3.5
deviations) are compared, each pair of blocks in one group of at most 2 x `block` rows, where the sorting, counting and verifying is
done with arrays; a group gives its links a class and a spanning forest of them, never the pairs. One direction tells near and far
pairs apart only by a constant factor, so the work stays in proportion to the square of the distinct vectors of like cells: rows sent are
(classes x near cells' rows / block).

Vectors that are null, empty, all zero or hold a null or non-finite component link with nothing, and so do rows with a null id, which
have no component and are not kept. Vectors of unlike lengths are not compared. Rows that repeat an id are vectors of their own, each with
its links and component. Ties of ids go to the least. Very long vectors make smaller blocks. Only id and vector are read, whatever the
other columns' names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_materialized, materialize
from tessera.llm.components import components, forest

QUERIES = 256  # windows are counted for so many vectors at a time
APART = 3.5  # deviations of a pair at the threshold beyond which cells are not compared
DENSE = 0.05  # of the pairs of a step, from which on all its cosines are taken at once
KEY = ["dim", "a0", "a1", "a2", "b0", "b1", "b2"]


def collisions_needed(projections: int, window: float, recall: float) -> int:
    """The largest count that a pair at the threshold reaches with at least the chance `recall`."""
    p, missed = erf(window / sqrt(2)), 0.0
    for count in range(projections + 1):
        missed += comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if missed > 1 - recall:
            return count
    return projections


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n + 2))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, exactly, so that squares neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _rows_of(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256((v + 0.0).tobytes()).digest() for v in _rows_of(b.column(1))], pa.binary()), b.column(1)], ["id", "digest", "v"])


def count_collisions(a: np.ndarray, order: np.ndarray, values: np.ndarray, half: float) -> np.ndarray:
    """For each row of projections `a` and each sorted row, the directions in which the latter lies in the former's window."""
    hits = np.zeros((len(a), order.shape[1]), np.uint8)
    for k in range(a.shape[1]):
        lo, hi = np.searchsorted(values[k], a[:, k] - half), np.searchsorted(values[k], a[:, k] + half, side="right")
        for row, x, y in zip(hits, lo.tolist(), hi.tolist()):
            row[order[k, x:y]] += 1
    return hits


def linked_pairs(x: np.ndarray, y: np.ndarray | None, threshold: float, projections: int, window: float, recall: float, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in x, in y) of verified pairs, a step at a time; without y, pairs of x with i < j."""
    toward = directions(x.shape[1], projections, seed)[:, 2:]
    half, need = window * sqrt(2 - 2 * threshold), collisions_needed(projections, window, recall)
    x = scaled(x)
    own = y is None
    y = x if own else scaled(y)
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    px, py = x @ toward / nx[:, None], y @ toward / ny[:, None]
    order = np.argsort(py.T, axis=1)
    values = np.take_along_axis(py.T, order, axis=1)
    for lo in range(0, len(x), QUERIES):
        hit = count_collisions(px[lo : lo + QUERIES], order, values, half) >= need
        i, j = np.nonzero(hit)
        i += lo
        if own:
            i, j = i[i < j], j[i < j]
        if len(i) > DENSE * hit.size:
            cosine = (x[lo : lo + QUERIES] @ y.T)[i - lo, j] / (nx[i] * ny[j])
        else:
            cosine = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", x[i[s : s + 65536]], y[j[s : s + 65536]]) for s in range(0, len(i), 65536)]]) / (nx[i] * ny[j])
        true = cosine >= threshold
        yield i[true], j[true]


def _join_spread(rows: DataFrame, found: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows inner joined with `found`, whose column `size` says how many rows a key has: keys of over a thousandth of all rows, of which
    there are at most a thousand, are broadcast, so none is a hot partition."""
    hot = F.broadcast(found.where(F.col(size) * 1000 > total))
    rest = rows.join(hot.select(key), key, "left_anti").join(found.where(F.col(size) * 1000 <= total), key)
    return rows.join(hot, key).unionByName(rest)


def near_duplicates(
    rows: DataFrame, threshold: float = 0.95, row_id: str = "vec_id", vector: str = "embedding", projections: int = 16, window: float = 1.5, recall: float = 0.999, block: int = 8192, seed: int = 7
) -> DataFrame:
    """row_id, n_links (other rows linked), component_id (the least id of the component) and kept, one row for each row."""
    spark = rows.sparkSession
    all_rows = rows.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("v"))
    usable = F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    read = all_rows.where(usable)
    kind = read.schema["v"].dataType.simpleString()
    vectors = materialize(read.mapInArrow(_digests, f"id long, digest binary, v {kind}"), "vectors")
    total = vectors.count()

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.zeros((b.num_rows, 2))
            for n, v in enumerate(_rows_of(b.column(4))):
                v = scaled(v[None])[0]
                at[n] = v @ directions(len(v), projections, seed)[:, :2] / np.sqrt(v @ v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at[:, 0]), pa.array(at[:, 1])], [*b.schema.names, "p0", "p1"])

    classes = vectors.groupBy("digest", "v").agg(F.min("id").alias("least"), F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("class"), "digest", "least", "n", "v")
    classes = materialize(classes.mapInArrow(lay_out, f"class long, digest binary, least long, n long, v {kind}, p0 double, p1 double"), "classes")
    side = 5.0 / max(1, round(sqrt(classes.count() / block)))  # projections lie mostly within 2.5 of 0
    reach = int(APART * sqrt(2 - 2 * threshold) / side) + 1
    placed = classes.select("class", "n", "v", F.size("v").alias("dim"), F.floor(F.col("p0") / side).alias("c0"), F.floor(F.col("p1") / side).alias("c1"))
    cells = placed.groupBy("dim", "c0", "c1").agg(F.ceil(F.count("*") * F.greatest(F.lit(1.0), F.col("dim") / 1024) / block).alias("cuts"))
    cells = materialize(cells, "cells")
    # Pairs of blocks, each once: offsets of the upper half plane, and within a cell the lower cut first.
    first = cells.select("dim", *[F.col(c).alias(a) for c, a in (("c0", "a0"), ("c1", "a1"), ("cuts", "acuts"))])
    first = first.select("*", F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("d0")).select("*", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("d1")).where("d0 > 0 or d1 >= 0")
    first = first.select("dim", "a0", "a1", "acuts", (F.col("a0") + F.col("d0")).alias("b0"), (F.col("a1") + F.col("d1")).alias("b1"))
    pairs = first.join(cells.select("dim", F.col("c0").alias("b0"), F.col("c1").alias("b1"), F.col("cuts").alias("bcuts")), ["dim", "b0", "b1"])
    pairs = pairs.select("*", F.explode(F.expr("sequence(0L, acuts - 1)")).alias("a2")).select("*", F.explode(F.expr("sequence(0L, bcuts - 1)")).alias("b2"))
    pairs = pairs.where("not (a0 = b0 and a1 = b1) or a2 <= b2").select(*KEY)
    sides = pairs.select(*KEY, F.lit(0).alias("side"), F.col("a0").alias("c0"), F.col("a1").alias("c1"), F.col("a2").alias("cut"))
    sides = sides.union(pairs.where("not (a0 = b0 and a1 = b1 and a2 = b2)").select(*KEY, F.lit(1), "b0", "b1", "b2"))
    dealt = placed.join(cells, ["dim", "c0", "c1"]).withColumn("cut", F.pmod(F.xxhash64("class"), F.col("cuts"))).drop("cuts")
    groups = dealt.join(sides, ["dim", "c0", "c1", "cut"]).select(*KEY, "side", "class", "n", "v")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        which, node, n = (group[c].to_numpy() for c in ("side", "class", "n"))
        x = np.stack(_rows_of(group["v"].chunk(0)))
        a, b = np.flatnonzero(which == 0), np.flatnonzero(which == 1)
        if own := key[1:4] == key[4:7]:
            b = a
        links, tree = np.zeros(len(node), np.int64), (np.zeros(0, np.int64),) * 2
        for i, j in linked_pairs(x[a], None if own else x[b], threshold, projections, window, recall, seed) if len(a) and len(b) else ():
            i, j = a[i], b[j]
            links += (np.bincount(i, n[j], len(node)) + np.bincount(j, n[i], len(node))).astype(np.int64)
            least, root = forest(np.concatenate([tree[0], i]), np.concatenate([tree[1], j]))
            tree = least[least != root], root[least != root]
        some = np.flatnonzero(links)
        edges = [node[some], node[tree[0]]], [links[some], None], [None, node[tree[1]]]
        sizes = len(some), len(tree[0])
        return pa.table({c: pa.concat_arrays([pa.nulls(m, pa.int64()) if v is None else pa.array(v, pa.int64()) for v, m in zip(two, sizes)]) for c, two in zip(("a", "links", "b"), edges)})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    found = materialize(groups.repartition(parts, *KEY).groupBy(*KEY).applyInArrow(compare, "a long, links long, b long"), "links")
    linked = found.where("links is not null").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    root = components(found.where("b is not null").select("a", "b"), "vector-components").withColumnRenamed("node", "class")
    named = classes.select("class", "digest", "least", "n").join(linked, "class", "left").join(root, "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = materialize(named.select("digest", "least", "n", F.coalesce("links", F.lit(0)).alias("links"), "root"), "named")
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    facts = _join_spread(named, whole, "root", "size", total).select("digest", "n", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    out = _join_spread(vectors.select("id", "digest"), facts, "digest", "n", total).select("id", "n_links", "component_id")
    for t in (cells, found):
        drop_materialized(t)
    rest = all_rows.where(~usable).select("id", F.lit(0).cast("long"), "id")
    return out.union(rest).select(F.col("id").alias(row_id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
