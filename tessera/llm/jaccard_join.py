"""N-gram Jaccard join: rare-first prefix filtering, joined on prefix n-grams, each pair verified once.

A document's set holds its distinct n-word shingles (A-Z lower-cased, words split at ASCII white space; a text
with fewer words is one shingle, a text without words has the empty set and links with nothing). Two
documents link when 100 * intersection >= percent * union.

1. `summaries`: one pass over the texts gives each document's set size, a 128-bit key of its set, a histogram
   of its shingles over hash ranges, and how often each of 2^19 buckets of shingles occurs in the corpus (a
   table of fixed size; all documents are counted). Documents with equal keys form a class; its least id
   stands for it, and copies are never paired.
2. `postings`: shingles are ordered rare first (by their bucket's count in half-octaves over the mean, then by
   hash), and the first |s| - ceil(t |s|) + 1 of each set are joined on: two sets that link share one of them. A
   task emits each set once, however many copies it reads. Of a shingle that more than `run` sets of one buffer have, `run` + 1
   rows go to the shingle's task, which is enough to tell that the run is long; the rest are dealt to all tasks by id.
3. Shingles with one posting are dropped. In a run of postings of one shingle with up to `run` sets, pairs pass
   the length filter and the positional filter; of the shingles a pair shares, the first in the order is kept, and then, once a
   pair, the suffix filter bounds what both can have in common after it (`after_match`, with histograms of about two
   shingles a hash range). Longer runs are not paired: a task holds the
   histograms of a run (beyond `SPAN` sets, of two blocks of it), applies the same filters, and gives a spanning forest of the pairs
   that pass, skipping pairs it has connected already. Pairs and forests give clusters by connected components.
4. Sets are dealt to tasks by their cluster and block (about `block` shingles), and verified there. In a cluster without a long
   run, each candidate pair is verified once, and a task gets the sets that its pairs name. In a cluster with one, where most pairs
   are candidates and there would be as many rows as pairs, every pair of blocks is verified with an inverted index: every pair of sets
   once. What leaves a task is a row a set (its links, and the least set it reaches), never a row a pair.

So rows stay in proportion to documents even where thousands of near copies all resemble each other; a
cluster with a long run is shipped as often as it has blocks (the links of a set can be told only where it meets all others). Components
of the links give the result.

Null and empty texts: the empty set, a component of their own. Ids are unique; rows that repeat an id with another
text link as one document, and a null id is left out. Columns other than the id and text are not read. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import columns, drop_materialized, hash_words, materialize, mix, release, slices, text_bytes, window_hashes
from tessera.llm.components import components, forest

BUCKET_BITS = 19
RANGE_BITS = (3, 13)
BYTES = 1_500_000
SPAN = 4096
#: Postings a task gathers before it looks for long runs among them.
BUFFER = 200_000


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    h, ends = hash_words([t.lower().split() for t in texts])
    g, at = window_hashes(h, ends, n)
    lo, hi = np.searchsorted(at, ends[:-1]), np.searchsorted(at, ends[1:])
    out = []
    for i, k in enumerate(np.diff(ends)):
        if k >= n:
            out.append(np.unique(g[lo[i] : hi[i]]))
        elif k:
            whole = np.full(1, k, np.uint64)
            for w in h[ends[i] : ends[i + 1]]:
                whole = mix(whole, w)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def histogram(grams: np.ndarray) -> bytes:
    """How many of the hashes lie in each of 2^k equal ranges, about two a range so that the bound stays sharp for any size."""
    k = min(max(int(np.log2(max(len(grams), 1) / 2)) if len(grams) > 2 else 0, RANGE_BITS[0]), RANGE_BITS[1])
    return np.minimum(np.bincount((grams >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k), 255).astype(np.uint8).tobytes()


def folded(h: np.ndarray, width: int) -> np.ndarray:
    """Histograms (rows x ranges) over `width` ranges, by adding up neighbours."""
    return h.reshape(len(h), width, -1).sum(2, dtype=np.int16)


def least_overlap(a, b, percent: int):
    """The least intersection with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def _batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for b in batches:
        ids, texts = b.column(0).to_numpy(), [t or b"" for t in b.column(1).to_pylist()]
        for lo, hi in slices(texts, len, BYTES):
            yield ids[lo:hi], shingle_sets(texts[lo:hi], n)


def summaries(docs: DataFrame, n: int, row_id: str, text: str) -> DataFrame:
    """Rows (id, size, k1, k2, ranges) of documents and, with a null id, (count as size, bucket as k1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << BUCKET_BITS, np.int64)
        for ids, sets in _batches(batches, n):
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            count += np.bincount((every >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(count))
            keys = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            ranges = [histogram(s) for s in sets]
            half = [np.array([(k >> s) & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64).astype(np.int64) for s in (0, 64)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(half[0]), pa.array(half[1]), pa.array(ranges, pa.binary())], ["id", "size", "k1", "k2", "ranges"])
        at = np.flatnonzero(count)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(count[at]), pa.array(at), none, pa.nulls(len(at), pa.binary())], ["id", "size", "k1", "k2", "ranges"])

    source = docs.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long"), text_bytes(text))
    return source.mapInArrow(run, "id long, size long, k1 long, k2 long, ranges binary")


def rarity(summary: DataFrame) -> np.ndarray:
    """The rank in the rare-first order of each bucket of shingles."""
    count = np.zeros(1 << BUCKET_BITS)
    bucket, n = columns(summary.where("id is null").groupBy("k1").agg(F.sum("size").alias("n")))
    count[bucket.to_numpy()] = n.to_numpy()
    return np.floor(2 * np.log2(np.maximum(count / max(count.mean(), 1e-9), 1))).astype(np.uint8)


def postings(docs: DataFrame, rank: np.ndarray, n: int, percent: int, run: int, row_id: str, text: str) -> DataFrame:
    """(gram, id, size, place, rank, extra) of the prefix of each distinct set a task meets.

    `extra` marks rows beyond the first `run` + 1 of a gram in a buffer.
    """
    sent = docs.sparkSession.sparkContext.broadcast(rank)
    names = ["gram", "id", "size", "place", "rank", "extra"]

    def flush(parts: list[tuple]) -> pa.RecordBatch:
        cols = [np.concatenate([p[j] for p in parts]) for j in range(5)]
        order = np.argsort(cols[0], kind="stable")
        g = cols[0][order]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        nth = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
        return pa.RecordBatch.from_arrays([*[pa.array(c[order].astype(np.int64)) for c in cols[:4]], pa.array(cols[4][order].astype(np.int32)), pa.array((nth > run).astype(np.int32))], names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen, parts, held = sent.value, set(), [], 0
        for ids, sets in _batches(batches, n):
            for i, s in zip(ids, sets):
                key = xxhash.xxh3_128_digest(s.tobytes())
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                r = rank[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                k = len(s) - -(-percent * len(s) // 100) + 1
                order = np.argsort(r, kind="stable")[:k]  # within a rank by hash: s is sorted
                parts.append((s[order].view(np.int64), np.full(k, i), np.full(k, len(s)), np.arange(k), r[order]))
                held += k
            if held >= BUFFER:
                yield flush(parts)
                parts, held = [], 0
        if parts:
            yield flush(parts)

    source = docs.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long"), text_bytes(text))
    return source.mapInArrow(emit, "gram long, id long, size long, place long, rank int, extra int")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by the first column, those whose value another row has too."""
    held: pa.RecordBatch | None = None
    twin = False  # whether the held row is like the one before it
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([held, b] if held is not None else [b]).combine_chunks()
        g = t.column(0).to_numpy()
        same = g[1:] == g[:-1]
        keep = np.zeros(len(g), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= twin
        twin = bool(keep[-1])
        yield from t.slice(0, len(g) - 1).filter(pa.array(keep[:-1])).combine_chunks().to_batches()
        held = t.slice(len(g) - 1).to_batches()[0]
    if held is not None and twin:
        yield held


def _candidates(percent: int, longest: int):
    """Of postings sorted by gram, size and id: pairs of short runs that pass (kind 0: a, b, their places and the gram), and
    postings of long ones (kind 1: the gram as a, the id as b, its place as pa)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "id", "size", "place", "rank"]
        held = [np.zeros(0, np.int64)] * 5
        going: int | None = None  # the gram of a long run of which part is done

        def emit(a, b, pa_, pb, gram, rank, kind):
            cols = [pa.array(a), pa.array(b), pa.array(pa_), pa.array(pb), pa.array(gram), pa.array(rank.astype(np.int32)), pa.array(np.full(len(a), kind, np.int32))]
            return pa.RecordBatch.from_arrays(cols, ["a", "b", "pa", "pb", "gram", "rank", "kind"])

        def work(g, i, s, p, r):
            nonlocal going
            if not len(g):
                return
            edges = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            length = np.diff(np.append(edges, len(g)))
            long = length > longest
            long[0] |= going == g[0]
            big = np.repeat(long, length)
            if big.any():
                yield emit(g[big], i[big], p[big], p[big], g[big], r[big], 1)
            going = int(g[-1]) if big[-1] else None
            g, i, s, p, r = (x[~big] for x in (g, i, s, p, r))
            for k in range(1, longest):
                at = np.flatnonzero(g[k:] == g[:-k])
                if not len(at):
                    break
                a, b = at, at + k  # sizes ascend within a gram
                ok = (i[a] != i[b]) & (100 * s[a] >= percent * s[b])
                ok &= np.minimum(s[a] - p[a], s[b] - p[b]) >= least_overlap(s[a], s[b], percent)
                if ok.any():
                    a, b = (np.where(i[a] < i[b], x, y)[ok] for x, y in ((a, b), (b, a)))
                    order = np.lexsort((p[a], i[b], i[a]))
                    a, b = a[order], b[order]
                    first = np.append(True, (i[a][1:] != i[a][:-1]) | (i[b][1:] != i[b][:-1]))
                    a, b = a[first], b[first]
                    yield emit(i[a], i[b], p[a], p[b], g[a], r[a], 0)

        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_numpy() for c in names]
            extra = b.column(b.schema.get_field_index("extra")).to_numpy() > 0
            if extra.any():
                g, i, _, p, r = (c[extra] for c in cols)
                yield emit(g, i, p, p, g, r, 1)
            new = [np.concatenate([h, c[~extra]]) for h, c in zip(held, cols)]
            g = new[0]
            if not len(g):
                continue
            last = int(np.searchsorted(g, g[-1]))
            if len(g) - last > longest:
                last = len(g)  # a long run need not be held together
            yield from work(*[x[:last] for x in new])
            held = [x[last:] for x in new]
        yield from work(*held)

    return run


def after_match(h_a, h_b, p_a, p_b, gram: int, rank: int):
    """An upper bound of what sets with these histograms (rows x ranges, one width) have in common, if `gram`, at these
    places, is the first shingle in the order that they share.

    Nothing before it is common. Shingles of the first rank are in the order of their hashes, so those before the match lie in its
    range or below: what the histograms hold above its range comes after it, and of what they hold up to there all but place + 1.
    Beyond the first rank the places do not tell ranges, and the whole histograms bound it.
    """
    common = np.minimum(h_a, h_b)
    if rank:
        return common.sum(-1)
    at = (gram & 0xFFFFFFFFFFFFFFFF) * h_a.shape[-1] >> 64
    below = [h[..., : at + 1].sum(-1) - p - 1 for h, p in ((h_a, p_a), (h_b, p_b))]
    return 1 + common[..., at + 1 :].sum(-1) + np.minimum(*below)


def _suffix_filter(percent: int):
    """Keep pairs whose histograms allow, after the match, the overlap that a link needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            need = least_overlap(b.column(4).to_numpy(), b.column(5).to_numpy(), percent).tolist()
            ok = []
            for x, y, least, *match in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), need, *[b.column(k).to_pylist() for k in (6, 7, 8, 9)]):
                h = [np.frombuffer(z, np.uint8)[None, :] for z in (x, y)]
                full = any((z == 255).any() for z in h)  # counts end there
                width = min(len(x), len(y))
                ok.append(full or int(after_match(*[folded(z, width) for z in h], *match)[0]) >= least)
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[list, ...]]:
    """Of rows sorted by the first column, the other columns of each group as lists; a group fits in memory."""
    task, rows = None, tuple([] for _ in range(columns - 1))
    for b in batches:
        for t, *row in zip(*[b.column(c).to_pylist() for c in range(columns)]):
            if t != task:
                if rows[0]:
                    yield rows
                task, rows = t, tuple([] for _ in range(columns - 1))
            for r, v in zip(rows, row):
                r.append(v)
    if rows[0]:
        yield rows


def _forests(percent: int):
    """Of rows (task, side, id, place, size, ranges, gram, rank) sorted by task, size and id: edges that connect what passes the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sides, ids, places, sizes, ranges, grams, ranks in _grouped(batches, 8):
            side, ids, place, size = (np.array(x, np.int64) for x in (sides, ids, places, sizes))
            comp, edges, last = np.arange(len(ids)), [], 0
            first = np.searchsorted(100 * size, percent * size)  # the least size within the length filter
            width = np.array([len(x) for x in ranges])  # ascends with the size
            start = {int(w): int(np.searchsorted(width, w)) for w in np.unique(width)}
            level = {w: np.frombuffer(b"".join(ranges[k : k + int((width == w).sum())]), np.uint8).reshape(-1, w).astype(np.int16) for w, k in start.items()}
            full = np.array([255 in x for x in ranges])

            def hits(i: int, js: np.ndarray) -> np.ndarray:
                need = least_overlap(size[js], size[i], percent)
                js, need = (x[np.minimum(size[js] - place[js], size[i] - place[i]) >= need] for x in (js, need))
                out = [js[full[js] | full[i]]]
                mine = level[int(width[i])][i - start[int(width[i])]][None, :]
                for w in np.unique(width[js]).tolist():
                    at = width[js] == w
                    most = after_match(level[w][js[at] - start[w]], folded(mine, w), place[js[at]], place[i], grams[0], ranks[0])
                    out.append(js[at][most >= need[at]])
                return np.unique(np.concatenate(out))

            for i in range(1, len(ids)):
                for js in (np.arange(last, last + 1), np.arange(first[i], i)):
                    js = js[(js >= first[i]) & (js < i)]
                    js = js[(comp[js] != comp[i]) & ((side[js] == 2) | (side[js] != side[i]))]
                    if len(js):
                        for j in hits(i, js).tolist():
                            if comp[j] != comp[i]:
                                edges.append((ids[j], ids[i]))
                                comp[comp == comp[i]] = comp[j]
                                last = i
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _verify(n: int, percent: int):
    """Of rows (task, side, id, text, other) sorted by task: id, least id it reaches, links; for each set with a link.

    Rows of side 3 are the pairs (id, other) to verify; without such rows, all pairs of the two sides (or of side 2) are.
    """

    def given(ids: np.ndarray, sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = {x: k for k, x in enumerate(ids.tolist())}
        order = np.argsort(a, kind="stable")
        a, b = (np.array([place[x] for x in y[order].tolist()], np.int64) for y in (a, b))
        ok = np.zeros(len(a), bool)
        edges = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        for lo, hi in zip(edges, np.append(edges[1:], len(a))):
            one, others = sets[a[lo]], [sets[k] for k in b[lo:hi]]
            size = np.array([len(s) for s in others])
            grams = np.concatenate(others)
            at = np.minimum(np.searchsorted(one, grams), len(one) - 1)
            both = np.add.reduceat((one[at] == grams).astype(np.int64), np.cumsum(size) - size)
            ok[lo:hi] = both >= least_overlap(len(one), size, percent)
        return a[ok], b[ok]

    def every(side: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(s) for s in sets])
        own = (side == 2).any()  # a block with itself
        probe = np.arange(len(sets)) if own else np.flatnonzero(side == 0)
        base = np.arange(len(sets)) if own else np.flatnonzero(side == 1)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(base) and len(probe):
            grams = np.concatenate([sets[k] for k in base])
            owner = np.repeat(np.arange(len(base)), size[base])
            order = np.argsort(grams, kind="stable")
            grams, owner = grams[order], owner[order]
            for k in probe:
                lo, hi = np.searchsorted(grams, sets[k], "left"), np.searchsorted(grams, sets[k], "right")
                width = hi - lo
                at = np.repeat(hi - np.cumsum(width), width) + np.arange(width.sum())
                both = np.bincount(owner[at], minlength=len(base))
                hit = base[(both >= least_overlap(size[k], size[base], percent)) & (both > 0)]
                hit = hit[hit > k] if own else hit
                a.append(np.full(len(hit), k))
                b.append(hit)
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sides, ids, texts, others in _grouped(batches, 5):
            side, ids = np.array(sides), np.array(ids, np.int64)
            pair = side == 3
            texts = [t for t, p in zip(texts, pair) if not p]
            sets = [s for lo, hi in slices(texts, len, BYTES) for s in shingle_sets(texts[lo:hi], n)]
            if pair.any():
                a, b = given(ids[~pair], sets, ids[pair], np.array([o for o, p in zip(others, pair) if p], np.int64))
            else:
                a, b = every(side, sets)
            ids = ids[~pair]
            if len(a):
                count = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
                node, root = forest(ids[a], ids[b])
                place = {int(x): k for k, x in enumerate(ids)}
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array([int(count[place[int(x)]]) for x in node], pa.int64())], ["id", "root", "links"])

    return run


def _dealt(rows: DataFrame, root: str, blocks: DataFrame) -> DataFrame:
    """`rows` (id, root ...) once for every pair of its group's blocks that its own block is in: task and side."""
    d = rows.join(blocks, root).withColumn("mine", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("other") == F.col("mine"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    return d.withColumn("task", F.concat_ws(":", root, F.least("mine", "other"), F.greatest("mine", "other"))).withColumn("side", side)


def _run_edges(found: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect the sets of long runs which pass the filters."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = found.where("kind = 1").select(F.col("a").alias("gram"), F.col("b").alias("id"), F.col("pa").alias("place"), "rank")
    blocks = long.groupBy("gram").agg(F.ceil(F.count("*") / F.lit(SPAN)).cast("int").alias("blocks"))
    work = _dealt(long.join(reps, "id"), "gram", blocks).select("task", "side", "id", "place", "size", "ranges", "gram", "rank")
    return work.repartition(parts, "task").sortWithinPartitions("task", "size", "id").mapInArrow(_forests(percent), "a long, b long")


def _found(docs: DataFrame, summary: DataFrame, member: DataFrame, n: int, percent: int, run: int, row_id: str, text: str) -> DataFrame:
    """Candidates among the sets that stand for their classes: pairs at their first common shingle, and postings of long runs."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = postings(docs, rarity(summary), n, percent, run, row_id, text)
    salt = F.when(F.col("extra") > 0, F.pmod(F.xxhash64("id"), F.lit(parts)) + 1).otherwise(0)
    shared = posted.repartition(parts, F.col("gram"), salt).sortWithinPartitions("gram").mapInArrow(_shared, posted.schema)
    shared = shared.join(member.select("id", "rep"), "id").groupBy("gram", F.col("rep").alias("id"))
    # Where a set is extra in one task and not in another, it counts among the shingle's first: those tell that a run is long.
    shared = shared.agg(F.first("size").alias("size"), F.first("place").alias("place"), F.first("rank").alias("rank"), F.min("extra").alias("extra"))
    found = shared.repartition(parts, F.col("gram"), salt).sortWithinPartitions("gram", "size", "id")
    found = found.mapInArrow(_candidates(percent, run), "a long, b long, pa long, pb long, gram long, rank int, kind int")
    match = F.min(F.struct("pa", "pb", "gram", "rank")).alias("match")
    return found.groupBy("kind", "a", "b").agg(match).select("kind", "a", "b", "match.*")


def _linked(docs: DataFrame, cluster: DataFrame, pairs: DataFrame, dense: DataFrame, blocks: DataFrame, n: int, percent: int, row_id: str, text: str) -> DataFrame:
    """Links of the sets dealt to clusters and blocks: (id, least id it reaches in the task, links)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("id"), text_bytes(text).alias("text"))
    whole = _dealt(cluster.join(dense, "root"), "root", blocks).select("task", "side", "id")
    mine = lambda c: F.pmod(F.xxhash64(c), "blocks").cast("int")
    few = pairs.join(cluster.select(F.col("id").alias("a"), "root"), "a").join(dense, "root", "left_anti").join(blocks, "root")
    few = few.select(F.concat_ws(":", "root", F.least(mine("a"), mine("b")), F.greatest(mine("a"), mine("b"))).alias("task"), "a", "b")
    ends = few.select("task", F.col("a").alias("id")).union(few.select("task", "b")).distinct()
    sets = whole.union(ends.select("task", F.lit(2).alias("side"), "id")).join(source, "id")
    work = sets.select("task", "side", "id", "text", F.lit(None).cast("long").alias("other")).union(few.select("task", F.lit(3), "a", F.lit(None).cast("binary"), "b"))
    return work.repartition(parts, "task").sortWithinPartitions("task", "side", "id").mapInArrow(_verify(n, percent), "id long, root long, links long")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 75, run: int = 64, block: int = 300_000, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id, n_shingles, component_id, n_links (other distinct sets it links with) of each document."""
    spark = docs.sparkSession
    summary = materialize(summaries(docs, n, row_id, text), "summary")
    base = summary.where("id is not null")
    classes = materialize(base.where("size > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep")), "classes")
    member = base.where("size > 0").join(classes, ["k1", "k2"]).select("id", "rep", "size", "ranges")

    found = materialize(_found(docs, summary, member, n, percent, run, row_id, text), "candidates")
    release(spark)  # of the postings' shuffles
    ids = found.where("kind = 0").select(F.col("a").alias("id")).union(found.select("b")).distinct()
    reps = materialize(member.where("id = rep").select("id", "size", "ranges").dropDuplicates(["id"]).join(ids, "id", "left_semi"), "sets")
    side = lambda c, k: reps.select(F.col("id").alias(c), F.col("ranges").alias(f"ranges_{k}"), F.col("size").alias(f"size_{k}"))
    pairs = found.where("kind = 0").join(side("a", 0), "a").join(side("b", 1), "b").select("a", "b", "ranges_0", "ranges_1", "size_0", "size_1", "pa", "pb", "gram", "rank")
    pairs = materialize(pairs.mapInArrow(_suffix_filter(percent), "a long, b long"), "pairs")
    runs = materialize(_run_edges(found, reps, percent), "runs")
    cluster = components(pairs.union(runs), "clusters").withColumnRenamed("node", "id")
    blocks = materialize(cluster.join(reps, "id").groupBy("root").agg(F.ceil(F.sum("size") / F.lit(block)).cast("int").alias("blocks")), "blocks")
    dense = materialize(cluster.join(runs.select(F.col("a").alias("id")).distinct(), "id").select("root").distinct(), "dense")
    for t in (found, reps, runs):
        drop_materialized(t)
    del found, reps, ids, runs
    release(spark)

    linked = materialize(_linked(docs, cluster, pairs, dense, blocks, n, percent, row_id, text), "linked")
    for t in (pairs, dense, blocks):
        drop_materialized(t)
    del pairs, dense, blocks
    release(spark)
    total = linked.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    final = components(linked.select("id", "root"), "components").select(F.col("node").alias("rep"), F.col("root").alias("comp"))
    named = materialize(classes.join(final, "rep", "left").join(total, "rep", "left"), "named")
    drop_materialized(linked)
    out = base.join(named, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(row_id), F.col("size").alias("n_shingles"), F.coalesce("comp", "rep", "id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
