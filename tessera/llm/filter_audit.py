"""Filter interaction audit: what each of five document filters removes in every order of applying them.

A document fails filter A with under `min_words` words, B with less than `min_distinct` percent distinct words, C with over
`max_capitals` percent of its code points in A-Z, D with any byte of `symbols`, and E if its text is identical to that of a smaller
doc_id, wherever in the table. A pass over the texts scans Arrow's own buffer: a table gives each byte its classes, prefix sums of the
classes taken at the documents' ends give words, capitals, code points and symbols, and prefix sums of a polynomial give every word's
64-bit hash. The hashes are sorted within each document; neighbours that agree are verified byte by byte, and a document
where two words share a hash is counted from the words themselves, so distinct counts are exact.

Whether a document fails does not depend on the order of filters, so a document is a mask of five bits; counts by part and mask
(at most 32 a part) hold all that the 120 orders ask for. Texts pass once; what is shuffled are ids, masks and SHA-256 digests. The first
document of each text is found by an aggregate of the digests and joined by id and digest, so a text that a third of the rows share
is no hot key.

Null texts are empty: no words, and identical to each other. A null part is the empty string. A null doc_id is never the smaller nor
the larger one: its row fails E never and has no labels. Rows repeated under one id are each counted, and none is a copy of
the other; labels repeated for a document count if any says so. Tied texts go by the id. Very long texts are scanned whole, in blocks
of bytes. Other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, mix, text_bytes

SPACE, CAPITAL, SYMBOL, LATER = 1, 2, 4, 8  # LATER: the second and later bytes of a code point
LETTERS = "ABCDE"
BLOCK = 1 << 20
STEP = 0x9E3779B97F4A7C15  # the polynomial's base, odd so that it has an inverse modulo 2^64
BACK = pow(STEP, -1, 1 << 64)
WEIGHT = mix(np.arange(256, dtype=np.uint64), np.uint64(1)) | np.uint64(1)


def byte_classes(symbols: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] |= SPACE
    table[65:91] |= CAPITAL
    table[list(symbols)] |= SYMBOL
    table[0x80:0xC0] |= LATER
    return table


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls as one array over Arrow's buffer, and the bounds of its values."""
    column = column.cast(pa.large_binary())
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between neighbouring bounds, from prefix sums of a block at a time."""
    at, total = np.zeros(len(bounds), np.int64), 0
    for lo in range(0, len(flags), BLOCK):
        c = np.cumsum(flags[lo : lo + BLOCK], dtype=np.int64)
        here = slice(*np.searchsorted(bounds, [lo + 1, lo + len(c) + 1]))
        at[here] = total + c[bounds[here] - lo - 1]
        total += int(c[-1])
    return np.diff(at)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word data[begin:end], by differences of a polynomial's prefix sums."""
    out = np.zeros(len(begin), np.uint64)
    lo = 0
    while lo < len(begin):
        hi = max(int(np.searchsorted(end, begin[lo] + BLOCK)), lo + 1)
        first, last = int(begin[lo]), int(end[hi - 1])
        power = np.full(last - first, STEP, np.uint64)
        back = np.full(last - first + 1, BACK, np.uint64)
        power[:1] = back[0] = 1
        prefix = np.zeros(last - first + 1, np.uint64)
        np.cumsum(WEIGHT[data[first:last]] * np.cumprod(power, dtype=np.uint64), out=prefix[1:])
        b, e = begin[lo:hi] - first, end[lo:hi] - first
        out[lo:hi] = mix((prefix[e] - prefix[b]) * np.cumprod(back, dtype=np.uint64)[b], (e - b).astype(np.uint64))
        lo = hi
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether data[a:a+n] equals data[b:b+n] for each of the pairs (every n over 0)."""
    out = np.ones(len(a), bool)
    total = np.cumsum(n)
    lo = 0
    while lo < len(a):
        hi = max(int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BLOCK)), lo + 1)
        m = n[lo:hi]
        starts = np.cumsum(m) - m
        inside = np.arange(int(m.sum())) - np.repeat(starts, m)
        unlike = data[np.repeat(a[lo:hi], m) + inside] != data[np.repeat(b[lo:hi], m) + inside]
        out[lo:hi] = np.add.reduceat(unlike, starts, dtype=np.int64) == 0
        lo = hi
    return out


def distinct_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Distinct words of each document, given all words in order and how many each document has."""
    doc = np.repeat(np.arange(len(words)), words)
    h = word_hashes(data, begin, end)
    order = np.lexsort((h, doc))
    x, y = order[:-1], order[1:]
    alike = (h[x] == h[y]) & (doc[x] == doc[y])
    x, y = x[alike], y[alike]
    n = end[x] - begin[x]
    true = n == end[y] - begin[y]
    true[true] = same_bytes(data, begin[x[true]], begin[y[true]], n[true])
    out = words - np.bincount(doc[x], minlength=len(words))
    for d in np.unique(doc[x[~true]]).tolist():  # two words of one hash
        lo = int(words[:d].sum())
        out[d] = len({data[b:e].tobytes() for b, e in zip(begin[lo : lo + words[d]].tolist(), end[lo : lo + words[d]].tolist())})
    return out


def scan(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of each document of a buffer."""
    cls = table[data]
    text = (cls & SPACE) == 0
    cut = np.zeros(len(data) + 1, bool)  # a document's bound parts two words
    cut[bounds] = True
    starts, ends = text.copy(), text.copy()
    starts[1:] &= ~text[:-1] | cut[1:-1]
    ends[:-1] &= ~text[1:] | cut[1:-1]
    words = sums(starts, bounds)
    return {
        "words": words,
        "distinct": distinct_words(data, np.flatnonzero(starts), np.flatnonzero(ends) + 1, words),
        "capitals": sums((cls & CAPITAL) > 0, bounds),
        "points": sums((cls & LATER) == 0, bounds),
        "symbols": sums((cls & SYMBOL) > 0, bounds),
    }


def masks(docs: DataFrame, part: str = "source", min_words: int = 50, min_distinct: int = 65, max_capitals: int = 5, symbols: bytes = b"#$%&*|") -> DataFrame:
    """doc_id, part, mask (1, 2, 4, 8 for failing A, B, C, D) and the SHA-256 of the text, of each row."""
    table = byte_classes(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, at = buffer_of(b.column(2))
            lo = 0
            while lo < b.num_rows:
                hi = max(int(np.searchsorted(at, at[lo] + BLOCK, side="right")) - 1, lo + 1)
                data, bounds = whole[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                n = scan(data, bounds, table)
                mask = (n["words"] < min_words) + 2 * (100 * n["distinct"] < min_distinct * n["words"]) + 4 * (100 * n["capitals"] > max_capitals * n["points"]) + 8 * (n["symbols"] > 0)
                digests = [hashlib.sha256(data[x:y]).digest() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(mask, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])
                lo = hi

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(text_bytes(), F.lit(b"")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def with_copies(found: DataFrame) -> DataFrame:
    """`masks` with bit 16 for failing E, in place of the digest. Reads `found` twice: materialize it first."""
    known = found.where("doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest", F.lit(0).alias("copy"))
    marked = known.join(first, ["doc_id", "digest"], "left").withColumn("mask", F.col("mask").bitwiseOR(F.coalesce("copy", F.lit(16))))
    return marked.select("doc_id", "part", "mask").union(found.where("doc_id is null").select("doc_id", "part", "mask"))


def with_labels(rows: DataFrame, labels: DataFrame, good: str = "quality = 1", toxic: str = "toxic = 1") -> DataFrame:
    """`rows` with good and toxic (0 or 1); a document without a label has neither."""
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(*[F.coalesce(F.max(F.expr(f"int({e})")), F.lit(0)).alias(c) for c, e in (("good", good), ("toxic", toxic))])
    known = rows.where("doc_id is not null").join(said, "doc_id", "left").fillna(0, ["good", "toxic"])
    return known.unionByName(rows.where("doc_id is null").selectExpr("*", "0 as good", "0 as toxic"))


def by_order(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The audit of rows (part, mask, good, toxic): one row per part, filter_order and step.

    kept and removed: after and by this step; redundant: fails its filter, but an earlier one removed it; unique_fails: fails
    only its filter; good_lost, toxic_lost: of the removed; shapley: what its filter removes, over all orders.
    """
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # at most 2^letters entries
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = parts.select("part", "m", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    bit = f"shiftleft(1, locate(substr(filter_order, {{k}}, 1), '{letters}') - 1)"
    before = f"aggregate(filter(sequence(1, {len(letters)}), k -> k < step), 0, (a, k) -> a | {bit.format(k='k')})"
    steps = steps.selectExpr("*", f"{bit.format(k='step')} as own", f"{before} as before")

    def total(when: str, value: str = "x.n"):
        return F.expr(f"aggregate(m, 0L, (a, x) -> a + if({when}, {value}, 0L))")

    gone = "(x.mask & own) > 0 and (x.mask & before) = 0"
    return steps.select(
        "part", "filter_order", "step",
        total("(x.mask & (before | own)) = 0").alias("kept"),
        total(gone).alias("removed"),
        total("(x.mask & own) > 0 and (x.mask & before) > 0").alias("redundant"),
        total("x.mask = own").alias("unique_fails"),
        total(gone, "x.good").alias("good_lost"),
        total(gone, "x.toxic").alias("toxic_lost"),
        total("(x.mask & own) > 0", f"x.n * {factorial(len(letters))}L div bit_count(x.mask)").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", **limits) -> DataFrame:
    """`by_order` of documents and their labels; `limits` are those of `masks`."""
    return by_order(with_labels(with_copies(materialize(masks(docs, part, **limits), "masks")), labels))
