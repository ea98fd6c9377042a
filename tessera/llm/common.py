"""What the operators of this package share: tables, the shared folder, word hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words kept in a worker's cache of word hashes before it is emptied; affects speed only.
WORD_CACHE = 120_000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session takes a temporary one; on a cluster,
    whose executors could not read that, it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back.

    Cuts the lineage with files every executor can read again, so losing one costs a retry only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    rows = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, 1000)  # whole texts pass through: batches of ten thousand take too much memory
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, rows)
    return spark.read.schema(df.schema).parquet(path)


def columns(df: DataFrame) -> list[pa.ChunkedArray]:
    """The columns of a table of bounded size, brought to the driver as Arrow arrays: `collect` would make objects of every row, in the JVM and in Python."""
    return df.toArrow().columns


def least_hashed(rows: DataFrame, key: str, most: int, row_id: str = "doc_id") -> DataFrame:
    """Of the distinct `rows`, the `most` of each key of least hashed id (there are few keys).

    Only rows whose hash is under a bound, set for about twice as many and 200 ids of the key, are ranked, so what one task ranks
    does not grow with the table. Were fewer than `most` ids of a key under the bound (odds under one in a billion), the sample
    would be that much smaller.
    """
    share = F.shiftrightunsigned(F.xxhash64(row_id), 11) / float(1 << 53)
    ids = rows.groupBy(key).agg(F.approx_count_distinct(row_id).alias("__ids"))
    near = rows.join(F.broadcast(ids), key).where(share * F.col("__ids") <= 2 * most + 200).drop("__ids").distinct()
    least = Window.partitionBy(key).orderBy(share, row_id)
    return near.withColumn("__n", F.row_number().over(least)).where(F.col("__n") <= most).drop("__n").select(*rows.columns)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a materialized frame that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(conf).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more.

    Its cleaner acts when the driver's collectors find the frames gone, which may be long after the disk is needed.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text column (null stays null); what the Arrow readers below take."""
    return F.col(column).cast("string").cast("binary")


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def hash_words(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and where each document's begin (one more at the end)."""
    ends = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) for d in docs], out=ends[1:])
    h = np.fromiter(map(_words.__getitem__, chain.from_iterable(docs)), np.uint64, int(ends[-1]))
    return h, ends


def mix(h: np.ndarray, w: np.ndarray | int) -> np.ndarray:
    """Fold `w` into `h`, order-sensitively (64-bit multiply and shift)."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h += w
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that stay inside a document, and the position each starts at."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    g = mix(np.full(m, n, np.uint64), h[:m])
    for k in range(1, n):
        g = mix(g, h[k : k + m])
    inside = np.ones(m, bool)
    for k in range(1, n):  # a window starting k words before a border crosses it
        p = ends[1:-1] - k
        inside[p[(p >= 0) & (p < m)]] = False
    at = np.flatnonzero(inside)
    return g[at], at


def per_doc(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[starts[i]:ends[i]] for each i; zero for empty ranges."""
    c = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=c[1:])
    return c[ends] - c[starts]


def slices(rows: list, weight, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose weights add up to about `most` (one row at least)."""
    i, total = 0, 0
    for k, r in enumerate(rows):
        total += weight(r)
        if total >= most:
            yield i, k + 1
            i, total = k + 1, 0
    if i < len(rows):
        yield i, len(rows)
