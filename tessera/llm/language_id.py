"""Language identification by error-correcting output codes.

Every language has a codeword of signs. For each bit a binary n-gram classifier tells the languages with a plus
from those with a minus: its weights are log-ratios of hashed character 2- and 3-gram probabilities (letters
and the gaps between them), averaged over a text's grams into a margin. Decoding is loss-weighted: a language's distance is the logistic loss of the
margins against its codeword, each bit weighted by how often that bit's classifier is right on texts of that
language; the nearest codeword wins. The score is the winner's share of exp(-distance), and a text whose two nearest
codewords are closer than `gap` in that share is flagged ambiguous.

Counts of grams cover all learning documents (text and lang not null); the bit weights come from at most
`weigh_rows` of them a language, those of least hashed id. What comes to the driver is one row a (language,
bucket). Codewords: all two-way splits of up to five languages, beyond that a seeded code of 8 bits a doubling.

A null text or one without a letter is `und` with score 0; with no learning document every text is. Texts are
read whole, however long. Repeated rows are each predicted. Only text, lang and id are read, whatever the other columns' names. Of
languages at the same distance the first in order wins, and the text is ambiguous. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import least_hashed, per_doc, slices

BITS = 15
SIZE = 1 << BITS
CHARS = 1_000_000
UNKNOWN = "und"
#: Steepness of the loss; fixed.
TAU = 12.0


@lru_cache(1)
def letters_only() -> np.ndarray:
    """Each code point, or a space where it is no letter: marks and digits say nothing of the language."""
    out = np.full(0x110000, 32, np.uint32)
    points = [c for c in range(0x110000) if chr(c).isalpha()]
    out[points] = points
    return out


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 2-grams and 3-grams that begin at each character, and each text's range of characters.

    Grams that reach over a text's end get bucket 0, which is kept free.
    """
    low = [t.lower() for t in texts]
    ends = np.cumsum([len(t) + 2 for t in low])
    codes = letters_only()[np.frombuffer(("  ".join([*low, ""])).encode("utf-32-le"), np.uint32)]
    shift = np.uint32(32 - BITS)
    two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + codes[2:] * np.uint32(0x27D4EB2F)
    two = np.append((two ^ (two >> np.uint32(15))) * np.uint32(0x2545F491) >> shift, 0).astype(np.int64)
    three = np.append((three ^ (three >> np.uint32(15))) * np.uint32(0x2545F491) >> shift, [0, 0]).astype(np.int64)
    for back in (1, 2):
        two[ends - back] = 0
        three[ends - back] = 0
    three[np.maximum(ends - 3, 0)] = 0
    two[np.maximum(ends - 3, 0)] = 0
    return two, three, np.append(0, ends[:-1]), ends


@dataclass
class CodeModel:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # bits x buckets
    trust: np.ndarray  # languages x bits, rows add up to 1

    def margins(self, texts: list[str]) -> np.ndarray:
        two, three, a, z = gram_buckets(texts)
        grams = np.maximum(per_doc((two > 0).astype(np.int64), a, z) + per_doc((three > 0).astype(np.int64), a, z), 1)
        out = np.zeros((len(texts), len(self.weights)))
        for b, w in enumerate(self.weights):
            out[:, b] = per_doc(w[two] + w[three], a, z) / grams
        return out

    def shares(self, margins: np.ndarray) -> np.ndarray:
        loss = np.logaddexp(0, -TAU * margins[:, None, :] * self.code[None, :, :])
        d = -(loss * self.trust[None, :, :]).sum(2) * self.code.shape[1]
        e = np.exp(d - d.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def codewords(n: int) -> np.ndarray:
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:  # all splits in two, each once
        return np.array([[1 if c == 0 or (s >> (c - 1)) & 1 else -1 for s in range((1 << (n - 1)) - 1)] for c in range(n)])
    bits, rng, best, most = 8 * int(np.ceil(np.log2(n))), np.random.default_rng(7), None, -1
    for _ in range(200):
        m = rng.choice([-1, 1], (n, bits))
        least = ((bits - m @ m.T) // 2 + bits * np.eye(n, dtype=int)).min()
        if least > most and (np.abs(m.sum(0)) < n).all():
            best, most = m, least
    return best


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list]]:
    for b in batches:
        texts, langs = [t or "" for t in b.column(0).to_pylist()], b.column(1).to_pylist()
        for lo, hi in slices(texts, len, CHARS):
            yield texts[lo:hi], langs[lo:hi]


def fit(docs: DataFrame, learn: Column, weigh_rows: int = 250) -> CodeModel:
    known = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull())
    languages = sorted(r[0] for r in known.select("lang").distinct().collect())
    n = len(languages)
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * SIZE, np.int64)
        for texts, langs in _texts(batches):
            two, three, a, z = gram_buckets(texts)
            base = np.repeat(np.array([place[x] for x in langs], np.int64) * SIZE, z - a)
            total += np.bincount(base + two, minlength=n * SIZE) + np.bincount(base + three, minlength=n * SIZE)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["cell", "n"])

    counts = np.zeros(n * SIZE)
    if n:
        pairs = known.select(F.col("text").cast("string"), "lang")
        for r in pairs.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            counts[r["cell"]] = r["n"]
    counts = counts.reshape(n, SIZE)
    if n:
        counts[:, 0] = 0
    p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * SIZE) if n else counts
    code = codewords(n)
    weights = np.zeros((code.shape[1], SIZE), np.float32)
    for b in range(code.shape[1]):
        up, down = code[:, b] > 0, code[:, b] < 0
        if up.any() and down.any():
            weights[b] = np.log(p[up].mean(0)) - np.log(p[down].mean(0))
            weights[b, 0] = 0
    model = CodeModel(languages, code, weights, np.full(code.shape, 1 / max(code.shape[1], 1)))
    if n < 2:
        return model

    # At most weigh_rows x languages ids, so they may be broadcast.
    ids = F.broadcast(least_hashed(known.select("doc_id", "lang"), "lang", weigh_rows).select("doc_id").distinct())
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for texts, langs in _texts(batches):
            got = m.margins(texts) * m.code[[place[x] for x in langs]] > 0
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(got.astype(np.int64).tolist(), pa.list_(pa.int64()))], ["lang", "right"])

    hits = known.join(ids, "doc_id", "left_semi").select(F.col("text").cast("string"), "lang").mapInArrow(right, "lang string, right array<long>")
    rates = np.full(code.shape, 0.5)
    for r in hits.select("lang", F.posexplode("right")).groupBy("lang", "pos").agg(F.avg("col").alias("rate")).collect():
        rates[place[r["lang"]], r["pos"]] = r["rate"]
    rates = np.maximum(rates, 0.01)
    model.trust = rates / rates.sum(1, keepdims=True)
    return model


def decide(model: CodeModel, texts: list[str], gap: float) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and whether it is ambiguous, of each text."""
    names, score, unclear = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
    if not model.languages:
        return names, score, unclear
    for lo, hi in slices(texts, len, CHARS):
        s = model.shares(model.margins(texts[lo:hi]))
        best = s.argmax(1)
        second = np.sort(s, 1)[:, -2] if s.shape[1] > 1 else np.zeros(hi - lo)
        for i in range(lo, hi):
            if any(map(str.isalpha, texts[i])):
                top = float(s[i - lo, best[i - lo]])
                names[i], score[i], unclear[i] = model.languages[best[i - lo]], top, bool(top - second[i - lo] < gap)
    return names, score, unclear


def predict(docs: DataFrame, model: CodeModel, gap: float = 0.1, row_id: str = "doc_id") -> DataFrame:
    """row_id, lang_pred, score and ambiguous of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            names, score, unclear = decide(m, texts, gap)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(unclear, pa.bool_())], [row_id, "lang_pred", "score", "ambiguous"])

    return docs.select(F.col(row_id).cast("long").alias(row_id), F.col("text").cast("string")).mapInArrow(run, f"{row_id} long, lang_pred string, score double, ambiguous boolean")


def accept(docs: DataFrame, model: CodeModel, gap: float = 0.1) -> DataFrame:
    """The rows of `docs` whose language is found and clear; a null lang becomes the one found."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at, lang = names.index("text"), names.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            found, clear = decide(m, texts, gap)[0::2]
            keep = pa.array([x != UNKNOWN and not u for x, u in zip(found, clear)], pa.bool_())
            told = pa.array([o if o is not None else x for o, x in zip(b.column(lang).to_pylist(), found)], b.schema.field(lang).type)
            yield pa.RecordBatch.from_arrays([told if i == lang else c for i, c in enumerate(b.columns)], names).filter(keep)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
