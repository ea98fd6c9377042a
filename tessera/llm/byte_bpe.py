"""Byte-level BPE encoding and decoding, with vectorised pre-tokenisation.

Boundaries of the pre-tokens are found without a regular expression. Every code point has a class (letter,
number, space, other white space, anything else), refined by what follows it (an apostrophe that may begin a
contraction, the last white space before a word). A small automaton reads the classes; a position begins a
pre-token if the automaton says so in the state it is in. As composing transition functions is associative, the
states at all positions come from a prefix scan: the automaton's functions form a finite monoid with a
composition table, the text is cut into lanes that are scanned side by side, the lanes' totals are scanned in
log steps, and one more lookup gives each position its state.

The slices between boundaries go through a cache of merged pairs (emptied when it holds `CACHE` slices; speed
only). The vocabulary's ranks come from a file whose path is a parameter; it is read once on the driver and sent to the
executors (its size is that of the vocabulary). Token offsets (byte positions in the UTF-8 text) stay with the ids,
so any range of tokens decodes to the span it came from.

Null texts count as empty; an empty text has no tokens. Texts of any length are encoded whole, one row at a
time within a batch of a few million characters. Repeated rows give the same ids; other columns are passed through by
`encode` and not read by `digest`. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import slices

CACHE = 120_000
CHARS = 1_000_000
LANE = 256

# Classes of code points; fixed values.
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Tells letters and numbers apart; see code_point_classes.
CLASS_PATTERN = r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+"
# Inputs of the automaton: the classes, refined.
IN_LETTER, IN_NUMBER, IN_OTHER, IN_RUN, IN_LAST_SPACE, IN_LAST_WHITE, IN_SHORT, IN_LONG, IN_BORDER = range(9)
# Its states: what the previous character was part of.
OPEN, WORD, DIGITS, MARKS, LEAD, BLANKS, ONE_MORE, TWO_MORE = range(8)


def code_point_classes() -> np.ndarray:
    """The class of every code point, as the tokenizer library sees it.

    Unicode editions differ on code points assigned lately: where two of them disagree, the library decides.
    """
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    out, newer = np.full(0x110000, OTHER, np.uint8), np.full(0x110000, OTHER, np.uint8)
    out[points] = [{"L": LETTER, "N": NUMBER}.get(x[0], OTHER) for x in map(unicodedata.category, every)]
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        newer[[ord(c) for c in regex.findall(pattern, every)]] = kind
    disputed = np.flatnonzero(out != newer).tolist()
    if disputed:
        pairs = {c + bytes([b]): 256 + 256 * k + b for k, c in enumerate((b"a", b"1")) for b in range(256)}
        library = tiktoken.Encoding("classes", pat_str=CLASS_PATTERN, mergeable_ranks={bytes([b]): b for b in range(256)} | pairs, special_tokens={})
        for c in disputed:
            joins = [library.encode_ordinary(before + chr(c))[0] >= 256 for before in ("a", "1")]
            out[c] = LETTER if joins[0] else NUMBER if joins[1] else OTHER
    out[WHITE_SPACE] = WHITE
    out[0x20] = SPACE
    return out


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a pre-token begins, for each (state, input)."""
    to, begins = np.zeros((8, 9), np.int64), np.zeros((8, 9), bool)
    runs = {IN_LETTER: WORD, IN_NUMBER: DIGITS, IN_OTHER: MARKS}
    for s in range(8):
        for i, run in runs.items():
            to[s, i], begins[s, i] = run, s not in (run, LEAD)
        for i, rest in ((IN_SHORT, ONE_MORE), (IN_LONG, TWO_MORE)):  # a contraction, unless the mark continues a token
            inside = s in (MARKS, LEAD)
            to[s, i], begins[s, i] = (MARKS, False) if inside else (rest, True)
        to[s, IN_RUN], begins[s, IN_RUN] = BLANKS, s != BLANKS
        to[s, IN_LAST_SPACE], begins[s, IN_LAST_SPACE] = LEAD, True
        to[s, IN_LAST_WHITE], begins[s, IN_LAST_WHITE] = OPEN, True
        to[s, IN_BORDER], begins[s, IN_BORDER] = OPEN, True
    for i in range(8):  # the letters of a contraction
        to[ONE_MORE, i], begins[ONE_MORE, i] = OPEN, False
        to[TWO_MORE, i], begins[TWO_MORE, i] = ONE_MORE, False
    return to, begins


class PreTokenizer:
    def __init__(self) -> None:
        self.classes = code_point_classes()
        self.to, self.begins = _automaton()
        identity = tuple(range(8))
        generators = [tuple(self.to[:, i]) for i in range(9)]
        ids, todo = {identity: 0}, [identity]
        while todo:  # the monoid that the inputs' functions generate
            f = todo.pop()
            for g in generators:
                h = tuple(g[x] for x in f)
                if h not in ids:
                    ids[h] = len(ids)
                    todo.append(h)
        self.apply = np.array(list(ids), np.uint8)
        self.size = len(ids)
        self.after = np.array([[ids[tuple(g[x] for x in f)] for g in ids] for f in ids], np.int32).ravel()
        self.generator = np.array([ids[tuple(g)] for g in generators], np.int32)

    def inputs(self, codes: np.ndarray, borders: np.ndarray) -> np.ndarray:
        kind = self.classes[codes]
        kind[borders] = 9
        after = np.append(kind[1:], 9)
        blank = (kind == SPACE) | (kind == WHITE)
        last = blank & (after <= OTHER)
        out = np.array([IN_LETTER, IN_NUMBER, IN_OTHER, IN_RUN, IN_RUN, 0, 0, 0, 0, IN_BORDER], np.uint8)[kind]
        out[last & (kind == SPACE)] = IN_LAST_SPACE
        out[last & (kind == WHITE)] = IN_LAST_WHITE
        at = np.flatnonzero(codes == ord("'"))
        if len(at):
            more = np.append(codes, [0, 0])
            one, two = more[at + 1], more[at + 2]
            out[at[np.isin(one, [ord(c) for c in "stmd"])]] = IN_SHORT
            long = ((one == ord("l")) & (two == ord("l"))) | (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")))
            out[at[long]] = IN_LONG
            out[borders] = IN_BORDER
        return out

    def starts(self, codes: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Positions where a pre-token (or a border) begins."""
        n = len(codes)
        if not n:
            return np.zeros(0, np.int64)
        given = self.inputs(codes, borders)
        lanes = -(-n // LANE)
        f = np.zeros(lanes * LANE, np.int32)
        f[:n] = self.generator[given]
        f = np.ascontiguousarray(f.reshape(lanes, LANE).T)
        for j in range(1, LANE):  # prefix products inside all lanes at once
            f[j] = self.after[f[j - 1] * self.size + f[j]]
        total, step = f[-1].copy(), 1
        while step < lanes:  # and over the lanes' totals
            total[step:] = self.after[total[:-step] * self.size + total[step:]]
            step *= 2
        entry = np.full(lanes, OPEN, np.uint8)
        entry[1:] = self.apply[total[:-1], OPEN]
        state = self.apply[f, entry[None, :]]
        before = np.concatenate([entry[None, :], state[:-1]]).T.ravel()[:n]
        return np.flatnonzero(self.begins[before, given])


class Encoder:
    """Encodes and decodes with the ranks of one vocabulary file ("base64 rank" lines)."""

    def __init__(self, lines: bytes) -> None:
        pairs = [x.split() for x in lines.splitlines() if x.strip()]
        self.ranks = {base64.b64decode(t): int(r) for t, r in pairs}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.pre = PreTokenizer()
        encoder = self

        class Cache(dict):
            def __missing__(self, piece: str) -> tuple[int, ...]:
                if len(self) >= CACHE:
                    self.clear()
                ids = self[piece] = encoder.merge(piece.encode("utf-8"))
                return ids

        self.cache = Cache()

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: always the adjacent pair of least rank next, leftmost first."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) > 64:
            return self._merge_long(piece)
        cuts = list(range(len(piece) + 1))
        none = len(self.tokens)
        pair = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pair:
            least = min(pair)
            if least == none:
                break
            i = pair.index(least)
            del cuts[i + 1], pair[i]
            if i < len(pair):
                pair[i] = ranks.get(piece[cuts[i] : cuts[i + 2]], none)
            if i:
                pair[i - 1] = ranks.get(piece[cuts[i - 1] : cuts[i + 1]], none)
        return tuple([ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap, for pre-tokens of any length."""
        ranks, n = self.ranks, len(piece)
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at i
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, z = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != z:
                continue  # one of the two has been merged since
            alive[j] = 0
            end[i] = z
            if z < n:
                prev[z] = i
                if (r := ranks.get(piece[i : end[z]])) is not None:
                    heapq.heappush(heap, (r, i, end[z]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:z])) is not None:
                heapq.heappush(heap, (r, p, z))
        return tuple([ranks[piece[i : end[i]]] for i in range(n) if alive[i]])

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for lo, hi in slices(texts, len, CHARS):
            part = texts[lo:hi]
            joined = "\n".join([*part, ""])
            borders = np.cumsum([len(t) + 1 for t in part]) - 1
            starts = self.pre.starts(np.frombuffer(joined.encode("utf-32-le"), np.uint32), borders)
            at = np.searchsorted(starts, borders).tolist()  # each border is itself a start
            cut = starts.tolist()
            pieces = [joined[a:b] for a, b in zip(cut, cut[1:])]
            a = 0
            for z in at:
                out.append(list(chain.from_iterable(map(self.cache.__getitem__, pieces[a:z]))))
                a = z + 1
        return out

    def offsets(self, ids: list[int]) -> np.ndarray:
        """Where each token begins in the text's UTF-8 bytes, and where the last one ends."""
        out = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.lengths[ids] if ids else [], out=out[1:])
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_encoders: dict[bytes, Encoder] = {}


def encoder_for(lines: bytes) -> Encoder:
    """One encoder (and cache) a worker process and vocabulary."""
    key = hashlib.sha256(lines).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(lines)
    return _encoders[key]


def _send_ranks(spark: SparkSession, ranks_path: str):
    with open(ranks_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", offsets: str | None = "offsets", exact: str | None = None) -> DataFrame:
    """`docs` with the text's ids and the tokens' byte offsets (one more than ids: the text's end; none if None).

    `exact` names a column that says whether the ids, decoded again, give the text's very bytes (null counts as empty). A column of
    `docs` that is named like one of those added is replaced; give other names to keep it. All others pass through.
    """
    sent = _send_ranks(docs.sparkSession, ranks_path)
    names = docs.columns
    at = names.index(text)
    schema = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (ids, offsets, exact)])
    keep = schema.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_for(sent.value)
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            for lo, hi in slices(texts, len, CHARS):
                got = e.encode(texts[lo:hi])
                part = b.slice(lo, hi - lo)
                cols = [part.column(names.index(c)) for c in keep]
                cols.append(pa.array(got, pa.list_(pa.int32())))
                if offsets:
                    cols.append(pa.array([e.offsets(g) for g in got], pa.list_(pa.int64())))
                if exact:
                    cols.append(pa.array([e.decode(g) == t.encode() for g, t in zip(got, texts[lo:hi])], pa.bool_()))
                yield pa.RecordBatch.from_arrays(cols, fields)

    more = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(offsets, T.ArrayType(T.LongType()))] if offsets else [])
    if exact:
        more.append(T.StructField(exact, T.BooleanType()))
    out = T.StructType([*schema.schema.fields, *more])
    fields = out.names
    return docs.mapInArrow(run, out)


def decode(rows: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`rows` with the bytes that the ids stand for (null ids: null)."""
    sent = _send_ranks(rows.sparkSession, ranks_path)
    names = rows.columns
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_for(sent.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):  # lists of ids take several times their size in Arrow
                b = whole.slice(lo, 500)
                got = pa.array([None if x is None else e.decode(x) for x in b.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns, got], [*names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())]))


def digest(docs: DataFrame, ranks_path: str, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """row_id, n_tokens, and the hashes of the ids and of the bytes they decode to, in one pass."""
    sent = _send_ranks(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_for(sent.value)
        names = [str(i) for i in range(len(e.tokens))]
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n, hashes, back = [], [], []
            for lo, hi in slices(texts, len, CHARS):
                for got in e.encode(texts[lo:hi]):
                    n.append(len(got))
                    hashes.append(hashlib.sha256(" ".join(map(names.__getitem__, got)).encode()).hexdigest())
                    back.append(hashlib.sha256(e.decode(got)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())], [row_id, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(row_id).cast("long").alias(row_id), F.col(text).cast("string")).mapInArrow(run, f"{row_id} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
