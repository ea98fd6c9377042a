"""Main text of web pages, with a suffix array over each host's token streams.

A page is read into blocks (runs of text between block-level tags, references decoded, white space folded) and
a token stream of its tags and words. The streams of a host are concatenated; suffixes are sorted by prefix doubling
to a depth of `least` tokens; neighbours that agree that far and lie in enough distinct pages are repeated substrings, and
the tokens under them are covered. A block covered by at least half is boilerplate and goes; unique runs stay. Elements and
words of a class or id only say how much repetition it takes:

- parts that are no article text by their element, role or plain name (menus, sidebars, forms, adverts, notices, reader
  comments ...: `NOT_MAIN`, `ROLES`, `CUES`) go however unique they are, as do parts outside the article or main element of
  a page that has one;
- contested blocks - all others of a page without such an element, and parts inside it with an unclear name (`HINTS`, or a name of which a cue is less
  than half, as "comments-on-law") - go
  where `often` pages of the host have the substring in a contested block;
- other blocks inside the article go where `site_pages` pages and more than half of the host's pages with an article have the
  substring: that is the site's text, not the author's. Headings stay, and where such blocks would be more than half of a
  page's article, all stay: an article is kept even if other pages copy it.

A host with more HTML than `shard_bytes` is dealt into shards by page id, so no task holds more however large the host is
(beyond a million such hosts' worth of input shards grow, so that the list of those hosts may be broadcast). Shards decide
nothing. Contested runs are counted a shard and added up by ranges of their 64-bit hashes. Runs of more than a quarter of a shard's articles
are added up by the same ranges, and those of shards with more than a third of the host's articles are counted by all shards: no run of more than half of the
articles is missed, and their number does not grow with the shards. So the text does not depend on the size of shards or the number of partitions. The pages are shuffled once.

Null html counts as empty and gives an empty text; null urls share one host. Pages of any length are read
whole; repeated rows give the same text and count as distinct pages only if their ids or urls differ. Extra columns are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import html as references
import math
import re
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD_CACHE, materialize, window_hashes
from tessera.llm.url_rules import url_host

# Element names and the words in a class, id or role that mark a part as not main text.
HOLDS_MAIN = {"article", "main"}
NOT_MAIN = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "iframe", "object", "svg", "head", "template", "noscript"}
TRACKED = HOLDS_MAIN | NOT_MAIN | {"div", "section", "header", "ul", "ol", "li", "table", "p", "dl", "figure", "details", "blockquote", "span", "body"}
BREAKS = TRACKED - {"span", "button", "select", "svg"} | {"h1", "h2", "h3", "h4", "h5", "h6", "pre", "hr", "tr", "dt", "dd", "figcaption", "address", "summary", "caption", "html", "option", "title"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CUES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "login",
    "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "replies", "reply", "sidebar", "signup", "sponsor", "sponsored", "subscribe",
}
# Words that often name such a part, but an article's own as well; there repetition decides.
HINTS = {"breadcrumb", "breadcrumbs", "modal", "notification", "pagination", "popup", "promo", "promotion", "related", "search", "share", "sharing", "social", "toolbar", "widget"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}

_markup = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|noscript|template|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<[a-zA-Z!/?][^<>]*\Z", re.S | re.I)
_attribute = re.compile(r"\b(class|id|role|style|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_name_part = re.compile(r"[a-z0-9]+")


def _marked(attributes: str) -> int:
    """What an element's attributes say: 0 nothing, 1 that repetition decides, 2 that it holds no main text."""
    if not attributes:
        return 0
    hint = 0
    for name, *value in _attribute.findall(attributes):
        v = "".join(value).lower()
        name = name.lower()
        if name == "role":
            if v.strip() in ROLES:
                return 2
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v):
                return 2
        elif name == "aria-hidden":
            if v == "true":
                return 2
        else:
            for token in v.split():
                words = _name_part.findall(token)
                cues = sum(w in CUES for w in words)
                if cues and 2 * cues >= len(words):
                    return 2
                hint = max(hint, int(cues > 0 or any(w in HINTS for w in words)))
    return 2 if re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes, re.I) else hint


class Block(NamedTuple):
    text: str
    main: bool  # inside an article or main element
    off: int  # as `_marked`, of the part around it
    heading: bool
    start: int  # its tokens
    end: int


class Page(NamedTuple):
    blocks: list[Block]
    tokens: list[str]
    has_main: bool

    def contested(self, b: Block) -> bool:
        return b.off == 1 if self.has_main and b.main else not self.has_main and b.off < 2


def read_page(page: str) -> Page:
    blocks, tokens, run = [], [], []
    stack: list[tuple[str, bool, int]] = []  # element, inside main, the strongest mark around
    main = has_main = heading = False
    done = off = 0

    def close() -> None:
        if run:
            words = references.unescape("".join(run)).split()
            run.clear()
            if words:
                blocks.append(Block(" ".join(words), main, off, heading, len(tokens), len(tokens) + len(words)))
                tokens.extend(words)

    for m in _markup.finditer(page):
        if m.start() > done:
            run.append(page[done : m.start()])
        done = m.end()
        raw, slash, name, attributes = m.groups()
        if name is None:
            if raw and raw.lower() == "title":
                close()
            continue
        name = name.lower()
        if name in ("br", "td", "th"):
            run.append(" ")
        if name not in BREAKS and name not in TRACKED:
            continue
        if name in BREAKS:
            close()
        if name in HEADINGS:
            heading = not slash
        elif name in BREAKS:
            heading = False
        tokens.append(f"<{slash}{name}>")
        if name not in TRACKED:
            continue
        if slash:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if at is not None:
                close()
                del stack[at:]
                _, main, off = stack[-1] if stack else ("", False, 0)
            continue
        if stack and stack[-1][0] == "p" and name in BREAKS:  # a paragraph ends where another block begins
            stack.pop()
            _, main, off = stack[-1] if stack else ("", False, 0)
        bad = 2 if name in NOT_MAIN or (name == "header" and not main) else _marked(attributes)
        if bad or name in HOLDS_MAIN or stack or name != "span":
            if bad > off:
                close()
            main, off = main or name in HOLDS_MAIN, max(off, bad)
            has_main |= main and off < 2
            if not attributes.rstrip().endswith("/"):
                stack.append((name, main, off))
    if done < len(page):
        run.append(page[done:])
    close()
    return Page(blocks, tokens, has_main)


class _TokenHashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h


_tokens = _TokenHashes()


def token_hashes(streams: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of streams laid end to end, the same in every process, and where each stream begins."""
    ends = np.zeros(len(streams) + 1, np.int64)
    np.cumsum([len(s) for s in streams], out=ends[1:])
    return np.fromiter(map(_tokens.__getitem__, chain.from_iterable(streams)), np.uint64, int(ends[-1])), ends


def repeats(h: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array to a depth of `least` tokens: where runs of that many start inside a stream, equal ones side by side, and
    the group of equal runs each is in."""
    size = np.diff(ends)
    n = len(h)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.unique(h, return_inverse=True)[1].astype(np.int64) + 1
    left = np.repeat(ends[1:], size) - np.arange(n)  # tokens to the stream's end
    depth = 1
    while depth < least:  # prefix doubling: ranks of suffixes by their first `depth` tokens
        step = min(depth, least - depth)
        next_rank = np.zeros(n, np.int64)
        next_rank[: n - step] = rank[step:]
        next_rank[left <= step] = 0
        pair = rank * (n + 1) + next_rank
        order = np.argsort(pair)
        a = pair[order]
        rank[order] = np.cumsum(np.append(True, a[1:] != a[:-1]))
        depth += step
    order = order[left[order] >= least]  # the suffix array to that depth
    r = rank[order]
    return order, np.cumsum(np.append(False, r[1:] != r[:-1]))[: len(r)]


def owners_of(start: np.ndarray, group: np.ndarray, owner: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """How many distinct owners each group of runs has, among the runs that start at `counted` tokens."""
    keep = counted[start]
    span = int(owner.max(initial=0)) + 1
    pairs = np.sort(group[keep] * span + owner[start[keep]])
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
    return np.bincount(pairs // span, minlength=int(group[-1]) + 1 if len(group) else 0)


def under(starts: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Which tokens lie in a run of `least` tokens with one of these starts."""
    cover = np.zeros(int(ends[-1]) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.subtract.at(cover, starts + least, 1)
    return np.cumsum(cover)[:-1] > 0


def covered(streams: list[list[str]], least: int, pages: int) -> list[np.ndarray]:
    """For each stream, which tokens lie in a substring of `least` tokens that `pages` distinct streams have."""
    h, ends = token_hashes(streams)
    start, group = repeats(h, ends, least)
    n = owners_of(start, group, np.repeat(np.arange(len(streams)), np.diff(ends)), np.ones(len(h), bool))
    return np.split(under(start[n[group] >= pages], ends, least), ends[1:-1])


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys, as differences by byte planes: the high bytes are zeros, which shuffles compress."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def page_numbers(ids: list, urls: list) -> list[int]:
    """Which distinct page each row is of."""
    seen: dict[tuple, int] = {}
    return [seen.setdefault(x, len(seen)) for x in zip(ids, urls)]


class Host:
    """The pages of a host, or of a shard of it, with the runs of their token streams."""

    def __init__(self, pages: list[str], owners: list[int], least: int):
        self.least, self.pages, self.owners = least, [read_page(p) for p in pages], np.array(owners, np.int64)
        self.h, self.ends = token_hashes([p.tokens for p in self.pages])
        size = np.diff(self.ends)
        self.owner = np.repeat(self.owners, size)
        self.in_main = np.repeat(np.array([p.has_main for p in self.pages], bool), size)
        self.contested = np.zeros(len(self.h), bool)
        for p, at in zip(self.pages, self.ends.tolist()):
            for b in p.blocks:
                if p.contested(b):
                    self.contested[at + b.start : at + b.end] = True
        self.main_pages = len(set(self.owners[[p.has_main for p in self.pages]].tolist()))

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, groups, and each group's pages: of contested blocks, and of those with an article."""
        start, group = repeats(self.h, self.ends, self.least)
        return start, group, owners_of(start, group, self.owner, self.contested), owners_of(start, group, self.owner, self.in_main)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of all runs, the same in every process, and where they start."""
        return window_hashes(self.h, self.ends, self.least)

    def texts(self, contested: np.ndarray, site: np.ndarray) -> list[str]:
        """Each page's main text, given the starts of runs that are too common in contested blocks, and in articles."""
        common, of_site, out = under(contested, self.ends, self.least), under(site, self.ends, self.least), []
        for p, at in zip(self.pages, self.ends.tolist()):
            kept, sites, total = [], 0, 0
            for b in p.blocks:
                if b.off == 2 or p.has_main and not b.main:
                    continue
                n = b.end - b.start
                if p.contested(b):
                    if 2 * int(common[at + b.start : at + b.end].sum()) < n:
                        kept.append((b.text, False))
                else:
                    drop = not b.heading and 2 * int(of_site[at + b.start : at + b.end].sum()) >= n
                    total, sites = total + n, sites + n * drop
                    kept.append((b.text, drop))
            out.append("\n\n".join(t for t, drop in kept if not drop or 2 * sites > total))
        return out


PARTITION_CHARS = 64_000_000
MOST_LARGE = 1_000_000
_RUNS = pa.schema([("part", pa.string()), ("shard", pa.string()), ("host", pa.string()), ("kind", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()), ("key", pa.int64()), ("pages", pa.int64())])
_runs = "part string, shard string, host string, kind int, keys binary, n binary, key long, pages long"


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_RUNS)], schema=_RUNS)


def extract(pages: DataFrame, least: int = 8, often: int = 3, site_pages: int = 5, shard_bytes: int = 1_000_000, row_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """row_id, url, text and n_chars of each row."""
    spark = pages.sparkSession
    data = pages.select(F.col(row_id).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("page"), F.coalesce(url_host(F.col(url).cast("string")), F.lit("")).alias("host"))
    sizes = materialize(data.groupBy("host").agg(F.sum(F.length("page") + 1).alias("bytes")), "hosts")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    share = max(shard_bytes, total // MOST_LARGE)
    large = F.broadcast(sizes.where(F.col("bytes") > share).select("host", F.ceil(F.col("bytes") / F.lit(share)).cast("int").alias("shards")))
    dealt = data.join(large, "host", "left")
    dealt = dealt.withColumn("shard", F.concat_ws(" ", "host", F.pmod(F.xxhash64("id", "url"), F.coalesce("shards", F.lit(1)))))
    # All readers below take the same columns, so that one shuffle of the pages serves them.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PARTITION_CHARS)
    dealt = dealt.select("shard", "host", "shards", "id", "url", "page").repartition(parts, "shard")
    kind = pages.schema[row_id].dataType.simpleString()

    def read(shard: pa.Table) -> Host:
        return Host(shard.column("page").to_pylist(), page_numbers(shard.column("id").to_pylist(), shard.column("url").to_pylist()), least)

    def propose(shard: pa.Table) -> pa.Table:
        """Of a large host's shard: contested runs and their pages (kind 0) and runs of more than a quarter of its articles (1), both packed by ranges of
        their keys; how many articles it has (2)."""
        found = []
        if (shards := shard.column("shards")[0].as_py()) is not None:
            host, name, one = shard.column("host")[0].as_py(), shard.column("shard")[0].as_py(), read(shard)
            start, group, contested, site = one.counted()
            keys, at = one.keys()
            of = keys[np.searchsorted(at, start[np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])])]
            ranges = min(shards, max(16, math.isqrt(64 * shards)))  # 8 x the root of the shards: rows and a range's keys both stay small
            for kind, keep, pages in ((0, contested > 0, contested), (1, 4 * site > one.main_pages, None)):
                k, n = of[keep], None if pages is None else pages[keep].astype("<u4")
                order = np.argsort(k)
                k, n = k[order], None if n is None else n[order]
                part = (k >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                ends = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
                found += [(f"{host} {i}", name, host, kind, pack(k[a:z]), None if n is None else n[a:z].tobytes(), None, one.main_pages) for i, (a, z) in enumerate(zip(ends[:-1], ends[1:])) if z > a]
            found.append((name, name, host, 2, None, None, None, one.main_pages))
        return _table(found)

    def add_up(part: pa.Table) -> pa.Table:
        """Of one range of a host's keys: contested runs that `often` pages have (kind 0, packed for each shard that has them), and runs that
        may be in more than half of the articles (1); other rows as they are.

        If more than half of a host's A articles have a run, the shards where more than a quarter of the articles have it hold more than A / 3 articles: W such
        articles and a quarter of the others must pass A / 2. So the shards' articles are added up for each run, and few runs are left: a twelfth of the articles has each.
        """
        rest = part.filter(pc.greater(part.column("kind"), 1)).cast(_RUNS)
        found = []
        rows = part.filter(pc.equal(part.column("kind"), 0)).to_pylist()
        keys = [unpack(r["keys"]) for r in rows]
        every, which = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
        n = np.bincount(which, weights=np.concatenate([np.zeros(0), *[np.frombuffer(r["n"], "<u4") for r in rows]]), minlength=len(every))
        common = every[n >= often]
        for r, k in zip(rows, keys):
            k = k[np.isin(k, common)]
            if len(k):
                found.append((r["part"], r["shard"], r["host"], 0, pack(k), None, None, None))
        if rows := part.filter(pc.equal(part.column("kind"), 1)).to_pylist():
            keys, pages = [unpack(r["keys"]) for r in rows], [r["pages"] for r in rows]
            every, which = np.unique(np.concatenate(keys), return_inverse=True)
            weight = np.bincount(which, weights=np.repeat(pages, [len(k) for k in keys]), minlength=len(every))
            found += [(rows[0]["part"], None, rows[0]["host"], 1, None, None, k, None) for k in every[3 * weight > sum(pages)].view(np.int64).tolist()]
        return pa.concat_tables([rest, _table(found)])

    def tally(shard: pa.Table, asked: pa.Table) -> pa.Table:
        """The pages of a shard that have each run its host's shards proposed."""
        hosts, counts, keys = [], np.zeros(0, np.int64), np.sort(asked.column("key").to_numpy().view(np.uint64))
        if shard.num_rows and len(keys):
            one = read(shard)
            own, at = one.keys()
            where = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = (keys[where] == own) & one.in_main[at]
            pairs = np.unique(where[hit] * (len(one.pages) + 1) + one.owner[at[hit]])
            counts = np.bincount(pairs // (len(one.pages) + 1), minlength=len(keys))
            hosts = [shard.column("host")[0].as_py()] * len(keys)
        return pa.table({"host": pa.array(hosts, pa.string()), "key": pa.array(keys[: len(hosts)].view(np.int64)), "n": pa.array(counts, pa.int64())})

    def finish(shard: pa.Table, told: pa.Table) -> pa.Table:
        ids, urls, texts = shard.column("id"), shard.column("url"), []
        if shard.num_rows:
            one = read(shard)
            if shard.column("shards")[0].as_py() is None:
                start, group, contested, site = one.counted()
                common, of_site = start[contested[group] >= often], start[site[group] >= max(site_pages, one.main_pages // 2 + 1)]
            else:
                own, at = one.keys()
                packed = [unpack(k) for k in told.column("keys").to_pylist() if k is not None]
                common = at[np.isin(own, np.concatenate([np.zeros(0, np.uint64), *packed]))]
                of_site = at[np.isin(own, told.column("key").drop_null().to_numpy().view(np.uint64))]
            texts = one.texts(common, of_site)
        return pa.table([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [row_id, "url", "text", "n_chars"])

    if large.isEmpty():
        told = spark.createDataFrame([], "shard string, keys binary, key long")
    else:
        # Both users of `found` read one exchange of what the shards propose.
        found = dealt.groupBy("shard").applyInArrow(propose, _runs).groupBy("part").applyInArrow(add_up, _runs)
        shards_of = F.explode(F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda k: F.concat_ws(" ", "host", k.cast("string")))).alias("shard")
        asked = found.where("kind = 1").select("host", "key").distinct().join(large, "host").select(shards_of, "key")
        counts = dealt.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(tally, "host string, key long, n long").groupBy("host", "key").agg(F.sum("n").alias("n"))
        articles = found.where("kind = 2").groupBy("host").agg(F.sum("pages").alias("articles"))
        site = counts.join(articles, "host").where((F.col("n") >= site_pages) & (2 * F.col("n") > F.col("articles"))).join(large, "host").select(shards_of, F.lit(None).cast("binary").alias("keys"), "key")
        told = found.where("kind = 0").select("shard", "keys", "key").unionByName(site)
    return dealt.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(finish, f"{row_id} {kind}, url string, text string, n_chars long")
