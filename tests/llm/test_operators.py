"""The operators against brute force, the tokenizer library, or held-out rows; nulls, empties, ties and clashing columns."""

import base64
import hashlib
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, components, html_text, jaccard_join, language_id, mixing, personal_data, quality_model, quality_rules, queries, url_rules, vector_search
from tessera.llm.common import hash_words, least_hashed, table, window_hashes

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def docs_of(spark, texts):
    """Documents with columns whose names clash with those that operators add."""
    return spark.createDataFrame([(i, t, "en" if t and "the" in t else None, "s", 0, 0.5, "x") for i, t in enumerate(texts)], DOC)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(seed, n, vocabulary=400):
    r = np.random.default_rng(seed)
    return [f"w{k}" for k in r.integers(0, vocabulary, n)]


def near_copies():
    base = prose(1, 120, 5000)
    out = [None, "", "  \n", "one two", "one two", "ONE two", " ".join(base), " ".join(base), " ".join(base).upper()]
    for k in range(110):  # a group beyond the length of a short run, at all distances
        w = list(base)
        for p in np.random.default_rng(k).integers(0, len(w), k % 9):
            w[p] = f"x{k}{p}"
        out.append(" ".join(w))
    out += [" ".join(prose(s, 60, 5000)) for s in range(50, 70)]
    out.append(" ".join(prose(9, 9000, 5000)))
    out.append(" ".join(prose(9, 9000, 5000)[40:]))
    return out


def brute_components(texts):
    sets = []
    for t in texts:
        w = [x.translate(str.maketrans(url_rules.UPPER, url_rules.LOWER)) for x in words_of(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and 100 * n >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_jaccard_join_equals_brute_force(spark):
    texts = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs_of(spark, texts), run=16, block=3000).collect()}
    assert got == brute_components(texts)


def test_jaccard_join_blocks_of_long_runs(spark, monkeypatch):
    texts = near_copies()
    monkeypatch.setattr(jaccard_join, "SPAN", 24)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs_of(spark, texts), run=8).collect()}
    assert got == {k: v[1] for k, v in brute_components(texts).items()}


def brute_links(texts):
    """Of each text, how many distinct other sets it links with."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset())
    kinds = set(sets) - {frozenset()}
    n = {a: sum(a != b and 100 * len(a & b) >= 75 * len(a | b) for b in kinds) for a in kinds}
    return [n.get(s, 0) for s in sets]


@pytest.mark.parametrize(("run", "block", "buffer"), [(64, 300_000, 200_000), (16, 3000, 200_000), (4, 2000, 300), (200, 500, 100)])
def test_jaccard_join_links_and_buffers(spark, monkeypatch, run, block, buffer):
    """Short and long runs, hot grams cut in the tasks that emit them, clusters of many blocks: links and components alike."""
    monkeypatch.setattr(jaccard_join, "BUFFER", buffer)
    texts = near_copies() + [" ".join(prose(200 + k // 2, 40, 300)) + f" z{k % 2}" for k in range(60)]
    d = docs_of(spark, texts).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_components(d, run=run, block=block).collect()}
    want, links = brute_components(texts), brute_links(texts)
    assert got == {i: (*want[i], links[i]) for i in want}


def test_suffix_bound_holds():
    """Never below what two sets have in common, if the match is the first that they share; often below the whole histograms' bound."""
    r, sharper = np.random.default_rng(8), 0
    for _ in range(300):
        pool = np.unique(r.integers(0, 1 << 63, 80, dtype=np.uint64) * np.uint64(2))
        a, b = (np.sort(r.choice(pool, int(r.integers(20, 60)), replace=False)) for _ in "ab")
        heavy = {int(x) for x in pool if x % np.uint64(7) == 0}
        order = [sorted(x.tolist(), key=lambda g: (g in heavy, g)) for x in (a, b)]
        match = min(set(order[0]) & set(order[1]), key=lambda g: (g in heavy, g))
        h = [np.frombuffer(jaccard_join.histogram(x), np.uint8)[None, :] for x in (a, b)]
        h = [jaccard_join.folded(x, min(y.shape[1] for y in h)) for x in h]
        rank = int(match in heavy)
        most = jaccard_join.after_match(*h, order[0].index(match), order[1].index(match), int(np.uint64(match).astype(np.int64)), rank)[0]
        assert most >= len(set(order[0]) & set(order[1]))
        sharper += most < np.minimum(*h).sum()
    assert sharper > 50


def test_jaccard_join_repeated_and_null_ids(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (2, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(d).collect())
    assert got == [(1, 1), (1, 1), (2, 1)]


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.jaccard_components(docs_of(spark, []).where("false")).count() == 0


def test_rarity_brings_arrays_to_the_driver(spark):
    """All 2^19 buckets: as rows they took 240 MB of the driver's Python."""
    size = 1 << jaccard_join.BUCKET_BITS
    summary = spark.range(size).selectExpr("cast(null as long) as id", "1 + id % 5 * 3 as size", "id as k1")
    tracemalloc.start()
    try:
        rank = jaccard_join.rarity(summary)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    count = 1 + np.arange(size) % 5 * 3
    assert (rank == np.floor(2 * np.log2(np.maximum(count / count.mean(), 1)))).all() and rank.max() == 1 and peak < 60e6


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (None, 3), (2000, 1999)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(e).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[2000] == 1999 and 1000 not in got


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(r.normal(size=6), 2)], 1, 2.0) for i in range(0, 300, 3)]
    rows += [(600, [1.0] * 6, 1, 2.0), (601, [1.0] * 6, 1, 2.0), (602, None, 1, 2.0), (700, [1.0, None, 0.0], 1, 2.0), (800, [float("nan")] * 6, 1, 2.0), (900, [float("inf")] * 6, 1, 2.0), (1000, [0.5, 0.5], 1, 2.0), (None, [1.0] * 6, 1, 2.0), (601, [1.0] * 6, 1, 2.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score double")
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q, v in {i: v for i, v in ok if i % 100 == 0}.items():
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:4]
        want[q] = [(i, -x) for x, i in s]
    for shard in (100_000, 7):  # few shards, and many
        got = defaultdict(list)
        for x in vector_search.top_k(df, F.col("vec_id") % 100 == 0, k=4, shard=shard).orderBy("query_id", "rank").collect():
            got[x["query_id"]].append((x["vec_id"], x["score"]))
        assert got == want
    assert vector_search.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_quality_base_counts(spark):
    texts = [None, "", "a b c", "x\ny\n\nx\n x\n", "p q r s t p q r s t u v", "#a $b% |c| <d> é è\u00a0ü", "aa " * 400]
    d = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in quality_rules.judge(d, np.zeros(1 << quality_rules.BITS)).collect()}
    for i, t in enumerate(texts):
        w, t = words_of(t), t or ""
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if words_of(x)]
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), failed, not failed)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")) == want, t


def test_quality_ratio_keeps_clean_and_drops_junk(spark, sf):
    r = queries.op3_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {x["quality"]: x["k"] for x in r}
    assert kept[1] >= 0.95 and kept.get(0, 0) <= 0.3


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, library):
    texts = ["", None, "Hello world", "I'd've they're 'tis ''s 'll x'll", "a  b\n\n c \n", " \t\n", "é中文 12٣ ²x\u00a0y\u3000z", "x" * 3000 + " " * 50 + "ab" * 900, "ſ’s 'S '", "\u0000 \ud7ff \U0001f600"]
    rnd = np.random.default_rng(2)
    texts += ["".join(rnd.choice(list("ab'sdtrelmv \n1.,é"), 30)) for _ in range(400)]
    got = {r["doc_id"]: r for r in byte_bpe.digest(docs_of(spark, texts), RANKS).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()), repr(t)
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_offsets_and_round_trip(spark):
    d = docs_of(spark, ["Grüße an alle", None, "a b"])
    rows = byte_bpe.decode(byte_bpe.encode(d, RANKS), RANKS).orderBy("doc_id").collect()
    for r in rows:
        raw = (r["text"] or "").encode()
        assert bytes(r["decoded"]) == raw and r["offsets"][-1] == len(raw) and len(r["offsets"]) == len(r["ids"]) + 1 and r["lang"] is None
    assert byte_bpe.digest(d.where("false"), RANKS).count() == 0


PAGE = "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li>Home</li></ul></nav><div class='cookie-notice'>We use cookies</div><!-- x --><article><h1>One &amp; two</h1><p>a  <b>b</b>\n c<br>d<p>e &lt;f&gt;<aside>side</aside><div class='ad'><p>buy</p></div><section id=comments><p>me too</p></section></article><form><input>Go</form><footer>&copy; x</footer></body></html>"


def test_ratio_counts_every_trusted_document(spark):
    """More than 20,000 of them, an id that no document has, repeated labels and null ids."""
    n = 20_600
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 977, F.lit(" v"), F.col("id") % 13).alias("text"))
    docs = docs.union(spark.createDataFrame([(None, "w1 v1"), (n + 5, "other words")], "doc_id long, text string"))
    labels = docs.where(f"doc_id < {n}").select("doc_id", F.lit(1).alias("quality"))
    labels = labels.union(spark.createDataFrame([(3, 1), (3, 0), (None, 1), (n + 5, 0), (n + 9, 1)], "doc_id long, quality int"))
    raw, target = np.full(1 << quality_rules.BITS, 0.5), np.zeros(1 << quality_rules.BITS)
    for k, t in docs.collect():
        one, two, *_ = quality_rules.grams(*hash_words([t.encode().split()]))
        for b in (*one, *two):
            raw[b] += 1
            target[b] += k is not None and k < n
    p = raw / raw.sum()
    assert np.allclose(quality_rules.fit_ratio(docs, labels), np.log((target + 20_000 * p) / (target.sum() + 20_000)) - np.log(p), atol=1e-12)


def test_likely_rows_hold_all_trusted_ones(spark):
    d = spark.range(20_000).select((F.col("id") * 7 - 50_000).alias("doc_id"))
    trusted = d.where("doc_id % 3 = 0")
    got = quality_rules.likely(d, trusted)
    assert trusted.join(got, "doc_id", "left_anti").count() == 0 and got.count() <= 1.01 * trusted.count()
    assert quality_rules.likely(d, trusted.where("false")).count() == 0


def test_ratio_and_verdict_equal_brute_force(spark, sf):
    """Mean log ratio of each text by dictionaries of counts over all documents, and the threshold."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r[0] for r in labels.where("quality = 1").select("doc_id").collect()}
    rows = {r[0]: quality_rules.grams(*hash_words([(r[1] or "").encode().split()])) for r in docs.collect()}
    raw, target = Counter(), Counter()
    for i, (one, two, *_) in rows.items():
        raw.update([*one.tolist(), *two.tolist()])
        if i in good:
            target.update([*one.tolist(), *two.tolist()])
    n, m = sum(raw.values()) + 0.5 * (1 << quality_rules.BITS), sum(target.values())
    ratio = {b: np.log((target[b] + 20_000 * (raw[b] + 0.5) / n) / (m + 20_000)) - np.log((raw[b] + 0.5) / n) for b in raw}
    for r in quality_rules.judge(docs, quality_rules.fit_ratio(docs, labels)).collect():
        one, two, *_ = rows[r["doc_id"]]
        every = [*one.tolist(), *two.tolist()]
        want = sum(ratio[b] for b in every) / max(len(every), 1)
        assert abs(r["llr"] - want) < 1e-9 and r["kept"] == (not r["base_failed"] and r["llr"] >= -0.15)


def test_html_main_text(spark):
    plain = "<body><div>Menu one two three four five six seven eight</div><p>{}</p></body>"
    rows = [(1, "http://a.b/1", PAGE), (2, None, None), (3, "http://a.b/3", ""), (4, "http://a.b/4", "<article></article><p>x</p>"), (5, "http://c.d/5", "<article><p>cut <b>of"), (6, "http://c.d/6", "<article><p>5 < 6 &am"), (1, "http://a.b/1", PAGE)]
    rows += [(10 + k, f"http://e.f/{k}", plain.format(f"only {k} here {'z' * k} and more")) for k in range(4)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect())
    want = {1: "One & two\n\na b c d\n\ne <f>", 2: "", 3: "", 4: "", 5: "cut of", 6: "5 < 6 &am"} | {10 + k: f"only {k} here {'z' * k} and more".replace("  ", " ") for k in range(4)}
    assert got == sorted((r[0], want[r[0]], len(want[r[0]])) for r in rows)
    assert html_text.extract(df.where("false")).count() == 0


def test_html_site_blocks_inside_main(spark):
    """What most pages of a host repeat inside their article goes; headings, and articles that are copies, stay."""
    notice = "Read all that we have written on this matter in our weekly letter"
    title = "Everything that was said about the matter of the day in this town"
    own = {i: " ".join(f"w{i}x{k}" for k in range(40)) for i in range(8)}
    rows = [(i, f"http://a.b/{i}", f"<article><h2>{title}</h2><p>{own[i]}</p><p>{notice}</p></article>") for i in range(6)]
    rows += [(i, f"http://a.b/{i}", f"<article><p>{own[i]}</p></article>") for i in (6, 7)]
    rows += [(10 + i, f"http://c.d/{i}", f"<article><p>{own[0]}</p><p>{own[1]}</p></article>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{title}\n\n{own[i]}" for i in range(6)} | {i: own[i] for i in (6, 7)} | {10 + i: f"{own[0]}\n\n{own[1]}" for i in range(6)}


def test_html_verdict_does_not_depend_on_shards(spark):
    """A block on few pages of a host that is dealt into many shards, and repeated rows of one page."""
    note = "All that stands here may be copied by those who say where they have found it"
    own = {i: " ".join(f"w{i}x{k}" for k in range(40)) for i in range(60)}
    rows = [(i, f"http://a.b/{i}", f"<p>{own[i]}</p>" + f"<div>{note}</div>" * (i % 12 == 0)) for i in range(60)]
    rows += [(100 + k, f"http://c.d/{k}", f"<p>{own[0]}</p><p>{own[k]}</p>") for k in (1, 2, 2, 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for size in (1_000_000, 1_000):
        got = sorted((r["page_id"], r["text"]) for r in html_text.extract(df, shard_bytes=size).collect())
        assert got == sorted([(i, own[i]) for i in range(60)] + [(100 + k, f"{own[0]}\n\n{own[k]}") for k in (1, 2, 2, 2)])


def brute_main_texts(rows, least=8, often=3, site_pages=5):
    """The rules of html_text by dictionaries of all runs of a host, a page at a time."""
    hosts = defaultdict(dict)
    for i, u, x in rows:
        hosts[re.sub(r"^.*?://([^/]*).*", r"\1", u)][(i, u)] = html_text.read_page(x or "")
    out = {}
    for pages in hosts.values():
        seen, mine = defaultdict(set), defaultdict(set)
        for key, p in pages.items():
            disputed = {k for b in p.blocks if p.contested(b) for k in range(b.start, b.end)}
            for k in range(len(p.tokens) - least + 1):
                run = tuple(p.tokens[k : k + least])
                if p.has_main:
                    seen[run].add(key)
                if k in disputed:
                    mine[run].add(key)
        articles = sum(p.has_main for p in pages.values())
        for key, p in pages.items():
            runs = [(k, tuple(p.tokens[k : k + least])) for k in range(len(p.tokens) - least + 1)]
            common = {k + j for k, r in runs if len(mine[r]) >= often for j in range(least)}
            site = {k + j for k, r in runs if len(seen[r]) >= site_pages and 2 * len(seen[r]) > articles for j in range(least)}
            kept = []
            for b in p.blocks:
                span = set(range(b.start, b.end))
                if b.off == 2 or p.has_main and not b.main or p.contested(b) and 2 * len(span & common) >= len(span):
                    continue
                kept.append((b.text, len(span), not p.contested(b), not p.contested(b) and not b.heading and 2 * len(span & site) >= len(span)))
            own = [x for x in kept if x[2]]
            stay = 2 * sum(n for _, n, _, d in own if d) > sum(n for _, n, _, _ in own)
            out[key] = "\n\n".join(t for t, _, _, d in kept if stay or not d)
    return out


def site_pages():
    """Pages of three hosts, with and without an article, that share lines at all rates, some in parts of an unclear name."""
    r, rows = np.random.default_rng(11), []
    shared = [" ".join(f"s{j}x{k}" for k in range(int(r.integers(6, 14)))) for j in range(12)]
    for i in range(90):
        parts = []
        for j in range(int(r.integers(2, 9))):
            line = shared[int(min(r.geometric(0.3), 12)) - 1] if r.random() < 0.6 else " ".join(f"w{x}" for x in r.integers(0, 60, 12))
            tag = ("<p>{}</p>", "<div class='related'>{}</div>", "<section id=search><p>{}</p></section>", "<h2>{}</h2>", "<div class=ad>{}</div>")[int(r.integers(0, 5))]
            parts.append(tag.format(line))
        body = "".join(parts)
        rows.append((i, f"http://h{i % 7 // 3}.example/{i}", f"<body><nav>{shared[0]}</nav>" + (f"<article>{body}</article>" if i % 5 else body) + f"<footer>{shared[1]}</footer>"))
    return rows


@pytest.mark.parametrize(("size", "parts"), [(8_000_000, 4), (3_000, 4), (3_000, 211)])
def test_html_equals_brute_force(spark, size, parts):
    rows = site_pages()
    want, before = brute_main_texts(rows), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
        got = {(r["page_id"], r["url"]): r["text"] for r in html_text.extract(df, shard_bytes=size).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want
    alone = {(i, u): brute_main_texts([(i, u, x)])[(i, u)] for i, u, x in rows}
    assert sum(alone[k] != want[k] for k in want) > 20  # pages that the suffix array changes


def test_html_names_do_not_delete_unique_text(spark):
    rows = [(1, "http://a.b/1", "<article><section id='search'><p>body about search</p></section></article>"), (2, "http://a.b/2", "<article><div class='search-results-article related'><p>main para</p></div></article>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "body about search", 2: "main para"}


def test_html_long_names_do_not_delete_unique_text(spark):
    """A cue that is a small part of a name leaves the block to repetition; short names and names of cues go."""
    body = "<html><body><article><h1>Title {k}</h1><p>First words of page {k} stand here alone.</p><section class='comments-on-law'><p>legal commentary body {k}</p></section>"
    body += "<div class='comment-list'>reader {k}</div><div id='cookie-consent-bar'>we use cookies {k}</div></article></body></html>"
    d = spark.createDataFrame([(k, f"http://a.b/{k}", body.replace("{k}", f"n{k}")) for k in range(4)], "page_id long, url string, html string")
    for k, r in enumerate(html_text.extract(d).orderBy("page_id").collect()):
        assert r["text"] == f"Title n{k}\n\nFirst words of page n{k} stand here alone.\n\nlegal commentary body n{k}"


def test_html_one_page_shards_of_a_large_host(spark):
    """Pages as large as a shard: every page is alone in its own, and the site's text is found all the same."""
    r = np.random.default_rng(3)
    notice = "this notice is on the pages of the site and tells readers nothing new at all"
    rows = []
    for k in range(40):
        own = " ".join(f"u{k}x{x}" for x in r.integers(0, 10**6, 60))
        rows.append((k, f"http://big.host/{k}", f"<html><body><article><h1>T {k}</h1><p>{own}</p>" + (f"<p>{notice}</p>" if k % 4 else "") + "</article></body></html>"))
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {x["page_id"]: x["text"] for x in html_text.extract(d).collect()}
    assert {x["page_id"]: x["text"] for x in html_text.extract(d, shard_bytes=300).collect()} == whole
    assert not any(notice in t for t in whole.values())


def test_html_coverage_is_of_distinct_pages():
    run = "a b c d e f g h".split()
    c = html_text.covered([["x", *run, "y"], ["z", *run], run * 2], 8, 3)
    assert [x.tolist() for x in c[:2]] == [[False] + [True] * 8 + [False], [False] + [True] * 8]
    assert not any(x.any() for x in html_text.covered([run * 3, ["q"]], 8, 2))


def brute_spans(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, p in patterns.items():
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m.group())
            if k == "ip" and any(int(x) > 255 for x in m.group().split(".")) or k == "card" and not (16 <= len(digits) <= 19 and personal_data.luhn(digits)) or k == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def test_personal_data_base_equals_patterns(spark):
    rnd = np.random.default_rng(4)
    texts = [None, "", "4111 1111 1111 1111 and 4111-1111-1111-1112", "a.b@c.d.e@f.g x@y", "1.2.3.4.5.6.7.8 256.1.1.1", "+1 (171) 555-2028 +12"]
    texts += ["".join(rnd.choice(list(a), 30)) for a in ("a@.1-", "1.2.3.", "12 -4", "+1 ().-2", "a@b.c+1 2.3.4.5@") for _ in range(150)]
    got = {r["doc_id"]: r for r in personal_data.digest(personal_data.detect(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in personal_data.BASE] == [sum(x.startswith(k) for x in want) for k in personal_data.BASE]


def test_personal_data_further_kinds_and_redaction(spark):
    t = 'see https://a.b/c?d=1, token = "04dbebab91ab85687d33" at 12 Stone Main Street, mail a@b.cd'
    s = personal_data.find_spans(t)
    assert [t[a:z] for k in ("url", "account", "address") for a, z in s[k]] == ["https://a.b/c?d=1", "04dbebab91ab85687d33", "12 Stone Main Street"]
    r = personal_data.redact(docs_of(spark, [t, None])).orderBy("doc_id").collect()
    assert r[0]["text"] == 'see [URL], token = "[ACCOUNT]" at [ADDRESS], mail [EMAIL]' and r[1]["text"] is None


def test_personal_data_union_leaves_nothing(spark):
    t = "card 4111 1111 1111 111 1.2.3.4 end, mail x+491701234567@a.bc and http://a.b/?token=12345678a"
    s = personal_data.find_spans(t)
    got = personal_data.redact_text(t)
    assert got.startswith("card [CARD] end")
    for k, spans in s.items():
        for a, z in spans:
            assert t[a:z] not in got
    rnd = np.random.default_rng(6)
    for _ in range(300):
        t = "".join(rnd.choice(list("a@.1-+4 :/httpsx"), 60))
        hit = np.zeros(len(t), bool)
        for spans in personal_data.find_spans(t).values():
            for a, z in spans:
                hit[a:z] = True
        mine = np.zeros(len(t), bool)
        for _, a, z in personal_data.merged(personal_data.find_spans(t)):
            assert not mine[a:z].any()
            mine[a:z] = True
        assert (hit == mine).all()


def test_personal_data_accounts_and_addresses():
    def found(kind, t):
        return [t[a:z] for a, z in personal_data.find_spans(t)[kind]]

    assert found("account", "IBAN: DE89 3704 0044 0532 0130 00 bis morgen") == ["DE89 3704 0044 0532 0130 00"]
    assert found("account", "IBAN DE89370400440532013000.") == ["DE89370400440532013000"]
    assert found("account", "iban DE88 3704 0044 0532 0130 00") == []  # wrong check digits, no sign
    assert found("account", "SSN 078-05-1120, passport no. C01234567, account number 1234-5678-90") == ["078-05-1120", "C01234567", "1234-5678-90"]
    assert found("account", "the account of 12 people, a passport in 2012") == []
    assert found("address", "Sie wohnt in der Hauptstrasse 12, er am Kirchplatz 3a.") == ["Hauptstrasse 12", "Kirchplatz 3a"]
    assert found("address", "au 12 rue de la Paix ou 3 bis, avenue Victor Hugo") == ["12 rue de la Paix", "3 bis, avenue Victor Hugo"]
    assert found("address", "en la Calle Mayor 5 y Avenida de la Paz 12") == ["Calle Mayor 5", "Avenida de la Paz 12"]
    assert found("address", "im Jahr 12 der strasse 5, calle mayor") == []


def test_personal_data_of_a_long_text(spark):
    """Five million characters, every span found; an empty table; repeated rows."""
    part = "word " * 95 + "a.b@c.de, 1.2.3.4 "
    t = part * (5_000_000 // len(part))
    s = personal_data.find_spans(t)
    n = t.count("@")
    assert len(s["email"]) == len(s["ip"]) == n and "@" not in personal_data.redact_text(t)
    for run in ("1" * 200_000, "a" * 200_000 + "@", "+1" + "2 " * 200_000, "Aa " * 100_000):
        personal_data.find_spans(run)
    d = docs_of(spark, ["x a@b.cd", "x a@b.cd"])
    assert {r["spans"] for r in personal_data.digest(personal_data.detect(d.union(d))).collect()} == {"email:2:8"}
    assert personal_data.detect(d.where("false")).count() == 0 and personal_data.redact(d.where("false")).count() == 0


def test_quality_classifier_on_held_out_rows(spark, sf):
    big = sf.replace("0.001", "0.01")
    r = queries.op7_quality_classifier(spark, big)
    j = r.join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out")
    assert j.where("quality = predicted").count() >= 0.93 * j.count()
    assert r.where("score is null or score < 0 or score > 1").count() == 0 and r.count() == 1000


def test_quality_classifier_without_classes(spark):
    rows = quality_model.with_statistics(docs_of(spark, [None, "", "a b"])).withColumn("quality", F.lit(1))
    assert quality_model.fit(rows).flat == 1.0 and quality_model.fit(rows.where("false")).flat == 0.5
    assert {x["score"] for x in quality_model.predict(rows, quality_model.fit(rows)).collect()} == {1.0}


def test_language_on_held_out_rows(spark, sf):
    big = sf.replace("0.001", "0.01")
    r = queries.op8_language_id(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert r.where("lang = lang_pred").count() >= 0.97 * r.count()


def test_language_unknown_and_unlearned(spark):
    d = docs_of(spark, [None, "", "123 !!", "the cat", "12 é"])
    one = language_id.fit(d, F.lit(True))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(d, one).collect()}
    assert all(got[i] == ("und", 0.0) for i in (0, 1, 2)) and got[3] == ("en", 1.0) and got[4] == ("en", 1.0)
    none = language_id.fit(d, F.lit(False))
    assert {r["lang_pred"] for r in language_id.predict(d, none).collect()} == {"und"}
    assert language_id.codewords(9).shape == (9, 32) and len({tuple(x) for x in language_id.codewords(4)}) == 4


def test_url_rules_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/x", "https://www.example.org/es/", "http://example.org/en/17?q#f", "http://x.org", "http://x.org?y=/a", "http://notexample.org/es/1", "http://a.com/de/1", "http://com/fr/", "http://a.com.evil.net/de/", "x://y://z/p", "http://é.org/\nq"]
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls + urls[:5])], "page_id long, url string, host string, verdict string")
    for parts in (1, 7):
        for r in url_rules.judge_urls(df, queries.URL_RULES, parts=parts).collect():
            u = (urls + urls[:5])[r["page_id"]]
            m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
            host, path = (m[1].translate(str.maketrans(url_rules.UPPER, url_rules.LOWER)), m[2]) if m else ("", "")
            hits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
            want = max(hits)[1:] if hits else (None, "allow")
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *want), u
    assert url_rules.judge_urls(df, []).where("rule is not null").count() == 0


def test_mixture_meets_its_targets(spark, sf):
    """Rates against the same steps in plain Python."""
    big = sf.replace("0.001", "0.01")
    d, lab = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    r = mixing.mix_to_targets(d, lab, F.expr("concat('q', quality)"), {"q0": 0.3, "q1": 0.7}).collect()
    n, p, rate = np.array([x["n_tokens"] for x in r]), np.array([x["p"] for x in r]), np.array([x["rate"] for x in r])
    assert rate.min() >= 0 and len(r) == d.count()
    assert np.allclose((n * rate) @ p / n.sum(), [0.3, 0.7], atol=0.01)
    want, target = np.ones(len(n)), n.sum() * np.array([0.3, 0.7])
    for _ in range(30):
        over = sum(n[i] * want[i] * p[i] for i in range(len(n))) - target
        if abs(over).max() <= 1e-4 * target.sum():
            break
        every, active = (sum(n[i] * np.outer(p[i], p[i]) for i in range(len(n)) if keep[i]) for keep in (want >= 0, want > 0))
        want = np.maximum(want - p @ np.linalg.solve(active + 1e-6 * every + 1e-9 * np.trace(every) * np.eye(2), over), 0)
    assert np.allclose(rate, want, atol=1e-6)


def test_mixture_of_unlike_documents_equals_brute_force(spark):
    """Given memberships, the fitted totals are the targets wherever rates >= 0 can meet them."""
    r = np.random.default_rng(3)
    p, n = r.dirichlet([0.3, 0.3, 0.3], 400), r.integers(0, 90, 400)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>").repartition(3)
    target = np.array([0.8, 0.15, 0.05]) * n.sum()
    rate = mixing.rates_after(p, mixing.fit_rates(members, target))
    assert rate.min() >= 0 and np.allclose((n * rate) @ p, target, atol=2e-4 * target.sum())
    moments, active, got = mixing.totals(members, 3, [])
    assert np.allclose(moments, (p * n[:, None]).T @ p) and np.allclose(active, moments) and np.allclose(got, n @ p)


def test_draw_takes_rows_at_their_rates(spark):
    """Drawn token shares meet the targets; rates over 1 repeat rows; columns that clash with added ones come back."""
    rows = [(i, " ".join([("good", "fine", "nice")[i % 3] if i % 4 else ("bad", "poor", "vile")[i % 3]] * 20) + f" w{i % 7}", 0.5, "x", "y") for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, p double, n_tokens string, row string")
    lab = d.select("doc_id", (F.col("doc_id") % 4 > 0).cast("int").alias("quality")).where("doc_id % 2 = 0 or doc_id % 3 = 0")
    got = mixing.draw(d, lab, F.col("quality").cast("string"), {"0": 0.5, "1": 0.5})
    assert got.columns == d.columns
    share = {r[0]: r[1] for r in got.groupBy((F.col("doc_id") % 4 > 0).cast("int")).count().collect()}
    assert abs(share[0] / 2000 - 1) < 0.05 and abs(share[1] / 2000 - 1) < 0.05
    assert got.join(d, d.columns, "left_anti").count() == 0
    assert got.exceptAll(mixing.draw(d, lab, F.col("quality").cast("string"), {"0": 0.5, "1": 0.5})).count() == 0


def test_mixture_without_labels(spark):
    d = docs_of(spark, [None, "", "a b"])
    lab = spark.createDataFrame([], "doc_id long, quality int")
    other = spark.createDataFrame([(77, 1), (None, 1), (1, None)], "doc_id long, quality int")
    quality = F.col("quality").cast("string")
    for labels in (lab, other):
        assert {x["rate"] for x in mixing.mix_to_targets(d, labels, quality, {"1": 1.0}).collect()} == {1.0}
        assert mixing.draw(d, labels, quality, {"1": 1.0}).count() == 3
        assert mixing.mix_to_targets(d.where("false"), labels, quality, {"1": 1.0}).count() == 0
        assert mixing.draw(d.where("false"), labels, quality, {"1": 1.0}).count() == 0
    assert mixing.mix_to_targets(d, other.union(spark.createDataFrame([(2, 1), (2, 0), (0, 1)], "doc_id long, quality int")), quality, {"1": 1.0}).count() == 3


def test_windows_stay_inside_documents():
    h, ends = hash_words([[b"a", b"b", b"c"], [], [b"a", b"b"]])
    g, at = window_hashes(h, ends, 2)
    assert at.tolist() == [0, 1, 3] and g[0] == g[2] != g[1]


def test_least_hashed_takes_the_same_rows_as_one_ranking(spark):
    ids = [(i, "ab"[i % 3 == 0]) for i in range(6000)]
    rows = spark.createDataFrame(ids + ids[:600] + [(7, "b")] * 3000 + [(9000, "c")], "doc_id long, k string")
    got = sorted(tuple(r) for r in least_hashed(rows, "k", 30).collect())
    hashed = sorted((r["k"], r["h"] % 2**64, r["doc_id"]) for r in rows.distinct().withColumn("h", F.xxhash64("doc_id")).collect())
    want = [(i, k) for key in "abc" for k, _, i in [x for x in hashed if x[0] == key][:30]]
    assert got == sorted(want)


@pytest.fixture(scope="module")
def folders(spark, sf, tmp_path_factory):
    """Tables without rows, and documents that each stand there twice."""
    base = tmp_path_factory.mktemp("tables")
    for t in ("documents", "labels", "pages", "embeddings", "conversations"):
        rows = table(spark, sf, t)
        rows.where("false").write.parquet(f"{base}/empty/{t}.parquet")
        (rows.unionByName(rows) if t == "documents" else rows).write.parquet(f"{base}/twice/{t}.parquet")
    return base


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_of_empty_tables(spark, folders, name):
    assert queries.QUERIES[name](spark, f"{folders}/empty").collect() == []


@pytest.mark.parametrize("name", ["op3_quality_rules", "op4_byte_bpe", "op6_personal_data", "op7_quality_classifier", "op8_language_id", "op10_mixing"])
def test_repeated_rows_are_each_judged_alike(spark, folders, name):
    got = queries.QUERIES[name](spark, f"{folders}/twice")
    rest = [c for c in got.columns if c != "doc_id"]
    per_id = got.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct(F.struct(*rest)).alias("kinds")).collect()
    assert per_id and all((r["n"], r["kinds"]) == (2, 1) for r in per_id)
