"""Plain versions of the classifiers' formulas and of every pipeline stage's decision; very long texts, ties and clashing names."""

import base64
import math
import re
from collections import Counter

import corpus_pipeline as c
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, html_text, jaccard_join, language_id, mixing, personal_data, quality_model, quality_rules, queries, vector_search
from tessera.llm.common import materialize, table

CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, x array<double>, ids string, id long, rate double, task string, n_words long, grams long"


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, 0.5, [1.0], "i", 7, 9.0, "t", 1, 2) for i, t in enumerate(texts)], CLASH)


def plain_statistics(text):
    """The fourteen statistics of a text, one by one."""
    space = "\t\n\x0b\x0c\r "
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    size, n = max(sum(ch not in space for ch in text), 1), max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip(space)]
    share = lambda kinds: sum(ch in kinds for ch in text) / size
    lengths = [len(w.encode()) for w in words]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    rare = lambda x: math.log(x + 0.002)
    return [
        math.log1p(len(words)), math.log(size / n), math.log1p(max(lengths, default=0)), rare(share("ABCDEFGHIJKLMNOPQRSTUVWXYZ")), rare(share("0123456789")), rare(share(".,;:!?")), rare(share("!")),
        rare(share("#*$%&|<>{}[]()=+@\\/^~_\"'-")), len(set(words)) / n, rare(len(covered) / n), rare((len(lines) - len(set(lines))) / max(len(lines), 1)),
        sum(x <= 3 for x in lengths) / n, sum(x >= 12 for x in lengths) / n, math.log1p(n / max(len(lines), 1)),
    ]


def test_quality_scores_equal_the_formula(spark, sf):
    """Statistics one by one, covariances by numpy, densities by determinant and inverse."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = {r["doc_id"]: r["score"] for r in queries.QUERIES["op7_quality_classifier"](spark, sf).collect()}
    held = {r["doc_id"] for r in docs.where(queries.QUALITY_HELD_OUT).select("doc_id").collect()}
    x = {r["doc_id"]: plain_statistics(r["text"] or "") for r in docs.collect()}
    taught = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["doc_id"] in x and r["doc_id"] not in held and r["quality"] in (0, 1)]
    groups = [np.array([x[i] for i, q in taught if q == k]) for k in (0, 1)]
    n = [len(g) for g in groups]
    covs = [np.cov(g.T, bias=True) for g in groups]
    pooled = np.diag(np.diag((n[0] * covs[0] + n[1] * covs[1]) / sum(n))) + 1e-4 * np.eye(14)
    shrunk = [0.9 * v + 0.1 * pooled for v in covs]

    def density(v, k):
        d = np.array(v) - groups[k].mean(0)
        return math.log(n[k] / sum(n)) - 0.5 * np.linalg.slogdet(shrunk[k])[1] - 0.5 * d @ np.linalg.inv(shrunk[k]) @ d

    for i, v in x.items():
        assert got[i] == pytest.approx(1 / (1 + math.exp(np.clip(density(v, 0) - density(v, 1), -500, 500))), abs=1e-6)
    assert len(got) == len(x)


def plain_grams(text):
    """Buckets of the 2- and 3-grams of a text, whose ends are two gaps, one by one."""
    m, out = (1 << 32) - 1, []
    low = text.lower() + "  "
    codes = [ord(ch) if ch.isalpha() else 32 for ch in low]
    n = len(codes)
    for i in range(n):
        two = three = 0
        if i < n - 2 and not i == max(n - 3, 0):
            t = (codes[i] * 0x9E3779B1 + codes[i + 1] * 0x85EBCA77) & m
            two = (((t ^ (t >> 15)) * 0x2545F491) & m) >> 17
            h = (t * 0xC2B2AE3D + codes[i + 2] * 0x27D4EB2F) & m
            three = (((h ^ (h >> 15)) * 0x2545F491) & m) >> 17
        out.append((two, three))
    return out


def test_language_scores_equal_the_formula(spark, sf):
    """Gram counts, weights, trust and loss-weighted distances by plain loops."""
    docs = table(spark, sf, "documents").limit(140)
    rows = [(r["doc_id"], (r["text"] or "")[:1500], r["lang"]) for r in docs.collect()] + [(900, None, "fr"), (901, "1 2 3", None), (902, "été là", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(d, F.col("doc_id") % 3 != 1)
    got = {r["doc_id"]: r for r in language_id.predict(d, model).collect()}
    taught = [(t, lang) for i, t, lang in rows if i % 3 != 1 and t is not None and lang is not None]
    langs = sorted({lang for _, lang in taught})
    counts = {lang: Counter() for lang in langs}
    for t, lang in taught:
        for pair in plain_grams(t):
            counts[lang].update(pair)
    for v in counts.values():
        v[0] = 0
    p = {lang: [(counts[lang][b] + 0.5) / (sum(counts[lang].values()) + 0.5 * 32768) for b in range(32768)] for lang in langs}
    code = language_id.codewords(len(langs))
    weights = []
    for b in range(code.shape[1]):
        up, down = ([p[lang] for k, lang in enumerate(langs) if code[k, b] * s > 0] for s in (1, -1))
        weights.append([math.log(sum(v[g] for v in up) / len(up)) - math.log(sum(v[g] for v in down) / len(down)) if g else 0.0 for g in range(32768)])

    def margins(text):
        grams = plain_grams(text)
        n = max(sum((a > 0) + (b > 0) for a, b in grams), 1)
        return [sum(w[a] + w[b] for a, b in grams) / n for w in weights]

    right = {lang: np.mean([[m * s > 0 for m, s in zip(margins(t), code[k])] for t, x in taught if x == lang], axis=0) for k, lang in enumerate(langs)}
    trust = {lang: np.maximum(v, 0.01) / np.maximum(v, 0.01).sum() for lang, v in right.items()}
    for i, t, _ in rows:
        if t is None or not any(map(str.isalpha, t)):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        m = margins(t)
        e = np.array([math.exp(-len(m) * sum(w * math.log1p(math.exp(-12 * x * s)) for w, x, s in zip(trust[lang], m, code[k]))) for k, lang in enumerate(langs)])
        share = e / e.sum()
        assert got[i]["score"] == pytest.approx(share.max(), abs=2e-3)
        if np.sort(share)[-1] - np.sort(share)[-2] > 0.01:
            assert got[i]["lang_pred"] == langs[int(share.argmax())]


def test_languages_that_tie_are_ambiguous(spark):
    model = language_id.CodeModel(["aa", "bb"], language_id.codewords(2), np.zeros((1, 32768), np.float32), np.ones((2, 1)))
    assert language_id.decide(model, ["abc def"], 0.1) == (["aa"], [0.5], [True])


def brute_groups(rows):
    """Least id of each row's group of texts of five-word shingles with a similarity of .75."""
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    by_gram, root = {}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        met = Counter(j for g in s for j in by_gram.get(g, ()))
        for j, n in met.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(rows[k][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
        for g in s:
            by_gram.setdefault(g, []).append(k)
    return {i: find(i) for i, _ in rows}


def test_every_stage_decides_as_a_plain_version_does(spark, sf):
    """Language: what `decide` accepts; copies: brute-force groups; PII: base patterns gone, other text untouched; mixing: rates' floors and one more; BPE: the tokenizer library."""
    docs = materialize(table(spark, sf, "documents"), "stage-in")
    first = materialize(c.identify_language(spark, docs, sf), "stage-1")
    model = language_id.fit(docs, F.lit(True))
    rows = docs.collect()
    said = list(zip(*language_id.decide(model, [r["text"] or "" for r in rows], 0.1)))
    want = {(r["doc_id"], r["lang"] if r["lang"] is not None else lang) for r, (lang, _, unclear) in zip(rows, said) if lang != "und" and not unclear}
    assert {(r["doc_id"], r["lang"]) for r in first.collect()} == want
    second = materialize(c.drop_near_copies(spark, first, sf), "stage-2")
    groups = brute_groups([(r["doc_id"], r["text"]) for r in first.collect()])
    assert {r["doc_id"] for r in second.collect()} == {i for i, g in groups.items() if i == g}
    third = materialize(c.redact_personal_data(spark, second, sf), "stage-3")
    before, spans = {r["doc_id"]: r["text"] for r in second.collect()}, {r["doc_id"]: r["spans"] for r in personal_data.digest(personal_data.detect(second)).collect()}
    for r in third.collect():
        text, union = before[r["doc_id"]], []
        for s, e in sorted(tuple(map(int, x.split(":")[-2:])) for x in spans[r["doc_id"]].split(",") if x):
            if union and s < union[-1][1]:
                union[-1][1] = max(union[-1][1], e)
            else:
                union.append([s, e])
        plain = "".join(re.escape(text[a:b]) + r"\[?[^\n]{0,40}?\]?" for a, b in zip([0, *[u[1] for u in union]], [u[0] for u in union])) + re.escape(text[union[-1][1] if union else 0 :])
        assert re.fullmatch(plain, r["text"], re.S) and r["n_chars"] == len(r["text"])
    fourth = materialize(c.mix_domains(spark, third, sf), "stage-4")
    rates = {r["doc_id"]: r["rate"] for r in mixing.mix_to_targets(third, table(spark, sf, "labels"), F.expr(queries.DOMAIN), queries.DOMAIN_WEIGHTS, full="q1t0").select("doc_id", "rate").collect()}
    drawn = Counter(r["doc_id"] for r in fourth.collect())
    assert all(math.floor(rates[i] + 1e-9) <= drawn[i] <= math.floor(rates[i] + 1e-9) + 1 for i in rates if abs(rates[i] - round(rates[i])) > 1e-6)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(t): int(k) for t, k in (line.split() for line in f.read().splitlines() if line)}
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in fourth.collect()}
    for r in c.encode_tokens(spark, fourth, sf).collect():
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["exact"]


def long_texts():
    w = [f"word{k % 900}" for k in range(120_000)]
    return [" ".join(w), " ".join(w[:-3]), "x" * 1_500_000, "The cat sat on the mat. " * 20_000, "short one"]


def test_very_long_texts_and_clashing_names(spark):
    d = clashing(spark, long_texts())
    j = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(d).collect()}
    assert j[0][1] == j[1][1] == 0 and j[0][0] == 900 and {j[k][1] for k in (2, 3, 4)} == {2, 3, 4}
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    rules = {r["doc_id"]: r for r in quality_rules.judge(d, quality_rules.fit_ratio(d, labels)).collect()}
    assert rules[0]["n_words"] == 120_000 and rules[2]["word_chars"] == 1_500_000 and rules[3]["base_failed"]
    scored = quality_model.predict(quality_model.with_statistics(d), quality_model.Discriminant([], [], [], 0.25)).collect()
    assert [r["score"] for r in scored] == [0.25] * 5
    x = {r["doc_id"]: r["x"] for r in quality_model.with_statistics(d).collect()}
    assert x[2] == pytest.approx(plain_statistics("x" * 1_500_000))
    lang = language_id.predict(d, language_id.fit(d, F.lit(True))).collect()
    assert {r["lang_pred"] for r in lang} == {"en"}
    rates = mixing.mix_to_targets(d, labels, F.expr(queries.DOMAIN), queries.DOMAIN_WEIGHTS, full="q1t0")
    assert rates.count() == 5
    coded = {r["doc_id"]: r for r in byte_bpe.encode(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), ids="tokens", offsets=None, exact="ok").collect()}
    assert all(r["ok"] and r["ids"] == "i" and r["task"] == "t" for r in coded.values())
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<article><p>{t}</p></article>", "t", 1) for k, t in enumerate(long_texts())], "page_id long, url string, html string, text string, n_chars long")
    assert {r["page_id"]: r["n_chars"] for r in html_text.extract(pages).collect()} == {k: len(" ".join(t.split())) for k, t in enumerate(long_texts())}


def test_one_overlong_vector(spark):
    rows = [(k, [float(k % 3), 1.0]) for k in range(0, 400, 50)] + [(7, [1.0] * 20_000)]
    d = spark.createDataFrame([(i, v, 0, "s") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")
    got = vector_search.top_k(d, F.col("vec_id") % 100 == 0, k=3).where("query_id = 0").orderBy("rank").collect()
    want = sorted(((-sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(rows[0][1], v)), i) for i, v in rows if i), key=lambda x: x)[:3]
    assert [(-r["score"], r["vec_id"]) for r in got] == want
