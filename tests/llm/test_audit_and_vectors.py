"""The filter audit and the vectors' near duplicates against brute force; nulls, ties, repeats, long values and clashing names."""

import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit, queries, vector_dedup
from tessera.llm.common import table

DOC = "doc_id long, text string, lang string, source string, mask int, digest string, part string, good int"


def brute_audit(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good, toxic = ({i for i, *said in labels if i is not None and said[k] == 1} for k in (0, 1))
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    rows = []
    for i, text, source in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > first[text]}
        rows.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        gone = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                lost = [r for r in mine if f in r[1] and not r[1] & before]
                gone[f] += len(lost)
                out[part, order, k + 1] = [sum(not r[1] & (before | {f}) for r in mine), len(lost), sum(f in r[1] and bool(r[1] & before) for r in mine), sum(r[1] == {f} for r in mine), sum(r[2] for r in lost), sum(r[3] for r in lost)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(gone[order[k - 1]])
    return out


def audited(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_equals_brute_force(spark):
    r = np.random.default_rng(3)
    texts = [None, "", " \n", "A", "héé # x", "Tab\tone\x0btwo " + "w " * 60, "Ab " * 400_000 + "|"]
    texts += [" ".join(f"{'W' if k % 7 == 0 else 'w'}{x}" for x in r.integers(0, [20, 400][k % 2], 30 + 2 * k)) + "$"[: k % 3 == 0] for k in range(40)]
    docs = [(i, t, [None, "", "a", "b"][i % 4]) for i, t in enumerate(texts)] + [(100 + i, texts[i % 9], "a") for i in range(60)] + [(None, texts[8], "a"), (None, None, "c"), (3, texts[3], "b"), (3, "other", "b")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 150, 3)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (7, None, None)]
    d = spark.createDataFrame([(i, t, "x", s, 7, "x", "p", 5) for i, t, s in docs], DOC).repartition(3)
    got = audited(filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == brute_audit(docs, labels)


def test_words_of_one_hash_are_counted_from_the_words(monkeypatch):
    """All words made to share one hash: verification finds it and the count stays exact."""
    monkeypatch.setattr(filter_audit, "word_hashes", lambda data, begin, end: np.zeros(len(begin), np.uint64))
    texts = [b"a b a c", b"", b"a a a", b"ab a ab"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = filter_audit.scan(data, np.cumsum([0, *map(len, texts)]), filter_audit.byte_classes(b"#"))
    assert n["distinct"].tolist() == [3, 0, 1, 2] and n["words"].tolist() == [4, 0, 3, 3]


def test_scan_in_blocks(monkeypatch):
    texts = [" ".join(f"é{k % 13}B#" for k in range(n)) for n in (0, 1, 5, 300, 40)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *[len(t.encode()) for t in texts]])
    whole = filter_audit.scan(data, bounds, filter_audit.byte_classes(b"#"))
    monkeypatch.setattr(filter_audit, "BLOCK", 7)
    cut = filter_audit.scan(data, bounds, filter_audit.byte_classes(b"#"))
    assert {k: v.tolist() for k, v in whole.items()} == {k: v.tolist() for k, v in cut.items()}
    assert whole["distinct"].tolist() == [0, 1, 5, 13, 13] and whole["points"].tolist() == [len(t) for t in texts]


def test_audit_query_equals_brute_force(spark, sf):
    folder = sf.replace("0.001", "0.01")
    docs = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in table(spark, folder, "labels").select("doc_id", "quality", "toxic").collect()]
    assert audited(queries.QUERIES["op11_filter_audit"](spark, folder)) == brute_audit(docs, labels)


VECTOR = "vec_id long, embedding array<float>, label int, v string, n long, digest string"


def brute_vectors(rows, threshold=0.95):
    ok = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for p, a in enumerate(ok):
        for b in ok[:p]:
            x, y = (np.asarray(rows[k][1], np.float32).astype(float) for k in (a, b))
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k in ok:
        least[find(k)] = min(rows[k][0], least.get(find(k), rows[k][0]))
    return sorted(((i, links[k], least[find(k)] if k in ok else i) for k, (i, _) in enumerate(rows)), key=str)


def group_of_vectors(dim=64):
    r = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x)
    rows = [(k, unit(r.normal(size=dim)).tolist()) for k in range(200)]
    for k in range(40):  # near ones at cosines about the threshold, copies, multiples
        base, noise = np.array(rows[k % 7][1]), unit(r.normal(size=dim))
        c = r.uniform(0.9, 0.999)
        rows.append((300 + k, (c * base + np.sqrt(1 - c * c) * unit(noise - (noise @ base) * base)).tolist()))
    rows += [(400 + k, rows[3][1]) for k in range(30)] + [(500, [x * 1e-30 for x in rows[3][1]]), (501, [x * 1e30 for x in rows[4][1]])]
    rows += [(502, [-x for x in rows[3][1]]), (9, rows[5][1]), (9, rows[6][1]), (9, rows[9][1]), (None, rows[3][1]), (None, None)]
    return [*rows, (600, None), (601, []), (602, [0.0] * dim), (603, [float("nan")] * dim), (604, [float("inf")] + [1.0] * (dim - 1)), (605, [None] + [1.0] * (dim - 1)), (606, [1.0, 2.0]), (607, [2.0, 4.0]), (608, [1.0] * 5000)]


@pytest.mark.parametrize("block", [16, 8192])
def test_vectors_equal_brute_force(spark, block):
    rows = group_of_vectors()
    d = spark.createDataFrame([(i, v, 0, "x", 1, "y") for i, v in rows], VECTOR).repartition(3)
    got = vector_dedup.near_duplicates(d, block=block, recall=0.999999)
    assert got.where("kept <> coalesce(vec_id = component_id, false)").count() == 0
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()), key=str) == brute_vectors(rows)


def test_the_count_meets_its_recall():
    """Of pairs right at the threshold, at least the calibrated share is found, and none below it."""
    r = np.random.default_rng(11)
    base = r.normal(size=(4000, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    noise = r.normal(size=base.shape)
    noise -= (noise * base).sum(axis=1)[:, None] * base
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    c = 0.9500001
    near = c * base + np.sqrt(1 - c * c) * noise
    for recall in (0.9, 0.99):
        found = sum(int((i == j).sum()) for i, j in vector_dedup.linked_pairs(base, near, 0.95, 16, 1.5, recall, 7))
        assert found >= 0.98 * recall * len(base)
    low = 0.9499 * base + np.sqrt(1 - 0.9499**2) * noise
    assert not any(len(i) for i, _ in vector_dedup.linked_pairs(base, low, 0.95, 16, 1.5, 0.999, 7))


def test_vectors_of_the_whole_table_equal_brute_force(spark, sf):
    folder = sf.replace("0.001", "0.01")
    rows = [tuple(r) for r in table(spark, folder, "embeddings").select("vec_id", "embedding").collect()]
    got = queries.QUERIES["op12_vector_dedup"](spark, folder)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()), key=str) == brute_vectors(rows)


def test_hot_keys_are_joined_once(spark):
    rows = spark.createDataFrame([(k, "h" if k < 900 else f"k{k}") for k in range(1000)], "id long, key string")
    found = rows.groupBy("key").agg(F.count("*").alias("size"))
    assert vector_dedup._join_spread(rows, found, "key", "size", 1000).select("id").distinct().count() == 1000
