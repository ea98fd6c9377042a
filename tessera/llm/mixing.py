"""Mixing sources to target weights with soft membership.

A classifier learned from a table of labelled documents gives every document a posterior over domains (a domain is a
distinct value of the label expression). Rates r >= 0, one a document, are then fitted so that the expected
tokens of each domain, sum_i r_i n_i p_ik, come to its target: least squares over the domains' totals, by
projected gradient from r = 1. A step moves each rate against the gradient in the metric of its tokens,
with the totals' misses weighed by the inverse of the domains' second moments (over the rows of a rate above 0), and cuts it
off at 0; steps that make the misses larger are cut (`fit_rates`). A step is a pass
over the table of posteriors that returns (2 x domains + 1) x domains sums; rates are never collected: a task works them
out from the few step vectors so far.

The classifier is a softmax regression over the hashed distinct words whose counts tell some domain apart (far from
what chance would give; `features` of them at most). It is fitted to at most `learn_rows` labelled documents
a domain, those of least hashed id (a documented bound); everything else covers every document. Posteriors
are written once to the shared folder.

`draw` applies the rates: a row is taken floor(rate) times, and once more by chance, by a hash of its id. So the expected
tokens of what is drawn are those that were fitted.

Null and empty texts have no tokens, the prior as their posterior, and a rate like any other; it changes no total.
Labels with a null label or id are not used; a label that names a domain without a target has target 0. A document
labelled twice teaches both. Where no label names a document, every document is in one unnamed domain and
keeps rate 1. Repeated rows each get a rate; in `draw`, rows that repeat an id share their chance. Columns whose names
clash with those added are no matter: `mix_to_targets` reads id and text only, `draw` gives the columns of its input. Very long texts
are read whole; words that tell domains apart equally well go by their bucket. An
empty table of documents, or of labels, gives no rows, or rates of 1.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import columns, hash_words, least_hashed, materialize, mix, slices, text_bytes

BITS = 16


def word_cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of the distinct buckets of each text's words, and each text's number of words."""
    h, ends = hash_words([t.split() for t in texts])
    n = np.diff(ends)
    bucket = (mix(np.zeros(len(h), np.uint64), h) >> np.uint64(64 - BITS)).astype(np.int64)
    cell = np.unique((np.repeat(np.arange(len(texts)), n) << BITS) | bucket)
    return cell >> BITS, cell & ((1 << BITS) - 1), n


@dataclass
class DomainModel:
    domains: list[str]
    log_prior: np.ndarray
    weights: np.ndarray  # domains x buckets, 0 where a bucket tells nothing apart

    def posteriors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        doc, bucket, n = word_cells(texts)
        s = np.tile(self.log_prior, (len(texts), 1))
        for k in range(len(self.domains)):
            s[:, k] += np.bincount(doc, weights=self.weights[k][bucket], minlength=len(texts))
        s = np.exp(s - s.max(1, keepdims=True))
        return s / s.sum(1, keepdims=True), n


#: What stands where nothing is taught.
ONE_DOMAIN = DomainModel(["all"], np.zeros(1), np.zeros((1, 1 << BITS)))


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, learn_rows: int = 5000, features: int = 2000) -> DomainModel:
    named = labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null")
    shares = {r["domain"]: r["n"] for r in named.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(shares)
    if not domains:
        return ONE_DOMAIN
    place = {d: i for i, d in enumerate(domains)}
    sample = least_hashed(named, "domain", learn_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(domains) << BITS), np.zeros(len(domains))
        for b in batches:
            texts, names = [t or b"" for t in b.column(0).to_pylist()], b.column(1).to_pylist()
            for lo, hi in slices(texts, len, 4_000_000):
                doc, bucket, _ = word_cells(texts[lo:hi])
                of = np.array([place[x] for x in names[lo:hi]])
                total += np.bincount((of[doc] << BITS) | bucket, minlength=len(total))
                rows += np.bincount(of, minlength=len(domains))
        at = np.flatnonzero(total)
        cells = [np.concatenate([at, -1 - np.arange(len(domains))]), np.concatenate([total[at], rows])]
        yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int64()), pa.array(cells[1])], ["cell", "n"])

    # The sample's size is bounded by learn_rows x domains, so its ids may be broadcast.
    taught = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(sample), "doc_id").select("text", "domain")
    total, rows = np.zeros(len(domains) << BITS), np.zeros(len(domains))
    cell, n = (c.to_numpy() for c in columns(taught.mapInArrow(count, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n"))))
    rows[-1 - cell[cell < 0]] = n[cell < 0]
    total[cell[cell >= 0]] = n[cell >= 0]
    # The buckets that tell some domain apart: their counts there are far from what chance would give.
    seen = total.reshape(len(domains), -1)
    common = (seen.sum(0) + 0.5) / (rows.sum() + 1)
    expected = rows[:, None] * common
    odds = np.log((seen + 8 * common) / (rows[:, None] + 8)) - np.log(common)
    far = np.where(np.abs(odds) < 0.7, 0, np.abs(seen - expected) / np.sqrt(expected + 1)).max(0)
    chosen = np.sort(np.argsort(-far)[:features])
    chosen = chosen[far[chosen] >= 5]
    feature = np.full(1 << BITS, -1)
    feature[chosen] = np.arange(len(chosen))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(0).to_pylist()]
            for lo, hi in slices(texts, len, 4_000_000):
                doc, bucket, _ = word_cells(texts[lo:hi])
                doc, f = doc[feature[bucket] >= 0], feature[bucket][feature[bucket] >= 0]
                lists = np.split(f, np.searchsorted(doc, np.arange(1, hi - lo)))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), pa.array(lists, pa.list_(pa.int64()))], ["domain", "f"])

    domain_of, lists = columns(taught.mapInArrow(present, "domain string, f array<long>"))  # bounded like the sample
    if not len(lists):
        return ONE_DOMAIN
    y = np.array([place[d] for d in domain_of.to_pylist()], np.int64)
    doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    f = pc.list_flatten(lists).to_numpy()
    weights, bias = softmax_fit(doc, f, y, len(chosen), len(domains))
    scores = np.zeros((len(domains), 1 << BITS))
    scores[:, chosen] = weights
    drawn = np.maximum(np.bincount(y, minlength=len(domains)), 1)
    prior = bias + np.log([shares[d] for d in domains]) - np.log(drawn)  # the sample is drawn by domain
    return DomainModel(domains, prior - prior.max(), scores)


def softmax_fit(doc: np.ndarray, f: np.ndarray, y: np.ndarray, n_features: int, k: int, steps: int = 250, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes x features) and biases, by full-batch Adam on sparse binary features."""
    w, m, v = (np.zeros((k, n_features + 1)) for _ in range(3))
    rows, truth = len(y), np.eye(k)[y]
    for t in range(1, steps + 1):
        s = np.stack([np.bincount(doc, weights=w[c][f], minlength=rows) for c in range(k)], 1) + w[:, -1]
        e = np.exp(s - s.max(1, keepdims=True))
        d = (e / e.sum(1, keepdims=True) - truth) / max(rows, 1)
        g = np.stack([np.append(np.bincount(f, weights=d[doc, c], minlength=n_features), d[:, c].sum()) for c in range(k)])
        g[:, :-1] += ridge * w[:, :-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w[:, :-1], w[:, -1]


def memberships(docs: DataFrame, model: DomainModel, row_id: str = "doc_id", carry: bool = False) -> DataFrame:
    """row_id, n_tokens, p (posterior, in the order of model.domains) and, with `carry`, the row itself as `row`. Materialized."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [row_id, "n_tokens", "p"] + ["row"] * carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            for lo, hi in slices(texts, len, 4_000_000):
                p, n = sent.value.posteriors(texts[lo:hi])
                flat = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))
                rest = [b.column(2).slice(lo, hi - lo)] if carry else []
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), flat, *rest], names)

    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    source = docs.select(F.col(row_id).cast("long").alias(row_id), text_bytes(), *[whole] * carry)
    kind = f", row {source.schema['row'].dataType.simpleString()}" if carry else ""
    return materialize(source.mapInArrow(run, f"{row_id} long, n_tokens long, p array<double>{kind}"), "memberships")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def rates_after(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    r = np.ones(len(p))
    for v in steps:
        r = np.maximum(r - p @ v, 0)
    return r


def totals(members: DataFrame, k: int, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At the rates after `steps`: second moments of the domains (sum n p p') over all rows and over those of a rate above 0, and the
    expected tokens of each domain."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * k + 1, k))
        for b in batches:
            n, p = b.column(0).to_numpy().astype(float), _matrix(b.column(1), k)
            r = rates_after(p, steps)
            total[:k] += (p * n[:, None]).T @ p
            total[k:-1] += (p * (n * (r > 0))[:, None]).T @ p
            total[-1] += p.T @ (n * r)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "v"])

    total = np.zeros((2 * k + 1) * k)
    for r in members.select("n_tokens", "p").mapInArrow(sums, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        total[r["cell"]] = r["v"]
    total = total.reshape(-1, k)
    return total[:k], total[k:-1], total[-1]


def fit_rates(members: DataFrame, targets: np.ndarray, most_passes: int = 40, close: float = 1e-4) -> list[np.ndarray]:
    """The step vectors after which the expected totals of the domains come to `targets` (in tokens).

    A step that makes the misses larger is halved, then replaced by one in the metric of all rows, which never does. Ends when no
    domain misses by more than `close` of all targets; else, with a warning, when such a step gains no hundredth, or after
    `most_passes`: then no rates >= 0 meet the targets, or the posteriors are too blurred for it.
    """
    k, steps, last, tries = len(targets), [], None, 0
    for _ in range(most_passes):
        moments, active, got = totals(members, k, steps)
        over, eye = got - targets, 1e-9 * max(moments.trace(), 1.0) * np.eye(k)
        if np.abs(over).max() <= close * max(targets.sum(), 1.0):
            return steps
        miss = over @ np.linalg.solve(moments + eye, over)
        if last is not None and miss > last and tries < 3:
            tries += 1
            steps[-1] = steps[-1] / 2 if tries < 3 else safe
            continue
        if tries == 3 and miss > 0.99 * last:
            break
        last, tries, safe = miss, 0, np.linalg.solve(moments + eye, over)
        steps.append(np.linalg.solve(active + 1e-6 * moments + eye, over))
    logging.getLogger(__name__).warning("the domains' totals do not meet their targets: %s, %s", got.round(1).tolist(), targets.round(1).tolist())
    return steps


def fit_mixture(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], full: str | None = None, row_id: str = "doc_id", carry: bool = False) -> tuple[DomainModel, DataFrame, list[np.ndarray]]:
    """The classifier, the documents' memberships, and the steps to their rates."""
    model = fit_domains(docs, labels, domain)
    members = memberships(docs, model, row_id, carry)
    share = np.array([weights.get(d, 0.0) for d in model.domains])
    if share.sum() <= 0:
        return model, members, []
    natural = totals(members, len(share), [])[2]
    share = share / share.sum()
    at = model.domains.index(full) if full in model.domains else None
    size = natural.sum() if at is None or not share[at] else natural[at] / share[at]
    return model, members, fit_rates(members, size * share)


def draw(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], full: str | None = None, row_id: str = "doc_id") -> DataFrame:
    """The rows of `docs`, each as often as its rate says: floor(rate) times, and once more with the rest as its chance.

    The chance is a hash of the row's id, so it is the same in every run.
    """
    model, members, steps = fit_mixture(docs, labels, domain, weights, full, row_id, carry=True)
    k = len(model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rates = rates_after(_matrix(b.column(1), k), steps)
            chance = np.array([xxhash.xxh3_64_intdigest(str(i)) / 2**64 for i in b.column(0).to_pylist()])
            times = np.floor(rates).astype(np.int64) + (rates % 1 > chance)
            yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(np.repeat(np.arange(b.num_rows), times)))], ["row"])

    kind = members.schema["row"].dataType.simpleString()
    return members.select(row_id, "p", "row").mapInArrow(run, f"row {kind}").select("row.*")


def mix_to_targets(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], full: str | None = None, row_id: str = "doc_id") -> DataFrame:
    """row_id, n_tokens, p and rate of each document.

    `weights` are the domains' shares of the mixture's tokens. Its size is that of the corpus, or, with `full`,
    the largest at which that domain need not be repeated (its target is what it has).
    """
    model, members, steps = fit_mixture(docs, labels, domain, weights, full, row_id)
    k = len(model.domains)
    names = members.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rates_after(_matrix(b.column(2), k), steps))], [*names, "rate"])

    return members.mapInArrow(run, f"{row_id} long, n_tokens long, p array<double>, rate double")
