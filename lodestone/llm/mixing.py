"""Mixing documents to target weights by soft membership.

Domains are the label pairs of the labelled table (quality, toxic). A softmax
regression over the most telling words and symbol runs, fitted on a bounded
sample of labelled rows (``FIT_ROWS``), gives every document a posterior over
domains. Document rates are the nonnegative ones nearest to 1 (by tokens) with
which the expected tokens of each domain, sum of rate x tokens x posterior,
meet the targets. By duality such a rate is max(0, 1 - posterior . x), with one
number x per domain for the whole corpus.

The dual of x is convex and is minimised by Newton's method with step halving.
Each step is one pass that sums (domains + 1) x domains numbers, so nothing per
document is kept on the driver; a ridge of ``RIDGE`` keeps x finite where no
rates can meet the targets, and there leaves the rest of least squares.

``solve`` ends when the targets are met or x is at the minimum; if neither
holds after ``STEPS`` passes and the gap is above ``MAX_GAP`` of all tokens, it
raises an error. A rest above ``MAX_GAP`` that no rates can avoid is a warning.

Defined results: null text is empty (0 tokens, rate 1); repeated rows keep
their own equal rates; equal texts get equal rates; texts of any length count
whole; a doc_id with contradicting labels has the smaller pair; without labels
there is one domain and all rates are equal; more than ``MAX_DOMAINS`` domains
raise an error; ``posteriors`` reads doc_id and text only and ``resample``
returns all columns as they are, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textbuf import ALNUM, SLICE_BYTES, TextSlice, runs, span_hashes, text_slices
from lodestone.session import load, materialize

FIT_ROWS = 6000
FEATURES = 512
STEPS = 60
#: Largest gap, as a share of all tokens, with which the targets count as met; slope (likewise) and relative gain of a step that count as none; ridge per token.
TOLERANCE, FLAT, PROGRESS, MAX_GAP, RIDGE = 1e-6, 1e-9, 1e-6, 0.01, 1e-9
MAX_DOMAINS = 256
DOMAINS = ("q0t0", "q0t1", "q1t0", "q1t1")
#: Target share of the tokens of each domain.
TARGETS = {"q0t0": 0.04, "q0t1": 0.01, "q1t0": 0.9, "q1t1": 0.05}

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def tokens_of(s: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and symbol runs, the row of each, and the words of each row."""
    low = s.data
    words = ALNUM[low]
    a, b, at = runs(words, s.offs)
    c, d, sym = runs(~words & ~_SPACE[low], s.offs)
    h = np.append(span_hashes(low, a, b), span_hashes(low, c, d))
    row = np.append(np.repeat(np.arange(s.n), np.diff(at)), np.repeat(np.arange(s.n), np.diff(sym)))
    return h.view(np.int64), row, np.diff(at)


def presence(s: TextSlice, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows x features (0 or 1) for sorted ``keys``, and the words of each row."""
    h, row, n = tokens_of(s)
    out = np.zeros((s.n, len(keys)), np.float32)
    if len(keys) and len(h):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        out[row[hit], at[hit]] = 1
    return out, n


@dataclass
class Posterior:
    domains: tuple[str, ...]
    keys: np.ndarray
    weights: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights[:-1] + self.weights[-1]
        e = np.exp(z - z.max(1, keepdims=True))
        return (e / e.sum(1, keepdims=True)).astype(np.float64)


def _labelled(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """About ``fit_rows`` labelled rows by hash of doc_id: domain, text."""
    own = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.struct("quality", "toxic")).alias("l"))
    share = min(1.0, fit_rows / max(1, own.count()))
    picked = own.where(F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) < F.lit(share * (1 << 30)))
    picked = picked.select("doc_id", F.format_string("q%dt%d", "l.quality", "l.toxic").alias("domain"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")  # at most about fit_rows ids


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, features: int = FEATURES) -> Posterior:
    sample = materialize(_labelled(docs, labels, fit_rows).select("domain", "text"), "mix-sample").coalesce(12)
    sizes = {r[0]: r[1] for r in sample.groupBy("domain").count().orderBy("domain").limit(MAX_DOMAINS + 1).collect()}
    if len(sizes) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} pairs of labels")
    domains = tuple(sizes) or (DOMAINS[0],)
    if len(domains) < 2:
        return Posterior(domains, np.zeros(0, np.int64), np.zeros((1, len(domains))))

    def count(batches):
        for s in text_slices(batches, lower=True):
            h, row, _ = tokens_of(s)
            names = np.array([domains.index(x) for x in s.column("domain").to_pylist()])
            pairs = np.unique(np.stack([row, h], 1), axis=0) if len(h) else np.zeros((0, 2), np.int64)
            cells, times = np.unique(np.stack([pairs[:, 1], names[pairs[:, 0].astype(int)]], 1), axis=0, return_counts=True)
            yield pa.record_batch([pa.array(cells[:, 0]), pa.array(cells[:, 1].astype(np.int32)), pa.array(times.astype(np.int64))], names=["word", "domain", "n"])

    counts = sample.mapInArrow(count, "word long, domain int, n long").groupBy("word").agg(*(F.sum(F.when(F.col("domain") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(domains))))
    total, every = sum(F.col(f"n{k}") for k in range(len(domains))), sum(sizes.values())
    gains = []
    for k, d in enumerate(domains):
        inside, outside = (F.col(f"n{k}") + 0.5) / (sizes[d] + 1.0), (total - F.col(f"n{k}") + 0.5) / (every - sizes[d] + 1.0)
        gains.append(F.abs(F.log(inside) - F.log(outside)) * F.sqrt(F.least(F.col(f"n{k}") + 0.5, F.lit(200.0))))
    best = counts.where(total >= 5).select("word", F.greatest(*gains).alias("gain")).orderBy(F.desc("gain"), "word").limit(features)
    keys = np.sort(np.array([r[0] for r in best.collect()], np.int64))

    def bits(batches):
        for s in text_slices(batches, lower=True):
            x, _ = presence(s, keys)
            yield pa.record_batch([s.column("domain"), pa.array([r.tobytes() for r in np.packbits(x.astype(bool), axis=1)], pa.binary())], names=["domain", "bits"])

    rows = sample.mapInArrow(bits, "domain string, bits binary").toArrow()  # about fit_rows rows of features / 8 bytes
    x = np.unpackbits(np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(rows.num_rows, -1), axis=1)[:, : len(keys)].astype(np.float32)
    y = np.eye(len(domains), dtype=np.float32)[[domains.index(d) for d in rows.column("domain").to_pylist()]]
    return Posterior(domains, keys, _softmax(x, y))


def _softmax(x: np.ndarray, y: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> np.ndarray:
    """Weights and bias (last row) by accelerated gradient descent."""
    x1 = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    w = v = np.zeros((x1.shape[1], y.shape[1]), np.float32)
    step = np.float32(2.0 / (np.square(x1).sum(1).mean() + 1))
    for t in range(rounds):
        z = x1 @ v
        e = np.exp(z - z.max(1, keepdims=True))
        grad = x1.T @ (e / e.sum(1, keepdims=True) - y) / np.float32(len(x)) + np.float32(ridge) * v
        new = v - step * grad
        v = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w.astype(np.float64)


def posteriors(docs: DataFrame, model: Posterior) -> DataFrame:
    """Per row: doc_id, n_tokens, p (posterior by domain)."""

    def run(batches):
        for s in text_slices(batches, lower=True):
            x, n = presence(s, model.keys)
            p = model.of(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(s.n + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            yield pa.record_batch([s.column("doc_id"), pa.array(n.astype(np.int64)), lists], names=["doc_id", "n_tokens", "p"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def rates_of(p: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    w = np.ones(len(p))
    for step in history:
        w = np.maximum(0.0, w - p @ step)
    return w


def _sums(members: DataFrame, k: int, history: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """At the current rates: half the sum of tokens x squared rate, expected tokens by domain, and the second moments of the posteriors of rows with a rate above 0."""

    def run(batches):
        half, total, moment = 0.0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                n, p = b.column(0).to_numpy().astype(float), b.column(1).flatten().to_numpy().reshape(-1, k)
                w = rates_of(p, history)
                half += 0.5 * float((n * w) @ w)
                total += (w * n) @ p
                moment += (p * n[:, None])[w > 0].T @ p[w > 0]
        yield pa.record_batch([pa.array(range(1 + k + k * k), pa.int32()), pa.array(np.concatenate([[half], total, moment.ravel()]))], names=["i", "v"])

    out = np.zeros(1 + k + k * k)
    for i, v in members.select("n_tokens", "p").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
        out[i] = v
    return float(out[0]), out[1 : 1 + k], out[1 + k :].reshape(k, k)


def solve(members: DataFrame, domains: tuple[str, ...], targets: dict[str, float] | None = None, multiples: dict[str, float] | None = None, steps: int = STEPS) -> list[np.ndarray]:
    """The step from rate 1 to the rates (``rates_of``). Targets are shares of all tokens, or multiples of a domain's expected tokens."""
    k = len(domains)
    half, now, moment = _sums(members, k, [])
    if not now.sum():
        return []
    if multiples is not None:
        goal = now * np.array([multiples.get(d, 1.0) for d in domains])
    else:
        share = np.array([(targets or TARGETS).get(d, 0.0) for d in domains])
        goal = now.sum() * (share / share.sum() if share.sum() else np.full(k, 1 / k))
    every, ridge = max(goal.sum(), 1e-9 * now.sum()), RIDGE * now.sum()
    x, value, passes, length = np.zeros(k), half, 0, 1.0
    gap, slope = now - goal, goal - now
    step, gain = np.zeros(k), np.inf
    while True:
        missed = np.abs(gap).max() / every
        if length == 1.0:  # a new point
            slope = ridge * x - gap
            step = -np.linalg.solve(moment + ridge * np.eye(k), slope)
            gain = -float(slope @ step)
        if missed <= TOLERANCE:
            return [x] if x.any() else []
        if np.abs(slope).max() <= FLAT * every or length < 1e-9 or missed > MAX_GAP and gain <= PROGRESS * abs(value):
            if missed > MAX_GAP:
                warnings.warn(f"no rates meet the targets: a rest of {missed:.2g} of all tokens", stacklevel=2)
            return [x]
        if passes >= steps:
            if missed > MAX_GAP:
                raise RuntimeError(f"targets not met after {steps} steps: gap {missed:.2g} of all tokens")
            return [x]
        trial = x + length * step
        half, after, active = _sums(members, k, [trial])
        passes += 1
        at = half + float(trial @ goal) + 0.5 * ridge * float(trial @ trial)
        if at <= value - 1e-4 * length * gain + 1e-15 * every:
            x, value, gap, moment, length = trial, at, after - goal, active, 1.0
        else:
            length /= 4


def rates(members: DataFrame, domains: tuple[str, ...], history: list[np.ndarray]) -> DataFrame:
    """Per row: doc_id, n_tokens, rate and the posterior of every domain."""
    names = sorted({*DOMAINS, *domains})

    def run(batches):
        for b in batches:
            p = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
            cols = [pa.array(np.round(p[:, domains.index(d)], 9) if d in domains else np.zeros(b.num_rows)) for d in names]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.round(rates_of(p, history), 9)), *cols], names=["doc_id", "n_tokens", "rate", *(f"p_{d}" for d in names)])

    return members.mapInArrow(run, "doc_id long, n_tokens long, rate double, " + ", ".join(f"p_{d} double" for d in names))


def resample(docs: DataFrame, model: Posterior, history: list[np.ndarray]) -> DataFrame:
    """Rows of ``docs`` repeated by their rates: the whole part, and one more with the probability of the rest (by a hash of doc_id and text)."""
    import zlib

    def run(batches):
        for s in text_slices(batches, lower=True):
            x, _ = presence(s, model.keys)
            w = rates_of(model.of(x), history)
            u = np.array([zlib.crc32(s.text(i), zlib.crc32(str(d).encode())) / 2**32 for i, d in enumerate(s.column("doc_id").to_pylist())])
            rows = np.repeat(np.arange(s.n), np.floor(w + u).astype(np.int64))
            part = np.cumsum(np.diff(s.offs)[rows]) // SLICE_BYTES  # a high rate must not make one batch of many copies
            for at in np.split(rows, np.flatnonzero(np.diff(part)) + 1):
                yield s.batch.slice(s.lo, s.n).take(pa.array(at))

    return docs.mapInArrow(run, docs.schema)


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = fit(docs, labels)
    members = materialize(posteriors(docs, model), "mix-posteriors")
    return rates(members, model.domains, solve(members, model.domains))
