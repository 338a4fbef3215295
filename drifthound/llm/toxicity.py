"""Toxicity by maximum-scoring segments.

A token is a word or the first bytes of one (`PREFIXES`), so that inflected and
compound forms share what they begin with. Fit, on at most `per_class` labelled
documents a class: tokens are counted by class; a token's log-odds get an
informative Dirichlet prior (its share of the sample, `prior` words in all),
and tokens whose log-odds less `errors` standard errors exceed `least_odds` are
listed, at most `listed` of them. A word scores the log-odds of the listed token
that is highest after that deduction; every other word the log-odds of having none, and at most -`drift`, so
that clean text has a negative mean.

Scan: all maximal segments of a text's word scores, in linear time (Ruzzo and
Tompa); words that aren't listed only lengthen the gaps between listed ones.

Calibration: clean text gives the scale of Karlin and Altschul's extreme-value
law: lambda solves sum(p exp(lambda s)) = 1, and K is set by how many clean
training documents reach a listed word's score. A segment of score S in n words
has the normal score lambda S - ln(K n); its E-value is exp(-that). Segments of
E-value under `e_value` are significant; a logistic curve over the sum and the
best of their normal scores gives the probability.

Null and empty texts have no words and get the probability of a text without
segments; repeated rows each get a row; without labels of both classes all
scores are 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, labelled_sample
from .text import Words, prefix_hashes, text_chunks, words_of

#: Lengths in bytes of the prefixes that are tokens.
PREFIXES = (4, 5, 6, 7, 8)

SEGMENTS = "array<struct<start:long,end:long,score:double,e_value:double>>"


def tokens_of(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, token hash) of each kind of token: whole words, then prefixes."""
    yield np.arange(len(w.hashes)), w.hashes
    for length in PREFIXES:
        yield prefix_hashes(w, length)


@dataclass
class Model:
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sure: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log-odds less some standard errors
    other: float = -0.05
    lam: float = 1.0
    log_k: float = 0.0
    e_value: float = 0.05
    weights: np.ndarray = field(default_factory=lambda: np.array([-40.0, 0.0, 0.0]))


def maximal_segments(values: list[float], gaps: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring runs of positive values with negative gaps between them.

    gaps[i] stands before values[i]. Returns (first value, last value, score).
    """
    held: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, last
    total = 0.0
    for i, v in enumerate(values):
        total += gaps[i]
        left, right, first = total, total + v, i
        total = right
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= left:
                j -= 1
            if j < 0 or held[j][1] >= right:
                held.append((left, right, first, i))
                break
            left, first = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, r - l) for l, r, a, b in held]


def solve_lambda(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(shares * exp(x * values)) = 1; the mean must be negative."""
    f = lambda x: float((shares * np.exp(np.minimum(700, x * values))).sum()) - 1
    hi = 1.0
    while f(hi) < 0 and hi < 1e6:
        hi *= 2
    lo = 0.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def logistic_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Newton steps for a logistic curve; x has a column of ones."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        grad = x.T @ (w * (y - p)) - ridge * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def word_scores(model: Model, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(words with a listed token, score of the surest one)."""
    best = np.full(len(w.hashes), -1)
    if len(model.hashes):
        for at, token in tokens_of(w):
            n = np.searchsorted(model.hashes, token)
            n[n == len(model.hashes)] = 0
            hit = model.hashes[n] == token
            at, n = at[hit], n[hit]
            better = (best[at] < 0) | (model.sure[n] > model.sure[best[at]])
            best[at[better]] = n[better]
    spots = np.flatnonzero(best >= 0)
    return spots, model.scores[best[spots]] if len(spots) else np.zeros(0)


def _segments(model: Model, w: Words) -> dict[int, list[tuple[int, int, float]]]:
    """For documents with listed words: segments as (first word, word after, score)."""
    bounds = w.bounds
    spots, values = word_scores(model, w)
    if not len(spots):
        return {}
    docs = np.searchsorted(bounds, spots, "right") - 1
    gaps = np.append(0, np.diff(spots) - 1) * model.other
    out = {}
    cuts = np.flatnonzero(np.diff(docs)) + 1
    for rows in np.split(np.arange(len(spots)), cuts):
        d = int(docs[rows[0]])
        g = gaps[rows].tolist()
        g[0] = 0.0
        place = spots[rows] - bounds[d]
        out[d] = [(int(place[a]), int(place[b]) + 1, s) for a, b, s in maximal_segments(values[rows].tolist(), g)]
    return out


def _evidence(model: Model, segments: list[tuple[int, int, float]], n: int) -> tuple[float, float, list[dict]]:
    """(log of the sum of normal scores, best normal score, significant segments)."""
    found = []
    for a, b, s in segments:
        normal = model.lam * s - model.log_k - math.log(max(1, n))
        if normal > -math.log(model.e_value):
            found.append({"start": a, "end": b, "score": s, "e_value": math.exp(-normal), "_n": normal})
    if not found:
        return 0.0, 0.0, []
    normals = [f.pop("_n") for f in found]
    return math.log1p(sum(normals)), max(normals), found


def _counts(sample: DataFrame) -> DataFrame:
    """token, y1, y0: how many words of each class have the token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_chunks(b.column(0)):
                w = words_of(data, offsets)
                toxic = np.repeat(label[lo:hi], np.diff(w.bounds))
                parts = [(h, toxic[at]) for at, h in tokens_of(w)]
                tokens, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                y1 = np.bincount(at, np.concatenate([p[1] for p in parts]), len(tokens)).astype(np.int64)
                n = np.bincount(at, minlength=len(tokens))
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(y1), pa.array(n - y1)], names=["token", "y1", "y0"])

    return sample.select("text", "label").mapInArrow(count, "token long, y1 long, y0 long").groupBy("token").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep: Column | None = None, per_class: int = 6000, listed: int = 20000, prior: float = 500.0, errors: float = 1.5, least_odds: float = 1.5, least_count: int = 3, drift: float = 0.05, e_value: float = 0.5) -> Model:
    sample = labelled_sample(docs, labels, label, keep, per_class).cache()  # a bounded sample, used three times
    words = sample.groupBy("label").agg(F.sum(F.coalesce(F.regexp_count(F.translate("text", ascii_uppercase, ascii_lowercase), F.lit(ALNUM_WORD)), F.lit(0))).alias("n")).collect()
    n1, n0 = (sum(r.n for r in words if r.label == c) for c in (1, 0))
    model = Model(e_value=e_value)
    if not n1 or not n0:
        sample.unpersist()
        return model
    share = (F.col("y1") + F.col("y0")) / float(n1 + n0) * prior
    # a prefix that all words have leaves nothing for the others
    odds = lambda y, n: F.log((F.col(y) + share) / F.greatest(F.lit(0.5), n + prior - F.col(y) - share))
    scored = _counts(sample).filter(F.col("y1") >= least_count).select("token", "y1", "y0", (odds("y1", n1) - odds("y0", n0)).alias("s"), F.sqrt(1 / (F.col("y1") + share) + 1 / (F.col("y0") + share)).alias("e"))
    top = scored.withColumn("sure", F.col("s") - errors * F.col("e")).filter(F.col("sure") > least_odds).orderBy(F.desc("sure"), "token").limit(listed).collect()
    if not top:
        sample.unpersist()
        return model
    hashes, s = np.array([r.token for r in top], np.int64).view(np.uint64), np.array([r.s for r in top])
    order = np.argsort(hashes)
    model.hashes, model.scores, model.sure = hashes[order], s[order], np.array([r.sure for r in top])[order]
    hits = _word_counts(sample, model)  # words by (listed score, class)
    c1, c0 = sum(r.y1 for r in hits), sum(r.y0 for r in hits)
    model.other = min(-drift, math.log((1 - min(0.99, c1 / n1)) / (1 - min(0.99, c0 / n0))))
    values = np.array([r.value for r in hits])
    clean = np.array([r.y0 + prior * (r.y1 + r.y0) / (n1 + n0) * (c0 + 1) / n0 for r in hits]) / n0
    model.lam = solve_lambda(np.append(values, model.other), np.append(clean, 1 - clean.sum()))
    rows = _features(sample, model)
    # K: clean documents that reach the smallest listed score, against the law's expectation
    floor = float(values.min())
    n = np.array([r.n for r in rows])
    best = np.array([r.best for r in rows])
    y = np.array([r.label for r in rows], float)
    w = np.array([r.weight for r in rows])
    reached = float((w * (y == 0) * (best >= floor)).sum()) + 1
    model.log_k = math.log(reached / max(1e-9, float((w * (y == 0) * n).sum()) * math.exp(-model.lam * floor)))
    x = np.array([[1.0, *_evidence(model, [(0, 0, v) for v in r.all], r.n)[:2]] for r in rows])
    model.weights = logistic_fit(x, y, w)
    sample.unpersist()
    return model


def _word_counts(sample: DataFrame, model: Model) -> list:
    """value, y1, y0: words of each class by their score (at most `listed` rows)."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_chunks(b.column(0)):
                w = words_of(data, offsets)
                spots, values = word_scores(shared.value, w)
                toxic = np.repeat(label[lo:hi], np.diff(w.bounds))[spots]
                value, at = np.unique(values, return_inverse=True)
                y1 = np.bincount(at, toxic, len(value)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(y1), pa.array(np.bincount(at, minlength=len(value)) - y1)], names=["value", "y1", "y0"])

    return sample.select("text", "label").mapInArrow(count, "value double, y1 long, y0 long").groupBy("value").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")).orderBy("value").collect()


def _features(sample: DataFrame, model: Model) -> list:
    """Words and segment scores of the sample's documents (2 * per_class rows at most)."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in text_chunks(b.column(0)):
                w = words_of(data, offsets)
                found = _segments(shared.value, w)
                scores = [[s for _, _, s in found.get(d, [])] for d in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(1)[lo:hi], b.column(2)[lo:hi], pa.array(np.diff(w.bounds).astype(np.int64)), pa.array([max(x, default=0.0) for x in scores], pa.float64()), pa.array(scores, pa.list_(pa.float64()))], names=["label", "weight", "n", "best", "all"])

    return sample.select("text", "label", "weight").mapInArrow(scan, "label int, weight double, n long, best double, all array<double>").collect()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: score, predicted, n_words and the significant segments."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    kind = dict(rows.dtypes)["_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    segment = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo, hi, data, offsets in text_chunks(b.column(1)):
                w = words_of(data, offsets)
                n = np.diff(w.bounds)
                x, spans = np.tile([1.0, 0.0, 0.0], (hi - lo, 1)), [[]] * (hi - lo)
                for d, segments in _segments(m, w).items():
                    x[d, 1], x[d, 2], spans[d] = _evidence(m, segments, int(n[d]))
                p = 1 / (1 + np.exp(-np.clip(x @ m.weights, -700, 700)))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(spans, segment)], names=["_id", "score", "predicted", "n_words", "segments"])

    return rows.mapInArrow(scan, f"_id {kind}, score double, predicted int, n_words long, segments {SEGMENTS}").withColumnRenamed("_id", id_col)
