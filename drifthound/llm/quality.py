"""Quality by random-indexing word vectors and a two-layer network.

Each white-space word is a lexeme (its hash) and a shape: letters, capitals and
digits as one sign a run, other signs as they stand (three a run at most), a
class of length, and whether it repeats the word before. On at most `per_class`
labelled documents a class, the `vocabulary` most frequent lexemes and shapes
get word vectors: the sum of the sparse random vectors of the lexemes and
shapes at most `reach` words away (random indexing), scaled to length one.
A text is the mean of its words' vectors, and of its shapes' own index vectors.

A network of one hidden layer is trained on these means in numpy; a fifth of
the sample is kept apart and sets the temperature of its probabilities.

Null and empty texts are the zero vector; words outside the vocabulary only
count in the mean; repeated rows each get a row; without labels of both classes
all scores are 0.5 (predicted 1); an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample
from .text import NOT_SPACE, Words, mixed, text_chunks, words_of, _BYTE, _power_tables

_U = np.uint64
_B = np.arange(256, dtype=np.uint8)
#: Letters (and bytes of longer characters), capitals and digits as one sign each.
SHAPE = np.where(((_B >= 97) & (_B <= 122)) | (_B >= 128), 97, np.where((_B >= 65) & (_B <= 90), 1, np.where((_B >= 48) & (_B <= 57), 48, _B))).astype(np.uint8)
_SIGN = ~((SHAPE == 97) | (SHAPE == 1) | (SHAPE == 48))


def shapes_of(w: Words) -> np.ndarray:
    """Hash of each word's shape, length class and repetition."""
    n = len(w.data)
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    s = SHAPE[w.data]
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    new[w.starts] = True
    keep = new.copy()
    sign = _SIGN[w.data]
    for back in (1, 2):  # the second and third sign of a run
        again = np.zeros(n, bool)
        again[back:] = new[:-back]
        keep |= again & sign
    place = np.concatenate([[0], np.cumsum(keep)])
    up, down = _power_tables(int(place[-1]) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[s[keep]] * up[: int(place[-1])])])
    a, b = place[w.starts], place[w.ends]
    length = np.digitize(w.ends - w.starts, [2, 4, 8, 13, 20]).astype(np.uint64)
    repeat = np.zeros(len(a), np.uint64)
    repeat[1:] = w.hashes[1:] == w.hashes[:-1]
    repeat[w.bounds[:-1][w.bounds[:-1] < len(a)]] = 0
    return mixed((sums[b] - sums[a]) * down[a] + length * _U(1000003) + repeat * _U(0x51ED270B))


@dataclass
class Model:
    tokens: np.ndarray  # sorted hashes of lexemes and shapes
    vectors: np.ndarray  # tokens x dims: word vectors, then index vectors
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -700, 700)))


def index_vectors(tokens: np.ndarray, dims: int, ones: int = 4) -> np.ndarray:
    """Sparse vectors of +1 and -1, the same for a token anywhere."""
    out = np.zeros((len(tokens), dims))
    for k in range(ones):
        h = mixed(tokens + _U((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        np.add.at(out, (np.arange(len(tokens)), (h >> _U(8)).astype(np.int64) % dims), np.where(h & _U(1), 1.0, -1.0))
    return out


def _look(tokens: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Number of each token, -1 where it is not in the vocabulary."""
    if not len(tokens):
        return np.full(len(x), -1)
    at = np.searchsorted(tokens, x)
    at[at == len(tokens)] = 0
    return np.where(tokens[at] == x, at, -1)


def _pooled(tokens: np.ndarray, vectors: np.ndarray, w: Words) -> np.ndarray:
    """Mean vector of each text, by a table of counts."""
    docs, v = len(w.bounds) - 1, len(tokens)
    n = np.diff(w.bounds)
    of = np.repeat(np.arange(docs), n)
    counts = np.zeros((docs, v))
    for hashes in (w.hashes, shapes_of(w)):
        at = _look(tokens, hashes)
        ok = at >= 0
        counts += np.bincount(of[ok] * v + at[ok], minlength=docs * v).reshape(docs, v)
    return counts @ vectors / np.maximum(1, n)[:, None]


def _chunks(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, int, int, Words]]:
    for b in batches:
        for lo, hi, data, offsets in text_chunks(b.column(column), size):
            for a in range(lo, hi, 512):  # few texts at once: the table of counts is dense
                z = min(hi, a + 512)
                o = offsets[a - lo : z - lo + 1]
                yield b, a, z, words_of(data[o[0] : o[-1]], o - o[0], NOT_SPACE)


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 24, steps: int = 600, rate: float = 0.02, decay: float = 1e-3, seed: int = 1) -> tuple:
    """Adam on the weighted log loss; a fifth of the rows sets the temperature."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    apart = rng.permutation(len(x)) % 5 == 0
    t = ~apart
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    wt = weight[t] / weight[t].sum()
    for step in range(1, steps + 1):
        h = np.tanh(z[t] @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -35, 35)))
        d = wt * (p - y[t])
        dh = np.outer(d, params[2]) * (1 - h * h)
        grads = [z[t].T @ dh + decay * params[0], dh.sum(0), h.T @ d + decay * params[2], np.array([d.sum()])]
        for k, g in enumerate(grads):
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            params[k] = params[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    logits = np.tanh(z[apart] @ params[0] + params[1]) @ params[2] + params[3]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [float((weight[apart] * np.logaddexp(0, np.where(y[apart] > 0, -logits, logits) / g)).sum()) for g in grid]
    return mean, scale, *params[:3], float(params[3][0]), float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None, per_class: int = 4000, vocabulary: int = 2048, dims: int = 64, reach: int = 2) -> Model | None:
    """None where a class has no labelled document."""
    spark = docs.sparkSession
    # a bounded sample, so a fixed number of partial sums; used three times
    sample = labelled_sample(docs, labels, label, keep, per_class).select("text", "label", "weight").repartition(8).cache()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, w in _chunks(batches, 0):
            t, n = np.unique(np.concatenate([w.hashes, shapes_of(w)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n.astype(np.int64))], names=["t", "n"])

    top = sample.mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "t").limit(vocabulary).collect()
    tokens = np.sort(np.array([r.t for r in top], np.int64).view(np.uint64))
    index = index_vectors(tokens, dims)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(tokens) + 1, dims))
        padded = np.vstack([index, np.zeros((1, dims))]).astype(np.float32)  # number -1 is the last row; small whole numbers
        for _, _, _, w in _chunks(batches, 0, 1 << 18):
            of = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
            kinds = [_look(tokens, w.hashes), _look(tokens, shapes_of(w))]
            own = padded[kinds[0]] + padded[kinds[1]]
            around = np.zeros_like(own)
            for r in range(1, min(reach, len(of) - 1) + 1):
                same = (of[r:] == of[:-r])[:, None]
                around[r:] += own[:-r] * same
                around[:-r] += own[r:] * same
            for k in kinds:
                for d in range(dims):
                    total[:, d] += np.bincount(k + 1, around[:, d], len(tokens) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([total[1:].tobytes()], pa.binary())], names=["sums"])

    sums = sum((np.frombuffer(r.sums).reshape(len(tokens), dims) for r in sample.mapInArrow(contexts, "sums binary").collect()), np.zeros((len(tokens), dims)))
    words = sums / np.maximum(1e-9, np.linalg.norm(sums, axis=1))[:, None]
    vectors = np.hstack([words, index])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lo, hi, w in _chunks(batches, 0):
            x = _pooled(tokens, vectors, w)
            yield pa.RecordBatch.from_arrays([b.column(1)[lo:hi], b.column(2)[lo:hi], pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "weight", "x"])

    rows = sample.mapInArrow(features, "label int, weight double, x binary").orderBy("x", "label").collect()  # 2 * per_class rows at most
    sample.unpersist()
    y = np.array([r.label for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.stack([np.frombuffer(r.x) for r in rows])
    return Model(tokens, vectors, *train(x, y, np.array([r.weight for r in rows])))


def _scorer(docs: DataFrame, model: Model | None):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray]]:
        m = shared.value
        for b, lo, hi, w in _chunks(batches, column):
            yield b, lo, hi, np.full(hi - lo, 0.5) if m is None else m.probability(_pooled(m.tokens, m.vectors, w))

    return score_batches


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: score and predicted."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    kind = dict(rows.dtypes)["_id"]
    scored = _scorer(docs, model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lo, hi, p in scored(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["_id", "score", "predicted"])

    return rows.mapInArrow(scan, f"_id {kind}, score double, predicted int").withColumnRenamed("_id", id_col)


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that score at least `least`, all columns; nothing is shuffled."""
    at = docs.columns.index(text_col)
    scored = _scorer(docs, model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lo, hi, p in scored(batches, at):
            yield b.slice(lo, hi - lo).filter(pa.array(p >= least))

    return docs.mapInArrow(clean, docs.schema)
