"""The numbers inside the two classifiers, against plain Python."""

import math
import random
import re

import numpy as np
import pytest

from drifthound.llm import quality, toxicity
from drifthound.llm.text import NOT_SPACE, hash_words, prefix_hashes, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(word):
    """Hashes of a word's tokens: the word, and each of its beginnings that is shorter than it."""
    raw = np.frombuffer(word.encode(), np.uint8)
    w = words_of(raw, np.array([0, len(raw)]))
    out = [int(hash_words([word])[0])]
    for n in toxicity.PREFIXES:
        at, h = prefix_hashes(w, n)
        assert len(at) == (len(raw) > n)
        out += [int(x) for x in h]
    return out


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(7)
    clean, bad = [f"{a}{b}" for a in ("river", "table", "wind", "moon") for b in ("", "s", "ing", "like")], ["villain", "villainous", "crud", "cruddy"]
    texts, marks = [], []
    for i in range(120):
        marks.append(int(i % 4 == 0))
        words = [rng.choice(clean) for _ in range(rng.randint(5, 40))]
        if marks[-1]:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(bad) for _ in range(rng.randint(2, 6))]
        elif rng.random() < 0.1:
            words[0] = "crud"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    return texts, marks, docs, toxicity.fit(docs, labels)


def test_log_odds_with_dirichlet_priors(toxic):
    texts, marks, _, model = toxic
    count = {}
    n = [0, 0]
    for t, y in zip(texts, marks):
        for word in WORD.findall(t.lower()):
            n[y] += 1
            for token in tokens(word):
                count.setdefault(token, [0, 0])[y] += 1
    want, prior = {}, 500.0
    for token, (y0, y1) in count.items():
        share = (y0 + y1) / (n[0] + n[1]) * prior
        odds = [math.log((y + share) / max(0.5, m + prior - y - share)) for y, m in ((y0, n[0]), (y1, n[1]))]
        sure = odds[1] - odds[0] - 1.5 * math.sqrt(1 / (y1 + share) + 1 / (y0 + share))
        if y1 >= 3 and sure > 1.5:
            want[token] = odds[1] - odds[0], sure
    assert len(want) >= 3 and {int(h) for h in model.hashes} == set(want)
    for h, s, sure in zip(model.hashes, model.scores, model.sure):
        assert (s, sure) == pytest.approx(want[int(h)])


def test_extreme_value_scale(toxic):
    texts, marks, docs, model = toxic
    rng = np.random.default_rng(2)
    for _ in range(50):
        values, shares = np.append(rng.uniform(0.2, 4, 5), -1.5), rng.dirichlet(np.ones(6))
        shares = shares * 0.1
        shares[-1] = 1 - shares[:-1].sum()
        lam = toxicity.solve_lambda(values, shares)
        assert lam > 0 and float((shares * np.exp(lam * values)).sum()) == pytest.approx(1, abs=1e-6)
    # K: clean documents that reach the least listed score, over what lambda expects of their words
    listed = {int(h): (float(s), float(sure)) for h, s, sure in zip(model.hashes, model.scores, model.sure)}

    def segments(text):
        values, gaps, last = [], [], None
        for i, word in enumerate(WORD.findall(text.lower())):
            found = [listed[t] for t in tokens(word) if t in listed]
            if found:
                values.append(max(found, key=lambda x: x[1])[0])
                gaps.append(0.0 if last is None else (i - last - 1) * model.other)
                last = i
        return [s for _, _, s in toxicity.maximal_segments(values, gaps)]

    floor = min(max((listed[t] for t in tokens(w) if t in listed), key=lambda x: x[1])[0] for text in texts for w in WORD.findall(text.lower()) if any(t in listed for t in tokens(w)))
    clean = [t for t, y in zip(texts, marks) if not y]
    reached = 1 + sum(max(segments(t), default=0) >= floor for t in clean)
    size = sum(len(WORD.findall(t)) for t in clean)
    assert model.log_k == pytest.approx(math.log(reached / (size * math.exp(-model.lam * floor))))
    # E-values and probabilities
    flagged = 0
    for r in toxicity.score(docs, model).collect():
        found, n = segments(texts[r.doc_id]), len(WORD.findall(texts[r.doc_id]))
        normals = [x for s in found if (x := model.lam * s - model.log_k - math.log(n)) > -math.log(model.e_value)]
        assert sorted(s.e_value for s in r.segments) == pytest.approx(sorted(math.exp(-x) for x in normals))
        x = [1.0, math.log1p(sum(normals)), max(normals)] if normals else [1.0, 0.0, 0.0]
        assert r.score == pytest.approx(1 / (1 + math.exp(-float(np.dot(x, model.weights)))))
        flagged += len(normals)
    assert flagged > 10


def test_logistic_curve_is_a_maximum():
    rng = np.random.default_rng(5)
    x = np.column_stack([np.ones(200), rng.normal(size=(200, 2))])
    y = (rng.random(200) < 1 / (1 + np.exp(-x @ [0.3, 1.5, -1]))).astype(float)
    w = rng.uniform(0.5, 2, 200)
    beta = toxicity.logistic_fit(x, y, w)
    loss = lambda b: float((w * np.logaddexp(0, np.where(y > 0, -x @ b, x @ b))).sum() + 0.005 * b @ b)
    for d in range(3):
        for step in (-1e-3, 1e-3):
            moved = beta.copy()
            moved[d] += step
            assert loss(moved) > loss(beta)


def test_index_vectors_and_pooling():
    rng = np.random.default_rng(3)
    hashes = np.sort(rng.integers(0, 1 << 62, 40, dtype=np.int64).astype(np.uint64))
    index = quality.index_vectors(hashes, 16)
    assert (quality.index_vectors(hashes[::-1], 16)[::-1] == index).all(), "a token's vector depends on the token alone"
    assert (np.abs(index).sum(axis=1) <= 4).all() and (np.abs(index).sum(axis=1) % 2 == 0).all() and (index != 0).any(axis=1).mean() > 0.9
    texts = ["one Two two", "", "three", "one!! 12 one"]
    raw = [t.encode() for t in texts]
    w = words_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), NOT_SPACE)
    shapes = quality.shapes_of(w)
    known = np.unique(np.concatenate([w.hashes[:3], shapes[1:4]]))
    vectors = rng.normal(size=(len(known), 5))
    of = {int(t): v for t, v in zip(known, vectors)}
    got = quality._pooled(known, vectors, w)
    for d in range(len(texts)):
        a, b = w.bounds[d], w.bounds[d + 1]
        total = sum((of.get(int(t), np.zeros(5)) for i in range(a, b) for t in (w.hashes[i], shapes[i])), np.zeros(5))
        assert got[d] == pytest.approx(total / max(1, b - a))


def test_network_follows_its_gradient_and_temperature():
    rng = np.random.default_rng(9)
    x, y, weight = rng.normal(size=(60, 4)), rng.integers(0, 2, 60).astype(float), rng.uniform(0.5, 2, 60)

    def parts(steps):
        return quality.train(x, y, weight, hidden=3, steps=steps, rate=0.01, decay=1e-3, seed=4)

    mean, scale, w1, b1, w2, b2, _ = parts(0)
    draw = np.random.default_rng(4)
    train = draw.permutation(60) % 5 != 0
    z = (x - mean) / scale

    def loss(params):
        a, b, c, d = params
        logit = np.tanh(z[train] @ a + b) @ c + d
        share = weight[train] / weight[train].sum()
        return float((share * np.logaddexp(0, np.where(y[train] > 0, -logit, logit))).sum() + 0.0005 * (np.square(a).sum() + np.square(c).sum()))

    start, moved = [w1, b1, w2, np.array([b2])], parts(1)[2:6]
    checked = 0
    for k, (p, q) in enumerate(zip(start, [*moved[:3], np.array([moved[3]])])):
        for at in np.ndindex(p.shape):
            up, down = [v.copy() for v in start], [v.copy() for v in start]
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            if abs(slope) > 1e-5:  # a first step goes a whole rate against the gradient's sign
                assert q[at] - p[at] == pytest.approx(-0.01 * np.sign(slope), rel=1e-2)
                checked += 1
    assert checked > 12
    mean, scale, w1, b1, w2, b2, temperature = parts(80)
    logit = np.tanh(z[~train] @ w1 + b1) @ w2 + b2
    held = lambda t: float((weight[~train] * np.logaddexp(0, np.where(y[~train] > 0, -logit, logit) / t)).sum())
    assert all(held(temperature) <= held(t) + 1e-12 for t in np.exp(np.linspace(np.log(0.25), np.log(8), 60)))
    model = quality.Model(np.zeros(0, np.uint64), np.zeros((0, 4)), mean, scale, w1, b1, w2, b2, temperature)
    assert model.probability(x[~train]) == pytest.approx(1 / (1 + np.exp(-logit / temperature)))
