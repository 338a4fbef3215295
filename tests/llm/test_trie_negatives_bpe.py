"""Conversation trie, hard negatives and the BPE transducer against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from drifthound.llm import bpe, dialogue_trie, hard_negatives
from drifthound.llm.queries import tokenizer_path

TURNS = "conv_id long, turn long, role string, text string, part int, depth long, x long, conv string"


def turn_md5(r):
    role, text = r[2] or "", r[3] or ""
    return hashlib.md5(f"{len(role)} {role}{text}".encode()).digest()


def brute_trie(rows):
    own = {}
    for r in rows:
        if r[0] is not None:
            own.setdefault(r[0], []).append(r)
    for c in own:
        own[c] = [(r[2] or "", r[3] or "") for r in sorted(own[c], key=lambda r: (r[1] is not None, r[1] or 0, turn_md5(r)))]
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for node, m in members.items():
        under = [n for n in members if n[: len(node)] == node]
        kids = [n for n in under if len(n) == len(node) + 1]
        leaves = [n for n in under if not any(k[: len(n)] == n and len(k) == len(n) + 1 for k in under)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in under if n)
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(node))))
        out.add((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3, "z") for r in rows], TURNS)
    out = [tuple(r) for r in dialogue_trie.conversation_trie(df).collect()]
    assert len(out) == len(set(out))
    return set(out)


def odd_conversations(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(0, 30), *range(100, 112), 205, 206, -1, -3, -100]:
        for t in range(rnd.randint(1, 7)):
            rows.append((c, rnd.choice([t, t, t, None, 0]), rnd.choice(["user", "assistant", None, ""]), rnd.choice(["hi", "hi", "é日", "", None, "longer text"])))
    rows += [(None, 0, "user", "hi"), rows[0], rows[0]]
    return rows


def test_trie(spark):
    rows = odd_conversations(1)
    assert trie_of(spark, rows) == brute_trie(rows)
    assert trie_of(spark, []) == set()


def test_trie_in_slices_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(dialogue_trie, "BLOCK_CELLS", 256)
    monkeypatch.setattr(dialogue_trie, "SKETCH_CELLS", 2048)  # two slices or more
    monkeypatch.setattr(dialogue_trie, "ENDS_BYTES", 8)
    rows = odd_conversations(2)
    rows += [(c, t, "user", f"turn {t}") for c in (301, 302, 303) for t in range(60)]  # each over several tasks
    rows += [(c, 0, "user", "same") for c in range(400, 440)]  # many equal conversations
    assert trie_of(spark, rows) == brute_trie(rows)


def test_sketch_never_underestimates():
    rng = np.random.default_rng(3)
    x, y = rng.integers(-(2**62), 2**62, (2, 500))
    x, y = np.concatenate([x, x[:100]]), np.concatenate([y, y[:100]])
    sketch = dialogue_trie.Sketch(1024)
    for lo in range(0, 600, 97):
        sketch.add(x[lo : lo + 97], y[lo : lo + 97])
    estimate = sketch.estimate(x, y)
    assert (estimate[:100] == 2).all() and (estimate[500:] == 2).all() and (estimate[100:500] >= 1).all() and (estimate == 1).sum() > 300


def brute_negatives(rows, positives=5, negatives=10):
    ok = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows
          if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, done = [], []
    for a in ok:
        if a[0] % 10 or a in done:
            continue
        done.append(a)
        scored = sorted(((sum(x * y for x, y in zip(a[2], b[2])), b) for b in ok if b[0] != a[0] and len(b[2]) == len(a[2])), key=lambda p: (-p[0], p[1][0]))
        for ps, p in [x for x in scored if x[1][1] == a[1]][:positives]:
            fit = [(s, b) for s, b in scored if b[1] != a[1] and 30 * ps <= 100 * s <= 90 * ps][:negatives]
            out += [(a[0], p[0], n + 1, b[0], ps, s) for n, (s, b) in enumerate(fit)]
    return sorted(out)


def negatives_of(spark, rows, **how):
    df = spark.createDataFrame([(*r, "a", 5, 6) for r in rows], "vec_id long, embedding array<float>, label int, id string, block int, score int")
    found = hard_negatives.hard_negatives(df, df.vec_id % 10 == 0, **how)
    return sorted(tuple(r) for r in found.collect())


def test_hard_negatives(spark):
    rng, rnd = np.random.default_rng(5), random.Random(5)
    centres = rng.normal(size=(3, 8))
    rows = [(i, (centres[i % 3] + rng.normal(size=8) * 0.7).tolist(), rnd.choice([0, 1, 2, i % 3])) for i in range(160)]
    rows += [(200, [0.0] * 8, 1), (201, [0.0] * 8, 1), (202, [0.0] * 8, 2), (210, [1.0, 2.0], 1), (211, [1.0, 2.0], 1), (212, [0.9, 1.1], 0), (213, [-1.0, 2.0], 0)]
    rows += [(220, None, 1), (221, [], 1), (222, [1.0, None], 1), (223, [math.nan] * 8, 1), (224, [math.inf] * 8, 1), (None, [1.0] * 8, 1), (226, [1.0] * 8, None)]
    rows += [rows[3], rows[3], rows[10], rows[20], (30, rows[40][1], 0)]  # repeats, and an id with two vectors
    rows += [(300, [3e12] * 3, 1), (301, [2e12] * 3, 1), (302, [1e12] * 3, 0)]  # products over what doubles hold exactly
    rows[-3:] = [(300, [3e4] * 3, 1), (301, [2e6] * 3, 1), (302, [9e5] * 3, 0)]
    want = brute_negatives(rows)
    assert negatives_of(spark, rows) == want and len(want) > 100
    assert negatives_of(spark, rows, lane=200, block=3, focus=1) == want
    assert negatives_of(spark, rows, focus=8) == want
    assert negatives_of(spark, []) == [] and negatives_of(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []


def test_coordinate_ranges_lose_nothing():
    rng = np.random.default_rng(8)
    v = rng.normal(size=(400, 6))
    bucket = hard_negatives.Bucket.of(np.arange(400), v, np.sort(np.linalg.norm(v, axis=1))[::-1])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    bucket.unit, bucket.order = unit, np.argsort(unit.T, axis=1)
    bucket.values = np.take_along_axis(unit.T, bucket.order, 1)
    pruned = 0
    for q in rng.normal(size=(60, 6)):
        q /= np.linalg.norm(q)
        least = rng.uniform(-1, 0.9)
        most = rng.uniform(least, 1)
        got = set(bucket.feasible(q, np.argsort(-np.abs(q))[:4], least, most).tolist())
        cosine = unit @ q
        assert set(np.flatnonzero((cosine >= least) & (cosine <= most)).tolist()) <= got
        pruned += 400 - len(got)
    assert pruned > 1000


@pytest.fixture(scope="module")
def library():
    ranks = bpe.load_ranks(tokenizer_path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_library(library):
    ranks, want = library
    encoder, rnd = bpe.Encoder(ranks, public_tokenizers.PATTERN), random.Random(4)
    for _ in range(3000):
        text = "".join(rnd.choice(["a", "b", "e", "the", " ", "\n", "  ", "é", "日", "ing", "1", "99", "!", "...", "\U0001f600", "́", "ß", "aaaa", "\x00", "'s", "ly"]) for _ in range(rnd.randint(0, 40)))
        assert list(encoder.encode(text)) == want.encode_ordinary(text)
    few = bpe.Transducer(ranks, max_states=50)
    for _ in range(500):
        data = bytes(rnd.choice([rnd.randrange(256), *b"aeiou thnsr"]) for _ in range(rnd.randint(1, 60)))
        assert few.encode(data) == want._encode_single_piece(data)
    long = "abc" * 100_000 + "=" * 50_001
    assert list(encoder.encode(long)) == want.encode_ordinary(long)


def test_transducer_of_other_ranks():
    """A token that its own bytes never merge to comes from a match that equals it, as in the library."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"bcd": 260}
    want = tiktoken.Encoding("own", pat_str=r"\w+|\W+", mergeable_ranks=ranks, special_tokens={})
    encoder, rnd = bpe.Encoder(ranks, r"\w+|\W+"), random.Random(9)
    for _ in range(2000):
        text = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 12)))
        assert list(encoder.encode(text)) == want.encode_ordinary(text)


def test_utf8_stream_equals_whole_decoding():
    rnd = random.Random(6)
    for _ in range(3000):
        raw = bytes(rnd.choice([rnd.randrange(256), *"aé日\U0001f600".encode()]) for _ in range(rnd.randint(0, 30)))
        raw = rnd.choice([raw, "aé日\U0001f600".encode() * 3])
        stream, at, out = bpe.Utf8Stream(), 0, ""
        while at < len(raw):
            n = rnd.randint(1, 4)
            out += stream.feed(raw[at : at + n])
            at += n
        assert out + stream.end() == raw.decode("utf-8", "replace")


def test_encode_and_decode_tables(spark, library):
    _, want = library
    texts = [None, "", " ", "one two  three\n\n", "É日\U0001f600 x", "same", "same", "word " * 1_000_000, "\x00\x1f\x85"]
    df = spark.createDataFrame([(i, t, "q", "r") for i, t in enumerate(texts)] + [(3, "repeated id", "q", "r"), (None, "no id", "q", "r")], "doc_id long, text string, ids string, decoded string")
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    rows = bpe.decode_ids(bpe.encode_texts(df, path, public_tokenizers.PATTERN), path).collect()
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in rows), key=str) == sorted(((i, want.encode_ordinary(t or ""), t or "") for i, t, *_ in df.collect()), key=str)
    assert bpe.decode_ids(bpe.encode_texts(df.limit(0), path, public_tokenizers.PATTERN), path).collect() == []
    listed = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode_ids(listed, path).collect()] == ["", ""]
