"""Each operator against brute force on small tables with the odd cases."""

import base64
import hashlib
import random
import re
import struct
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from drifthound.llm import components, decontam, license_scan, mixing, ngram_join, quality, sharding, token_ids, topk, toxicity, warc
from drifthound.llm.files import get, put
from drifthound.llm.queries import tokenizer_path
from drifthound.llm.text import NOT_SPACE, hash_words, prefix_hashes, text_chunks, words_of

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, source string, size string, shard string, n int, w string, `_id` string, part int, token string"


def words(text, pattern=ALNUM):
    return pattern.findall((text or "").translate(LOWER))


def docs_of(spark, texts, sources=None):
    """Rows with ids from 0, and other columns whose names operators use inside."""
    rows = [(i, t, (sources or ["s"])[i % len(sources or ["s"])], "x", "y", 1, "w", "i", 2, "t") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "one", "two words", "É K é", "a\tb\nc", " x y", "x" * 50_000, "same text here again and again", "same text here again and again", None, ""]


def test_word_arrays():
    import pyarrow as pa

    texts = [t or "" for t in ODD] + ["Ab cD,ef", "end", "start"]
    for pattern, kind in ((ALNUM, None), (SPACE, NOT_SPACE)):
        for limit in (1 << 20, 7):
            got, hashes = [], []
            for lo, hi, data, offsets in text_chunks(pa.array(texts), limit):
                w = words_of(data, offsets, *([kind] if kind is not None else []))
                got += [[w.text(i).decode() for i in range(a, b)] for a, b in zip(w.bounds[:-1], w.bounds[1:])]
                hashes += w.hashes.tolist()
                at, h = prefix_hashes(w, 2)
                assert len(at) == sum(len(w.text(i)) > 2 for i in range(len(w.hashes)))
            want = [words(t, pattern) for t in texts]
            assert got == want
            assert hashes == hash_words([x for l in want for x in l]).tolist()


def test_sharding(spark):
    texts = ODD + [("word " * k) for k in range(40)]
    rows = sharding.shard_by_bytes(docs_of(spark, texts)).orderBy("doc_id").collect()
    sizes = [len((t or "").encode()) + 1 for t in texts]
    assert [r.size for r in rows] == sizes and [r.text_crc32 for r in rows] == [zlib.crc32((t or "").encode()) for t in texts]
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    before = 0
    for r in rows:
        assert r.shard == min(7, (2 * before + r.size) * 8 // (2 * sum(sizes)))
        before += r.size
    for s in {r.shard for r in rows}:
        assert [r.slot for r in rows if r.shard == s] == list(range(sum(r.shard == s for r in rows)))
    again = docs_of(spark, ["t"] * 5).selectExpr("1 AS doc_id", "text")
    assert sharding.shard_by_bytes(again).count() == 5 and sharding.shard_by_bytes(again.filter("false")).count() == 0


def test_mixing(spark):
    rng = random.Random(1)
    texts = [None, "", *[" ".join("w" for _ in range(rng.randint(1, 30))) for _ in range(120)]]
    docs = docs_of(spark, texts, ["b", "a", None, "c", "a"])
    rows = mixing.mix(docs).collect()
    size = {r.source: r.source_size for r in rows}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    free, left, target = set(size), 1.5 * sum(size.values()), {}
    while free:  # shares by weight; what is above twice the size is reshared
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * size[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        free -= over
    for s in size:
        assert {round(r.target, 6) for r in rows if r.source == s} == {round(target[s], 6)}
        assert abs(sum(r.copies * r.size for r in rows if r.source == s) - target[s]) <= 30
    assert all(r.copies <= 2 and len(r.positions) == r.copies and r.size == len(words(texts[r.doc_id], SPACE)) for r in rows)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix(docs.filter("false")).count() == 0
    twice = docs.unionByName(docs)
    assert mixing.mix(twice).count() == 2 * len(texts)


def test_mixed_documents_keep_clashing_columns(spark):
    rows = [(i, f"w{i} " * (i + 1), "s", i * 10, "p", 7) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_key int, positions string, mix_place int")
    out = mixing.mix_documents(docs, position_col="at")
    assert out.columns == [*docs.columns, "at"] and {tuple(r)[:-1] for r in out.collect()} <= set(rows)


def test_license_scan(spark):
    texts = ODD + ["Released UNDER the (MIT) License. under the mit license", "CC-BY NC 4.0", "cc by", "Apache License, version 2", "All rights reserved", "licensed under the gnu general public license version 3 or so",
                   "permission is hereby granted free of charge to every person obtaining a copy of this software and all associated documentation files"]
    base = license_scan.PHRASES
    for r in license_scan.scan_licenses(docs_of(spark, texts)).collect():
        w = words(texts[r.doc_id])
        places = [(i, label) for label, p in base for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({l for _, l in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        if "gnu" in w:
            assert r.labels == "gpl-3"
        if "hereby" in w:  # one word differs, one is put in
            assert r.labels == "mit" and r.n_base == 0
    assert license_scan.scan_licenses(docs_of(spark, ["x"]).filter("false")).count() == 0


def test_license_scan_lowers_ascii_only(spark):
    """A letter outside A-Z that Unicode lowers to one of them is another letter."""
    docs = docs_of(spark, ["Under The MIT License", "under the m\u0130t license", "x \u212a y"])
    rows = license_scan.scan_licenses(docs, phrases=(("other", "x k y"), *license_scan.PHRASES)).orderBy("doc_id").collect()
    assert [r.n_base for r in rows] == [1, 0, 0]


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(x) for x in v] for v in rng.normal(0, 0.3, (150, 20)).astype(np.float32)]
    vectors[7] = vectors[8] = vectors[9]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(200, None), (201, [float("nan")] * 20), (202, []), (203, [1.0, 2.0]), (204, [None] * 20), (250, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = topk.top_k(df.filter("vec_id % 50 = 0"), df, lane=32, slice_dims=6).collect()
    clean = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in clean if i % 50 == 0]:
        want = sorted((-int(clean[q] @ c), i) for i, c in clean.items() if i != q and len(c) == len(clean[q]))[:5]
        assert sorted((r.rank, -r.score, r.vec_id) for r in got if r.query_id == q) == [(k + 1, s, i) for k, (s, i) in enumerate(want)]
    chunked = topk.top_k(df.filter("vec_id % 50 = 0"), df, chunk=1).collect()
    assert sorted(chunked) == sorted(got)
    assert topk.top_k(df.filter("false"), df).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/%20é\n", "<p>one</p>"), (3, None, "<p>one</p>"), (9, "u", None), (8, "u", ""), (None, "n", "<p>null id</p>"), (4, "x", "é" * 70_000), (4, "x", "é" * 70_000), (1, "y", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    listed = warc.write_archives(pages, str(tmp_path / "a"))
    back = warc.read_archives(listed).collect()
    assert len(back) == len(rows) == sum(r.records for r in listed.collect())
    by = {}
    for r in back:
        by.setdefault(r.page_id, []).append(r)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    for i, u, h in rows:
        for r in by[i]:
            assert (r.payload_digest, r.payload_bytes, r.url) == (digest(h), len((h or "").encode()), u)
            assert r.payload is None if r.record_type == "revisit" else r.payload.decode() == (h or "")
    assert by[3][0].record_type == "response" and (by[5][0].record_type, by[5][0].refers_to) == ("revisit", 3) and by[9][0].refers_to == 8
    assert sorted(r.record_type for r in by[4]) == ["response", "revisit"] and by[None][0].record_type == "response"
    assert warc.archive_round_trip(pages.filter("false")).count() == 0


def test_warc_faults(spark, tmp_path):
    good = warc.record(1, 1, "u", b"payload", None, False)
    assert warc.parse_record(good)["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"payload", b"paylozd"), good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date", b"X-Date"), b""):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    dictionary = zstandard.train_dictionary(1024, [b"some words of sample %d and more words" % i for i in range(400)]).as_bytes()
    packed = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).compress(good)
    squeezed = zstandard.ZstdCompressor().compress(dictionary)
    for lead in (dictionary, squeezed):  # plain, and compressed itself
        raw = struct.pack("<II", warc.DICTIONARY_MAGIC, len(lead)) + lead + packed + packed
        address = put(str(tmp_path), "x", [raw])
        rows = warc.read_archives(spark.createDataFrame([(address,)], "address string")).collect()
        assert [r.page_id for r in rows] == [1, 1]
    cut = put(str(tmp_path), "cut", [raw[:-3]])
    rows = warc.read_archives(spark.createDataFrame([(cut,)], "address string"), errors="report").collect()
    assert rows[0].page_id == 1 and "cut off" in rows[1].fault


def test_decontamination(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)] + ["É", "ß"]
    items = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (12, 25, 10, 9, 3, 1)] + [None, "", "..."]
    items[5] = "uniqueword"
    texts = ODD + [" ".join(rng.choice(vocab) for _ in range(200)) for _ in range(5)]
    texts += [f"{texts[-1]} {items[0].upper()}, and {' '.join(items[1].split()[3:18])} tail", items[2], items[3] + " x", "x " + items[4], "Uniqueword!", " ".join(items[0].split()[:9])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for j, item in enumerate(items):
            v = words(item)
            k = min(10, len(v))
            for p in range(len(v) - k + 1 if v else 0):
                for q in range(len(w) - k + 1):
                    if w[q : q + k] == v[p : p + k]:
                        hit |= set(range(q, q + k))
                        found.add(str(j))
        want[i] = (len(w), len(hit), sorted(found))
    docs = docs_of(spark, texts)
    for block in (2_000_000, 20):
        got = decontam.find_contamination(docs, bench, block_words=block).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, list(r.items)) for r in got} == want and len(got) == len(texts)
    clean = decontam.remove_contaminated(docs, bench, block_words=20)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, x in want.items() if not x[2]}
    assert decontam.find_contamination(docs, bench.filter("false")).filter("contaminated").count() == 0
    assert decontam.find_contamination(docs.filter("false"), bench).count() == 0


def shingles(text, k):
    w = words(text, SPACE)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(texts, k, num, den):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and den * len(a & b) >= num * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_texts(seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 60))] for _ in range(8)]
    texts = []
    for b in base:
        for _ in range(9):
            t = list(b)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"v{rng.randint(0, 9)}"
            texts.append(" ".join(t))
    return texts + ODD + ["a b c", "A B C", "a b c d"]


@pytest.mark.parametrize("crowd, product", [(2, 0), (4, 0), (16, 4)])
def test_ngram_components(spark, crowd, product):
    texts = near_texts(5)
    docs = docs_of(spark, texts).repartition(4)
    # a product of no size calls for stars
    got = ngram_join.link_components(docs, 4, 85, 100, crowd=crowd, product_rows=product).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == brute_components(texts, 4, 85, 100)


def test_ngram_components_of_template_pages(spark):
    """Pages of two templates with words of their own, few or many: only the short ones link, and none of the links is lost."""
    rng = random.Random(22)
    texts = []
    for i in range(500):
        template = [f"t{i % 2}x{j}" for j in range(100)]
        own = [f"w{i}x{j}" for j in range(rng.randint(4, 30))]
        at = rng.choice([0, 100, 100, 50])
        texts.append(" ".join(template[:at] + own + template[at:]))
    for parts in (1, 3):
        got = ngram_join.link_components(docs_of(spark, texts).repartition(parts), 4, 85, 100).orderBy("doc_id").collect()
        assert [(r.n_shingles, r.component_id) for r in got] == brute_components(texts, 4, 85, 100)


def test_ngram_components_of_one_crowd(spark):
    """Many near copies in one task: their n-grams are frequent, and nodes of every salt must meet."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(300):
        t = list(base)
        t[rng.randrange(60)] = f"v{i}"
        texts.append(" ".join(t))
    texts += near_texts(13)
    docs = docs_of(spark, texts).coalesce(1)
    got = ngram_join.link_components(docs, 4, 80, 100).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == brute_components(texts, 4, 80, 100)


def test_keep_first(spark):
    texts = near_texts(6)
    docs = docs_of(spark, texts)
    kept = {r.doc_id for r in ngram_join.keep_first(docs).collect()}
    assert kept == {i for i, (_, c) in enumerate(brute_components(texts, 5, 80, 100)) if i == c}
    twice = docs.filter("doc_id = 3").unionByName(docs.filter("doc_id = 3"))
    assert ngram_join.keep_first(twice).count() == 1 and ngram_join.keep_first(docs.filter("false")).count() == 0


def test_keep_first_of_repeated_ids(spark):
    """Rows that share an id are told apart by their text; names clash with those used inside."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, b, 1, 2), (2, a, 3, 4), (2, b, 5, 6), (2, a, 7, 8)], "doc_id long, text string, key int, nth int")
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns and {(r.doc_id, r.text) for r in kept.collect()} == {(1, b), (2, a)} and kept.count() == 2


def test_signatures_bound_the_difference():
    """Two signatures, folded or not, differ in at most as many bits as the sets in n-grams."""
    rng = np.random.default_rng(8)
    for n, m in ((600, 590), (1025, 900), (5000, 4100), (4097, 4000)):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: m - 50], rng.integers(0, 1 << 63, 50).astype(np.uint64)]))
        a, b = (np.frombuffer(ngram_join._wide(s), np.uint64) for s in (x, y))
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)))
        assert 0.8 * len(np.setxor1d(x, y)) <= np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(40) if i % 9] + [(rng.randint(50, 90), rng.randint(50, 90)) for _ in range(25)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert got[n] == min(seen)
    assert set(got) == set(near)


def test_wavelet_matrix():
    rng = np.random.default_rng(8)
    for n, sigma in ((0, 1), (1, 1), (1000, 7), (5000, 300), (700, 70_000)):
        ids = rng.integers(0, sigma, n).astype(np.uint32)
        m, docs, lengths = token_ids.open_shard(b"".join(token_ids.shard_bytes(ids, np.array([4]), np.array([n]))))
        assert (m.decode() == ids).all() and docs.tolist() == [4] and lengths.tolist() == [n]
        for i in rng.integers(0, max(1, n), 10)[: n and 10]:
            t = int(ids[i])
            at = np.flatnonzero(ids == t)
            assert m.access(int(i)) == t and m.count(t) == len(at) and m.select(t, len(at) - 1) == at[-1] and m.select(t, len(at)) is None
            assert m.count(t, n // 4, n // 2) == (ids[n // 4 : n // 2] == t).sum()
        assert m.count(10**6) == 0 and m.select(10**6, 0) is None
        if 0 < n <= 1000:
            assert m.occurrences(int(ids[0])) == np.flatnonzero(ids == ids[0]).tolist()


def test_encoder_of_odd_texts():
    """Cut, composed and forgotten pieces give the tokenizer's own ids."""
    rng = random.Random(4)
    bits = ["a", "b", "Zed", "\u00e9", "\u6f22", " ", "  ", "\n", "\n\n", "\t", "\u00a0", "\u3000", "'s", "'", "$$$", "...", ",", "!?", "12", "<|x", "|", "don't", "x" * 80]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    encoder = token_ids.Encoder(tokenizer_path(), limit=300)
    for lo in range(0, len(texts), 250):
        part = texts[lo : lo + 250]
        ids, lengths = encoder.encode(pa.array(part, pa.large_string()))
        got = np.split(ids, np.cumsum(lengths)[:-1])
        assert [g.tolist() for g in got] == [[*e.ids, 2] for e in encoder.tokenizer.encode_batch_fast(part, add_special_tokens=False)]


def test_token_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = ODD + ["a  b\n\nc", " lead", "trail ", "x\ty z", "foo's 'll <|endoftext|> bar", "word. word, next. word.", "½ ² x²", "a\x1cb c", "a \n b", "tail.\nhead, x"]
    want = [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]
    docs = docs_of(spark, texts)
    for size in (1 << 22, 5):
        rows = token_ids.token_ids(docs, tokenizer_path(), shard_tokens=size).orderBy("doc_id").collect()
        start = 0
        for r, ids in zip(rows, want, strict=True):
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    assert token_ids.token_ids(docs.filter("false"), tokenizer_path()).count() == 0
    encoder = token_ids.Encoder(tokenizer_path(), limit=8)  # forgets all the time
    for x, ids in zip(texts * 2, want * 2):
        assert encoder.encode(pa.array([x or ""], pa.large_string()))[0].tolist() == ids


def test_token_ids_of_null_ids(spark):
    ids = [None, None, *[(1 << 60) + i for i in range(20)], (1 << 53) + 1, -1, 0]
    docs = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    rows = token_ids.token_ids(docs, tokenizer_path(), shard_tokens=9).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(ids, key=lambda i: (i is not None, i))


def test_token_shards_in_training_order(spark):
    import corpus_pipeline

    docs = docs_of(spark, [f"{'w ' * (i % 7)}text {i}" for i in range(60)], ["a", "b", "c"])
    mixed = corpus_pipeline.mix_stage(spark, docs, "")
    rows = corpus_pipeline.token_stage(spark, mixed, "").orderBy("start").collect()
    want = sorted((p, r.doc_id) for r in mixing.mix(docs).collect() for p in r.positions)
    assert [r.doc_id for r in rows] == [i for _, i in want] and len({i for _, i in want}) < len(want)


def labelled(spark, seed):
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(80)]
    texts, marks = [], []
    for i in range(240):
        w = [rng.choice(plain) for _ in range(rng.randint(15, 60))]
        bad = i % 4 == 0
        for _ in range(4 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "rottenest", "rottener"]))
        texts.append(" ".join(w))
        marks.append(int(bad))
    labels = spark.createDataFrame([(i, 1 - m, m) for i, m in enumerate(marks) if i % 3], "doc_id long, quality int, toxic int")
    return docs_of(spark, texts + ODD), labels, marks


def test_toxicity(spark):
    docs, labels, marks = labelled(spark, 9)
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(rows) == len(marks) + len(ODD) and all(0 <= r.score <= 1 for r in rows.values())
    apart = [i for i in range(len(marks)) if i % 3 == 0]
    assert np.mean([rows[i].predicted == marks[i] for i in apart]) >= 0.95
    assert all(rows[len(marks) + i].predicted == 0 for i in range(len(ODD)))
    assert any(rows[i].segments for i in apart if marks[i])
    none = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert toxicity.score(docs, none).agg({"predicted": "max"}).first()[0] == 0
    assert toxicity.score(docs.filter("false"), model).count() == 0


def test_maximal_segments():
    """All maximal segments: none can be widened or split, by trying every span."""
    rng = random.Random(10)
    for _ in range(200):
        values = [rng.randint(1, 5) for _ in range(rng.randint(1, 7))]
        gaps = [0] + [-rng.randint(0, 6) for _ in values[1:]]
        line = [x for v, g in zip(values, gaps) for x in (g, v)]

        def best(lo, hi):
            """The recursive definition: the best span, then the same to its left and right."""
            spans = [(sum(line[a:b]), a - b, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
            top = max(spans, key=lambda s: (s[0], s[1]), default=(0,))
            if top[0] <= 0:
                return []
            _, _, a, b = top
            return best(lo, a) + [sum(line[a:b])] + best(b, hi)

        assert [s for _, _, s in toxicity.maximal_segments([float(v) for v in values], [float(g) for g in gaps])] == best(0, len(line))


def test_quality(spark):
    docs, labels, marks = labelled(spark, 11)
    junk = docs.selectExpr("doc_id", "CASE WHEN doc_id % 4 = 0 AND doc_id < 240 THEN regexp_replace(text, ' ', ' | ') ELSE text END AS text", "source")
    model = quality.fit(junk, labels)
    rows = {r.doc_id: r for r in quality.score(junk, model).collect()}
    apart = [i for i in range(len(marks)) if i % 3 == 0]
    assert len(rows) == len(marks) + len(ODD) and np.mean([rows[i].predicted == 1 - marks[i] for i in apart]) >= 0.95
    kept = quality.keep_good(junk, model)
    assert kept.columns == junk.columns and kept.count() == sum(r.predicted for r in rows.values())
    again = quality.fit(junk, labels)
    assert np.allclose(again.w1, model.w1) and again.temperature == model.temperature
    assert quality.fit(junk, labels.filter("quality = 1")) is None
    assert quality.score(junk.filter("false"), None).count() == 0


def test_quality_counts_single_words(spark):
    docs, labels, _ = labelled(spark, 12)
    once = docs.selectExpr("doc_id", "concat(text, ' once', doc_id) AS text")
    model = quality.fit(once, labels)  # all words fit into the vocabulary
    assert set(hash_words([f"once{i}" for i in range(240) if i % 3]).tolist()) <= set(model.tokens.tolist())


def test_shard_files_in_folder(tmp_path):
    address = put(str(tmp_path), "x", [b"a", b"b"])
    assert get(address) == b"ab" and get(f"file://{address}") == b"ab"


def test_labelled_sample_beside_any_columns(spark):
    """Documents with the names that the sample uses inside, and an id in many rows."""
    rows = [(i % 40 if i < 40 else 7, f"text {i}", "a", 1.0, 5, "x") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, weight double, _i int, id string")
    labels = spark.createDataFrame([(i, i % 2, 9.0, "t") for i in range(40)] + [(3, 0, 1.0, "t"), (None, 1, 1.0, "t")], "doc_id long, quality int, weight double, text string")
    from drifthound.llm.common import labelled_sample

    sample = labelled_sample(docs, labels, "quality", per_class=12).collect()
    assert sorted(r.label for r in sample) == [0] * 12 + [1] * 12
    assert all(r.label == r.id % 2 for r in sample)


@pytest.mark.parametrize("operator", ("toxicity", "quality"))
def test_classifiers_beside_any_columns(spark, operator):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["good", "fine", "calm", "soft"] if i % 2 else ["bad", "vile", "evil", "harsh"]) for _ in range(30)) for i in range(80)]
    docs = spark.createDataFrame([(i, t, "a", 1.0, 5, "x", 0.5, 1) for i, t in enumerate(texts)], "doc_id long, text string, label string, weight double, _i int, id string, score double, predicted int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    module = {"toxicity": toxicity, "quality": quality}[operator]
    model = module.fit(docs, labels, "toxic")
    out = {r.doc_id: r.predicted for r in module.score(docs, model).collect()}
    assert len(out) == 80
    if operator == "quality":  # so few different words are no passage's log-odds
        assert sum(out[i] == i % 2 for i in range(80)) > 70
