"""The whole pipeline against plain Python, stage by stage on what the stage before kept."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import tokenizers

import corpus_pipeline
from drifthound.llm.common import table
from drifthound.llm.queries import tokenizer_path

from .test_operators import ODD, SPACE, brute_components, near_texts, words


def corpus(seed):
    """Texts, sources, labels and benchmark items: groups of near copies, junk, benchmark passages, odd texts."""
    rng = random.Random(seed)
    items = [" ".join(f"b{rng.randint(0, 99)}" for _ in range(n)) for n in (14, 30, 10)]
    good = near_texts(seed) + [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 90))) for _ in range(60)]
    good += [f"{good[0]} {items[0].upper()} {good[9]}", f"{good[20]} {' '.join(items[1].split()[4:16])}", items[2] + "."]
    junk = [" ".join(f"{rng.choice(('buy', 'click', 'win'))}{rng.randint(0, 20)}!!" for _ in range(rng.randint(20, 60))) for _ in range(70)]
    junk += [junk[0], junk[1]]
    rows = [(t, 1) for t in good] + [(t, 0) for t in junk]
    rng.shuffle(rows)
    return rows, [rng.choice(["x", "x", "x", "ß", "a", None]) for _ in rows], items


def mixed(rows):
    """(position, id, text) of each copy that the mix takes of (id, text, source)."""
    size = {i: len(SPACE.findall(t or "")) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(sources)}
    slope = {s: (-0.8, 0.0, 0.8)[n % 3] for n, s in enumerate(sources)}
    left, open_, target = 1.5 * sum(total.values()), set(sources), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        for s in full or open_:
            target[s] = 2 * total[s] if full else level * weight[s]
            left -= target[s] if full else 0
        open_ = open_ - full if full else set()
    out = []
    for s in sources:
        before = 0
        for i, t in sorted(((i, t) for i, t, x in rows if x == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            base = math.floor(target[s] / total[s]) if total[s] else 0
            copies = base + (2 * before + size[i] < 2 * (target[s] - base * total[s])) if size[i] else 0
            for p in range(copies):
                y = min(1.0, (p * total[s] + before + size[i] / 2) / target[s])
                a = slope[s]
                out.append((y if a == 0 else (math.sqrt((1 - a) ** 2 + 4 * a * y) - (1 - a)) / (2 * a), i, t))
            before += size[i]
    return sorted(out)


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rows, sources, items = corpus(3)
    # with columns of the names that stages use
    spark.createDataFrame([(i, t, "en", s, len(t or ""), -1.0, 3, 0.5, 7, "k") for i, ((t, _), s) in enumerate(zip(rows, sources))], "doc_id long, text string, lang string, source string, n_chars long, training_position double, label int, weight double, _i long, mix_key string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(rows) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(f"item{i}", t) for i, t in enumerate(items)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline(spark, place):
    rows, sources, items = corpus(3)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mix", "tokens"]
    docs = table(spark, place, "documents")
    good = corpus_pipeline.STAGES[0][1](spark, docs, place)
    assert good.columns == docs.columns
    ids = {r.doc_id for r in good.collect()}
    plain = {i for i, (t, _) in enumerate(rows) if t in ODD or len(words(t)) < 5}
    assert ids - plain == {i for i, (_, y) in enumerate(rows) if y} - plain, "the classifier rejects the junk and nothing else"

    kept = sorted(ids)
    groups = brute_components([rows[i][0] for i in kept], 5, 80, 100)
    kept = [i for n, (i, (_, c)) in enumerate(zip(kept, groups)) if n == c]
    windows = {tuple(w[p : p + 10]) for w in map(words, items) for p in range(len(w) - 9)}
    hit = {i for i in kept if any(tuple(w[p : p + 10]) in windows for w in [words(rows[i][0])] for p in range(len(w) - 9))}
    assert len(kept) < len(ids) and len(hit) >= 2
    taken = mixed([(i, rows[i][0], sources[i]) for i in kept if i not in hit])

    encoder = tokenizers.Tokenizer.from_file(tokenizer_path())
    want, start = [], 0
    for _, i, t in taken:
        coded = [*encoder.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(coded), zlib.crc32(np.array(coded, "<u4").tobytes())))
        start += len(coded)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, place).orderBy("start").collect()]
    assert got == want and len({i for i, *_ in got}) < len(got)


def test_pipeline_of_empty_tables(spark, place, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, place, name).filter("false").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
