"""Benchmark decontamination with suffix arrays of the training text.

A shard is a few MB of whole documents. Its words are ranked by the benchmark's
vocabulary, and the suffixes that begin with two words standing together in
some item (one word, where items of one word exist) are sorted by their first
`window` words: a suffix array without those suffixes that no test suffix can
match. Every test suffix is then binary-searched word by word; what is left
after d words are the places of all verbatim matches of d words. A match of
`window` words, or of a whole shorter item, is a hit; hits that follow each
other in item and document are one longer match.

Words are compared as 64-bit hashes. Items are taken in blocks of about
`block_words` words, so that what is broadcast has a bound.

Null and empty texts have no words and are clean; items without words are
ignored; items that share an id count once; repeated documents each get a row;
empty tables give an empty result or clean documents; other columns are not
read, and pass through in `remove_contaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD
from .text import text_chunks, words_of

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


@dataclass
class Index:
    """Test suffixes of one block: ranks of their first words, item and place."""

    vocabulary: np.ndarray  # sorted word hashes
    pairs: np.ndarray  # sorted codes of two ranks standing together
    singles: np.ndarray  # ranks of items of one word
    needed: np.ndarray  # words that a suffix must match
    ranks: np.ndarray  # suffixes x window, -3 beyond needed
    items: np.ndarray
    places: np.ndarray
    names: list[str]


def build_index(names: list[str], texts: list[str | None], window: int) -> Index:
    hashes: list[np.ndarray] = []
    for _, _, data, offsets in text_chunks(pa.array(texts, pa.string())):
        w = words_of(data, offsets)
        hashes += [w.hashes[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:])]
    vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    ranks, needed, items, places, pairs, singles = [], [], [], [], [], []
    for n, h in enumerate(hashes):
        if not len(h):
            continue
        r = np.searchsorted(vocabulary, h).astype(np.int64)
        k = min(window, len(r))
        rows = np.lib.stride_tricks.sliding_window_view(r, k)
        ranks.append(np.pad(rows, ((0, 0), (0, window - k)), constant_values=-3))
        needed.append(np.full(len(rows), k))
        items.append(np.full(len(rows), n))
        places.append(np.arange(len(rows)))
        if k == 1:
            singles.append(r)
        else:
            pairs.append(r[:-1] * len(vocabulary) + r[1:])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Index(vocabulary, np.unique(cat(pairs)), np.unique(cat(singles)), cat(needed), np.concatenate(ranks) if ranks else np.zeros((0, window), np.int64), cat(items), cat(places), names)


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def suffix_array(ranks: np.ndarray, ends: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at `starts` in the order of their first `depth` ranks, and those ranks."""
    keys = np.full((depth, len(starts)), -2, np.int64)
    for d in range(depth):
        inside = starts + d < ends
        keys[d, inside] = ranks[starts[inside] + d]
    order = np.lexsort(keys[::-1])
    return starts[order], keys[:, order]


def narrow(keys: np.ndarray, wanted: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Range of the sorted suffixes that match each test suffix, and the words matched."""
    q, n = len(wanted), keys.shape[1]
    lo, hi, matched = np.zeros(q, np.int64), np.full(q, n), np.zeros(q, np.int64)
    alive = np.arange(q)
    for d in range(keys.shape[0]):
        alive = alive[(needed[alive] > d)]
        if not len(alive):
            break
        column, value = keys[d], wanted[alive, d]
        bounds = []
        for upper in (False, True):
            a, b = lo[alive].copy(), hi[alive].copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                c = column[np.minimum(mid, n - 1)]
                right = open_ & ((c <= value) if upper else (c < value))
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            bounds.append(a)
        found = bounds[0] < bounds[1]
        matched[alive[found]] = d + 1
        alive = alive[found]
        lo[alive], hi[alive] = bounds[0][found], bounds[1][found]
    return lo, hi, matched


def shard_hits(index: Index, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document word, words, item, item word) of every hit in a shard."""
    none = (np.zeros(0, np.int64),) * 4
    if not len(hashes) or not len(index.vocabulary):
        return none
    at = np.searchsorted(index.vocabulary, hashes)
    at[at == len(index.vocabulary)] = 0
    ranks = np.where(index.vocabulary[at] == hashes, at, -1)
    starts = np.flatnonzero(ranks >= 0)
    nexts = np.append(ranks, -1)[starts + 1]
    opens = _member(index.singles, ranks[starts]) | ((nexts >= 0) & _member(index.pairs, ranks[starts] * len(index.vocabulary) + nexts))
    starts = starts[opens]
    if not len(starts):
        return none
    ends = bounds[np.searchsorted(bounds, starts, "right")]
    places, keys = suffix_array(ranks, ends, starts, index.ranks.shape[1])
    lo, hi, matched = narrow(keys, index.ranks, index.needed)
    full = np.flatnonzero(matched >= index.needed)
    sizes = hi[full] - lo[full]
    which = np.repeat(full, sizes)
    upto = np.cumsum(sizes)
    spot = places[np.repeat(lo[full] - (upto - sizes), sizes) + np.arange(int(upto[-1]) if len(upto) else 0)]
    return spot, index.needed[which], index.items[which], index.places[which]


def _per_document(index: Index, hashes: np.ndarray, bounds: np.ndarray) -> dict[int, tuple[list[dict], list[str], int]]:
    """For documents with hits: merged word spans, items, longest match in words."""
    spot, size, item, place = shard_hits(index, hashes, bounds)
    if not len(spot):
        return {}
    doc = np.searchsorted(bounds, spot, "right") - 1
    out = {}
    order = np.lexsort((spot, spot - place, item, doc))
    cuts = np.flatnonzero(np.diff(doc[order])) + 1
    for rows in np.split(order, cuts):
        d = int(doc[rows[0]])
        s, n, diagonal = spot[rows], size[rows], (spot - place)[rows]
        joined = np.append(False, (np.diff(s) == 1) & (np.diff(diagonal) == 0) & (np.diff(item[rows]) == 0))
        runs = np.diff(np.append(np.flatnonzero(~joined), len(rows)))
        longest = int((runs - 1 + n[np.flatnonzero(~joined)]).max())
        by_start = np.argsort(s, kind="stable")
        a, b = s[by_start] - bounds[d], (s + n)[by_start] - bounds[d]
        reach = np.maximum.accumulate(b)
        first = np.append(True, a[1:] > reach[:-1])
        spans = [{"start": int(x), "end": int(y)} for x, y in zip(a[first], reach[np.append(np.flatnonzero(first)[1:] - 1, len(a) - 1)])]
        out[d] = (spans, sorted({index.names[i] for i in np.unique(item[rows])}), longest)
    return out


def _indexes(benchmark: DataFrame, window: int, block_words: int, item_col: str, text_col: str) -> list:
    """A broadcast index for each block of items."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    words = rows.agg(F.sum(F.coalesce(F.regexp_count("t", F.lit("(?i)" + ALNUM_WORD)), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-int(words) // block_words))
    out = []
    for n in range(blocks):
        part = (rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == n)).collect()
        out.append(benchmark.sparkSession.sparkContext.broadcast(build_index([r.i for r in part], [r.t for r in part], window)))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items, spans of hit words, longest match, contaminated."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.xxhash64(text_col).alias("_h"))
    kind = dict(rows.dtypes)["_id"]
    found = None
    indexes = _indexes(benchmark, window, block_words, item_col, "text")
    for n, shared in enumerate(indexes):

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, every=n == 0) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                for lo, hi, data, offsets in text_chunks(b.column(1)):
                    w = words_of(data, offsets)
                    hit = _per_document(index, w.hashes, w.bounds)
                    keep = range(hi - lo) if every else sorted(hit)
                    empty = ([], [], 0)
                    got = [hit.get(d, empty) for d in keep]
                    at = pa.array([lo + d for d in keep], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(at), b.column(2).take(at), pa.array(np.diff(w.bounds)[list(keep)].astype(np.int64)), pa.array([g[0] for g in got], SPANS),
                         pa.array([g[1] for g in got], pa.list_(pa.string())), pa.array([g[2] for g in got], pa.int64())],
                        names=["_id", "_h", "n_words", "spans", "items", "longest"])

        part = rows.mapInArrow(scan, f"_id {kind}, _h long, n_words long, spans array<struct<start:long,end:long>>, items array<string>, longest long").withColumn("_first", F.lit(int(n == 0)))
        found = part if found is None else found.unionByName(part)
    if len(indexes) > 1:
        merge = "aggregate(array_sort(flatten(collect_list(spans))), cast(array() as array<struct<start:bigint,end:bigint>>), (acc, s) -> CASE WHEN size(acc) = 0 OR s.start > element_at(acc, -1).end THEN concat(acc, array(s)) ELSE concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end)))) END)"
        found = found.groupBy("_id", "_h").agg(F.max("n_words").alias("n_words"), F.expr(merge).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("longest").alias("longest"), F.sum("_first").cast("int").alias("_rows"))
        found = found.withColumn("_row", F.explode(F.sequence(F.lit(1), "_rows")))
    return found.select(
        F.col("_id").alias(id_col), "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.array_sort("items").alias("items"), "spans", F.col("longest"), (F.size("items") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 2_000_000, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The documents without a hit, all columns; nothing is shuffled."""
    at = docs.columns.index(text_col)
    for shared in _indexes(benchmark, window, block_words, item_col, "text"):

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for lo, _, data, offsets in text_chunks(b.column(at)):
                    w = words_of(data, offsets)
                    spot = shard_hits(index, w.hashes, w.bounds)[0]
                    keep[lo + np.searchsorted(w.bounds, spot, "right") - 1] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
