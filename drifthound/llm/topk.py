"""Exact top-k inner products by columnar branch and bound.

Vectors become integers, floor(256 x). Candidates of a task are turned into a
vertical layout, one row per dimension, in blocks of `lane` vectors. Queries
meet a block dimension slice by dimension slice: partial products of all that
survive are added up, and a candidate goes when its partial product plus
|rest of query| * |rest of candidate| (Cauchy-Schwarz) can't reach the k-th
best score the query has so far; survivors are compacted before the next
slice. Each task gives at most k rows a query, and a window keeps the k best.

Queries are taken in chunks of at most `chunk` vectors, so that what is
broadcast has a fixed bound; each chunk meets every candidate.

Vectors that are null, empty or hold null or non-finite components take no
part; only vectors of equal length are compared; a query is never its own
candidate (equal vec_id); repeated rows of a query are answered once if their
vectors are equal, repeated candidates each count; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries whose first products with a lane of candidates are held at once.
QUERY_BLOCK = 256
SCHEMA = "query_no long, query_id long, vec_id long, score long"


class _Best:
    """The k best (score, then smaller id) of one query within a task."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int | None:
        return int(self.scores[-1]) if len(self.scores) == self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        if len(s) > 4 * self.k:  # at least as good as the k-th
            keep = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
            s, i = s[keep], i[keep]
        order = np.lexsort((i, -s))[: self.k]
        self.scores, self.ids = s[order], i[order]


def _matrix(column: pa.Array, ids: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and integer vectors of a batch (rows are already clean)."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
    ids = ids.to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        out[int(d)] = (ids[rows], flat[offsets[rows][:, None] + np.arange(d)].astype(np.int64))
    return out


def _rest(m: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norm of what is left of each row from each cut on, rounded up."""
    squares = m.astype(np.float64) ** 2
    return np.stack([np.sqrt(squares[:, c:].sum(1)) for c in cuts]) * (1 + 1e-9)


def _search(best: list[_Best], qids: np.ndarray, q: np.ndarray, qrest: np.ndarray, cids: np.ndarray, c: np.ndarray, slices: list[int]) -> None:
    """One lane of candidates against all queries of their length."""
    crest = _rest(c, slices)
    layout = np.ascontiguousarray(c.T)  # one row per dimension
    exact = np.abs(q).max(initial=0).astype(float) * np.abs(c).max(initial=0) * q.shape[1] < 2**52
    kind = np.float64 if exact else np.int64
    head = layout[: slices[1]].astype(kind)
    for n in range(len(q)):
        if n % QUERY_BLOCK == 0:  # first products of a few queries at once: their size doesn't grow with the chunk
            first = q[n : n + QUERY_BLOCK, : slices[1]].astype(kind) @ head
        alive = np.flatnonzero(cids != qids[n])
        part = first[n % QUERY_BLOCK, alive].astype(np.int64)
        for s in range(1, len(slices) - 1):
            if (least := best[n].least) is not None:
                keep = part + qrest[s, n] * crest[s, alive] >= least
                alive, part = alive[keep], part[keep]
            if not len(alive):
                break
            lo, hi = slices[s], slices[s + 1]
            part = part + q[n, lo:hi] @ layout[lo:hi, alive]
        if len(alive):
            best[n].add(part, cids[alive])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", slice_dims: int = 8, lane: int = 8192, chunk: int = 65536) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query."""
    if not 1 <= k:
        raise ValueError("k is at least 1")
    spark = candidates.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        ok = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
        return df.filter(v.isNotNull() & F.col(id_col).isNotNull() & ok).select(
            F.col(id_col).cast("long").alias("i"), F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"))

    asked, offered = clean(queries).distinct(), clean(candidates)
    # queries in chunks of a fixed size: chunk numbers come from a hash, so that no order over all is needed
    chunks = max(1, -(-asked.count() * 5 // (4 * chunk)))
    found = None
    for n in range(chunks):
        part = asked if chunks == 1 else asked.filter(F.pmod(F.xxhash64("i", "v"), F.lit(chunks)) == n)
        block = part.toArrow()  # about `chunk` vectors
        by_length = _matrix(block.column("v").combine_chunks(), block.column("i").combine_chunks()) if block.num_rows else {}
        shared = spark.sparkContext.broadcast(by_length)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            state = {}
            base = 0
            for d, (ids, q) in sorted(shared.value.items()):
                # dimensions with most of the queries' mass come first
                order = np.argsort(-(q.astype(np.float64) ** 2).sum(0), kind="stable")
                q = q[:, order]
                cuts = [*range(0, d, slice_dims), d]
                state[d] = (base, ids, q, _rest(q, cuts), cuts, order, [_Best(k) for _ in ids])
                base += len(ids)
            for b in batches:
                for d, (cids, c) in _matrix(b.column(1), b.column(0)).items():
                    if d in state:
                        _, ids, q, qrest, cuts, order, best = state[d]
                        for lo in range(0, len(c), lane):
                            _search(best, ids, q, qrest, cids[lo : lo + lane], c[lo : lo + lane][:, order], cuts)
            for base, ids, *_, best in state.values():
                rows = [(base + n, ids[n], i, s) for n, x in enumerate(best) for i, s in zip(x.ids, x.scores)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*rows)], names=["query_no", "query_id", "vec_id", "score"])

        rows = offered.mapInArrow(scan, SCHEMA).withColumn("_chunk", F.lit(n))
        found = rows if found is None else found.unionByName(rows)
    by = W.partitionBy("_chunk", "query_no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
