"""Hard negatives by coordinate pruning over length buckets.

Components become floor(256 x); a score is the integer inner product. An
anchor's positives are the best `positives` rows of its label; a positive's
negatives are the best `negatives` rows of other labels whose score lies
between two shares of the positive's score.

A task sorts its rows (in lanes of about `lane` components) by label and length and cuts
them into buckets of nearly equal length. A bucket holds one sorted list of
values for each coordinate, of vectors brought to length 1. An anchor goes
through the buckets from the longest vectors on. The scores that still count
(from the share of the positive, or the k-th best so far, to the upper share)
bound the angle to any vector of the bucket, and the angle bounds each
coordinate: on the anchor's `focus` largest coordinates a range of each sorted
list is feasible. Rows in all ranges are scored exactly; a bucket too short
for any score that counts ends the search.

Anchors are written to the shared folder in blocks of `block` rows, which each
task reads one after the other, so neither the driver nor a broadcast holds
them; a task gives at most `positives` rows an anchor and `negatives` rows a
positive for each lane, and windows keep the best.

Rows with a null id, label or vector, an empty vector, or a null or non-finite
component take no part. Only vectors of one length are compared. Rows with the
anchor's id are not its others; an anchor row that repeats as a whole is
answered once; other repeated rows each count. Ties go to the smaller id.
Scores beyond what doubles hold exactly are computed in whole numbers of any
size; one that doesn't fit a long is an error. An empty table, or one without
anchors, gives an empty result; other columns are not read.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_folder, written
from .files import get, make_folder, put

#: Rows of a bucket, and the least share of its longest vector's length that a row of it has.
BUCKET_ROWS, BUCKET_SHARE = 2048, 0.9
#: What rounding may do to a unit vector's coordinate or cosine.
SLACK = 1e-9
EXACT = float(2**52)


def whole_numbers(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: row numbers and floor(256 x), as doubles that are whole."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    return {int(d): (rows := np.flatnonzero(lengths == d), flat[starts[rows][:, None] + np.arange(d)]) for d in np.unique(lengths)}


def products(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where these hold every sum, else in whole numbers of any size."""
    if np.abs(rows).max(initial=0) * np.abs(vector).max(initial=0) * len(vector) < EXACT:
        return (rows @ vector).astype(np.int64)
    exact = [sum(int(x) * int(y) for x, y in zip(r, vector)) for r in rows]
    return np.array(exact, np.int64 if all(-(2**63) <= s < 2**63 for s in exact) else object)


@dataclass
class Bucket:
    """Rows of nearly equal length; `order` and `values` are the sorted lists, one row for each coordinate."""

    places: np.ndarray
    longest: float
    shortest: float
    unit: np.ndarray
    order: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, places: np.ndarray, vectors: np.ndarray, lengths: np.ndarray) -> Bucket:
        unit = vectors / np.maximum(lengths, 1e-300)[:, None]
        order = np.argsort(unit.T, axis=1, kind="stable")
        return cls(places, float(lengths[0]), float(lengths[-1]), unit, order, np.take_along_axis(unit.T, order, 1))

    def feasible(self, direction: np.ndarray, focus: np.ndarray, least: float, most: float) -> np.ndarray:
        """Numbers within the bucket of rows whose cosine to `direction` may lie between the two."""
        if least <= -1 and most >= 1:
            return np.arange(len(self.places))
        near, far = math.acos(min(1.0, max(-1.0, most))), math.acos(min(1.0, max(-1.0, least)))  # angles to the anchor
        found = None
        for f in focus:
            axis = math.acos(min(1.0, max(-1.0, float(direction[f]))))  # the anchor's angle to the axis
            # a row at an angle b to the anchor is between |axis - b| and axis + b away from the axis
            high = 1.0 if near <= axis <= far else math.cos(min(abs(axis - near), abs(axis - far)))
            low = -1.0 if near <= math.pi - axis <= far else min(math.cos(axis + near), math.cos(axis + far))
            high, low = high + SLACK, low - SLACK
            if found is None:
                lo, hi = np.searchsorted(self.values[f], low, "left"), np.searchsorted(self.values[f], high, "right")
                found = self.order[f, lo:hi]
            else:
                x = self.unit[found, f]
                found = found[(x >= low) & (x <= high)]
            if not len(found):
                break
        return found


class Lane:
    """Rows of one vector length in one task, with their buckets."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.lengths = np.sqrt((vectors * vectors).sum(1)) if vectors.size == 0 or np.abs(vectors).max() < 1e150 else np.array([math.hypot(*v) for v in vectors])
        self._buckets: dict[int | None, list[Bucket]] = {}
        self._of_label: dict[int, np.ndarray] | None = None

    def _cut(self, places: np.ndarray) -> list[Bucket]:
        places = places[np.argsort(-self.lengths[places], kind="stable")]
        out, lo = [], 0
        while lo < len(places):
            lengths = self.lengths[places[lo : lo + BUCKET_ROWS]]
            n = max(1, int((lengths >= BUCKET_SHARE * lengths[0]).sum()))
            out.append(Bucket.of(places[lo : lo + n], self.vectors[places[lo : lo + n]], lengths[:n]))
            lo += n
        return out

    def buckets(self, label: int | None) -> list[Bucket]:
        """Of one label's rows, or (None) of all rows."""
        if label not in self._buckets:
            if label is None:
                places = np.arange(len(self.ids))
            else:
                if self._of_label is None:
                    by = np.argsort(self.labels, kind="stable")
                    cuts = np.flatnonzero(np.diff(self.labels[by])) + 1
                    self._of_label = {int(self.labels[p[0]]): p for p in np.split(by, cuts) if len(p)}
                places = self._of_label.get(label, np.zeros(0, np.int64))
            self._buckets[label] = self._cut(places)
        return self._buckets[label]

    def best(self, anchor: np.ndarray, anchor_id: int, label: int, same: bool, ranges: list[tuple[int | None, int | None]], k: int, focus: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each range of scores (either end may be open) its k best rows of the label, or of other labels: ids and scores."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ranges]
        size = float(np.sqrt((anchor * anchor).sum())) if np.abs(anchor).max() < 1e150 else math.hypot(*anchor)
        direction = anchor / size if size else anchor
        largest = np.argsort(-np.abs(direction), kind="stable")[:focus]
        highs = [hi for _, hi in ranges]
        most = None if any(h is None for h in highs) else max(highs, default=None)

        def least() -> int | None:
            """The lowest score that can still be among the results."""
            ends = [lo if len(s) < k else int(s[k - 1]) if lo is None else max(lo, int(s[k - 1])) for (lo, _), (_, s) in zip(ranges, found)]
            return None if any(e is None for e in ends) else min(ends)

        for b in self.buckets(label if same else None):
            low = least()
            if low is not None and low > 0 and low > size * b.longest * (1 + SLACK):
                break  # this bucket and all that follow are too short
            # the cosine's bounds: a score is size * length * cosine
            lengths = (b.longest, b.shortest)
            bottom = -2.0 if low is None or not size else min(low / (size * x) if x else -2.0 for x in lengths) - SLACK
            top = 2.0 if most is None or not size else max(most / (size * x) if x else 2.0 for x in lengths) + SLACK
            if bottom > 1 or top < -1:
                continue
            places = b.places[b.feasible(direction, largest, bottom, top)]
            places = places[(self.labels[places] == label) == same] if not same else places
            places = places[self.ids[places] != anchor_id]
            if not len(places):
                continue
            scores, ids = products(self.vectors[places], anchor), self.ids[places]
            for n, (lo, hi) in enumerate(ranges):
                fit = np.ones(len(ids), bool)
                if lo is not None:
                    fit &= scores >= lo
                if hi is not None:
                    fit &= scores <= hi
                if fit.any():
                    i, s = np.concatenate([found[n][0], ids[fit]]), np.concatenate([found[n][1], scores[fit]])
                    order = np.lexsort((i, -s))[:k]
                    found[n] = i[order], s[order]
        return found


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue()


def _unpacked(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def _regrouped(batches: Iterator[pa.RecordBatch], most: int, cells: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `most` rows, or (cells) of rows with about `most` components, one row at least."""
    held, room = [], most
    for b in batches:
        ends = np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False)) if cells else np.arange(1, b.num_rows + 1)
        at, done = 0, 0
        while at < b.num_rows:
            to = int(np.searchsorted(ends, done + room, "right"))
            to = max(to, at + 1) if not held else max(to, at)
            if to > at:
                held.append(b.slice(at, to - at))
                room -= int(ends[to - 1]) - done
                at, done = to, int(ends[to - 1])
            if room <= 0 or at < b.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, room = [], most
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _anchor_blocks(rows: DataFrame, folder: str, block: int) -> list[str]:
    """Write rows in blocks; the addresses, whose order numbers the anchors."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _regrouped(batches, block):
            yield pa.RecordBatch.from_arrays([pa.array([put(folder, "anchors", [_packed(b)])])], names=["address"])

    return sorted(r.address for r in rows.mapInArrow(write, "address string").collect())


def _search(rows: DataFrame, blocks: list[str], lane: int, answer: Callable[[Lane, int, pa.Table], Iterator[tuple]], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """Every lane of rows against every block of anchors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _regrouped(batches, lane, cells=True):
            ids, labels = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            lanes = {d: Lane(ids[at], labels[at], v) for d, (at, v) in whole_numbers(b.column(2)).items()}
            for n, address in enumerate(blocks):
                out = list(answer(lanes, n, _unpacked(get(address))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[f"c{j}" for j in range(len(kinds))])

    return rows.mapInArrow(scan, schema)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100), focus: int = 4,
    lane: int = 1 << 21, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    if min(positives, negatives, focus, lane, block) < 1:
        raise ValueError("positives, negatives, focus, lane and block are at least 1")
    (low_num, low_den), (high_num, high_den) = low, high
    v = F.col(vector_col)
    ok = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    cells = [F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.cast("array<double>").alias("v")]
    taking_part = v.isNotNull() & F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ok
    clean = rows.filter(taking_part).select(*cells)
    folder = new_folder(rows.sparkSession, "anchors")
    make_folder(folder)
    blocks = _anchor_blocks(rows.filter(taking_part & is_anchor).select(*cells).distinct(), folder, block)

    def nearest(lanes: dict[int, Lane], n: int, anchors: pa.Table) -> Iterator[tuple]:
        ids, labels = anchors.column(0).to_pylist(), anchors.column(1).to_pylist()
        for d, (at, q) in whole_numbers(anchors.column(2).combine_chunks()).items():
            for row, vector in zip(at.tolist(), q) if d in lanes else ():
                ((found, scores),) = lanes[d].best(vector, ids[row], labels[row], True, [(None, None)], positives, focus)
                for i, s in zip(found.tolist(), scores.tolist()):
                    yield n, row, i, s

    four = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    found = _search(clean, blocks, lane, nearest, "block int, row int, id long, score long", four)
    by = W.partitionBy("block", "row").orderBy(F.desc("score"), "id")
    kept = written(found.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= positives), "positives")

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        """A block's positives: at most `block` times `positives` rows."""
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "address": [put(folder, "positives", [_packed(group.combine_chunks().to_batches()[0])])]})

    wanted = {r.block: r.address for r in kept.groupBy("block").applyInArrow(pack, "block int, address string").collect()}

    def hardest(lanes: dict[int, Lane], n: int, anchors: pa.Table) -> Iterator[tuple]:
        if n not in wanted:
            return
        scored: dict[int, list[tuple[int, int, int]]] = {}
        for r in sorted(_unpacked(get(wanted[n])).to_pylist(), key=lambda r: r["n"]):
            scored.setdefault(r["row"], []).append((r["n"], r["id"], r["score"]))
        ids, labels = anchors.column(0).to_pylist(), anchors.column(1).to_pylist()
        for d, (at, q) in whole_numbers(anchors.column(2).combine_chunks()).items():
            for row, vector in zip(at.tolist(), q) if d in lanes else ():
                # low_num * p / low_den <= score <= high_num * p / high_den, in whole numbers
                pairs = [(p, -(-low_num * p[2] // low_den), high_num * p[2] // high_den) for p in scored.get(row, [])]
                pairs = [x for x in pairs if x[1] <= x[2]]
                if pairs:
                    best = lanes[d].best(vector, ids[row], labels[row], False, [x[1:] for x in pairs], negatives, focus)
                    for (p, _, _), (found, scores) in zip(pairs, best):
                        for i, s in zip(found.tolist(), scores.tolist()):
                            yield n, row, p[0], ids[row], p[1], p[2], i, s

    columns = "block int, row int, n int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _search(clean, blocks, lane, hardest, columns, [pa.int32()] * 3 + [pa.int64()] * 5)
    by = W.partitionBy("block", "row", "n").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
