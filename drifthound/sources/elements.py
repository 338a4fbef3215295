"""The elements of a JSON array in a file, read by many tasks: blocks of bytes, cut wherever they fall.

Whether a byte stands in a string, and how deep, depends on all before it. So
blocks are first summed up for both cases (in a string or not), the sums are
put together in order (a row for each block), and each block then knows its
state. An element belongs to the block in which it begins; the task reads on
until it ends. A file of one block needs no sums: its task finds the array too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .files import place_of

CHUNK = 1 << 18
QUOTE, COMMA, COLON, ARRAY, BACKSLASH = 34, 44, 58, 91, 92
_MARKS = np.isin(np.arange(256), [QUOTE, COMMA, COLON, 91, 93, 123, 125])
_STEP = np.select([np.isin(np.arange(256), [91, 123]), np.isin(np.arange(256), [93, 125])], [1, -1])
_OPEN, _CLOSE = _STEP > 0, _STEP < 0


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(address, bytes) of a file, or of the files below a folder that aren't hidden."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        raise FileNotFoundError(path)
    found, listed = [], system.listFiles(place, True)
    while listed.hasNext():
        f = listed.next()
        if not f.getPath().getName().startswith((".", "_")):
            found.append((f.getPath().toString(), f.getLen()))
    return sorted(found)


def _chunks(address: str, start: int, end: int) -> Iterator[bytes]:
    system, path = place_of(address)
    with system.open_input_file(path) as f:
        f.seek(start)
        while start < end:
            data = f.read(min(CHUNK, end - start))
            if not data:
                return
            start += len(data)
            yield data


@dataclass
class State:
    """Where a byte stands: in a string, how many arrays and objects around it, backslashes right before it."""

    string: bool = False
    depth: int = 0
    slashes: int = 0

    def read(self, chunk: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The brackets, commas and colons outside strings: (places, bytes, depth after each); the state goes on to the chunk's end."""
        data = np.frombuffer(chunk, np.uint8)
        at = np.flatnonzero(_MARKS[data])
        slash = np.flatnonzero(data == BACKSLASH)
        if len(slash) or self.slashes:
            # backslashes in a row up to each, with those before the chunk
            first = np.concatenate([[True], np.diff(slash) > 1])[: len(slash)]
            run = slash - np.maximum.accumulate(np.where(first, slash, 0)) + 1
            if len(slash) and slash[0] == 0:
                run[: np.argmax(first[1:]) + 1 if first[1:].any() else len(run)] += self.slashes
            escaping = np.zeros(len(data) + 1, bool)
            escaping[slash + 1] = run % 2 == 1
            escaping[0] = self.slashes % 2 == 1
            at = at[~(escaping[at] & (data[at] == QUOTE))]
            self.slashes = (int(run[-1]) if len(slash) and slash[-1] == len(data) - 1 else 0)
        what = data[at]
        quotes = what == QUOTE
        inside = (np.cumsum(quotes) + self.string) % 2 == 1  # after each mark
        kept = ~(inside | quotes)
        if len(inside):
            self.string = bool(inside[-1])
        at, what = at[kept], what[kept]
        depth = self.depth + np.cumsum(_STEP[what])
        if len(depth):
            self.depth = int(depth[-1])
        return at, what, depth


def _slashes_before(address: str, start: int) -> int:
    """Backslashes right before a place."""
    n, width = 0, 64
    while n < start:
        data = b"".join(_chunks(address, max(0, start - width), start))
        n = len(data) - len(data.rstrip(b"\\"))
        if n < len(data):
            break
        width *= 16
    return n


def _first_byte(address: str, start: int) -> int:
    """The first byte from a place on that isn't white space; 0 without any."""
    for chunk in _chunks(address, start, start + CHUNK):
        if text := chunk.lstrip():
            return text[0]
    return 0


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: whether its quotes change the state, and its depth for both states before it."""
    for b in batches:
        out = []
        for address, start, end in zip(*(c.to_pylist() for c in b.columns[:3])):
            states = [State(s, 0, _slashes_before(address, start)) for s in (False, True)]
            for chunk in _chunks(address, start, end):
                for s in states:
                    s.read(chunk)
            out.append((address, start, states[0].string, states[0].depth, states[1].depth, _first_byte(address, 0) if start == 0 else 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()))], names=["file", "start", "turns", "outer", "inner", "first"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of the outermost object, each with the place of its colon; null if its value is no array."""
    for b in batches:
        out = []
        for address, start, end, string, depth in zip(*(c.to_pylist() for c in b.columns)):
            s, at = State(string, depth, _slashes_before(address, start)), start
            for chunk in _chunks(address, start, end):
                places, what, level = s.read(chunk)
                for i in places[(what == COLON) & (level == 1)].tolist():
                    out.append((address, at + i, _name_before(address, at + i) if _first_byte(address, at + i + 1) == ARRAY else None))
                at += len(chunk)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [(), (), ()], (pa.string(), pa.int64(), pa.string()))], names=["file", "at", "key"])


def _name_before(address: str, colon: int) -> str:
    text = b"".join(_chunks(address, max(0, colon - 4096), colon)).rstrip()
    return text[text.rfind(b'"', 0, len(text) - 1) + 1 : -1].decode("utf-8", "replace")


def _array_of(address: str, size: int, key: str | None) -> tuple[int, int]:
    """The bytes of a file's array, or of the array under `key` (from its colon on); none are (0, 0)."""
    if key is None:
        return (0, size) if _first_byte(address, 0) == ARRAY else (0, 0)
    s, at, lo = State(), 0, None
    for chunk in _chunks(address, 0, size):
        places, what, level = s.read(chunk)
        for i in places[(what == COLON) & (level == 1)].tolist():
            if lo is not None:
                return lo, at + i
            if _first_byte(address, at + i + 1) == ARRAY and _name_before(address, at + i) == key:
                lo = at + i
        at += len(chunk)
    return (0, 0) if lo is None else (lo, size)


def _elements(key: str | None, ranges: dict[str, tuple[int, int]]):
    """Elements of each file's array, for the blocks in which they begin; `ranges` has the bytes of the array's value in files of several blocks."""
    level = 1 if key is None else 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for address, start, end, string, depth, whole in zip(*(c.to_pylist() for c in b.columns)):
                lo, hi = _array_of(address, end, key) if whole else ranges.get(address, (0, 0))
                if whole and lo:
                    start, depth = lo, 1  # at its colon
                if start >= hi or end <= lo:
                    continue
                s, at, held, out = State(string, depth, 0 if whole else _slashes_before(address, start)), start, None, []
                for chunk in _chunks(address, start, hi):
                    places, what, levels = s.read(chunk)
                    closing = _CLOSE[what] & (levels == level - 1)
                    cut = closing | ((_OPEN[what] | (what == COMMA)) & (levels == level))
                    last = 0
                    for i, closed in zip(places[cut].tolist(), closing[cut].tolist()):
                        if held is not None:
                            text = (held + chunk[last:i]).strip()
                            if text:
                                out.append(text.decode("utf-8", "replace"))
                        last = i + 1
                        # an element that begins here belongs to this block, if the byte before it does
                        held = b"" if not closed and lo <= at + i < min(end, hi) else None
                        if at + i >= end:
                            break
                    if held is not None:
                        held += chunk[last:]
                    at += len(chunk)
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([address] * len(out)), pa.array(out)], names=["file", "value"])
                        out = []
                    if at >= end and held is None:
                        break

    return scan


def _dealt(spark: SparkSession, rows: list[tuple], schema: str, tasks: int) -> DataFrame:
    """Rows of (file, start, end, ...) dealt to tasks of some equal bytes.

    No shuffle deals them: by the few bytes of one, Spark would take what is
    read from the files for a table to broadcast.
    """
    order = sorted(rows, key=lambda r: r[1] - r[2])
    hands = [order[i::tasks] for i in range(tasks)]
    return spark.createDataFrame(spark.sparkContext.parallelize(hands, tasks).flatMap(lambda hand: hand), schema)


def json_elements(spark: SparkSession, path: str, key: str | None = None, block: int = 32 << 20) -> DataFrame:
    """file, value: the texts of the elements of each file's array, or (key) of the array under that key of its object.

    Files of UTF-8. A file that has no such array gives no rows; a path without files is an error.
    """
    sizes = [(f, n) for f, n in files_of(spark, path) if n]
    if not sizes:
        return spark.createDataFrame([], "file string, value string")
    places = [(f, at, min(n, at + block)) for f, n in sizes for at in range(0, n, block)]
    tasks = max(1, min(len(places), max(spark.sparkContext.defaultParallelism, sum(e - s for _, s, e in places) // block)))
    whole = {f: n <= block for f, n in sizes}
    parts = [p for p in places if not whole[p[0]]]
    known = [(*p, False, 0, True) for p in places if whole[p[0]]]
    ranges: dict[str, tuple[int, int]] = {}
    if parts:
        few = min(len(parts), tasks)
        sums = {(r.file, r.start): r for r in _dealt(spark, parts, "file string, start long, end long", few).mapInArrow(_sums, "file string, start long, turns boolean, outer long, inner long, first int").collect()}  # a row for each block
        file, states = None, []
        for f, start, end in parts:
            if f != file:
                file, string, depth = f, False, 0
            states.append((f, start, end, string, depth))
            r = sums[f, start]
            depth += r.inner if string else r.outer
            string ^= r.turns
        known += [(*p, False) for p in states]
        ends = {f: n for f, n in sizes if not whole[f]}
        if key is None:
            ranges = {f: (0, n) for f, n in ends.items() if sums[f, 0].first == ARRAY}
        else:
            colons: dict[str, list[tuple[int, str]]] = {}
            for r in _dealt(spark, states, "file string, start long, end long, string boolean, depth long", few).mapInArrow(_keys, "file string, at long, key string").collect():  # the few keys of each file's object
                colons.setdefault(r.file, []).append((r["at"], r.key))
            for f, found in colons.items():
                found.sort()
                for (at, name), (after, _) in zip(found, [*found[1:], (ends[f], "")]):
                    if name == key:
                        ranges[f] = (at, after)
    return _dealt(spark, known, "file string, start long, end long, string boolean, depth long, whole boolean", tasks).mapInArrow(_elements(key, ranges), "file string, value string")
