"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

A vocabulary is a map from byte strings to ranks. The adjacent pair whose
join has the lowest rank merges first, the leftmost of equals. A sequence of
tokens is what these merges make of its bytes if no merge would ever cross
the border of two neighbours; so whether a token may follow another depends
on the two alone (`Merges.may_follow`), and exactly one sequence has no such
border.

The transducer reads bytes. A branch is (last token, place in the trie of
token bytes, tokens not yet given out): the text so far ends with that token
and the bytes that lead to the place. Where a place is a token that may follow,
a branch that has read it begins. A state is the set of branches, freed of the
tokens that all of them begin with: these are given out. Branches die where
the trie ends, so a token is known at most the longest token's bytes later.
States are made when first reached, and all are dropped when there are too
many.

Each match of the pattern is read by itself; a match that is a token as a
whole is that token. Short matches are remembered.

Decoding takes ids block by block; bytes of a character that a block leaves
unfinished wait for the next (`Utf8Stream`).

Null and empty texts give no ids, and ids of a null list the empty text; equal rows and ids are each answered;
other columns are not read; an empty table gives an empty result. An id outside the vocabulary is an error.
Bytes that aren't UTF-8 are decoded to U+FFFD, as a decoder of the whole would.
"""

from __future__ import annotations

import base64
import gc
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice, takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = -1
NEVER = 1 << 62
#: Bytes of text that are encoded before a batch is given on.
BLOCK_BYTES = 2 << 20
#: Ids that are decoded at once.
BLOCK_IDS = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of base64 bytes and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Merges:
    """What the ranks do to the bytes of one token, and to two tokens side by side."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self._history: dict[int, list[tuple[int, bytes, bytes]]] = {}

    def merge(self, data: bytes) -> Iterator[tuple[int, list[bytes]]]:
        """(rank of the next merge or NEVER, parts) before each merge and at the end."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1)), default=(NEVER, 0))
            yield rank, parts
            if rank == NEVER:
                return
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def history(self, token: int) -> list[tuple[int, bytes, bytes]]:
        """(rank of the next merge, first part, last part) of each step of a token's bytes."""
        if token not in self._history:
            self._history[token] = [(rank, parts[0], parts[-1]) for rank, parts in self.merge(self.bytes_of[token])]
        return self._history[token]

    def reachable(self, token: int) -> bool:
        """Whether the bytes of a token merge to that token."""
        return self.history(token)[-1][1] == self.bytes_of[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of the two: both are merged in step, the lower rank first."""
        a, b = self.history(left), self.history(right)
        i = j = 0
        while True:
            (next_left, _, last), (next_right, first, _) = a[i], b[j]
            crossing = self.ranks.get(last + first, NEVER)
            if crossing < next_left and crossing <= next_right:
                return False
            if next_left <= next_right:
                if next_left == NEVER:
                    return True
                i += 1
            else:
                j += 1


class Transducer:
    """Bytes to token ids; states are made when they are first reached."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 150_000) -> None:
        self.merges, self.max_states = Merges(ranks), max_states
        self.child: dict[int, int] = {}  # place * 256 + byte to place; place 0 is the root
        self.token_at: dict[int, int] = {}
        for token, rank in ranks.items():
            place = 0
            for byte in token:
                place = self.child.setdefault(place << 8 | byte, len(self.child) + 1)
            self.token_at[place] = rank
        self._follows: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = []
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.ends: list[tuple[int, ...]] = []
        self._numbers: dict[tuple, int] = {}
        self._follows.clear()
        self._state(((NONE, 0, ()),))

    def _state(self, branches: tuple) -> int:
        """The number of a state. Branches stand in the order of their places' depth, so the one at the root is the last."""
        n = self._numbers.get(branches)
        if n is None:
            n = self._numbers[branches] = len(self.states)
            self.states.append(branches)
            self.steps.append({})
            self.ends.append(branches[-1][2])
        return n

    def _may_follow(self, left: int, right: int) -> bool:
        known = self._follows.get((left, right))
        if known is None:
            known = self.merges.reachable(right) and (left == NONE or self.merges.may_follow(left, right))
            self._follows[left, right] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """(next state, tokens given out)."""
        branches, whole = [], None
        child, token_at, follows = self.child.get, self.token_at.get, self._follows.get
        for last, place, held in self.states[state]:
            there = child(place << 8 | byte)
            if there is None:
                continue
            branches.append((last, there, held))
            token = token_at(there)
            if token is not None and whole is None:  # one branch at most is at the root
                known = follows((last, token))
                if known or known is None and self._may_follow(last, token):
                    whole = (token, 0, (*held, token))
        branches.append(whole)
        given = branches[0][2]
        if given:  # what all branches hold first
            for _, _, held in branches:
                if held[: len(given)] != given:
                    given = tuple(x for x, y in takewhile(lambda p: p[0] == p[1], zip(given, held)))
            if given:
                branches = [(last, place, held[len(given) :]) for last, place, held in branches]
        found = self.steps[state][byte] = self._state(tuple(branches)), given
        return found

    def encode(self, data: bytes) -> list[int]:
        """Ids of one match."""
        whole = self.merges.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self.reset()
        state, out, steps = 0, [], self.steps
        for byte in data:
            step = steps[state].get(byte) or self._step(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        out += self.ends[state]
        return out


#: Texts without characters from here on are matched by the standard library, which is faster.
NARROW = 0x250


def narrowed(pattern: str) -> re.Pattern | None:
    r"""The same matches below NARROW with \p{L}, \p{N} and \s spelled out; None if the pattern uses more than that."""
    import regex

    def ranges(kind: str) -> str:
        inside = [c for c in range(NARROW) if regex.fullmatch(kind, chr(c))]
        ends = [c for c in inside if c + 1 not in inside]
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip([c for c in inside if c - 1 not in inside], ends))

    out, in_class = [], False
    for part in re.findall(r"\\[pP]\{\^?\w+\}|\\.|.", pattern, re.DOTALL):
        if part in (r"\p{L}", r"\p{N}", r"\s"):
            out.append(ranges(part) if in_class else f"[{ranges(part)}]")
        elif part == r"\S" and not in_class:
            out.append(f"[^{ranges(chr(92) + 's')}]")
        elif len(part) > 1 and part[1].isalpha():
            return None
        else:
            in_class = part == "[" or (in_class and part != "]")
            out.append(part)
    return re.compile("".join(out))


class Encoder(dict):
    """Matches of the pattern to their ids; a dictionary of those met so far."""

    #: Characters of a match that is remembered, and how many are.
    LONG, MOST = 40, 400_000

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        super().__init__()
        self.transducer, self.wide = Transducer(ranks), regex.compile(pattern)
        self.narrow, self.wider = narrowed(pattern), re.compile(f"[{chr(NARROW)}-{chr(sys.maxunicode)}]")

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.transducer.encode(piece.encode()))
        if len(piece) <= self.LONG:
            if len(self) >= self.MOST:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> Iterator[int]:
        pattern = self.wide if self.narrow is None or self.wider.search(text) else self.narrow
        matches = pattern.findall(text) if len(text) <= BLOCK_BYTES else (m.group() for m in pattern.finditer(text))
        return chain.from_iterable(map(self.__getitem__, matches))


class Utf8Stream:
    """Bytes in blocks to text in blocks: a character cut by a block's end waits for its other bytes."""

    #: Bytes that must follow a first byte (well-formed UTF-8: C2 to DF one, E0 to EF two, F0 to F4 three).
    FOLLOW = np.select([np.arange(256) < 0xC2, np.arange(256) < 0xE0, np.arange(256) < 0xF0, np.arange(256) < 0xF5], [0, 1, 2, 3], 0).tolist()

    def __init__(self) -> None:
        self.waiting = b""

    def feed(self, block: bytes) -> str:
        data = self.waiting + block
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:  # the last first byte
                if self.FOLLOW[byte] >= back:
                    cut = len(data) - back
                break
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


def decode_stream(ids: Iterable[int], bytes_of: Callable[[int], bytes], block: int = BLOCK_IDS) -> Iterator[str]:
    """Text of a stream of ids, as soon as its characters are whole."""
    ids, stream = iter(ids), Utf8Stream()
    while some := list(islice(ids, block)):
        yield stream.feed(b"".join(map(bytes_of, some)))
    yield stream.end()


#: Encoders and vocabularies of this worker, by path.
_loaded: dict[tuple, object] = {}


def _kept(key: tuple, make: Callable[[], object]) -> object:
    if key not in _loaded:
        _loaded.clear()  # one of each worker's life is enough
        _loaded[key] = make()
    return _loaded[key]


def _blocks(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` in all."""
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(lengths):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and `ids`, the token ids of each whole text."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _kept(("encode", ranks_path, pattern), lambda: Encoder(load_ranks(ranks_path), pattern))
        gc.disable()  # states and remembered matches hold no cycles, and a search for some takes half the time
        for b in batches:
            texts = b.column(1)
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for lo, hi in _blocks(sizes, BLOCK_BYTES):
                flat, ends = [], [0]
                for t in texts.slice(lo, hi - lo).to_pylist():
                    flat.append(np.fromiter(encoder.encode(t), np.int32))
                    ends.append(ends[-1] + len(flat[-1]))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), ids], names=["id", "ids"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The columns of `encoded` and `decoded`, the text of each row's ids."""
    if "decoded" in {c.lower() for c in encoded.columns}:
        raise ValueError("the table has a column `decoded`")
    at = encoded.columns.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def load() -> dict[int, bytes]:
            return {rank: token for token, rank in load_ranks(ranks_path).items()}

        bytes_of = _kept(("decode", ranks_path), load).__getitem__
        for b in batches:
            lists = b.column(at).fill_null([]) if b.column(at).null_count else b.column(at)
            for lo, hi in _blocks(lists.value_lengths().to_numpy(zero_copy_only=False), BLOCK_BYTES // 2):
                part = b.slice(lo, hi - lo)
                texts = ["".join(decode_stream(x.values.to_numpy(zero_copy_only=False).tolist(), bytes_of)) for x in lists.slice(lo, hi - lo)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(decode, f"{fields}, decoded string")
