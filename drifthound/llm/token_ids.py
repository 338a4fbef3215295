"""Token ids in wavelet matrices: one compressed file per shard.

Documents are range-partitioned by id (or by an order column and id) and encoded in that order; each run of at
most `shard_tokens` ids (or one document, if that is longer) becomes a file.
A file holds the shard's alphabet, its document ids, lengths and null ids, and one
bit-plane per bit of the alphabet: plane l has the l-th bit of all ids in the
order that the planes above leave them (zeros first). Rank on the planes, by a
directory of counts that stands in the file, gives access, counting and
occurrence lookup without decoding the rest.

Null and empty texts are only the end id; documents of equal id stand side by
side, ordered by text; null ids stay null and come first; an empty table writes no file and gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import json
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, prefix_sums, shuffle_partitions, written
from .files import get, make_folder, put

MAGIC = b"DHWM0003"
END_ID = 2
CHUNK_BYTES = 2 << 20
#: Pieces of more characters are not kept, and count as several.
LONG_PIECE = 64


#: Bytes of a plane for each count of its rank directory.
RANK_BYTES = 64


class WaveletMatrix:
    """Ids over an alphabet of their own, as bit-planes with a rank directory.

    The directory has the number of ones in each `RANK_BYTES` bytes of a plane.
    """

    def __init__(self, alphabet: np.ndarray, n: int, planes: list[np.ndarray], directory: np.ndarray) -> None:
        self.alphabet, self.n, self.planes, self.directory = alphabet, n, planes, directory
        self.bits = len(planes)
        self._ranks: list[np.ndarray | None] = [None] * self.bits
        self.zeros = (n - directory.sum(axis=1, dtype=np.int64)).tolist()

    @staticmethod
    def counts(plane: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(plane)
        return np.add.reduceat(ones, np.arange(0, len(ones), RANK_BYTES), dtype=np.uint16) if len(ones) else np.zeros(0, np.uint16)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        present = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
        present[ids] = True
        alphabet = np.flatnonzero(present).astype(np.uint32)
        code = np.zeros(len(present), np.uint32)
        code[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
        bits = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 1
        now = code[ids].astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for level in range(bits - 1, -1, -1):
            one = (now & now.dtype.type(1 << level)) != 0
            planes.append(np.packbits(one, bitorder="little"))
            if level:
                now = np.concatenate([now[np.flatnonzero(~one)], now[np.flatnonzero(one)]])  # places are faster than masks
        return cls(alphabet, len(ids), planes, np.array([cls.counts(p) for p in planes]))

    def decode(self) -> np.ndarray:
        """All ids, by undoing the planes from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for p in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[p], count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~one)] = now[: self.zeros[p]]
            above[np.flatnonzero(one)] = now[self.zeros[p] :] | kind(1 << (self.bits - 1 - p))
            now = above
        return self.alphabet[now]

    def _rank1(self, p: int, i: int) -> int:
        """Ones before place i of plane p, from the directory and the block that i is in."""
        if self._ranks[p] is None:
            self._ranks[p] = np.append(0, np.cumsum(self.directory[p], dtype=np.int64))
        byte, bit = divmod(i, 8)
        block = byte // RANK_BYTES
        plane = self.planes[p]
        total = int(self._ranks[p][block]) + int(np.bitwise_count(plane[block * RANK_BYTES : byte]).sum())
        return total + (int(plane[byte]) & ((1 << bit) - 1)).bit_count() if bit else total

    def access(self, i: int) -> int:
        code = 0
        for p in range(self.bits):
            one = self.planes[p][i // 8] >> (i % 8) & 1
            code = code << 1 | int(one)
            i = self.zeros[p] + self._rank1(p, i) if one else i - self._rank1(p, i)
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def _range(self, code: int, lo: int, hi: int) -> tuple[int, int]:
        for p in range(self.bits):
            if code >> (self.bits - 1 - p) & 1:
                lo, hi = self.zeros[p] + self._rank1(p, lo), self.zeros[p] + self._rank1(p, hi)
            else:
                lo, hi = lo - self._rank1(p, lo), hi - self._rank1(p, hi)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often a token stands in places lo to hi."""
        code = self._code(token)
        if code is None:
            return 0
        a, b = self._range(code, lo, self.n if hi is None else hi)
        return b - a

    def _select_bit(self, p: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of plane p."""
        rank = (lambda i: self._rank1(p, i)) if bit else (lambda i: i - self._rank1(p, i))
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            if rank(mid + 1) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, token: int, k: int) -> int | None:
        """Place of the k-th (from 0) occurrence of a token."""
        code = self._code(token)
        if code is None:
            return None
        lo, hi = self._range(code, 0, self.n)
        if not 0 <= k < hi - lo:
            return None
        at = lo + k
        for p in range(self.bits - 1, -1, -1):
            bit = code >> (self.bits - 1 - p) & 1
            at = self._select_bit(p, bit, at - self.zeros[p] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def shard_bytes(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """A shard's file: magic, header length, header, then the sections it lists; null ids are masked."""
    m = WaveletMatrix.build(ids)
    packer = zstandard.ZstdCompressor(level=1)
    sections = [packer.compress(np.ascontiguousarray(x).tobytes()) for x in (m.alphabet.astype("<u4"), np.ma.filled(doc_ids, 0).astype("<i8"), lengths.astype("<u4"), np.packbits(np.ma.getmaskarray(doc_ids)), m.directory.astype("<u2"), *m.planes)]
    header = json.dumps({"n": m.n, "docs": len(doc_ids), "bits": m.bits, "sections": [len(s) for s in sections]}).encode()
    return [MAGIC, len(header).to_bytes(4, "little"), header, *sections]


def open_shard(raw: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
    """(matrix, document ids, tokens of each document) of a shard's file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a shard file")
    at = 12 + int.from_bytes(raw[8:12], "little")
    header = json.loads(raw[12:at])
    if at + sum(header["sections"]) != len(raw):
        raise ValueError("a shard file has the wrong length")
    parts = []
    for size in header["sections"]:
        parts.append(zstandard.ZstdDecompressor().decompress(raw[at : at + size]))
        at += size
    planes = [np.frombuffer(p, np.uint8) for p in parts[5:]]
    m = WaveletMatrix(np.frombuffer(parts[0], "<u4"), header["n"], planes, np.frombuffer(parts[4], "<u2").reshape(len(planes), -1))
    lengths = np.frombuffer(parts[2], "<u4").astype(np.int64)
    if lengths.sum() != m.n or m.bits != header["bits"]:
        raise ValueError("a shard's lengths don't add up")
    null = np.unpackbits(np.frombuffer(parts[3], np.uint8), count=len(lengths)).astype(bool)
    return m, np.ma.array(np.frombuffer(parts[1], "<i8"), mask=null), lengths


class _Pieces(dict):
    """Number of each piece of text seen; new ones wait in `new` to be encoded."""

    def __init__(self, owner: Encoder, lead: str) -> None:
        self.owner, self.lead = owner, lead

    def __missing__(self, key: str) -> int:
        n = self[key] = self.owner.count
        self.owner.count += 1
        self.owner.held += 1 + len(key) // LONG_PIECE
        self.owner.new.append(self.lead + key)
        return n


class Encoder:
    """The tokenizer's encode() of many texts, each distinct piece only once.

    Byte-level BPE never joins what stands on both sides of a single space or
    line break between two other characters: the space opens the next
    pre-token, the line break is one of its own. Texts are cut there, and
    known pieces are looked up. A new piece that ends with a letter and ASCII
    punctuation is put together from the two. Tokenizers of another kind encode
    whole texts. At `limit` pieces, those used once and long ones are forgotten.
    """

    #: White space but single spaces and line breaks between words, as str.split() takes it.
    ODD = r"^\n?$|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")

    def __init__(self, path: str, limit: int = 500_000) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        shape = json.loads(self.tokenizer.to_str())
        before = shape.get("pre_tokenizer") or {}
        added = shape.get("added_tokens", [])
        # no added token may reach over a cut
        self.tail = "".join(set(string.punctuation) - set("'").union(*(t["content"] for t in added)))
        self.known = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and shape["model"].get("type") == "BPE" and shape.get("normalizer") is None
            and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") for t in added)
        )
        self.new: list[str] = []
        self.bare, self.spaced, self.count = _Pieces(self, ""), _Pieces(self, " "), 2
        self.held, self.alone = 0, set()
        fixed = [[END_ID], self.tokenizer.encode("\n", add_special_tokens=False).ids]
        self.sizes = np.array([len(f) for f in fixed])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids, self.uses = np.array(sum(fixed, []), np.uint32), np.full(2, 2)
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[n for t, n in vocabulary.items() if t[0] == "\u0120"]] = True  # byte-level BPE's sign for a space
        self.line = fixed[1][0] if fixed[1] else None
        self.known = self.known and len(fixed[1]) == 1

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the pieces in the order in which they are encoded, ids of each, all ids).

        Pieces that open with a space are encoded in one text, whose ids that
        open with a space begin a piece; the others in one text with line
        breaks between them, but for those that hold white space.
        """
        alone = [n for n, p in enumerate(pieces) if p in self.alone] if self.alone else []
        spaced = [n for n, p in enumerate(pieces) if p[0] == " " and p not in self.alone]
        bare = [n for n, p in enumerate(pieces) if p[0] != " " and p not in self.alone]
        one, two = (np.array(ids, np.uint32) for ids in self._encode(["".join([pieces[n] for n in spaced]), "\n".join([pieces[n] for n in bare])]))
        first = np.append(np.flatnonzero(self.opens[one]), len(one))
        breaks = np.append(np.flatnonzero(two == self.line), len(two)) if bare else np.zeros(0, np.int64)
        rest = self._encode([pieces[n] for n in alone]) if alone else []
        sizes = np.concatenate([np.diff(first), np.diff(breaks, prepend=-1) - 1, np.array([len(r) for r in rest], np.int64)])
        return np.array(spaced + bare + alone, np.int64), sizes, np.concatenate([one, two[two != self.line], np.array(sum(rest, []), np.uint32)])

    def _flush(self) -> None:
        """Encode the new pieces, those that others are put together from first."""
        if not self.new:
            return
        first = len(self.sizes)
        made, base, end = [], [], []
        for n, p in enumerate(self.new):  # grows while it is read
            if p[-1] in self.tail and len(word := p.rstrip(self.tail)) > 1 and word[-1].isalpha() and p not in self.alone:
                made.append(first + n)
                base.append(self.spaced[word[1:]] if word[0] == " " else self.bare[word])
                end.append(self.bare[p[len(word) :]])
        composed = np.array(made, np.int64)
        plain = np.setdiff1d(np.arange(first, first + len(self.new)), composed, assume_unique=True)
        grow = lambda x, fill=0: np.concatenate([x, np.full(len(self.new), fill, np.int64)])
        self.sizes, self.starts, self.uses = grow(self.sizes), grow(self.starts), grow(self.uses)
        if len(plain):
            order, sizes, flat = self._encode_pieces([self.new[n - first] for n in plain.tolist()])
            plain = plain[order]
            self.sizes[plain], self.starts[plain] = sizes, len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, flat])
        if len(composed):
            of = np.array([base, end], np.int64).T.ravel()
            parts = self.sizes[of]
            upto = np.cumsum(parts)
            flat = self.ids[np.repeat(self.starts[of] - (upto - parts), parts) + np.arange(int(upto[-1]))]
            sizes = parts.reshape(-1, 2).sum(1)
            self.sizes[composed], self.starts[composed] = sizes, len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, flat])
        self.new, self.alone = [], set()

    def _forget(self) -> None:
        uses, half = self.uses[2:], max(1, self.limit // 2)
        floor = max(2, int(np.partition(uses, -half)[-half]) + 1) if len(uses) > half else 2
        keep = np.append([True, True], uses >= floor)
        for pieces in (self.bare, self.spaced):
            keep[[n for p, n in pieces.items() if len(p) > LONG_PIECE]] = False
        number = np.where(keep, np.cumsum(keep) - 1, -1)
        for pieces in (self.bare, self.spaced):
            left = [(p, int(number[n])) for p, n in pieces.items() if keep[n]]
            pieces.clear()
            pieces.update(left)
        sizes = self.sizes[keep]
        upto = np.cumsum(sizes)
        self.ids = self.ids[np.repeat(self.starts[keep] - (upto - sizes), sizes) + np.arange(int(upto[-1]))]
        self.starts, self.sizes, self.uses = upto - sizes, sizes, self.uses[keep] // 2
        self.count = self.held = len(sizes)
        self.uses[:2] = 2

    def _slow_numbers(self, text: str) -> list[int]:
        """Pieces of a text with white space of another kind, or more of it; those that hold it are encoded alone."""
        pieces = [p for p in self.CUT.split(text) if p]
        self.alone.update(p for p in pieces if p.split() != [p.removeprefix(" ")])
        return [self.bare[p] for p in pieces]

    def _numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all pieces, and 0 after each text; where each text ends).

        All texts are cut at once at spaces and before line breaks; only their
        distinct words become strings here.
        """
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary
        odd = pc.match_substring_regex(words, self.ODD).to_numpy(zero_copy_only=False)
        lined = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        slow = np.logical_or.reduceat(odd[at], offsets[:-1])
        number = np.zeros(len(words), np.int64)
        for pieces, rows in ((self.spaced, ~odd & ~lined), (self.bare, ~odd & lined)):
            kept = words.filter(pa.array(rows))
            if pieces is self.bare:
                kept = pc.utf8_slice_codeunits(kept, 1)
            number[rows] = list(map(pieces.__getitem__, kept.to_numpy(zero_copy_only=False)))
        numbers, breaks = number[at], lined[at]
        first = offsets[:-1][~slow]
        numbers[first] = list(map(self.bare.__getitem__, words.take(pa.array(at[first])).to_numpy(zero_copy_only=False)))
        # a line break is a piece before the word that it opens
        size = 1 + breaks
        ends = np.cumsum(size)
        spread = np.ones(int(ends[-1]), np.int64)
        spread[ends - 1] = numbers
        bounds = np.append(0, ends)[offsets]
        parts = []
        for d, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            parts += [np.array(self._slow_numbers(texts[d].as_py()), np.int64) if slow[d] else spread[lo:hi], np.zeros(1, np.int64)]
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])[1::2]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; number of ids of each text)."""
        if not self.known:
            parts = [np.array([*ids, END_ID], np.uint32) for ids in self._encode(texts.to_pylist())]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        if self.held > self.limit:
            self._forget()
        at, ends = self._numbers(texts)
        self._flush()
        self.uses += np.bincount(at, minlength=len(self.uses))
        sizes = self.sizes[at]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.starts[at] - upto[:-1], sizes) + np.arange(int(upto[-1]))]
        return ids, np.diff(upto[np.append(0, ends)])


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder a worker process: what a task has learned serves the next one."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of at least `limit` bytes."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    lo, n = 0, len(upto)
    while lo < n:
        hi = min(n, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + limit)) + 1)
        yield lo, hi
        lo = hi


def write_token_shards(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 22, order_col: str | None = None) -> DataFrame:
    """Write the shard files, by id or first by `order_col`; returns their list: part, seq, address, docs, tokens."""
    spark = docs.sparkSession
    make_folder(folder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, seq = TaskContext.get().partitionId(), encoder_of(tokenizer), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            ids, doc_ids, lengths = (f(x) for f, x in zip((np.concatenate, np.ma.concatenate, np.concatenate), zip(*held)))
            held.clear()
            pa.default_memory_pool().release_unused()
            address = put(folder, f"shard-{part:06d}-{seq:05d}", shard_bytes(ids, doc_ids, lengths))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "address": [address], "docs": [len(doc_ids)], "tokens": [len(ids)]}, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("address", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

        for b in batches:
            doc_ids = np.ma.array(b.column(0).fill_null(0).to_numpy(), mask=b.column(0).is_null().to_numpy(zero_copy_only=False))
            texts = b.column(1).cast(pa.large_string())
            for lo, hi in _slices(texts, CHUNK_BYTES):
                ids, lengths = encoder.encode(texts[lo:hi])
                held.append((ids, doc_ids[lo:hi], lengths))
                tokens += len(ids)
                if tokens >= shard_tokens:
                    yield flush()
                    tokens, seq = 0, seq + 1
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *([F.col(order_col).alias("o")] if order_col else []))
    first = ["o", "i"] if order_col else ["i"]
    ordered = rows.repartitionByRange(shuffle_partitions(spark), *first).sortWithinPartitions(*first, "t")
    return written(ordered.select("i", "t").mapInArrow(encode, "part int, seq int, address string, docs long, tokens long"), "shards")


def read_token_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, shard address."""
    spark = shards.sparkSession
    placed = prefix_sums(shards, ["part", "seq"], ["tokens"]).select("address", F.col("tokens_before").alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for address, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                matrix, doc_ids, lengths = open_shard(get(address))
                ids = matrix.decode().astype("<u4", copy=False)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids.data.astype(np.int64), mask=np.ma.getmaskarray(doc_ids)), pa.array(start + ends - lengths), pa.array(lengths), pa.array(np.array(crcs, np.int64)), pa.array([address] * len(crcs))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return placed.repartition(shuffle_partitions(spark)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def token_ids(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write all documents as shards, then read the shards back."""
    spark = docs.sparkSession
    return read_token_shards(write_token_shards(docs, new_folder(spark, "token-ids"), tokenizer, **options))
