"""Prefix trie of conversations, with count-min screening of prefix digests.

The digest of a prefix is the exclusive or of 128-bit hashes of its (place,
role and text): a running aggregate, so a long conversation is cut over tasks
like any other rows. Rows (conversation, depth) carry the digest of their
prefix and, since a turn's own hash can be taken out again, of their parent.

Screening: all digests are counted in a count-min sketch whose cells stop at
two. An estimate of one proves a prefix that only one conversation has: its
node, and all below it, need no other row, and are given out where they are.
Only the other rows are shuffled by digest, for exact grouping: members, then
(joined back) which member is the smallest, children, leaves and savings. The
sketch grows with the number of rows up to `SKETCH_CELLS`; beyond, digests are
taken in slices, each with a sketch of its own.

Sums over subtrees need no walk: a conversation that isn't the smallest member
of a node saves that node's last turn, so the savings below a node are sums of
its members' suffixes; and a leaf counts for each prefix of its smallest
member.

Turns stand by number, null first; equal numbers by md5 of the turn. Null role
and text are empty. Rows without a conversation id are left out. Conversations
without turns after rebuilding still belong to the root. Repeated rows are
turns like others. An empty table has no root and gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, shuffle_partitions, written

#: Rows of the sketch, its most cells in all (a byte each), cells of a block, and cells of a row for each digest.
SKETCH_ROWS, SKETCH_CELLS, BLOCK_CELLS, SPREAD = 4, 1 << 24, 1 << 16, 2
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: Bytes of joined ids in one row.
ENDS_BYTES = 1 << 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _cells(x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """The cell of each digest in each row of the sketch."""
    x, y = x.view(np.uint64), y.view(np.uint64)
    spread = (x[None, :] * _ODD[:, None]) ^ ((y[None, :] + _ODD[:, None]) >> np.uint64(17)) * _ODD[::-1, None]
    spread ^= spread >> np.uint64(31)
    return (spread % np.uint64(width)).astype(np.int64) + np.arange(SKETCH_ROWS)[:, None] * width


class Sketch:
    """A count-min sketch whose cells count to two."""

    def __init__(self, width: int) -> None:
        self.width, self.cells = width, np.zeros(SKETCH_ROWS * width, np.uint8)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        for row in _cells(x, y, self.width):
            at, n = np.unique(row, return_counts=True)
            self.cells[at] = np.minimum(2, self.cells[at] + np.minimum(n, 2).astype(np.uint8))

    def estimate(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.cells[_cells(x, y, self.width)].min(0)


def build_sketch(digests: DataFrame, n: int) -> np.ndarray:
    """The cells for `n` digests (columns x, y): each task's nonzero blocks, added up block by block."""
    width = -(-SPREAD * max(n, BLOCK_CELLS // SKETCH_ROWS) * SKETCH_ROWS // BLOCK_CELLS) * BLOCK_CELLS // SKETCH_ROWS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(width)
        for b in batches:
            sketch.add(b.column(0).to_numpy(), b.column(1).to_numpy())
        blocks = sketch.cells.reshape(-1, BLOCK_CELLS)
        some = np.flatnonzero(blocks.any(1))
        for k in range(0, len(some), 64):
            packed = [zlib.compress(blocks[j].tobytes(), 1) for j in some[k : k + 64]]
            yield pa.RecordBatch.from_arrays([pa.array(some[k : k + 64].astype(np.int32)), pa.array(packed)], names=["block", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cells = np.frombuffer(zlib.decompress(raw), np.uint8)
                if k != block:
                    if block is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)])], names=["block", "cells"])
                    block, total = k, np.zeros(BLOCK_CELLS, np.uint8)
                total = np.minimum(2, total + cells)
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)])], names=["block", "cells"])

    counted = digests.select("x", "y").mapInArrow(count, "block int, cells binary")
    cells = np.zeros(SKETCH_ROWS * width, np.uint8)
    # at most SKETCH_CELLS bytes
    for r in counted.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, cells binary").toLocalIterator():
        cells[r.block * BLOCK_CELLS : (r.block + 1) * BLOCK_CELLS] = np.frombuffer(zlib.decompress(bytes(r.cells)), np.uint8)
    return cells


def screen(rows: DataFrame, n: int, root: tuple[int, int] = (0, 0)) -> DataFrame:
    """`rows` with `alone` and `parent_alone`: whether the sketch proves (x, y) and (px, py) to be of one row only.

    `rows` is a written table of `n` rows. A parent that is the root is never alone.
    """
    slices = max(1, -(-n * SPREAD * SKETCH_ROWS // SKETCH_CELLS))

    def in_slice(x: str, k: int) -> Column:
        return F.lit(True) if slices == 1 else F.pmod(F.xxhash64(x), F.lit(slices)) == k

    names = [f.name for f in rows.schema]
    ax, ay, bx, by = (names.index(c) for c in ("x", "y", "px", "py"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    for k in range(slices):
        mine = rows.filter(in_slice("x", k))
        cells = build_sketch(mine, mine.count() if slices > 1 else n)
        shared = rows.sparkSession.sparkContext.broadcast(cells)  # at most SKETCH_CELLS bytes

        def probe(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            sketch = Sketch(1)
            sketch.cells, sketch.width = shared.value, len(shared.value) // SKETCH_ROWS
            for b in batches:
                flags = []
                for u, v, known in ((ax, ay, "alone"), (bx, by, "parent_alone")):
                    x, y = b.column(u).to_numpy(), b.column(v).to_numpy()
                    flag = sketch.estimate(x, y) == 1
                    if known == "parent_alone":
                        flag &= ~((x == root[0]) & (y == root[1]))
                    if slices > 1:  # what other slices have found stays
                        here = b.column(len(names) + 2 + (known == "parent_alone")).to_numpy(zero_copy_only=False)
                        flag = np.where(here, flag, b.column(len(names) + (known == "parent_alone")).to_numpy(zero_copy_only=False))
                    flags.append(pa.array(flag))
                yield pa.RecordBatch.from_arrays([*[b.column(j) for j in range(len(names))], *flags], names=[*names, "alone", "parent_alone"])

        if slices > 1:
            flagged = rows if k else rows.withColumns({"alone": F.lit(False), "parent_alone": F.lit(False)})
            given = flagged.withColumns({"_in": in_slice("x", k), "_pin": in_slice("px", k)})
        else:
            given = rows
        old, rows = rows, written(given.mapInArrow(probe, f"{schema}, alone boolean, parent_alone boolean"), "screened")
        discard(old)
        shared.destroy()
    return rows


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, part, pos (place from 0 in the conversation), content (md5), chars; rows of a conversation may lie in several parts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    content = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(" "), role, text).cast("binary")))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), content.alias("content"), F.char_length(text).cast("long").alias("chars"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("content")]
    parted = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).withColumn("part", F.spark_partition_id())
    return written(parted, "turns")


def rebuilt(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 100, most: int = 6) -> DataFrame:
    """Rebuilt conversations: conv, part, depth (from 1), length, content, chars; and a row of depth 0 for each conversation.

    A conversation c begins with the first h turns of c - c % group, h = crc32(c as text) % most, and goes on with
    its own turns after its first h.
    """
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    before = W.partitionBy("conv").orderBy("part")
    spans = written(turns.groupBy("conv", "part").agg(F.count("*").alias("n")).select(
        "conv", "part", F.coalesce(F.sum("n").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("n").over(W.partitionBy("conv")).alias("own")), "spans")
    place = F.row_number().over(W.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), "content")) - 1

    def placed(rows: DataFrame, of: DataFrame) -> DataFrame:
        """`rows` with what `of` has for their conversation and part, and their places."""
        there = of.withColumnsRenamed({"conv": "_c", "part": "_p"})
        return rows.join(there, (F.col("conv") == F.col("_c")) & (F.col("part") == F.col("_p"))).withColumn("pos", F.col("offset") + place).drop("_c", "_p")

    first = F.col("conv") % group == 0
    heads = placed(turns.filter(first), spans.filter(first)).filter(F.col("pos") < most - 1)
    heads = heads.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "content", "chars"))).alias("head"))  # fewer than `most` turns
    plan = spans.withColumns({"base": F.col("conv") - F.col("conv") % group, "h": (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")})
    plan = plan.join(heads.withColumnRenamed("conv", "_c"), F.col("base") == F.col("_c"), "left").drop("_c")
    plan = plan.withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,content:binary,chars:bigint>>")), F.lit(1), F.col("h")))
    plan = plan.withColumn("length", F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    plan = written(plan, "plan")
    own = placed(turns, plan.select("conv", "part", "offset", "h", "length", F.size("head").alias("p"))).filter("pos >= h").select(
        "conv", "part", (F.col("pos") - F.col("h") + F.col("p") + 1).alias("depth"), "length", "content", "chars")
    # the turns that come from elsewhere, and the row of depth 0, once for each conversation
    once = plan.filter("offset = 0")
    base = once.select("conv", F.lit(-1).alias("part"), "length", F.inline("head")).select("conv", "part", (F.col("pos") + 1).alias("depth"), "length", "content", "chars")
    roots = once.select("conv", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("depth"), "length", F.lit(None).cast("binary").alias("content"), F.lit(0).cast("long").alias("chars"))
    return written(own.unionByName(base).unionByName(roots), "rebuilt")


def _prefix_rows(turns: DataFrame) -> DataFrame:
    """Rows of depth 1 and more with the digests of their prefix (x, y) and of its parent (px, py)."""
    own = {c: F.xxhash64(F.lit(seed), "depth", "content") for c, seed in (("mx", 11), ("my", 12))}
    rows = turns.filter("depth > 0").withColumns(own)
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("conv", "part").agg(F.bit_xor("mx").alias("tx"), F.bit_xor("my").alias("ty"))
    parts = parts.select(F.col("conv").alias("_c"), F.col("part").alias("_p"), *[F.coalesce(F.bit_xor(t).over(before), F.lit(0)).alias(o) for t, o in (("tx", "ox"), ("ty", "oy"))])
    within = W.partitionBy("conv", "part").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    running = rows.withColumns({"x": F.bit_xor("mx").over(within), "y": F.bit_xor("my").over(within)})
    joined = running.join(parts, (F.col("conv") == F.col("_c")) & (F.col("part") == F.col("_p")))
    x, y = (F.col(a).bitwiseXOR(F.col(o)) for a, o in (("x", "ox"), ("y", "oy")))
    return written(joined.select("conv", "part", F.col("depth").cast("long"), F.col("length").cast("long"), "chars", x.alias("x"), y.alias("y"),
        x.bitwiseXOR(F.col("mx")).alias("px"), y.bitwiseXOR(F.col("my")).alias("py")), "prefixes")


def _ends(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ends: SHA-256 of the ids of each key, ascending and joined by commas.

    Ids are range-partitioned, so those of one key may fill many tasks; each
    joins its ids to texts of some ENDS_BYTES, and one task hashes a key's texts.
    """
    kinds = ", ".join(f"{k} long" for k in keys)
    n = len(keys)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, texts, size = None, None, [], 0
        out = []

        def close() -> None:
            if key is not None:
                out.append((*key, first, ",".join(texts)))

        for b in batches:
            columns = [b.column(j).to_pylist() for j in range(n + 1)]
            for *k, conv in zip(*columns):
                if k != key or size > ENDS_BYTES:
                    close()
                    key, first, texts, size = k, conv, [], 0
                texts.append(str(conv))
                size += len(texts[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*keys, "first", "ids"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*keys, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        for b in batches:
            columns = [b.column(j).to_pylist() for j in range(n)]
            for *k, text in zip(*columns, b.column(n + 1).to_pylist()):
                if k != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*keys, "ends"])
                out.clear()
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, sha.hexdigest())], names=[*keys, "ends"])

    order = [*keys, "conv"]
    joined = rows.select(*order).repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(join, f"{kinds}, first long, ids string")
    return joined.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digest, f"{kinds}, ends string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each node of the trie over `rebuilt` conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.
    """
    roots = turns.filter("depth = 0")
    least, n_convs, n_turns = roots.agg(F.min("conv"), F.count("*"), F.sum("length")).first()
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = screen(_prefix_rows(turns), n_turns or 0)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    own_end = F.when(F.col("depth") == F.col("length"), F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY_SHA))
    below = (F.col("depth") < F.col("length")).cast("long")

    # 1. proven singletons: all but the parent's name is on the row, and that too unless the parent may be shared
    tails = rows.filter("alone AND (parent_alone OR depth = 1)").select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("conv")).alias("parent_conv_id"),
        one.alias("n_convs"), below.alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), own_end.alias("ends_sha256"))

    # 2. the others, grouped exactly
    maybe = rows.filter("NOT alone")
    edge = rows.filter("alone AND NOT parent_alone AND depth > 1")
    key = ["depth", "x", "y"]
    nodes = written(maybe.groupBy(*key).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("px").alias("px"), F.min("py").alias("py")), "nodes")
    children = nodes.select((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).unionByName(
        edge.select((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y"))).groupBy(*key).agg(F.count("*").alias("n_children"))
    known = written(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", none)), "known")
    discard(nodes)

    def named(df: DataFrame, at: tuple[Column, Column, Column], *cols: str, how: str = "inner") -> DataFrame:
        """`df` with columns of the node at (depth, x, y)."""
        there = known.select(*[F.col(c).alias(f"_{c}") for c in (*key, *cols)])
        d, x, y = at
        return df.join(there, (d == F.col("_depth")) & (x == F.col("_x")) & (y == F.col("_y")), how).drop("_depth", "_x", "_y")

    # 3. rows of members that aren't the smallest save their turn; the smallest member of a childless node stands for a leaf
    here = (F.col("depth"), F.col("x"), F.col("y"))
    met = named(maybe, here, "conv_id", "n_children")
    met = written(met.select("conv", "part", *key, "length", F.when(F.col("conv") == F.col("_conv_id"), none).otherwise(F.col("chars")).alias("saves"),
        ((F.col("conv") == F.col("_conv_id")) & (F.col("_n_children") == 0) & (F.col("depth") == F.col("length"))).cast("long").alias("leaf")), "met")
    # of each part of a conversation: what later parts save, and whether the conversation stands for a leaf (a conversation whose end is proven alone does)
    parts = met.groupBy("conv", "part").agg(F.sum("saves").alias("total"), F.min("depth").alias("top"), F.max("leaf").alias("leaf"), F.max((F.col("depth") == F.col("length")).cast("int")).alias("ended"))
    whole = W.partitionBy("conv")
    after = whole.orderBy(F.desc("top")).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("conv").alias("_c"), F.col("part").alias("_p"), F.coalesce(F.sum("total").over(after), none).alias("later"),
        F.when(F.max("ended").over(whole) == 1, F.max("leaf").over(whole)).otherwise(one).alias("leaves"))
    within = W.partitionBy("conv", "part").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    sums = met.withColumn("within", F.sum("saves").over(within)).join(parts, (F.col("conv") == F.col("_c")) & (F.col("part") == F.col("_p")))
    sums = sums.groupBy(*key).agg(F.sum(F.col("within") + F.col("later")).alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = _ends(maybe.filter("depth = length"), key)
    full = known.join(sums, key).join(ends, key, "left")
    parent = (F.col("depth") - 1, F.col("px"), F.col("py"))
    top = full.filter("depth = 1").withColumn("_conv_id", F.lit(least).cast("long"))
    # a parent that isn't known is proven alone: the node has its only member
    shared = named(full.filter("depth > 1"), parent, "conv_id", how="left").unionByName(top).select(
        "conv_id", "depth", F.coalesce("_conv_id", "conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"))
    firsts = named(edge, parent, "conv_id").select(
        F.col("conv").alias("conv_id"), "depth", F.col("_conv_id").alias("parent_conv_id"), one.alias("n_convs"), below.alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), own_end.alias("ends_sha256"))

    # 4. the root: all conversations; leaves below are smallest members of childless nodes and ends proven alone
    first_level = known.filter("depth = 1").select("depth").unionByName(rows.filter("alone AND depth = 1").select("depth")).agg(F.count("*")).first()[0]
    leaves = known.filter("n_children = 0").agg(F.count("*")).first()[0] + rows.filter("alone AND depth = length").count()
    saved = met.agg(F.sum("saves")).first()[0] or 0
    at_root = _ends(roots.filter("length = 0").select("conv", F.lit(0).cast("long").alias("depth")), ["depth"]).withColumnRenamed("depth", "_d")
    spark = turns.sparkSession
    root = spark.createDataFrame([(least, 0, n_convs, first_level, max(leaves, 1), saved)] if n_convs else [], "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    root = root.join(at_root, F.col("depth") == F.col("_d"), "left").withColumns({"parent_conv_id": F.lit(None).cast("long"), "ends_sha256": F.coalesce("ends", F.lit(EMPTY_SHA))})
    return tails.select(*columns).unionByName(shared.select(*columns)).unionByName(firsts.select(*columns)).unionByName(root.select(*columns))


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of a table of turns, rebuilt first."""
    return prefix_trie(rebuilt(conversations, conv_col, turn_col, role_col, text_col))
