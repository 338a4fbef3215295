"""N-gram Jaccard join: a blocked sparse product of documents by word n-grams.

A document's set is the hashes of its distinct word k-grams (of the whole
sequence, where it has fewer words); documents of equal sets are one node. Two
nodes link when den * intersection >= num * union.

Incidence: n-grams get one global order, seldom ones first (a sketch of fixed
size finds the frequent ones; any order gives the same links). In that order a
set of size n keeps its first n - ceil(num n / den) + 1 n-grams: linked sets
share one of them. N-grams that no node of fitting size shares are dropped.

Stars: each n-gram's nodes first meet one of them, the node with the fewest
n-grams of its own, which of near copies is the nearest to their common text.
So a group of near copies makes about as many pairs as it has rows, not their
square. For n-grams of many nodes further stars, each around a node outside the
n-gram's largest component, go on while each at least halves what is left. Rows
that no partner of their n-gram's sizes can link with from there on (too few
n-grams follow) take no part: pages of one template with words of their own.

Product: then what two nodes of different components share of the n-grams they
keep is counted by joining the incidence to itself on the n-gram, as long as
what follows an n-gram in both orders can still reach the overlap that the
sizes call for. The count and what follows the last n-gram counted bound the
overlap; pairs below what their sizes call for are discarded. So are pairs whose signatures differ in more bits than
linked sets can: bit i of a signature is the parity of the n-grams that fall in
it, so two signatures differ in at most as many bits as the sets in n-grams.
The product is whole: whatever pairs the stars leave are made, and the overlaps
of all that the bounds leave are counted over whole sets.

Null and empty texts, and texts without words, have the empty set and link with
nothing; their component is their own id. Null ids are never a component's id
where another is there. Repeated rows each get a row; an empty table gives an
empty result; other columns are not read, and pass through in `keep_first`.
N-grams and sets are compared as 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, unused, written
from .components import components
from .text import NOT_SPACE, text_chunks, windows, words_of

_U = np.uint64
SKETCH_BITS = 22
#: At most so many frequent buckets are told to the tasks.
FREQUENT = 65536
MAP_BITS = 26
#: Longs of a set's signature.
LONGS = 16
_SIGNATURE = [f"s{i}" for i in range(LONGS)]
#: Sets of more n-grams than half the bits also get a signature of at least twice as many bits as n-grams.
SHORT = 32 * LONGS


def ngram_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of each text."""
    for lo, hi, data, offsets in text_chunks(column):
        w = words_of(data, offsets, NOT_SPACE)
        rolled = windows(w.hashes, k)
        for d in range(hi - lo):
            a, b = int(w.bounds[d]), int(w.bounds[d + 1])
            if b - a >= k:
                yield lo + d, np.unique(rolled[a : b - k + 1])
            elif b > a:  # salted by the length, so that no k-gram is equal to it
                yield lo + d, windows(w.hashes[a:b], b - a) ^ _U(b - a)
            else:
                yield lo + d, np.zeros(0, np.uint64)


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _parities(s: np.ndarray, bits: int) -> np.ndarray:
    """Bit i: whether an odd number of n-grams falls in it."""
    return (np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)


def _wide(s: np.ndarray) -> bytes | None:
    return None if len(s) <= SHORT else np.packbits(_parities(s, 1 << (2 * len(s) - 1).bit_length())).tobytes()


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> _U(64 - SKETCH_BITS)).astype(np.int64)


def _keep(num: int, den: int, n: str = "n") -> str:
    """How many n-grams a set of size n keeps."""
    return f"({n} - ({num} * {n} + {den} - 1) div {den} + 1)"


def _read_sets(docs: DataFrame, k: int) -> DataFrame:
    """One pass: a row per document (id, text hash, node, n, signature), and rows (bucket, seen) of what a task saw often."""
    kind = dict(docs.dtypes)["_id"]
    names = ["id", "h", "node", "n", *_SIGNATURE, "bucket", "seen", "wide"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sets = np.zeros(1 << SKETCH_BITS, np.int32), 0
        id_type = None
        for b in batches:
            id_type = b.column(0).type
            nodes, sizes, wide = [], [], []
            bits = np.zeros((b.num_rows, 64 * LONGS), bool)
            for d, s in ngram_sets(b.column(1), k):
                nodes.append(node_of(s) if len(s) else None)
                sizes.append(len(s))
                bits[d] = _parities(s, 64 * LONGS)
                wide.append(_wide(s))
                np.add.at(seen, _bucket(s), 1)
                sets += len(s)
            signature = np.packbits(bits, axis=1).view(np.int64)
            empty = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(signature[:, i]) for i in range(LONGS)), empty, empty, pa.array(wide, pa.binary())], names=names)
        mean = sets / len(seen)
        often = np.flatnonzero(seen >= max(4, mean + 6 * mean**0.5 + 2))
        if len(often):
            none = pa.nulls(len(often), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(often), id_type), *[none] * (3 + LONGS), pa.array(often), pa.array(seen[often].astype(np.int64)), pa.nulls(len(often), pa.binary())], names=names)

    return written(docs.mapInArrow(scan, f"id {kind}, {', '.join(f'{c} long' for c in names[1:-1])}, wide binary"), "sets")


def _incidence(docs: DataFrame, k: int, num: int, den: int, crowd: int, frequent: list) -> DataFrame:
    """The n-grams that linked sets share: token, node, n, place in the node's order, own, crowded.

    `own` counts the n-grams that a node keeps but shares with none. A token of
    `crowd` nodes is crowded.
    """
    spark = docs.sparkSession
    table = np.zeros((2, len(frequent)), np.int64)
    for i, r in enumerate(sorted(frequent, key=lambda r: r.bucket)):
        table[:, i] = r.bucket, r.seen
    shared = spark.sparkContext.broadcast(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, counts = shared.value
        done: set[int] = set()  # copies within a task add nothing
        for b in batches:
            held: list[tuple[np.ndarray, ...]] = []
            for _, s in ngram_sets(b.column(0), k):
                n = len(s)
                if not n or (node := node_of(s)) in done:
                    continue
                done.add(node)
                weight = np.zeros(n, np.int64)
                if len(buckets):
                    at = np.searchsorted(buckets, _bucket(s))
                    at[at == len(buckets)] = 0
                    weight = np.where(buckets[at] == _bucket(s), counts[at], 0)
                keep = n + (-num * n // den) + 1
                order = np.lexsort((s, weight))[:keep]
                # a frequent n-gram is dealt over several partitions; salt 0 is for the others only
                salt = np.where(weight[order] > 0, 1 + (node & 63), 0)
                held.append((s[order].view(np.int64), np.full(keep, node), np.full(keep, n), np.arange(keep), salt))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=["token", "node", "n", "place", "salt"])

    rows = docs.select("_t").mapInArrow(scan, "token long, node long, n long, place long, salt long")
    by = W.partitionBy("token", "salt")
    near = by.orderBy("n", "node")
    fits = lambda other: F.least("n", other) * den >= F.greatest("n", other) * num
    # a row stays if a node of fitting size is next to it; of equal rows (copies in several tasks) one stays
    met = rows.withColumns({"_p": F.lag(F.struct("n", "node")).over(near), "_q": F.lead(F.struct("n", "node")).over(near)})
    first = F.col("_p").isNull() | (F.col("_p.node") != F.col("node")) | (F.col("_p.n") != F.col("n"))
    lo, hi = F.min("node").over(by), F.max("node").over(by)
    useful = (F.col("salt") > 0) | F.coalesce(fits(F.col("_p.n")) & (F.col("_p.node") != F.col("node")), F.lit(False)) | F.coalesce(fits(F.col("_q.n")), F.lit(False))
    kept = met.withColumns({"_lo": lo, "_hi": hi}).filter((F.col("_lo") < F.col("_hi")) | (F.col("salt") > 0)).filter(useful & first)
    counted = kept.select("token", "node", "n", "place", ((F.col("salt") > 0) | (F.count("*").over(by) >= crowd)).alias("crowded"))
    own = F.expr(_keep(num, den)) - F.count("*").over(W.partitionBy("node"))
    return written(counted.withColumn("own", own), "incidence")


def _whole_sets(docs: DataFrame, k: int, nodes: DataFrame) -> DataFrame:
    """node, grams (sorted hashes as bytes) of the nodes asked for.

    A bit map of fixed size keeps most other documents out of the shuffle.
    """
    spark = docs.sparkSession
    bit = F.expr(f"node & {(1 << MAP_BITS) - 1}")
    rows = nodes.select(F.shiftright(bit, 6).alias("w"), F.expr("shiftleft(1L, cast(node & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    bits[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    shared = spark.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, done = shared.value, set()
        for b in batches:
            nodes, grams, size = [], [], 0
            for _, s in ngram_sets(b.column(0), k):
                if not len(s) or (node := node_of(s)) in done:
                    continue
                done.add(node)
                low = node & ((1 << MAP_BITS) - 1)
                if int(bits[low >> 6]) >> (low & 63) & 1:
                    nodes.append(node)
                    grams.append(s.tobytes())
                    size += 8 * len(s)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(grams, pa.binary())], names=["node", "grams"])
                        nodes, grams, size = [], [], 0
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(grams, pa.binary())], names=["node", "grams"])

    found = docs.select("_t").mapInArrow(scan, "node long, grams binary")
    return written(found.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "whole-sets")


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep[i] = den * both >= num * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(scan, "a long, b long")


def _alike(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, na, nb, x, y) whose wide signatures differ in no more bits than linked sets can; short sets have none."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i, (na, nb, x, y) in enumerate(zip(*(batch.column(c) for c in range(2, 6)))):
                if x.is_valid and y.is_valid:
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    if len(x) != len(y):  # folded to the same bits, of which each byte holds eight in a row
                        x, y = (x, y) if len(x) > len(y) else (y, x)
                        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)))
                    keep[i] = int(np.bitwise_count(x ^ y).sum()) * (num + den) <= (na.as_py() + nb.as_py()) * (den - num)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "na", "nb", "x", "y").mapInArrow(scan, "a long, b long")


def _differ(a: str, b: str) -> str:
    """Bits in which two signatures differ."""
    return " + ".join(f"bit_count({a.format(c)} ^ {b.format(c)})" for c in _SIGNATURE)


def link_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", crowd: int = 16, product_rows: int = 4) -> DataFrame:
    """Per document: id, n_shingles, component_id (the smallest id that links reach).

    N-grams of at least `crowd` nodes take further stars, while the product
    would meet more than `product_rows` pairs for each row of the incidence.
    """
    return _components(docs, k, num, den, id_col, text_col, crowd, product_rows).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _components(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str, crowd: int = 16, product_rows: int = 4) -> DataFrame:
    """Per document: id, hash of the text, n, component_id."""
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.xxhash64(text_col).alias("_h"))
    sets = _read_sets(read, k)
    frequent = sets.filter("seen IS NOT NULL").groupBy("bucket").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "bucket").limit(FREQUENT).collect()
    texts = read.select("_t")
    incidence = _incidence(texts, k, num, den, crowd, frequent)
    signatures = written(sets.filter("node IS NOT NULL").groupBy("node").agg(*[F.max(c).alias(c) for c in ("n", *_SIGNATURE)]), "signatures")
    wide = written(sets.filter("wide IS NOT NULL").select("node", "wide").dropDuplicates(["node"]), "wide")

    pair = [F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")]
    fits = f"least(l.n, r.n) * {den} >= greatest(l.n, r.n) * {num}"
    # what two sets share is at most what follows the first n-gram that they share
    follow = "least(l.n - l.place, r.n - r.place)"
    reach = f"{follow} * {num + den} >= (l.n + r.n) * {num}"

    def with_signature(rows: DataFrame, node: str, mark: str) -> DataFrame:
        return rows.join(signatures.select(F.col("node").alias(node), F.col("n").alias(f"n{mark}"), *[F.col(c).alias(f"{c}{mark}") for c in _SIGNATURE]), node)

    def links_of(pairs: DataFrame) -> DataFrame:
        """The pairs that link, from whole sets read for just their nodes."""
        met = with_signature(with_signature(pairs, "a", "a"), "b", "b")
        short = met.filter(f"({_differ('{}a', '{}b')}) * {num + den} <= (na + nb) * {den - num}").select("a", "b", "na", "nb")
        near = written(_alike(short.join(wide.toDF("a", "x"), "a", "left").join(wide.toDF("b", "y"), "b", "left"), num, den), "pairs")
        nodes = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        whole = _whole_sets(texts, k, nodes)
        links = written(_linked(near, whole, num, den), "links")
        discard(near, whole)
        return links

    def star(rows: DataFrame, among: DataFrame) -> DataFrame:
        """The pairs of each n-gram's rows with its row of the fewest own n-grams in `among`."""
        hubs = among.groupBy("token").agg(F.min(F.struct("own", "node", "n", "place")).alias("h")).select("token", "h.node", "h.n", "h.place")
        hubs = written(hubs, "hubs")
        found = links_of(rows.alias("l").join(hubs.alias("r"), F.col("l.token") == F.col("r.token")).filter(f"l.node <> r.node AND {fits} AND {reach}").select(*pair).distinct())
        discard(hubs)
        return found

    def rooted(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels.withColumnsRenamed({"node": "_n", "root": "_r"}), F.col("node") == F.col("_n"), "left").select(*rows.columns, F.coalesce("_r", "node").alias("root"))

    def within_reach(rows: DataFrame) -> DataFrame:
        """Rows that can reach a partner of their n-gram's sizes: what follows them calls for a partner small enough, and a partner for a row small enough.

        Pages of one template have their own n-grams first and then the
        template's: too little follows for a partner of their size, so none of
        them is left to be paired.
        """
        largest = F.expr(f"(n - place) * {num + den} div {num} - n")  # size of the largest partner
        ends = written(rows.groupBy("token").agg(F.min("n").alias("_n"), F.max(largest).alias("_m")).withColumnRenamed("token", "_t"), "ends")
        kept = written(rows.withColumn("_l", largest).join(ends, F.col("token") == F.col("_t")).filter("_l >= _n AND n <= _m").select(*rows.columns), "reach")
        discard(ends)
        return kept

    links = star(incidence, incidence)
    labels = components(links)
    wider = within_reach(incidence.filter("crowded"))
    crowded = within_reach(wider)
    discard(wider)
    bound, last, heavy = product_rows * incidence.count(), None, None
    while True:
        discard(heavy)
        heavy = written(rooted(crowded, labels), "heavy")
        roots = heavy.groupBy("token", "root").agg(F.count("*").alias("c"))
        tokens = roots.groupBy("token").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("own"), F.max_by("root", F.struct("c", "root")).alias("major"), F.count("*").alias("roots")).filter("roots > 1")
        tokens = written(tokens.select(F.col("token").alias("_t"), "major", F.expr("(all * all - own) / 2").alias("pairs")), "tokens")
        left = tokens.agg(F.sum("pairs")).first()[0] or 0
        # n-grams of one component are done with
        several, old = written(heavy.join(tokens, F.col("token") == F.col("_t")).drop("_t", "pairs"), "heavy"), heavy
        heavy = several
        discard(tokens, old)
        if left <= bound or (last is not None and 2 * left > last):
            break
        last = left
        found = star(heavy, heavy.filter("root <> major"))
        old, links = links, written(links.unionByName(found), "links")
        discard(old, found, labels)
        labels = components(links)
    # the product: crowded n-grams between components (what is outside a token's largest one, with all), others in full
    sizes = [F.when(F.col("l.node") < F.col("r.node"), F.col(f"{x}.n")).otherwise(F.col(f"{y}.n")).alias(f"n{i}") for i, x, y in (("a", "l", "r"), ("b", "r", "l"))]
    entry = [*pair, *sizes, F.expr(follow).alias("follow")]
    few = rooted(incidence.filter("NOT crowded"), labels)
    light = few.alias("l").join(few.alias("r"), F.col("l.token") == F.col("r.token")).filter(f"l.node < r.node AND l.root <> r.root AND {fits} AND {reach}").select(*entry)
    signed = written(heavy.join(signatures.drop("n"), "node"), "signed")
    near = f"({_differ('l.{}', 'r.{}')}) * {num + den} <= (l.n + r.n) * {den - num}"
    outside = signed.filter("root <> major").alias("l").join(signed.alias("r"), F.col("l.token") == F.col("r.token"))
    outside = outside.filter(f"l.root <> r.root AND (r.root = r.major OR l.node < r.node) AND {fits} AND {reach} AND {near}").select(*entry)
    # what is counted, and what follows the last n-gram counted
    counted = light.unionByName(outside).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"), F.min("follow").alias("follow"))
    possible = counted.filter(f"(shared + follow - 1) * {num + den} >= (na + nb) * {num}")
    found = links_of(possible.select("a", "b"))
    old, links = links, written(links.unionByName(found), "links")
    discard(old, found, labels, heavy, signed, incidence, crowded, signatures, wide)
    labels = components(links)
    # the least id of each node, then of each component; each is a table, so that Spark can split the joins' large keys
    members = sets.filter("n IS NOT NULL").select("id", "h", "node", "n")
    firsts = written(rooted(members.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least")), labels), "firsts")
    least = written(firsts.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    placed = written(firsts.join(least, "root").select(F.col("node").alias("_n"), "component_id"), "placed")
    discard(labels, links, firsts, least)
    return members.join(placed, F.col("node") == F.col("_n"), "left").select("id", "h", "n", F.coalesce("component_id", "id").alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that with the smallest id; all columns.

    Of rows that repeat an id and a text, one stays; rows that repeat an id
    with another text are told apart by the text's hash. Texts without words
    stay.
    """
    key, text, nth = unused(docs, "key", "text_hash", "nth")
    first = _components(docs, k, num, den, id_col, text_col).filter(F.col("id").eqNullSafe(F.col("component_id")))
    kept = written(first.select(F.xxhash64("id", "h").alias(key), F.col("h").alias(text)).distinct(), "kept")
    rows = docs.withColumn(text, F.xxhash64(text_col)).withColumn(key, F.xxhash64(id_col, text))
    met = rows.join(kept, [key, text], "left_semi")
    return met.withColumn(nth, F.row_number().over(W.partitionBy(key, text).orderBy(F.lit(0)))).filter(F.col(nth) == 1).select(*docs.columns)
