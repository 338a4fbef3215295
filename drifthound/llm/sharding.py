"""Sharding by bytes: contiguous shards cut at equal targets of a global prefix sum.

Rows are put in the order of their id (ties by crc32, then by size). A row of
size s that starts at byte b of B in all goes to shard floor((2b + s) * n / 2B),
so each cut is at the row whose middle passes an equal target: a shard misses
its target by at most one row. Equal texts are not kept together: a group of
copies may be larger than a shard.

Null and empty texts have size 1; repeated rows each get a slot; an empty table
gives an empty result; other columns are not read unless named in `carry`, and
may have any name that the output does not use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, size, text_crc32, shard, slot (and the columns in `carry`)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit(1).cast("long").alias("rows"),
        *[F.col(c).alias(f"_c_{c}") for c in carry],
    )
    placed = prefix_sums(rows, ["_id", "text_crc32", "size"], ["size", "rows"])
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(size_before * 2 + size) * {shards} div (size_total * 2)")).cast("int"))
    # one row per shard, at most `shards` of them
    first = placed.groupBy("shard").agg(F.min("rows_before").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("rows_before") - F.col("_first")).alias("slot"),
        *[F.col(f"_c_{c}").alias(c) for c in carry],
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id") -> None:
    """Write `docs` with one folder per shard, each in slot order."""
    others = tuple(c for c in docs.columns if c != id_col)
    placed = shard_by_bytes(docs, shards, id_col, carry=others)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
