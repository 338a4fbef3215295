"""Sums and ranks along a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.runs import materialised


def running_sums(df: DataFrame, order: tuple[str, ...], sums: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds, for each of `sums`, <name>_before (of the rows that come earlier) and <name>_total, within `keys`.

    Rows are range-partitioned by keys and order, and written, so that they
    stay where they are; what earlier partitions hold is added to a window
    inside each. The only table that is summed up as a whole has a row for
    each partition and key.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = materialised(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    totals = parted.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    earlier = group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    at = [F.col(k).alias(f"_of_key{i}") for i, k in enumerate(keys)]
    offsets = totals.select(F.col("_part").alias("_of_part"), *at, *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}_offset") for c in sums], *[F.sum(f"_{c}").over(group).alias(f"{c}_total") for c in sums])
    within = W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = parted.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_{c}_in") for c in sums])
    same = F.col("_part") == F.col("_of_part")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_of_key{i}"))
    met = inside.join(offsets, same)
    return met.select(*df.columns, *[(F.col(f"_{c}_offset") + F.col(f"_{c}_in")).alias(f"{c}_before") for c in sums], *[f"{c}_total" for c in sums])


def upper_nearest_rank(df: DataFrame, value: str, q: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, value: the value whose rank (from 0) is ceil(q * (n - 1)); nothing where there is no value."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = running_sums(counted, (value,), ("_n",), keys)
    rank = F.ceil(F.lit(q) * (F.col("_n_total") - 1))
    return placed.filter((F.col("_n_before") <= rank) & (rank < F.col("_n_before") + F.col("_n"))).select(*keys, value)
