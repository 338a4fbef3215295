"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    """Of each u the least neighbour, as a table: so the join that follows can split a hub's edges."""
    return written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def components(links: DataFrame) -> DataFrame:
    """`links` has two ids, a and b; returns node, root (the least id) of all linked nodes.

    Each step is written to the shared folder. A hub's edges are summed up
    before they are shuffled, and met by joins that Spark can split.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        # large star: each node's larger neighbours point to the least of the node and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        met = both.filter("v > u").join(least.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u"))
        large = written(met.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct(), "large")
        # small star: each node and its smaller neighbours point to the least of them
        down = _least(large)
        met = large.join(down.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u"))
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        old, edges = edges, written(small, "edges")
        discard(old, least, large, down)
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    labels = written(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "labels")
    discard(edges)
    return labels
