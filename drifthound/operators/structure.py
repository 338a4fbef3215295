"""Scores of the walk that a run makes through the graph of labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import run_order, so_far, ratio, sigmoid
from .baselines import bank_events, surprisal
from .distances import bounded

START = "<start>"


def walk_facts(events: DataFrame, *kept: str) -> DataFrame:
    """run_id, pos, act, the columns kept, prev (the label before), own_s and own_c (sum of the label's places in its run, from 1, and how many), return_rate, edge_novelty."""
    e = events.select("run_id", "pos", "act", *kept)
    e = e.withColumns({"prev": F.lag("act").over(run_order()), "leaves": F.coalesce(F.lead("act").over(run_order()) != F.col("act"), F.lit(False)).cast("int")})
    own = W.partitionBy("run_id", "act")
    earlier = own.orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumns({"back": (F.coalesce(F.sum("leaves").over(earlier), F.lit(0)) > 0).cast("int"), "own_s": F.sum(F.col("pos") + 1).over(own), "own_c": F.count("*").over(own)})
    e = e.withColumn("new_edge", (F.col("prev").isNotNull() & (F.row_number().over(W.partitionBy("run_id", "act", "prev").orderBy("pos")) == 1)).cast("int"))
    n = F.row_number().over(run_order())
    return e.select("run_id", "pos", "act", *kept, "prev", "own_s", "own_c", (F.sum("back").over(so_far()) / n).alias("return_rate"), ratio(F.sum("new_edge").over(so_far()), n - 1).alias("edge_novelty"))


def walk_features(events: DataFrame) -> DataFrame:
    """run_id, pos, act, return_rate, edge_novelty."""
    return walk_facts(events).select("run_id", "pos", "act", "return_rate", "edge_novelty")


def as_events(bank: DataFrame) -> DataFrame:
    return bank_events(bank).select(F.col("ref_id").alias("run_id"), "pos", "act")


def step_profile(values: DataFrame, col: str) -> DataFrame:
    """step, mu, sd, last: a feature at each step over reference runs."""
    p = values.groupBy(F.col("pos").alias("step")).agg(F.avg(col).alias("mu"), F.greatest(F.coalesce(F.stddev_samp(col), F.lit(0.0)), F.lit(1e-6)).alias("sd"))
    return p.withColumn("last", F.max("step").over(W.partitionBy(F.lit(0))))


def at_step(values: DataFrame, profile: DataFrame) -> DataFrame:
    """Adds mu and sd of each prefix's step; steps past the longest reference use the last one."""
    last = profile.select("last").limit(1)
    placed = values.join(F.broadcast(last)).withColumn("step", F.least("pos", "last")).drop("last") if last.take(1) else values.withColumn("step", F.col("pos"))
    # as many rows as the longest reference has steps
    return placed.join(F.broadcast(profile.drop("last")), "step", "left").drop("step")


def _left_out(features: DataFrame, col: str) -> DataFrame:
    """step_profile for each reference without its own values: run_id, pos, mu, sd."""
    lengths = features.groupBy("run_id").agg(F.max("pos").alias("end"))
    top = lengths.agg(F.max("end").alias("most"), F.sort_array(F.collect_list("end"), asc=False).alias("ends"))  # one row, as many ends as references
    # the longest of the others
    last = lengths.join(F.broadcast(top)).select(F.col("run_id").alias("_r"), F.when(F.col("end") < F.col("most"), F.col("most")).otherwise(F.coalesce(F.try_element_at("ends", F.lit(2)), F.lit(-1))).alias("last"))
    sums = features.groupBy(F.col("pos").alias("step")).agg(F.count(col).alias("c"), F.sum(col).alias("s"), F.sum(F.col(col) * F.col(col)).alias("ss"))
    at = features.join(F.broadcast(last), F.col("run_id") == F.col("_r")).select("run_id", "pos", F.least("pos", "last").alias("step"))
    own = features.select("run_id", F.col("pos").alias("step"), F.col(col).alias("v"))
    met = at.join(F.broadcast(sums), "step", "left").join(own, ["run_id", "step"], "left")
    n, s, ss = F.col("c") - 1, F.col("s") - F.col("v"), F.col("ss") - F.col("v") * F.col("v")
    sd = F.sqrt(F.greatest(F.lit(0.0), (ss - s * s / n) / F.greatest(F.lit(1), n - 1)))
    return met.select("run_id", "pos", F.when(n > 0, s / n).alias("mu"), F.when(n > 0, F.greatest(sd, F.lit(1e-6))).alias("sd"))


def profile_scores(events: DataFrame, refs: DataFrame, squash: float = 1.0, leave_out: bool = False) -> DataFrame:
    """run_id, pos, cycle_resid, cycle_absz, edge_absz against reference runs (as events).

    With `leave_out`, `events` are the references, each held against the others.
    """
    out = walk_features(events)
    theirs = walk_features(refs)
    for col, name in (("return_rate", "r"), ("edge_novelty", "e")):
        out = out.join(_left_out(theirs, col), ["run_id", "pos"], "left") if leave_out else at_step(out, step_profile(theirs, col))
        out = out.withColumns({f"mu_{name}": F.coalesce("mu", F.lit(0.0)), f"sd_{name}": F.coalesce("sd", F.lit(1.0))}).drop("mu", "sd")
    z = lambda col, name: F.abs(F.col(col) - F.col(f"mu_{name}")) / F.col(f"sd_{name}") / squash - 1
    return out.select("run_id", "pos", sigmoid((F.col("return_rate") - F.col("mu_r")) / squash).alias("cycle_resid"), sigmoid(z("return_rate", "r")).alias("cycle_absz"), sigmoid(z("edge_novelty", "e")).alias("edge_absz"))


def graph_progress(events: DataFrame, bank: DataFrame, scale: float = 5.0, leave_out: bool = False) -> DataFrame:
    """Steps taken, less the step at which references are at this label."""
    sums = bank_events(bank).groupBy("act").agg(F.sum(F.col("pos") + 1).alias("s"), F.count("*").alias("c"))
    met = events.select("run_id", "pos", "act").join(sums, "act", "left")
    if leave_out:
        own = W.partitionBy("run_id", "act")
        met = met.withColumns({"_s": F.col("s") - F.sum(F.col("pos") + 1).over(own), "_c": F.col("c") - F.count("*").over(own)}).select("run_id", "pos", F.col("_s").alias("s"), F.col("_c").alias("c"))
    return met.select("run_id", "pos", F.when(F.col("c").isNull() | (F.col("c") == 0), 0.5).otherwise(sigmoid((F.col("pos") + 1 - F.col("s") / F.col("c")) / scale)).alias("score"))


def df_legality(events: DataFrame, bank: DataFrame, leave_out: bool = False) -> DataFrame:
    """Share of transitions that no reference (with `leave_out`: no other one) makes."""
    before = F.lag("act").over(W.partitionBy("ref_id").orderBy("pos"))
    edges = bank_events(bank).withColumn("a", before).filter("a IS NOT NULL")
    known = edges.groupBy("a", F.col("act").alias("b")).agg(F.count_distinct("ref_id").alias("refs"))
    e = events.select("run_id", "pos", F.lag("act").over(run_order()).alias("a"), F.col("act").alias("b")).join(known, ["a", "b"], "left")
    illegal = (F.col("a").isNotNull() & (F.coalesce("refs", F.lit(0)) <= (1 if leave_out else 0))).cast("int")
    return e.select("run_id", "pos", ratio(F.sum(illegal).over(so_far()), F.row_number().over(run_order()) - 1).alias("score"))


def dfg_fitness(traces: DataFrame, bank: DataFrame) -> DataFrame:
    """Missing tokens of a replay on the bank's directly-follows graph, per event so far.

    Of several marked predecessors the smallest label gives its token. The
    marking depends on all that came before, so runs are replayed in Arrow
    batches, in time linear in their length.
    """
    before = F.coalesce(F.lag("act").over(W.partitionBy("ref_id").orderBy("pos")), F.lit(START))
    edges = bank_events(bounded(bank)).withColumn("a", before).select("act", "a").distinct()
    graph: dict[str, list[str]] = {}
    for r in edges.orderBy("act", "a").collect():  # no more edges than the bank has events
        graph.setdefault(r.act, []).append(r.a)
    shared = traces.sparkSession.sparkContext.broadcast(graph)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = shared.value
        for b in batches:
            size = b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            missing = []
            for labels in b.column(1).to_pylist():
                marked, lacking = {START: 1}, 0
                for x in labels or ():
                    source = next((s for s in graph.get(x, ()) if marked.get(s, 0) > 0), None)
                    if source is None:
                        lacking += 1
                    else:
                        marked[source] -= 1
                    marked[x] = marked.get(x, 0) + 1
                    missing.append(lacking)
            pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(size)), size)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(pos.astype(np.int32)), pa.array(np.array(missing, np.float64) / (pos + 1))], names=["run_id", "pos", "score"])

    return traces.select("run_id", "labels").mapInArrow(replay, "run_id string, pos int, score double")


def step_surprisal(events: DataFrame, bank: DataFrame, refs: DataFrame, alpha: float = 0.5, squash: float = 2.0) -> DataFrame:
    """Cumulative bigram surprisal, z-scored at each step against reference runs (as events)."""
    total = lambda e: surprisal(e, bank, 1, alpha).select("run_id", "pos", F.sum("nll").over(so_far()).alias("total"))
    met = at_step(total(events), step_profile(total(refs), "total"))
    z = (F.col("total") - F.coalesce("mu", "total")) / F.coalesce("sd", F.lit(1.0)) / squash
    return met.select("run_id", "pos", sigmoid(z).alias("score"))
