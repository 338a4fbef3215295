"""Running scores that need little or no bank; all share one sort of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import run_order, so_far, ratio

COUNTED = ("step_count", "error_rate", "error_count", "repeat_rate", "empty_rate", "policy_count")
START, UNKNOWN = "<s>", "<unk>"


def _so_far(flag: Column) -> Column:
    return F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(so_far())


def counted_scores(events: DataFrame, step_cap: int = 60, error_cap: int = 5, policy_cap: int = 2) -> DataFrame:
    """run_id, pos and the six counted scores."""
    tool = F.col("kind") == "tool"
    seen = F.row_number().over(W.partitionBy("run_id", "kind", "args_hash").orderBy("pos")) > 1
    e = events.withColumn("again", tool & F.col("args_hash").isNotNull() & seen)
    calls = _so_far(tool)
    capped = lambda x, cap: F.least(F.lit(1.0), x / F.lit(float(cap)))
    return e.select(
        "run_id", "pos", capped(F.row_number().over(run_order()), step_cap).alias("step_count"),
        ratio(_so_far(tool & F.col("error")), calls).alias("error_rate"), capped(_so_far(F.col("error")), error_cap).alias("error_count"),
        ratio(_so_far(F.col("again")), calls).alias("repeat_rate"), ratio(_so_far(tool & (F.col("status") == "empty")), calls).alias("empty_rate"),
        capped(_so_far(F.col("status").isin("policy", "invalid")), policy_cap).alias("policy_count"),
    )


def bank_events(bank: DataFrame) -> DataFrame:
    """The bank's labels as rows: ref_id, bank_idx, pos, act."""
    return bank.select("ref_id", "bank_idx", F.posexplode("labels").alias("pos", "act"))


def surprisal(events: DataFrame, bank: DataFrame, order: int = 1, alpha: float = 0.5) -> DataFrame:
    """run_id, pos, nll: negative log-probability of each event under a smoothed model of the bank."""
    if order not in (0, 1):
        raise ValueError("the order is 0 or 1")
    refs = bank_events(bank)
    context = lambda by: F.coalesce(F.lag("act").over(by), F.lit(START)) if order else F.lit("")
    seen = refs.withColumn("ctx", context(W.partitionBy("ref_id").orderBy("pos")))
    counts = seen.groupBy("ctx", "act").agg(F.count("*").alias("c"))
    sums = counts.groupBy("ctx").agg(F.sum("c").alias("t"))
    size = refs.agg((F.count_distinct("act") + 1).alias("v"))
    e = events.select("run_id", "pos", "act").withColumn("ctx", context(run_order()))
    # at most the bank's alphabet squared: Spark broadcasts it while it is small
    met = e.join(counts, ["ctx", "act"], "left").join(sums, "ctx", "left").crossJoin(F.broadcast(size))
    p = F.when(F.col("t").isNull(), 1 / F.col("v")).otherwise((F.coalesce("c", F.lit(0)) + alpha) / (F.col("t") + alpha * F.col("v")))
    return met.select("run_id", "pos", "act", (-F.log(p)).alias("nll"))


def ngram_score(events: DataFrame, bank: DataFrame, order: int = 1, alpha: float = 0.5, scale: float = 6.0) -> DataFrame:
    s = surprisal(events, bank, order, alpha)
    return s.select("run_id", "pos", F.least(F.lit(1.0), F.avg("nll").over(so_far()) / scale).alias("score"))


def random_score(events: DataFrame, seed: int = 0) -> DataFrame:
    """A number of [0, 1) that is constant in a run: the first 13 hex digits of an md5."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "run_id").cast("binary")), 1, 13)
    return events.select("run_id", "pos", (F.conv(digits, 16, 10).cast("long") / F.lit(float(16**13))).alias("score"))
