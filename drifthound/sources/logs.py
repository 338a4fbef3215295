"""Event logs from tables: one row an event, with the attributes that scores use.

Columns: run_id, pos (from 0), act, task_id, kind, error, status, args_hash,
n (events of the run), success.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COLUMNS = ["run_id", "pos", "act", "task_id", "kind", "error", "status", "args_hash", "n", "success"]


def _finished(events: DataFrame, good) -> DataFrame:
    """Number the events of each run and say how it ended; `good` is a test of the last act."""
    run = W.partitionBy("run_id")
    last = F.last("act").over(run.orderBy("_o").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return events.select(
        "*", (F.row_number().over(run.orderBy("_o")) - 1).cast("int").alias("pos"), F.count("*").over(run).cast("int").alias("n"), good(last).alias("success"),
    ).select(*COLUMNS)


def status_of(error: Column) -> Column:
    """Status of an activity by its value."""
    return F.when(error & (F.col("value") < 5), "policy").when(error, "err").when(F.col("value") < 2, "empty").otherwise("ok")


def hash_of() -> Column:
    return F.md5(F.concat_ws("|", "event_type", "props").cast("binary"))


def session_log(spark: SparkSession, sf_dir: str, gap_hours: int = 24) -> DataFrame:
    """The activity of each user, cut at gaps of more than `gap_hours`."""
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.expr("timestampdiff(MICROSECOND, before, ts)")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("before", F.lag("ts").over(by))
    e = e.withColumn("first", F.when(F.col("before").isNull() | (gap > gap_hours * 3_600_000_000), 1).otherwise(0))
    e = e.withColumn("sid", F.sum("first").over(by))
    error = F.col("event_type") == "error"
    rows = e.select(
        F.concat_ws(":", "user_id", "sid").alias("run_id"), F.struct("ts", "event_id").alias("_o"), F.col("event_type").alias("act"), F.col("user_id").cast("string").alias("task_id"),
        F.lit("tool").alias("kind"), error.alias("error"),
        status_of(error).alias("status"), hash_of().alias("args_hash"),
    )
    return _finished(rows, lambda last: last != "error")


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer; a run fails if its last order is in status F."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select(
        F.col("o_custkey").cast("string").alias("run_id"), F.struct("o_orderdate", "o_orderkey").alias("_o"),
        F.concat_ws("-", "o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("act"), F.col("o_custkey").cast("string").alias("task_id"),
        F.lit("tool").alias("kind"), (F.col("o_orderstatus") == "F").alias("error"), F.when(F.col("o_orderstatus") == "F", "err").otherwise("ok").alias("status"),
        F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("args_hash"),
    )
    return _finished(rows, lambda last: F.substring(last, 1, 1) != "F")


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation by role; a run succeeds if the last turn responds."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role <> 'system'")
    act = F.when(F.col("role") == "assistant", "respond").otherwise("user")
    rows = c.select(
        F.col("conv_id").cast("string").alias("run_id"), F.col("turn").alias("_o"), act.alias("act"), F.col("conv_id").cast("string").alias("task_id"),
        act.alias("kind"), F.lit(False).alias("error"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("args_hash"),
    )
    return _finished(rows, lambda last: last == "respond")


def traces_of(events: DataFrame) -> DataFrame:
    """One row a run: labels in order, number of events, success, task."""
    return events.groupBy("run_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "act"))), lambda x: x["act"]).alias("labels"),
        F.count("*").cast("int").alias("n"), F.first("success").alias("success"), F.first("task_id").alias("task_id"),
    )


def alphabet(events: DataFrame) -> DataFrame:
    return events.select("act").distinct().orderBy("act")
