"""Run records and traces as JSON: readers of both record shapes, the catalogue, sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .elements import json_elements

_MESSAGE = "struct<role:string,content:string,tool_calls:string,tool_call_id:string,id:string,error:boolean>"
LIST_RECORD = f"task_id string, trial int, reward double, traj array<{_MESSAGE}>, info struct<task:struct<instruction:string,user_id:string,actions:array<string>>>"
SIMULATION = f"struct<task_id:string,trial:int,messages:array<{_MESSAGE}>,reward_info:struct<reward:double,reward_basis:string>,termination_reason:string,duration:double,agent_cost:double>"
TASK = "struct<id:string,user_scenario:struct<instructions:struct<task_instructions:string>>>"
EVENT = "struct<act:string,pos:int,ts:double,attr:struct<raw:string,kind:string,args_hash:string,error:boolean,status:string,write:boolean,terminal:boolean,by_user:boolean,obs_len:int,len:int>>"
TRACE = f"run_id string, task_id string, trial int, reward double, domain string, model string, instruction string, meta map<string,string>, events array<{EVENT}>"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share: under spark.checkpoint.dir, in local mode also elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: computed once, and no longer tied to what made it."""
    place = shared_folder(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of materialised tables that nothing will read again."""
    for df in tables:
        if files := df.inputFiles():
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def catalogue(spark: SparkSession, rows: list[tuple[str, str, str, str, str]], chosen: str = "all") -> DataFrame:
    """Data sets (source, family, path, domain, model), all or those of one family."""
    df = spark.createDataFrame(rows, "source string, family string, path string, domain string, model string")
    if chosen == "all":
        return df
    if chosen not in {r[1] for r in rows}:
        raise ValueError(f"unknown family {chosen!r}")
    return df.filter(F.col("family") == chosen)


def read_run_list(spark: SparkSession, path: str, domain: str, model: str) -> DataFrame:
    """Records of a JSON list, of any size: run_id, task_id, trial, reward, domain, model, instruction, meta, messages."""
    r = json_elements(spark, path).select(F.from_json("value", LIST_RECORD).alias("r")).select("r.*")
    return r.select(
        run_id(domain, model).alias("run_id"), "task_id", "trial", F.coalesce("reward", F.lit(0.0)).alias("reward"), F.lit(domain).alias("domain"), F.lit(model).alias("model"),
        F.col("info.task.instruction").alias("instruction"),
        F.create_map(F.lit("user_id"), F.col("info.task.user_id"), F.lit("n_gt_actions"), F.coalesce(F.size("info.task.actions"), F.lit(0)).cast("string")).alias("meta"),
        F.col("traj").alias("messages"),
    )


def read_simulations(spark: SparkSession, path: str, domain: str, model: str) -> DataFrame:
    """Records of a JSON object with `simulations`, in the columns of read_run_list."""
    simulations = json_elements(spark, path, "simulations").select("file", F.from_json("value", SIMULATION).alias("s"))
    tasks = json_elements(spark, path, "tasks").select("file", F.from_json("value", TASK).alias("t")).groupBy("file", F.col("t.id").alias("task_id")).agg(F.first("t.user_scenario.instructions.task_instructions").alias("instruction"))
    s = simulations.select("file", "s.*").join(tasks, ["file", "task_id"], "left")
    return s.select(
        run_id(domain, model).alias("run_id"), "task_id", "trial", F.coalesce("reward_info.reward", F.lit(0.0)).alias("reward"), F.lit(domain).alias("domain"), F.lit(model).alias("model"), "instruction",
        F.create_map(F.lit("termination_reason"), F.col("termination_reason"), F.lit("duration"), F.col("duration").cast("string"), F.lit("agent_cost"), F.col("agent_cost").cast("string"), F.lit("reward_basis"), F.col("reward_info.reward_basis")).alias("meta"),
        "messages",
    )


def run_id(domain: str, model: str):
    return F.concat(F.lit(f"{model}:{domain}:t"), F.coalesce(F.col("task_id"), F.lit("None")), F.lit(":r"), F.coalesce(F.col("trial").cast("string"), F.lit("None")))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces of a JSON-lines file; empty lines are skipped, a missing file is an error."""
    t = spark.read.schema(TRACE).json(path).filter("run_id IS NOT NULL")
    return t.withColumn("success", F.coalesce("reward", F.lit(0.0)) >= 1 - 1e-6)


def write_traces(traces: DataFrame, path: str) -> None:
    traces.select("run_id", "task_id", "trial", "reward", "domain", "model", "instruction", "meta", "events").write.json(path)


def trace_events(traces: DataFrame) -> DataFrame:
    """The events of traces as rows."""
    return traces.select("run_id", "task_id", (F.col("reward") >= 1 - 1e-6).alias("success"), F.size("events").alias("n"), F.explode("events").alias("e")).select(
        "run_id", "e.pos", "e.act", "task_id", "e.attr.kind", "e.attr.error", "e.attr.status", "e.attr.args_hash", "n", "success")


def write_results(results: DataFrame, path: str) -> None:
    results.write.json(path)
