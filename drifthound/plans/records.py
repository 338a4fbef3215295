"""Queries over message logs and run records, both made from the session log."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import projection, registry
from ..sources import runs
from ..sources.logs import session_log
from .oracles import SESSION, sql


#: Calls of a message in either record shape.
CALLS = {"list": "array<struct<id:string,function:struct<name:string,arguments:string>>>", "object": "array<struct<id:string,name:string,arguments:string,requestor:string>>"}


def _messages_of(family: str, text: bool = True) -> Column:
    """The messages that an event would have come from, in order; their calls as JSON or as they are."""
    call_id = F.concat(F.lit("c"), "pos")
    args = F.to_json(F.struct(F.col("args_hash").alias("h")))
    body = F.when(F.col("act") == "error", F.when(F.col("status") == "policy", "Error: this cannot be done").otherwise("Error: user not found")).when(F.col("status") == "empty", "[]").otherwise("done")
    if family == "list":
        calls = F.array(F.struct(call_id.alias("id"), F.struct(F.col("act").alias("name"), args.alias("arguments")).alias("function")))
    else:
        calls = F.array(F.struct(call_id.alias("id"), F.col("act").alias("name"), args.alias("arguments"), F.when(F.col("act") == "view", "user").otherwise("assistant").alias("requestor")))
    calls = F.to_json(calls) if text else calls
    message = lambda order, role, content=F.lit(None), tool_calls=F.lit(None), of=F.lit(None), error=F.lit(None): F.struct(
        order.alias("idx"), role.alias("role"), content.cast("string").alias("content"), tool_calls.cast("string" if text else CALLS[family]).alias("tool_calls"), (of if family == "list" else F.lit(None)).cast("string").alias("tool_call_id"),
        (of if family == "object" else F.lit(None)).cast("string").alias("id"), error.cast("boolean").alias("error"))
    actor = F.when(F.col("act") == "view", "user").otherwise("assistant") if family == "object" else F.lit("assistant")
    at = F.col("pos") * 4
    rows = F.array(
        F.when(F.col("pos") == 0, message(at, F.lit("system"), F.lit("policy"))), F.when(F.col("act") == "signup", message(at + 1, F.lit("assistant"), F.lit("welcome"))),
        message(at + 2, actor, tool_calls=calls), message(at + 3, F.lit("tool"), body, of=call_id, error=(F.col("act") == "error") if family == "object" else F.lit(None)),
        F.when(F.col("pos") == F.col("n") - 1, message(at + 4, F.lit("user"), F.lit("bye ###STOP###"))))
    return F.filter(rows, lambda m: m.isNotNull())


def session_messages(spark: SparkSession, sf_dir: str, family: str = "list") -> DataFrame:
    """Message logs that the session log would have come from, in either record shape.

    Each event is a call and its result; a sign-up is announced first; a user
    ends the run. In the object shape, views are the user's own calls.
    """
    return session_log(spark, sf_dir).select("run_id", F.inline(_messages_of(family)))


def session_registry(spark: SparkSession) -> DataFrame:
    return registry.registry_of(spark, [("shop", "purchase", "agent", "WRITE"), ("shop", "signup", "agent", "WRITE"), ("shop", "click", "agent", "READ"), ("shop", "view", "user", "GENERIC")])


def projected(granularity: str, family: str, matching: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = session_messages(spark, sf_dir, family)
    events = projection.project(messages, family, session_registry(spark) if family == "object" else None, matching)
    return projection.relabel(events, granularity).select("run_id", "pos", "act")


def tool_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = projection.project(session_messages(spark, sf_dir, "object"), "object", session_registry(spark), "id")
    return registry.audit(events.filter(F.col("kind").isin("tool", "user_tool")).select(F.col("act").alias("tool"), "error"), session_registry(spark))


# ---- record files: both shapes, written from the session log and read back
def record_files(spark: SparkSession, sf_dir: str, family: str, per_file: int = 256) -> str:
    """The folder of record files that hold each run and a twin of it without messages, some `per_file` runs a file."""
    fields = ("role", "content", "tool_calls", "tool_call_id", "id", "error")
    e = session_log(spark, sf_dir)
    said = F.transform(_messages_of(family, text=False), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    # messages follow the order of their events
    packed = e.groupBy("run_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("said")))), lambda x: x["said"])).alias("messages"), F.first("task_id").alias("task_id"), F.first("success").alias("success"))
    ends = packed.select("task_id", F.split_part("run_id", F.lit(":"), F.lit(2)).cast("int").alias("trial"), F.col("success").cast("double").alias("reward"), "messages")
    twins = F.array(F.struct(F.col("trial").alias("trial"), F.col("messages").alias("messages")), F.struct((F.col("trial") + 100_000).alias("trial"), F.slice("messages", 1, 0).alias("messages")))
    each = ends.select("task_id", "reward", F.inline(twins))
    if family == "list":
        task = F.struct(F.lit("buy").alias("instruction"), F.col("task_id").alias("user_id"), F.array(F.lit("a"), F.lit("b")).alias("actions"))
        record = F.struct("task_id", "trial", "reward", F.col("messages").alias("traj"), F.struct(task.alias("task")).alias("info"))
    else:
        record = F.struct("task_id", "trial", "messages", F.struct("reward", F.lit("DB").alias("reward_basis")).alias("reward_info"), F.lit("user_stop").alias("termination_reason"), F.lit(1.5).alias("duration"))
    files = max(1, e.select("run_id").distinct().count() // per_file)
    by_file = each.select(F.pmod(F.xxhash64("task_id", "trial"), F.lit(files)).alias("part"), record.alias("r")).groupBy("part").agg(F.collect_list("r").alias("rs"))
    if family == "list":
        text = F.to_json("rs")
    else:
        tasks = F.transform(F.array_distinct(F.transform("rs", lambda r: r["task_id"])), lambda t: F.struct(t.alias("id"), F.struct(F.struct(F.lit("buy").alias("task_instructions")).alias("instructions")).alias("user_scenario")))
        text = F.to_json(F.struct(F.col("rs").alias("simulations"), tasks.alias("tasks")))
    folder = runs.shared_folder(spark, f"records-{family}")
    by_file.select("part", text.alias("value")).write.partitionBy("part").text(folder)
    return folder


READERS = {"list": runs.read_run_list, "object": runs.read_simulations}


def record_runs(family: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of record files, as the reader of their shape gives them."""
    r = READERS[family](spark, record_files(spark, sf_dir, family), "shop", "m")
    own = {"list": ("user_id", "n_gt_actions"), "object": ("termination_reason", "reward_basis")}[family]
    return r.select("run_id", "task_id", "trial", "reward", "domain", "model", "instruction", *[F.col("meta")[k].alias(k) for k in own], F.size("messages").alias("messages"))


def record_traces(family: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record files to traces, written as JSON lines and read back as events; runs without messages go."""
    r = runs.materialised(READERS[family](spark, record_files(spark, sf_dir, family), "shop", "m"), "runs")  # read from JSON once
    events = projection.project(projection.explode_messages_of(r), family, session_registry(spark) if family == "object" else None, "id")
    place = runs.shared_folder(spark, "traces")
    runs.write_traces(projection.build_traces(r, events), place)
    runs.discard(r)
    return runs.trace_events(runs.read_traces(spark, place)).withColumn("error", F.coalesce("error", F.lit(False)))


def record_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, messages and successes of every data set that the catalogue names."""
    listed = runs.catalogue(spark, [(f"shop-{f}", f, record_files(spark, sf_dir, f), "shop", m) for f, m in (("list", "m1"), ("object", "m2"))])
    out = None
    for row in listed.collect():  # one row a data set
        r = READERS[row.family](spark, row.path, row.domain, row.model)
        part = r.groupBy(F.lit(row.source).alias("source"), "domain", "model").agg(F.count("*").alias("runs"), F.sum(F.size("messages")).alias("messages"), F.sum("reward").cast("int").alias("successes"))
        out = part if out is None else out.unionByName(part)
    return out


_TWINS = "two AS (SELECT *, unnest([0, 100000]) AS more, split_part(run_id, ':', 2) AS sid FROM tr)"


def record_runs_sql(family: str) -> str:
    own = {"list": "task_id AS user_id, '2' AS n_gt_actions", "object": "'user_stop' AS termination_reason, 'DB' AS reward_basis"}[family]
    return sql(f"""SELECT 'm:shop:t' || task_id || ':r' || (CAST(sid AS INTEGER) + more) AS run_id, task_id, CAST(CAST(sid AS INTEGER) + more AS INTEGER) AS trial, CAST(success AS DOUBLE) AS reward, 'shop' AS domain, 'm' AS model,
      'buy' AS instruction, {own}, CAST(CASE WHEN more > 0 THEN 0 ELSE 2 + 2 * n + len(list_filter(labels, lambda x: x = 'signup')) END AS INTEGER) AS messages FROM two""", SESSION, _TWINS)


def record_traces_sql(family: str) -> str:
    by_user = "act = 'view'" if family == "object" else "false"
    return sql(f"""SELECT 'm:shop:t' || replace(run_id, ':', ':r') AS run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY pos, sub) - 1 AS INTEGER) AS pos, act, task_id, kind, error,
        CASE WHEN kind IN ('respond', 'user') THEN NULL WHEN error AND status = 'policy' THEN 'policy' WHEN error THEN 'notfound' WHEN status = 'empty' THEN 'empty' ELSE 'ok' END AS status,
        CASE WHEN kind IN ('tool', 'user_tool') THEN substr(sha1(act || '|[{{"key":"h","value":"' || args_hash || '"}}]'), 1, 12) END AS args_hash, CAST(count(*) OVER (PARTITION BY run_id) AS INTEGER) AS n, success FROM (
      SELECT run_id, pos, 1 AS sub, act, task_id, CASE WHEN {by_user} THEN 'user_tool' ELSE 'tool' END AS kind, error, status, args_hash, success FROM ev
      UNION ALL SELECT run_id, pos, 0, 'respond', task_id, 'respond', false, NULL, NULL, success FROM ev WHERE act = 'signup'
      UNION ALL SELECT run_id, n, 2, 'end_conversation', task_id, 'user', false, NULL, NULL, success FROM tr)""", SESSION)


RECORD_CATALOGUE = sql("""SELECT 'shop-' || f AS source, 'shop' AS domain, m AS model, 2 * count(*) AS runs, CAST(sum(2 + 2 * n + len(list_filter(labels, lambda x: x = 'signup'))) AS BIGINT) AS messages, CAST(2 * count(*) FILTER (success) AS INTEGER) AS successes
  FROM tr, (VALUES ('list', 'm1'), ('object', 'm2')) v(f, m) GROUP BY f, m""")


# ---- every status, literals, several open calls, calls without ids
#: Result texts by the first hexadecimal digit of args_hash: text, error flag of the object shape, and the status expected.
LIST_RESULTS = (
    ("done", "ok"), ("[]", "empty"), ("null", "empty"), ("{}", "empty"), ("None", "empty"), ("Error: user not found", "notfound"), ("Error: the order cannot be changed", "policy"), ("error: this is not allowed", "policy"),
    ("Error: not enough seats", "avail"), ("ERROR: payment amount is off", "payment"), ("Error: not enough balance", "payment"), ("Error: it should be whole", "invalid"), ("Error: it should match", "invalid"),
    ("Error: broken", "err"), ("  Error: item not available", "avail"), ("", "ok"),
)
OBJECT_RESULTS = (
    ("done", False, "ok"), ("[]", False, "empty"), ("", False, "empty"), ("Tool x not found.", True, "wrongtool"), ("unknown ID format or type", True, "wrongtool"), ("bad payment method", True, "payment"), ("user not found", True, "notfound"),
    ("the line must be suspended", True, "avail"), ("this is not permitted", True, "policy"), ("it must be positive", True, "invalid"), ("a required positional argument", True, "invalid"), ("broken", True, "err"),
    ("done", None, "ok"), ("Error: you cannot use this", None, "policy"), ("it must be paid", True, "invalid"), ("null", False, "empty"),
)
RENAMED = {"purchase": "return_delivered_order_items", "signup": "transfer_to_human_agents"}
TOOLS = {"shop": {"return_delivered_order_items": ("agent", "WRITE"), "transfer_to_human_agents": ("agent", "GENERIC"), "click": ("agent", "READ"), "view": ("user", "GENERIC")}, "bank": {"click": ("agent", "WRITE")}}


def odd_messages(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """The session log as calls without ids, two to a message, every second message a Python literal; results follow in order."""
    e = session_log(spark, sf_dir)
    digit = F.conv(F.substring("args_hash", 1, 1), 16, 10).cast("int")
    name = F.col("act")
    for old, new in RENAMED.items():
        name = F.when(F.col("act") == old, new).otherwise(name)
    args = F.when(digit == 14, F.lit(None).cast("string")).when(digit == 15, F.col("args_hash")).otherwise(F.concat(F.lit('{"z": "1", "h": "'), "args_hash", F.lit('"}')))
    literal = (F.floor(F.col("pos") / 2) % 2) == 1
    quote = lambda x, q: F.concat(F.lit(q), x, F.lit(q))
    if family == "list":
        said = F.when(literal, F.concat(F.lit("{'id': None, 'function': {'name': "), quote(name, "'"), F.lit(", 'arguments': "), F.coalesce(quote(args, "'"), F.lit("None")), F.lit("}}"))).otherwise(
            F.to_json(F.struct(F.struct(name.alias("name"), args.alias("arguments")).alias("function"))))
    else:
        said = F.concat(F.lit("{'name': "), quote(name, "'"), F.lit(", 'arguments': "), F.when(digit < 14, args).otherwise(F.coalesce(quote(args, "'"), F.lit("None"))), F.lit("}"))
        said = F.when(literal, said).otherwise(F.concat(F.lit('{"name": '), quote(name, '"'), F.lit(', "arguments": '), F.when(digit < 14, args).otherwise(F.coalesce(quote(args, '"'), F.lit("null"))), F.lit("}")))
    table = LIST_RESULTS if family == "list" else OBJECT_RESULTS
    body = F.element_at(F.array(*[F.lit(r[0]) for r in table]), digit + 1)
    flag = F.lit(None).cast("boolean") if family == "list" else F.element_at(F.array(*[F.lit(r[1]).cast("boolean") for r in table]), digit + 1)
    at = (F.floor(F.col("pos") / 2) * 4).cast("int")
    calls = e.select("run_id", at.alias("idx"), "pos", said.alias("said")).groupBy("run_id", "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), ", ").alias("said"))
    none = F.lit(None).cast("string")
    asked = calls.select("run_id", "idx", F.lit("assistant").alias("role"), none.alias("content"), F.concat(F.lit("["), "said", F.lit("]")).alias("tool_calls"), F.lit(None).cast("boolean").alias("error"))
    told = e.select("run_id", (at + 1 + F.col("pos") % 2).alias("idx"), F.lit("tool").alias("role"), body.alias("content"), none.alias("tool_calls"), flag.alias("error"))
    return asked.unionByName(told).withColumns({"tool_call_id": none, "id": none})


def projected_odd(family: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The odd messages as events, with arguments, statuses, kinds of tool and ends; the object shape's registry is read from a file."""
    known = None
    if family == "object":
        place = runs.shared_folder(spark, "registry")
        text = json.dumps({"domains": {d: {t: {"side": s, "type": k} for t, (s, k) in tools.items()} for d, tools in TOOLS.items()}})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(place)
        known = registry.read_registry(spark, place, "shop")
    e = projection.project(odd_messages(spark, sf_dir, family), family, known, "fifo", literals=True)
    return e.select("run_id", "pos", "act", "kind", "args_hash", "error", "status", "obs_len", "rw", "write", "terminal")


def projected_odd_sql(family: str) -> str:
    table = LIST_RESULTS if family == "list" else OBJECT_RESULTS
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"
    pick = lambda i: f"([{', '.join(lit(r[i]) for r in table)}])[digit + 1]"
    error = "digit BETWEEN 5 AND 14" if family == "list" else f"coalesce({pick(1)}, digit = 13)"
    rw = "CASE WHEN act IN ('return_delivered_order_items', 'transfer_to_human_agents') THEN 'write' ELSE 'read' END" if family == "list" else "CASE act WHEN 'return_delivered_order_items' THEN 'write' WHEN 'error' THEN 'unknown' ELSE 'read' END"
    given = """CASE digit WHEN 14 THEN '{}' WHEN 15 THEN '[{"key":"_","value":"' || args_hash || '"}]' ELSE '[{"key":"h","value":"' || args_hash || '"},{"key":"z","value":"1"}]' END"""
    renamed = "CASE act " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RENAMED.items()) + " ELSE act END"
    return sql(f"""SELECT run_id, pos, act, 'tool' AS kind, substr(sha1(act || '|' || {given}), 1, 12) AS args_hash, {error} AS error, {pick(-1)} AS status, CAST(length({pick(0)}) AS INTEGER) AS obs_len, {rw} AS rw, {rw} = 'write' AS write,
      act = 'transfer_to_human_agents' AS terminal FROM (SELECT run_id, pos, {renamed} AS act, args_hash, CAST(('0x' || substr(args_hash, 1, 1)) AS INTEGER) AS digit FROM ev)""", SESSION)
