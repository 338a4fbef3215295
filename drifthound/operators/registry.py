"""Which tools read, write, end a run or belong to the user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tools that change state, in record lists; all others read.
LIST_WRITE_TOOLS = (
    "book_reservation", "cancel_pending_order", "cancel_reservation", "exchange_delivered_order_items", "modify_pending_order_address",
    "modify_pending_order_items", "modify_pending_order_payment", "modify_user_address", "return_delivered_order_items", "send_certificate",
    "transfer_to_human_agents", "update_reservation_baggages", "update_reservation_flights", "update_reservation_passengers",
)
TERMINATE_TOOLS = ("transfer_to_human_agents",)
_SCHEMA = "domains map<string,map<string,struct<side:string,type:string>>>"


def read_registry(spark: SparkSession, path: str, domain: str | None = None) -> DataFrame:
    """domain, tool, side, type of a registry file; an unknown domain is an error."""
    r = spark.read.schema(_SCHEMA).json(path, multiLine=True).select(F.explode("domains").alias("domain", "tools")).select("domain", F.explode("tools").alias("tool", "t")).select("domain", "tool", "t.side", "t.type")
    if domain is None:
        return r
    one = r.filter(F.col("domain") == domain)
    if not one.take(1):
        raise ValueError(f"unknown domain {domain!r}")
    return one


def registry_of(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "domain string, tool string, side string, type string")


def list_rw(tool: Column) -> Column:
    """read or write in record lists."""
    return F.when(tool.isin(*LIST_WRITE_TOOLS), "write").otherwise("read")


def by_tool(registry: DataFrame, with_domain: bool) -> DataFrame:
    """The registry, if it has one row for each tool (with domains, for each tool of a domain)."""
    keys = ["domain", "tool"] if with_domain else ["tool"]
    if twice := registry.groupBy(*keys).count().filter("count > 1").limit(20).collect():
        raise ValueError(f"the registry has several rows for {sorted(r.tool for r in twice)}" + ("" if with_domain else "; give calls a column domain, or choose one domain"))
    return registry


def with_rw(calls: DataFrame, registry: DataFrame | None = None, tool: str = "act") -> DataFrame:
    """Adds rw: by the registry read, write or unknown (a generic tool reads).

    Calls with a column domain are looked up in their own domain.
    """
    if registry is None:
        return calls.withColumn("rw", list_rw(F.col(tool)))
    own = "domain" in calls.columns
    kinds = by_tool(registry, own).select(F.col("domain").alias("_domain"), F.col("tool").alias("_tool"), F.when(F.col("type") == "WRITE", "write").otherwise("read").alias("_rw"))
    same = F.col(tool) == F.col("_tool")
    # a registry has some dozens of tools
    met = calls.join(F.broadcast(kinds), same & (F.col("domain") == F.col("_domain")) if own else same, "left")
    return met.withColumn("rw", F.coalesce("_rw", F.lit("unknown"))).drop("_domain", "_tool", "_rw")


def tool_coverage(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """Per tool: calls, ok, err, known; `calls` has tool and error (null: no result)."""
    c = calls.groupBy("tool").agg(F.count("*").alias("calls"), F.count(F.when(~F.col("error"), 1)).alias("ok"), F.count(F.when(F.col("error"), 1)).alias("err"))
    known = registry.select("tool").distinct().withColumn("known", F.lit(True))
    return c.join(F.broadcast(known), "tool", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def audit(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """The coverage of tools; a tool outside the registry that ever succeeds is an error."""
    covered = tool_coverage(calls, registry)
    if odd := covered.filter(~F.col("known") & (F.col("ok") > 0)).select("tool").orderBy("tool").limit(20).collect():
        raise ValueError(f"tools outside the registry that succeed: {[r.tool for r in odd]}")
    return covered.withColumn("hallucinated", ~F.col("known"))
