"""Workflow graphs as edge tables: chains, ends, dependencies, resolved labels, topology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chain(steps: DataFrame, flow: str, order: str) -> DataFrame:
    """flow, order, next, previous of steps that follow one another."""
    by = Window.partitionBy(flow).orderBy(order)
    return steps.select(flow, order, F.lead(order).over(by).alias("next"), F.lag(order).over(by).alias("previous"))


def ends(steps: DataFrame, edges: DataFrame, flow: str) -> DataFrame:
    """Steps (flow, step) without an outgoing edge (flow, src, dst)."""
    return steps.join(edges.select(flow, F.col("src").alias("step")).distinct(), [flow, "step"], "left_anti")


def sequential_dependencies(tasks: DataFrame, flow: str, order: str, free: str) -> DataFrame:
    """flow, step, predecessor: each task that names no context of its own depends on the one before it."""
    by = Window.partitionBy(flow).orderBy(order)
    rows = tasks.withColumn("predecessor", F.lag(order).over(by)).where(F.col("predecessor").isNotNull() & ~F.col(free))
    return rows.select(flow, F.col(order).alias("step"), "predecessor")


def resolved_edges(steps: DataFrame) -> DataFrame:
    """flow, src, dst of steps (flow, name, dependencies, return_values, outgoing).

    A label means the step of that name, or else the steps that listen for it. Outgoing names and
    returned labels lead to what they mean; a dependency leads here from its source unless the source
    returns labels."""
    names = steps.select("flow", F.col("name").alias("label"), F.col("name").alias("dst"))
    listens = steps.select("flow", F.explode("dependencies").alias("label"), F.col("name").alias("dst")).join(names.select("flow", "label"), ["flow", "label"], "left_anti")
    meant = names.unionByName(listens).distinct()
    said = steps.select("flow", F.col("name").alias("src"), F.explode(F.array_union(F.coalesce("outgoing", F.array().cast("array<string>")), F.coalesce("return_values", F.array().cast("array<string>")))).alias("label"))
    forward = said.join(meant, ["flow", "label"]).select("flow", "src", "dst")
    plain = steps.where(F.coalesce(F.size("return_values"), F.lit(0)) <= 0).select("flow", F.col("name").alias("src"))
    back = steps.select("flow", F.explode("dependencies").alias("src"), F.col("name").alias("dst")).join(plain, ["flow", "src"], "left_semi")
    return forward.unionByName(back.select("flow", "src", "dst")).distinct()


def end_kinds(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """steps with `ends`: no outgoing edge, and neither conditional nor start."""
    out = edges.select("flow", F.col("src").alias("name")).distinct().withColumn("_leads", F.lit(True))
    return steps.join(out, ["flow", "name"], "left").withColumn("ends", F.col("_leads").isNull() & ~F.col("step_type").isin("conditional", "router", "start")).drop("_leads")


def topology(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """flow, pattern by ordered rules.

    steps: flow, name, kind (agent, tool, other), dynamic (a router decided at run time). edges: flow,
    src, dst (a step's name or END), conditional."""
    agents = steps.groupBy("flow").agg(F.count_if(F.col("kind") == "agent").alias("agents"), F.max(F.coalesce("dynamic", F.lit(False))).alias("dynamic"))
    kinds = steps.select("flow", F.col("name").alias("dst"), "kind")
    fans = edges.where("conditional").join(kinds, ["flow", "dst"], "left").groupBy("flow", "src").agg(F.count_if(F.col("kind") == "agent").alias("a"), F.count_if(F.col("kind") == "tool").alias("t"), F.count_if(F.col("dst") == "END").alias("e"), F.count_if(F.col("src") == F.col("dst")).alias("self"))
    routed = fans.groupBy("flow").agg(F.max("a").alias("fan"), F.max((F.col("t") > 0) & (F.col("e") + F.col("a") > 0)).alias("loop"), F.max(F.col("self") > 0).alias("own"))
    rule = F.when(F.col("dynamic") & (F.col("agents") >= 2), "Hierarchical").when(F.col("fan").isNull(), "Sequential").when(F.col("fan") >= 2, "Hierarchical").when(F.col("loop"), "ReActLoop").otherwise("Custom")
    return agents.join(routed, "flow", "left").select("flow", rule.alias("pattern"))
