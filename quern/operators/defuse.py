"""Definition-use edges of scripts: guarded as-of lookups over the table of variable events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import asof, macros


def edges(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """(script_id, var, def_node, use_node): the dominant definition of every use.

    A variable that all branches of a node define counts as defined by that
    node once it ends; such a definition reaches uses outside of the node only.
    """
    made = events.where(F.col("event").isin("def", "bound")).select("script_id", "var", F.col("exec_id").alias("at"), "ord", F.col("node_id").alias("def_node"), "guards")
    ends = nodes.select("script_id", "node_id", (F.col("exit_id") - 1).alias("at"), F.col("guards"))
    propagated = macros.all_path_definitions(events, nodes).join(ends, ["script_id", "node_id"]).select("script_id", "var", "at", F.lit(1 << 20).alias("ord"), F.col("node_id").alias("def_node"), "guards")
    uses = events.where("event = 'use'").select("script_id", "var", F.col("exec_id").alias("at"), "ord", F.col("node_id").alias("use_node"), "guards")
    uses = uses.withColumn("_id", F.struct("script_id", "var", "at", "ord", "use_node"))
    found = asof.dominant_definition(made.union(propagated), uses, ["script_id", "var"], ["at", "ord"], "def_node", "guards", "_id", "def_node")
    return found.where("def_node IS NOT NULL").select("script_id", "var", "def_node", "use_node").distinct()


def dependencies(edges_: DataFrame) -> DataFrame:
    """(script_id, def_node, use_node, vars)."""
    return edges_.groupBy("script_id", "def_node", "use_node").agg(F.array_sort(F.collect_set("var")).alias("vars"))
