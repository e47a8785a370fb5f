"""Trees and graphs: nested sets, descendants, post-order, removal with what depends on it, closures."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.containment import contained
from quern.operators.sequences import number_rows


def shared_place(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; where that is unset, one of this machine if the master is local, an error on a cluster."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/quern-{spark.sparkContext.applicationId}"


#: Rows of a shuffle for which there is a partition at least.
ROWS = 1 << 18


def small_partitions(spark: SparkSession, rows: int = 0) -> SparkSession:
    """Partitions of 8 MB after a shuffle, where the session has Spark's own 64 MB: rows of scripts are narrow and compress well, and a task holds twenty times as much of them when it sorts.

    ``rows``: how many there are.  Shuffles then begin with a partition for
    every ``ROWS`` of them at least, however few the session names, so that
    tasks don't grow with the input; adaptive execution merges small ones.
    Where the session has it merge none, it is the session's own number of
    partitions that is raised: Spark then heeds no other.
    """
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark.conf.get(name).lower() in ("67108864b", "67108864", "64m", "64mb"):
        spark.conf.set(name, str(8 << 20))
    merges = all(spark.conf.get(f"spark.sql.adaptive.{c}enabled").lower() == "true" for c in ("", "coalescePartitions."))
    plain, first = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if rows > ROWS * int(merges and spark.conf.get(first, None) or spark.conf.get(plain)):
        spark.conf.set(first if merges else plain, str(-(-rows // ROWS)))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, so that later stages restart from there."""
    spark = df.sparkSession
    path = f"{shared_place(spark)}/closure-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def descendants(nodes: DataFrame, key: str = "script_id", node: str = "node_id", begin: str = "exec_id", end: str = "exit_id") -> DataFrame:
    """(key, ancestor, descendant) for nodes numbered as nested sets: those that begin within (begin, end)."""
    around = nodes.where(F.col(end) > F.col(begin) + 1)
    return contained(around, nodes, [key], begin, end, begin, node, node, names=("ancestor", "descendant"))


def descendants_of_paths(paths_: DataFrame) -> DataFrame:
    """(ancestor, descendant) from the path of each node: as many rows as all depths together, and no join."""
    above = F.slice("path", 1, F.size("path") - 1)
    return paths_.select(F.explode(above).alias("ancestor"), F.col("node").alias("descendant"))


def paths(nodes: DataFrame, node: str, parent: str, most: int = 64) -> DataFrame:
    """(node, path): the nodes from the root to each node, found level by level."""
    level = nodes.where(F.col(parent).isNull()).select(F.col(node).alias("node"), F.array(node).alias("path"))
    out = level
    for _ in range(most):
        level = cut(nodes.join(level.select(F.col("node").alias(parent), F.col("path").alias("_path")), parent).select(F.col(node).alias("node"), F.concat("_path", F.array(node)).alias("path")))
        if level.isEmpty():
            return out
        out = out.union(level)
    raise ValueError(f"trees of over {most} levels")


def post_order(paths_: DataFrame, by: list[str]) -> DataFrame:
    """``place``: children before parents, siblings by node; from sorting paths with an end mark that sorts last.

    A tree is dealt by the nodes below its root.
    """
    key = F.concat(F.transform("path", lambda x: F.struct(F.lit(0).alias("end"), x.alias("x"))), F.array(F.struct(F.lit(1).alias("end"), F.element_at("path", -1).alias("x"))))
    place = F.struct(F.get("_key", 0), F.get("_key", 1))
    return number_rows(paths_.withColumn("_key", key), by, ["_key"], "place", place).drop("_key")


def remove_cascading(nodes: DataFrame, gone: DataFrame, closed: DataFrame, node: str = "node_id") -> DataFrame:
    """``nodes`` without ``gone`` and all that descends from them."""
    below = closed.join(gone.select(F.col(node).alias("ancestor")), "ancestor").select(F.col("descendant").alias(node))
    return nodes.join(gone.select(node).union(below).distinct(), node, "left_anti")


def roll_up(rows: DataFrame, levels: list[str], flag: str) -> DataFrame:
    """bool_or of a flag for each level of a hierarchy: (level, key, flag)."""
    out = None
    for level in levels:
        own = rows.groupBy(F.lit(level).alias("level"), F.col(level).cast("string").alias("key")).agg(F.bool_or(flag).alias(flag))
        out = own if out is None else out.union(own)
    return out


def without_nodes(tables: dict[str, DataFrame], gone: DataFrame, columns: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Each table without the rows that name a removed node (script_id, node_id) in one of its columns."""
    out = {}
    for name, rows in tables.items():
        for c in columns[name]:
            rows = rows.join(gone.select("script_id", F.col("node_id").alias(c)), ["script_id", c], "left_anti").select(*rows.columns)
        out[name] = rows
    return out
