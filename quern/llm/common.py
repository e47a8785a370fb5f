"""What several operators share: the shared folder, cut lineage, distributed ranks and components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of every word contract here, as a regular expression class for what is not white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a folder of our own if the master is local, so that
    driver and executors are one process; on a cluster an error, for no folder
    of one machine can be read by the others.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + os.path.join(tempfile.gettempdir(), "quern-shared")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def small_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of 4 MB at most, where the session has Spark's own bound: a worker holds one batch of texts and what it makes of it, and the executor buffers on both ways."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).lower() in ("67108864b", "67108864", "64m", "64mb"):
        spark.conf.set(name, str(4 << 20))
    return spark


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each made longer until no column of ``df`` has it, in either case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages restart from there, on any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def discard(tables: list[DataFrame]) -> None:
    """Deletes what ``cut`` has written for tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._quern_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession, rows: int, rows_each: int = 500_000) -> int:
    """Partitions for ``rows`` rows: the session's number, or more where a task would get over ``rows_each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def hash_bucket(key: Column, buckets: int) -> Column:
    """Which of ``buckets`` equal ranges of hash values a hexadecimal hash lies in, in the order of the hashes."""
    return F.floor(F.conv(F.substring(key, 1, 7), 16, 10).cast("bigint") * buckets / F.lit(1 << 28)).cast("int")


def prefix_sums(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group up to and including each row.

    ``bucket`` is an integer column whose order agrees with ``order``.  No task
    holds more than one bucket of one group: sums inside a bucket come from a
    window, sums of earlier buckets from a table with a row for each group and
    bucket, which is joined back on the same keys (no second shuffle of rows).
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_sum").over(_over(earlier, group, bucket)), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_local", F.sum(value).over(local))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return rows.join(sums, same, "left").withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before", *[f"_k{i}" for i in range(len(keys))])


def _over(window, group: Sequence[str], bucket: str):
    """Without a group the table of buckets is one list, as long as there are buckets."""
    return window if group else Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)


#: So many edges, 16 bytes each, are one task's work: what is left of a larger table once rounds have shrunk it, or the whole of a smaller one.
SMALL_EDGES = 1 << 18


def components(edges: DataFrame, label: str, small: int = SMALL_EDGES) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root the least node of the component.

    A round names each node after its least neighbour and rewrites the edges
    with the new names: an aggregate and two joins on the edges that are left,
    so a node of any degree is pre-aggregated, never gathered.  Once ``small``
    edges or fewer are left, one task of bounded size ends the work; names are
    then handed back round by round.  The result doesn't depend on ``small``.
    """
    edges = cut(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), f"{label}-edges")
    steps, written = [], [edges]
    while edges.count() > small:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
        steps.append(cut(step, f"{label}-names"))
        edges = (
            edges.join(steps[-1].select(F.col("node").alias("a"), F.col("root").alias("a2")), "a")
            .join(steps[-1].select(F.col("node").alias("b"), F.col("root").alias("b2")), "b")
            .where("a2 <> b2")
            .selectExpr("greatest(a2, b2) AS a", "least(a2, b2) AS b")
            .distinct()
        )
        edges = cut(edges, f"{label}-edges")
        written += [steps[-1], edges]
    names = edges.coalesce(1).mapInArrow(_united, "node bigint, root bigint")
    for step in reversed(steps):
        names = cut(names, f"{label}-names")
        written.append(names)
        follow = names.select(F.col("node").alias("root"), F.col("root").alias("next"))
        names = step.join(follow, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    roots = cut(names, f"{label}-roots")
    discard(written)
    return roots


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all nodes of a bounded table of edges: the larger root goes under the smaller until none differ."""
    ends = [np.concatenate([np.asarray(b.column(0)), np.asarray(b.column(1))]).reshape(2, -1) for b in batches if b.num_rows]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    x, y = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while (apart := root[x] != root[y]).any():
        a, b = root[x[apart]], root[y[apart]]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[root], pa.int64())], ["node", "root"])
