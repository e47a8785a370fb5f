"""Results kept by what they were computed from: tables of Parquet files under a folder, keyed by a hash of the content.

The same class keeps value sets, partitions of options, translations of chunks
and packages; a changed input has another key, so nothing stale is read.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_key(*columns: str | Column) -> Column:
    """SHA-256 of the columns, lengths included, null apart from every value."""
    shown = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\x00")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *[F.concat(F.length(x).cast("string"), F.lit(":"), x) for x in shown]), 256)


class Cache:
    """A folder of Parquet files with the columns key and those of the result, in 256 partitions by the key's first two digits.

    Rows are written aside and moved in file by file when all are there, so a
    reader sees a file whole or not at all.  Writers don't wait for each other:
    if two keep the same key, the one that wrote last counts, and readers see
    one row for a key.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, f"key string, {schema}"
        self.names = spark.createDataFrame([], self.schema).columns

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """What is kept, one row a key; with ``keys`` (key) theirs alone, from their partitions alone.  Nothing yet is an empty table."""
        path = self._path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        kept = self.spark.read.schema(f"{self.schema}, version bigint, writer string, part string").option("basePath", self.path).parquet(self.path)
        if keys is not None:
            parts = [r[0] for r in keys.select(F.substring("key", 1, 2)).distinct().collect()]  # 256 at most
            kept = kept.where(F.col("part").isin(parts)).join(keys.select("key").distinct(), "key", "left_semi")
        rest = [c for c in self.names if c != "key"]
        last = kept.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("version", "writer")).alias("_row"))
        return last.select("key", "_row.*").select(*self.names)

    def write(self, rows: DataFrame) -> None:
        """Keeps rows, one for each key; what is kept under a key is replaced."""
        writer = uuid.uuid4().hex
        fs = self._path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        aside = f"{self.path}/_aside/{writer}"
        new = rows.select(*self.names).dropDuplicates(["key"]).withColumns({"version": F.lit(time.time_ns()), "writer": F.lit(writer), "part": F.substring("key", 1, 2)})
        new.repartition("part").write.partitionBy("part").parquet(aside)
        for folder in fs.listStatus(self._path(aside)):
            if not folder.isDirectory():
                continue
            name = folder.getPath().getName()
            fs.mkdirs(self._path(f"{self.path}/{name}"))
            for f in fs.listStatus(folder.getPath()):
                if f.getPath().getName().endswith(".parquet"):
                    fs.rename(f.getPath(), self._path(f"{self.path}/{name}/{writer}-{f.getPath().getName()}"))
        fs.delete(self._path(aside), True)

    def through(self, requests: DataFrame, inputs: Sequence[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``requests`` with the results: those kept by the content of ``inputs``, the others computed by ``compute`` (rows with key in, key and result out) and kept."""
        keyed = requests.withColumn("key", content_key(*inputs))
        self.write(compute(keyed.join(self.read(keyed).select("key"), "key", "left_anti").dropDuplicates(["key"])))
        return keyed.join(self.read(keyed), "key", "left")


def latest_kept(kept: DataFrame, asked: DataFrame, by: Sequence[str], order: str, value: str, out: str = "value") -> DataFrame:
    """``asked`` with the value kept for the latest place at or before its own."""
    from quern.operators import asof

    later = asked.withColumn("_at", F.col(order)).withColumn(order, F.col(order) + F.lit(1))  # at its own place counts
    return asof.last_definition(kept, later, by, [order], value, out=out).withColumn(order, F.col("_at")).drop("_at")
