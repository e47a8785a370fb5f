"""Scripts as a stream (an extension: the analyses themselves know no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import tables
from quern.sources.files import ScriptFiles


def parsed_stream(spark: SparkSession, path: str) -> DataFrame:
    """New scripts of a folder, parsed as they come; each script stands alone, so nothing is kept between batches."""
    rows = spark.readStream.option("wholetext", True).text(path)
    return tables.parse_scripts(rows.select(F.col("_metadata.file_path").alias("script_id"), F.col("value").alias("text")))


def script_stream(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, bytes, error) of new and changed files, many small ones in few tasks."""
    spark.dataSource.register(ScriptFiles)
    return spark.readStream.format("scripts").load(path)


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type with a watermark; ``ts`` becomes a timestamp with time zone first."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").count().select("w.start", "event_type", "count")
